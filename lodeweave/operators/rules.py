"""Rule evaluation of chunks and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import fixed_values as V
from lodeweave.functions.text import explode_lines

CONFIG = {"max_function_lines": 50, "max_complexity": 10, "forbidden_imports": {}, "naming_conventions": {}}


def checked_config(raw: dict | None) -> dict:
    """A rule configuration with defaults for what is missing or wrong."""
    raw = raw if isinstance(raw, dict) else {}
    rules = raw.get("rules") if isinstance(raw.get("rules"), dict) else {}

    def whole(name: str) -> int:
        try:
            return max(1, int(rules.get(name, CONFIG[name])))
        except (TypeError, ValueError):
            return CONFIG[name]

    lists = rules.get("forbidden_imports")
    names = rules.get("naming_conventions")
    weights, given = dict(V.DEBT_WEIGHTS), raw.get("scoring_weights")
    for k in weights:
        try:
            v = float((given if isinstance(given, dict) else {}).get(k, weights[k]))
            weights[k] = v if 0 <= v <= 1 else weights[k]
        except (TypeError, ValueError):
            pass
    return {
        "max_function_lines": whole("max_function_lines"), "max_complexity": whole("max_complexity"),
        "forbidden_imports": {str(k): [str(x) for x in v] for k, v in lists.items() if isinstance(v, list)} if isinstance(lists, dict) else {},
        "naming_conventions": {str(k): str(v) for k, v in names.items()} if isinstance(names, dict) else {}, "scoring_weights": weights,
    }


def chunk_violations(chunks: DataFrame, config: dict | None = None, keep: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """R1 to R3 in one pass over the chunks: ``keep``, rule_name, severity, value; a chunk may break several rules."""
    c = CONFIG | (config or {})
    lines = F.col("end_line") - F.col("start_line") + 1
    score = F.col("complexity_score").cast("int")
    callable_ = F.col("chunk_type").isin("function", "method")
    name = F.col("chunk_name")
    wanted = F.lit(None).cast("string")
    for lang, convention in c["naming_conventions"].items():
        wanted = F.when(F.col("language") == lang, F.lit(V.NAMING.get(convention))).otherwise(wanted)
    fits = F.when(wanted.isNull() | name.isin(V.EXEMPT_NAMES) | name.startswith("__"), F.lit(True))
    for pattern in V.NAMING.values():
        fits = fits.when(wanted == pattern, name.rlike(pattern))
    found = F.array(
        F.when(callable_ & (lines > c["max_function_lines"]), F.struct(F.lit("MAX_FUNCTION_LINES").alias("rule_name"), F.lit("medium").alias("severity"), lines.cast("string").alias("value"))),
        F.when(callable_ & (score > c["max_complexity"]), F.struct(F.lit("MAX_COMPLEXITY").alias("rule_name"), F.when(score > 2 * c["max_complexity"], "high").otherwise("medium").alias("severity"), score.cast("string").alias("value"))),
        F.when(~fits, F.struct(F.lit("NAMING_CONVENTION").alias("rule_name"), F.lit("low").alias("severity"), name.alias("value"))),
    )
    return chunks.select(*keep, F.explode(found).alias("v")).filter("v is not null").select(*keep, "v.*")


def forbidden_imports(files: DataFrame, text: str, forbidden: dict[str, list[str]], *keep: str) -> DataFrame:
    """Lines that import a forbidden package of their language or a part of it; (package, line) once a file."""
    lines = explode_lines(files.select(*keep, F.col("language"), F.col(text).alias("_t")), "_t", *dict.fromkeys([*keep, "language"]))
    target = F.lit(None).cast("string")
    banned = F.array().cast("array<string>")
    for lang, packages in forbidden.items():
        if lang in V.IMPORTS:
            target = F.when(F.col("language") == lang, F.regexp_extract("line", V.IMPORTS[lang], 1)).otherwise(target)
            banned = F.when(F.col("language") == lang, F.array(*map(F.lit, packages))).otherwise(banned)
    rows = lines.select(*keep, "line_number", target.alias("imported"), F.explode(banned).alias("package")).filter("imported <> ''")
    part = F.array(*(F.concat("package", F.lit(s)) for s in "./:"))
    hit = (F.col("imported") == F.col("package")) | F.exists(part, lambda p: F.col("imported").startswith(p))
    return rows.filter(hit).select(*keep, "line_number", "package").distinct()
