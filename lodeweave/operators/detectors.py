"""Line detectors as one rule table: the first rule of a line's language that fits makes the finding."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.functions import fixed_values as V
from lodeweave.functions.text import entropy, explode_lines


@dataclass(frozen=True)
class Rule:
    detector: str
    language: str  # "" is every language
    pattern: str
    title: str
    severity: str


RULES: list[Rule] = [
    *(Rule("HARDCODED_SECRET", "", p, t, "critical") for p, t in V.SECRETS),
    *(Rule("SQL_INJECTION", lang, p, "Potential SQL injection vulnerability", "critical") for lang, ps in V.SQL_INJECTION.items() for p in ps),
    *(Rule("DANGEROUS_FUNCTION", lang, *r) for lang, rs in V.DANGEROUS.items() for r in rs),
    *(Rule("INSECURE_RANDOM", lang, p, "Insecure random number generation", "medium") for lang, ps in V.INSECURE_RANDOM.items() for p in ps),
    *(Rule("OPEN_REDIRECT", lang, p, "Potential open redirect vulnerability", "high") for lang, ps in V.OPEN_REDIRECT.items() for p in ps),
]
#: The detectors in the order in which they run.
ORDER = ["HARDCODED_SECRET", "SQL_INJECTION", "DANGEROUS_FUNCTION", "MISSING_AUTH", "INSECURE_RANDOM", "OPEN_REDIRECT"]
#: Starts of a comment line that a detector passes over.
COMMENTS = {"HARDCODED_SECRET": r"^(#|//|\*|<!--)", "DANGEROUS_FUNCTION": r"^(#|//|\*|<!--)", "INSECURE_RANDOM": r"^(#|//|\*)", "OPEN_REDIRECT": r"^(#|//|\*)"}


def register_detector(rules: list[Rule]) -> None:
    """Add rules of a detector of one's own."""
    RULES.extend(rules)


def _guard(detector: str) -> Column:
    line = F.col("line")
    ok = ~line.rlike(r"^\s*" + COMMENTS[detector][1:]) if detector in COMMENTS else F.lit(True)
    return ok & ~line.contains("# nosec") if detector == "DANGEROUS_FUNCTION" else ok


def first_rule(detector: str) -> Column:
    """Number of the first rule that fits the line, or null: a chain of conditions inside the projection, without a shuffle."""
    chain = None
    for i, r in enumerate(RULES):
        if r.detector != detector:
            continue
        fits = F.col("line").rlike(r.pattern) if not r.language else (F.col("language") == r.language) & F.col("line").rlike(r.pattern)
        if detector == "HARDCODED_SECRET":
            fits = fits & ~F.regexp_extract("line", r.pattern, 0).rlike(V.PLACEHOLDER)
        chain = F.when(fits, F.lit(i)) if chain is None else chain.when(fits, F.lit(i))
    return F.when(_guard(detector), chain)


def findings(df: DataFrame, text: str, language: str, *keep: str, detectors: tuple[str, ...] = ("HARDCODED_SECRET", "SQL_INJECTION", "DANGEROUS_FUNCTION", "INSECURE_RANDOM", "OPEN_REDIRECT")) -> DataFrame:
    """Findings of D1a, D2, D3, D5 and D6: ``keep``, detector, severity, title, line_number, code_snippet; one a line and detector.

    Lines are exploded once for all detectors; null texts have none.
    """
    rows = explode_lines(df.select(*keep, F.col(language).alias("language"), F.col(text).alias("_t")), "_t", *dict.fromkeys([*keep, "language"]))
    rules = F.array(*(F.struct(F.lit(r.detector).alias("detector"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title")) for r in RULES))
    hits = rows.select("*", F.explode(F.array(*(first_rule(d) for d in detectors))).alias("_rule")).filter("_rule is not null")
    hits = hits.withColumn("_r", F.element_at(rules, F.col("_rule") + 1))
    return hits.select(*keep, "_r.detector", "_r.severity", "_r.title", "line_number", F.substring(F.trim("line"), 1, 300).alias("code_snippet"))


def entropy_findings(df: DataFrame, text: str, *keep: str, threshold: float = 4.5) -> DataFrame:
    """Quoted hexadecimal strings of 32 to 64 digits whose entropy reaches ``threshold``; several a line."""
    rows = explode_lines(df.select(*keep, F.col(text).alias("_t")), "_t", *keep)
    found = rows.select(*keep, "line_number", F.explode(F.regexp_extract_all("line", F.lit(V.HEX_STRING), F.lit(1))).alias("value"))
    return found.withColumn("entropy", F.round(entropy("value"), 6)).filter(F.col("entropy") >= threshold)


def _unguarded_routes(code: str) -> list[tuple[int, str]]:
    import re

    try:
        nodes = ast.walk(ast.parse(code))
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in nodes:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.decorator_list:
            names = {p for d in n.decorator_list for p in re.split(r"[\s.(]", ast.unparse(d)) if p}
            if names & {*V.ROUTE_DECORATORS} and not names & {*V.AUTH_DECORATORS}:
                out.append((min(d.lineno for d in n.decorator_list), n.name))
    return out


def missing_auth(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """D4 for Python texts: routes without a decorator that asks for authentication; a text that does not parse has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:-1], line, name) for r in b.itertuples(index=False) for line, name in _unguarded_routes(r[-1])]
            yield pd.DataFrame(rows, columns=[*keep, "line_number", "function_name"])

    picked = df.filter(F.col(text).contains("@")).select(*keep, F.col(text).alias("_t"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in picked.select(*keep).dtypes)
    return picked.mapInPandas(run, f"{kinds}, line_number int, function_name string")


def scan_files(df: DataFrame, text: str, language: str, *keep: str) -> DataFrame:
    """Findings of all detectors (D1 to D6) with ``place`` in each file's report: by severity, then detector, then line.

    Columns as of ``findings``. A null text has no findings; a text that does not parse has none of D4.
    """
    line = findings(df, text, language, *keep)
    hex_ = entropy_findings(df.filter(F.col(text).isNotNull()), text, *keep).filter(~F.col("value").rlike(V.PLACEHOLDER))
    hex_ = hex_.select(*keep, F.lit("HARDCODED_SECRET").alias("detector"), F.lit("high").alias("severity"), F.lit("High-entropy string (possible secret)").alias("title"), "line_number", F.col("value").alias("code_snippet"))
    auth = missing_auth(df.filter(F.col(language) == "python"), text, *keep)
    auth = auth.select(*keep, F.lit("MISSING_AUTH").alias("detector"), F.lit("high").alias("severity"), F.format_string("Endpoint '%s' has no authentication decorator", "function_name").alias("title"), "line_number", F.lit("").alias("code_snippet"))
    every = line.unionByName(hex_).unionByName(auth)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, V.SEVERITIES)), F.col("severity")), F.lit(0))
    order = F.array_position(F.array(*map(F.lit, ORDER)), F.col("detector"))
    return every.withColumn("place", F.row_number().over(W.partitionBy(*keep).orderBy(rank, order, "line_number", "title", "code_snippet")))
