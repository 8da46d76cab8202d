"""Text expressions, all JVM-side: lines, tokens, noise, complexity, routing and skipping of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import fixed_values as V

#: Every line end that Python's splitlines() knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def lines(text: Column | str) -> Column:
    """Lines as by splitlines(): no empty last piece; null stays null (P10)."""
    parts = F.split(_col(text), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row per line: ``keep``, ``line_number`` from 1 and ``line`` (P10). Null texts give no row."""
    return df.select(*keep, F.posexplode(lines(text)).alias("_n", "line")).withColumn("line_number", F.col("_n") + 1).drop("_n")


def language_of(path: Column | str) -> Column:
    """Language by suffix, whatever its case; null where there is none."""
    suffix = F.regexp_extract(F.lower(_col(path)), r"(\.[^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in V.LANGUAGE_OF_SUFFIX.items() for x in kv])
    return F.try_element_at(table, suffix)


def in_skipped_dir(path: Column | str) -> Column:
    """A part of the path is a skipped directory."""
    return F.arrays_overlap(F.split(_col(path), "/"), words(V.SKIP_DIRS))


def matches_skip_pattern(path: Column | str) -> Column:
    """The path fits a skipped pattern."""
    return _col(path).rlike("|".join(f"(?:{p})" for p in V.SKIP_PATTERNS))


def is_minified(text: Column | str) -> Column:
    """A line is longer than 500 characters."""
    return F.coalesce(F.exists(lines(text), lambda x: F.length(x) > V.MINIFIED_LINE), F.lit(False))


def should_skip(path: Column | str, text: Column | str) -> Column:
    """by directory, pattern, or for its long lines where there is content."""
    return in_skipped_dir(path) | matches_skip_pattern(path) | ((F.coalesce(_col(text), F.lit("")) != "") & is_minified(text))


def name_tokens(name: Column | str) -> Column:
    """Distinct lower-case words of three letters or more of a name, without stop words."""
    spread = F.regexp_replace(F.regexp_replace(_col(name), "([a-z])([A-Z])", "$1 $2"), "_", " ")
    found = F.transform(F.regexp_extract_all(spread, F.lit("[a-zA-Z]{3,}"), F.lit(0)), F.lower)
    return F.array_sort(F.array_except(found, words(V.STOP_WORDS)))


def strip_noise(code: Column | str, language: Column | str) -> Column:
    """Code without doc strings, comments and import lines; other languages stay as they are."""
    c, lang = F.coalesce(_col(code), F.lit("")), _col(language)
    py = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r'"""[\s\S]*?"""', ""), r"'''[\s\S]*?'''", ""), r"#[^\n]*", "")
    py = F.array_join(F.filter(F.split(py, "\n"), lambda x: ~x.rlike(r"^\s*(import |from \S+ import)")), "\n")
    brace = F.regexp_replace(F.regexp_replace(c, r"/\*[\s\S]*?\*/", ""), r"//[^\n]*", "")
    script = F.array_join(F.filter(F.split(brace, "\n"), lambda x: ~x.rlike(r"^\s*import ")), "\n")
    return F.when(lang == "python", py).when(lang.isin("javascript", "typescript", "tsx"), script).when(lang.isin("java", "go", "rust", "c", "cpp", "php", "ruby"), brace).otherwise(c)


def body_tokens(code: Column | str, language: Column | str) -> Column:
    """Identifiers of four characters or more and their ``_`` parts of three or more, without stop words."""
    whole = F.transform(F.regexp_extract_all(strip_noise(code, language), F.lit(r"\b[a-zA-Z][a-zA-Z0-9_]{3,}\b"), F.lit(0)), F.lower)
    parts = F.flatten(F.transform(whole, lambda t: F.filter(F.split(t, "_"), lambda p: F.length(p) >= 3)))
    return F.array_sort(F.array_except(F.array_union(whole, parts), words(V.STOP_WORDS)))


def code_tokens(code: Column | str, language: Column | str) -> Column:
    """Distinct tokens that the token similarity compares."""
    found = F.transform(F.regexp_extract_all(strip_noise(code, language), F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]{3,}\b"), F.lit(0)), F.lower)
    return F.array_except(found, words(V.STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; null where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def blended_similarity(cosine: Column, tokens_similarity: Column, other_code: Column, stored: bool = True) -> Column:
    """0.7 cosine + 0.3 token similarity to 4 places; the cosine where tokens say nothing; null where stored code is missing."""
    missing = F.coalesce(other_code, F.lit("")) == ""
    mixed = F.when(tokens_similarity.isNull(), cosine).otherwise(F.round(0.7 * cosine + 0.3 * tokens_similarity, 4))
    return F.when(missing, F.lit(None).cast("double") if stored else cosine).otherwise(mixed)


def app_of(path: Column | str) -> Column:
    """The part after the first ``apps`` of a path, or null."""
    parts = F.split(F.regexp_replace(_col(path), r"\\", "/"), "/")
    at = F.array_position(parts, "apps")
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


def file_role(path: Column | str) -> Column:
    """view, compute or other, by the file's name (X11)."""
    p = F.lower(F.regexp_replace(_col(path), r"\\", "/"))
    return F.when(p.rlike(r"(^|/)(views|consumers|serializers)\.py$"), "view").when(p.rlike(r"(^|/)(tasks|services|engines?|workers)\.py$"), "compute").otherwise("other")


def complexity(code: Column | str, language: Column | str) -> Column:
    """1 + branching words."""
    c, lang = _col(code), _col(language)
    expr = F.regexp_count(c, F.lit(V.OTHER_BRANCHES))
    for name, pattern in V.BRANCHES.items():
        expr = F.when(lang == name, F.regexp_count(c, F.lit(pattern))).otherwise(expr)
    return expr + 1


def entropy(text: Column | str) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    t = _col(text)
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    share = lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(t)
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(bits)
