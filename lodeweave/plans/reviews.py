"""Pull-request review and its reports (B5, B11, B12), with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.functions import fixed_values as V
from lodeweave.functions import text as X
from lodeweave.operators import chunker, cluster, detectors, review, rules, vectors
from lodeweave.plans import fixtures, queries
from lodeweave.plans.registry import register
from lodeweave.session import ship, spread, table

_KEYS = ("pr_id", "pr_file_id", "filename")
_quote = lambda t: t.replace("'", "''")
_DIRS = "[" + ", ".join(f"'{x}'" for x in V.SKIP_DIRS) + "]"
_PATTERNS = "|".join(f"(?:{p})" for p in V.SKIP_PATTERNS)
_RULES = ", ".join(f"({i}, '{r.detector}', '{r.severity}', '{_quote(r.title)}')" for i, r in enumerate(detectors.RULES))
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_CUT = queries._Q_LINES.split("),\ncut2", 1)[1]
_Q_FILES = f"""files AS (SELECT DISTINCT pr_id, pr_file_id, filename, content FROM (SELECT pr_id, pr_file_id, filename, content FROM pr_files UNION ALL FROM {fixtures.sql("pr_files")})),
kept AS (SELECT pr_id, pr_file_id, filename, coalesce({queries._Q_SUFFIX}, '') AS language, content FROM files
  WHERE NOT (len(list_intersect(string_split(filename, '/'), {_DIRS})) > 0 OR regexp_matches(filename, '{_PATTERNS}') OR coalesce(len(list_filter(string_split_regex(content, '{_LINE_END}'), lambda x: length(x) > 500)) > 0, false))),
cut AS (SELECT pr_id, pr_file_id, filename, language, string_split_regex(content, '{_LINE_END}') AS a FROM kept WHERE content IS NOT NULL),
cut2 AS (SELECT * REPLACE (CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a) FROM cut),
lines AS (SELECT pr_id, pr_file_id, filename, language, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_number FROM cut2),
rule_rows AS (SELECT * FROM (VALUES {_RULES}) t(rule, detector, severity, title)),
hits AS ({" UNION ALL ".join(f"SELECT *, {queries.rule_sql(n)} AS rule FROM lines" for n in detectors.ORDER if n != "MISSING_AUTH")}),
{queries.auth_sql("pr_id, pr_file_id, filename")},
fnd AS (SELECT pr_id, pr_file_id, filename, detector, severity, title, line_number::INT AS line_number, left(trim(line, ' '), 300) AS code_snippet FROM hits JOIN rule_rows USING (rule)
  UNION ALL SELECT pr_id, pr_file_id, filename, 'MISSING_AUTH', 'high', 'Endpoint ''' || function_name || ''' has no authentication decorator', line_number, '' FROM auth)"""
_RANK = "coalesce(list_position([" + ", ".join(f"'{x}'" for x in V.SEVERITIES) + "], severity), 100) - 1"
_ORDER = "list_position([" + ", ".join(f"'{x}'" for x in detectors.ORDER) + "], detector)"
_HEALTH = "greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END))"


def _files(s: SparkSession, d: str) -> DataFrame:
    """The files of pull requests once each, with the fixture files, without skipped ones, and their language."""
    f = table(s, d, "pr_files").select("pr_id", "pr_file_id", "filename", "content").unionByName(fixtures.frame(s, "pr_files")).distinct()
    return spread(f).filter(~X.should_skip("filename", "content")).withColumn("language", F.coalesce(X.language_of("filename"), F.lit("")))


def _findings(s: SparkSession, d: str) -> DataFrame:
    ship(s)
    return detectors.scan_files(_files(s, d), "content", "language", *_KEYS)


@register(f"WITH {_Q_FILES} SELECT *, {_RANK} AS rank, row_number() OVER (PARTITION BY pr_id, pr_file_id, filename ORDER BY {_RANK}, {_ORDER}, line_number, title, code_snippet)::INT AS place FROM fnd")
def pr_findings(s: SparkSession, d: str) -> DataFrame:
    """All detectors' findings in the files of pull requests, by severity in each file."""
    return _findings(s, d).withColumn("rank", review.severity_rank("severity").cast("long"))


_Q_IMPORTS = (
    "imports AS (SELECT pr_id, pr_file_id, filename, line_number::INT AS line_number, language, CASE language "
    + " ".join(f"WHEN '{k}' THEN regexp_extract(line, '{_quote(V.IMPORTS[k])}', 1)" for k in queries._FORBIDDEN)
    + " END AS imported FROM lines), packages AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{p}')" for k, ps in queries._FORBIDDEN.items() for p in ps)
    + ") t(language, package)), imp AS (SELECT DISTINCT pr_id, pr_file_id, filename, line_number, package FROM imports JOIN packages USING (language) WHERE imported <> '' AND (imported = package OR starts_with(imported, package || '.') OR starts_with(imported, package || '/') OR starts_with(imported, package || ':')))"
)
_Q_REVIEW = f"""{_Q_FILES}, {_Q_IMPORTS},
rev AS (SELECT pr_id, filename, lower(detector) AS finding_type, severity, title, line_number FROM fnd UNION ALL SELECT pr_id, filename, 'rule', 'high', 'Forbidden import: ' || package, line_number FROM imp)"""


def _review(s: SparkSession, d: str) -> DataFrame:
    """Findings of detectors and forbidden imports in one form."""
    f = _findings(s, d).select("pr_id", "filename", F.lower("detector").alias("finding_type"), "severity", "title", "line_number")
    i = rules.forbidden_imports(_files(s, d), "content", queries._FORBIDDEN, *_KEYS)
    return f.unionByName(i.select("pr_id", "filename", F.lit("rule").alias("finding_type"), F.lit("high").alias("severity"), F.concat(F.lit("Forbidden import: "), "package").alias("title"), "line_number"))


@register(f"WITH {_Q_REVIEW} SELECT * FROM rev")
def pr_review_files(s: SparkSession, d: str) -> DataFrame:
    """B12 without chunks, R4, R7: security and import findings of each file as one table."""
    return _review(s, d)


@register(f"WITH {_Q_REVIEW} SELECT pr_id, {', '.join(f'''count(*) FILTER (severity = '{x}') AS {x}''' for x in V.SEVERITIES)}, count(*) AS total FROM rev WHERE finding_type NOT IN ('duplicate', 'debt_impact') GROUP BY 1")
def pr_severity_counts(s: SparkSession, d: str) -> DataFrame:
    """Findings by severity without those of context."""
    return review.severity_pivot(_review(s, d).filter(~F.col("finding_type").isin("duplicate", "debt_impact")), "pr_id")


_Q_PRS = "prs AS (SELECT pr_id, any_value(repo_id) AS repo_id, min(fetched_at) AS opened_at, max(fetched_at) AS reviewed_at FROM pr_files GROUP BY 1)"


def _prs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pr_files").groupBy("pr_id").agg(F.min("repo_id").alias("repo_id"), F.min("fetched_at").alias("opened_at"), F.max("fetched_at").alias("reviewed_at"))


@register(f"""WITH {_Q_REVIEW}, {_Q_PRS}, h AS (SELECT pr_id, {_HEALTH} AS health FROM rev GROUP BY 1),
l AS (SELECT repo_id, health, row_number() OVER (PARTITION BY repo_id ORDER BY reviewed_at DESC, pr_id) AS n FROM (SELECT repo_id, pr_id, reviewed_at, coalesce(health, 100) AS health FROM prs LEFT JOIN h USING (pr_id)))
SELECT repo_id, round(avg(health), 1) AS health_score FROM repositories LEFT JOIN (FROM l WHERE n <= 5) USING (repo_id) GROUP BY 1""")
def overview_health(s: SparkSession, d: str) -> DataFrame:
    """The mean health of the five pull requests that were reviewed last; null where a repository has none."""
    h = _prs(s, d).join(review.health_score(_review(s, d), "pr_id"), "pr_id", "left")
    w = W.partitionBy("repo_id").orderBy(F.col("reviewed_at").desc(), "pr_id")
    last = h.withColumn("n", F.row_number().over(w)).filter("n <= 5").groupBy("repo_id").agg(F.round(F.avg(F.coalesce("health_score", F.lit(100))), 1).alias("health_score"))
    return table(s, d, "repositories").select("repo_id").join(last, "repo_id", "left")


@register(f"""WITH {_Q_REVIEW}, {_Q_PRS}, c AS (SELECT pr_id, {', '.join(f'''count(*) FILTER (severity = '{x}') AS {x}''' for x in V.SEVERITIES)}, count(*) AS total FROM rev GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY opened_at DESC, pr_id)::INT AS place FROM prs QUALIFY place <= 50)
SELECT repo_id, pr_id, place, {', '.join(f'coalesce({x}, 0) AS {x}' for x in [*V.SEVERITIES, 'total'])} FROM n LEFT JOIN c USING (pr_id)""")
def pr_list(s: SparkSession, d: str) -> DataFrame:
    """The fifty newest pull requests of each repository with their findings by severity."""
    w = W.partitionBy("repo_id").orderBy(F.col("opened_at").desc(), "pr_id")
    newest = _prs(s, d).withColumn("place", F.row_number().over(w)).filter("place <= 50").select("repo_id", "pr_id", "place")
    return newest.join(review.severity_pivot(_review(s, d), "pr_id"), "pr_id", "left").na.fill(0, [*V.SEVERITIES, "total"])


@register(f"WITH {_Q_REVIEW} SELECT pr_id, filename, severity, title, line_number, row_number() OVER (PARTITION BY pr_id ORDER BY filename, severity, line_number, title)::INT AS place FROM rev WHERE severity IN ('critical', 'high')")
def pr_serious_by_path(s: SparkSession, d: str) -> DataFrame:
    """Critical and high findings of a pull request by path."""
    w = W.partitionBy("pr_id").orderBy("filename", "severity", "line_number", "title")
    return _review(s, d).filter(F.col("severity").isin("critical", "high")).select("pr_id", "filename", "severity", "title", "line_number", F.row_number().over(w).alias("place"))


@register(f"WITH {_Q_FILES} SELECT DISTINCT sha256(lower(detector) || ':' || title || ':' || left(code_snippet, 300)) AS fingerprint, severity FROM fnd WHERE severity IN ('critical', 'high')")
def finding_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Cache keys of the suggestions for critical and high findings."""
    f = _findings(s, d).filter(F.col("severity").isin("critical", "high")).withColumn("kind", F.lower("detector"))
    return f.select(review.fingerprint("kind", "title", "code_snippet").alias("fingerprint"), "severity").distinct()


_Q_ADDED = f"""patches AS (SELECT DISTINCT pr_file_id, patch FROM (SELECT pr_file_id, patch FROM pr_files UNION ALL FROM {fixtures.sql("patches")}) WHERE patch IS NOT NULL),
pl AS (SELECT pr_file_id, patch, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT *, string_split_regex(patch, '\\r?\\n') AS a FROM patches)),
ps AS (SELECT *, CASE WHEN starts_with(line, '@@') THEN try_cast(regexp_extract(line, '\\+(\\d+)', 1) AS BIGINT) END AS s FROM pl),
ph AS (SELECT *, count(s) OVER (PARTITION BY pr_file_id, patch ORDER BY pos) AS h FROM ps),
pn AS (SELECT *, first(s) OVER w - 1 + sum(CASE WHEN s IS NULL AND (starts_with(line, '+') OR starts_with(line, ' ')) THEN 1 ELSE 0 END) OVER w AS line_number FROM ph WHERE h > 0 WINDOW w AS (PARTITION BY pr_file_id, patch, h ORDER BY pos)),
added AS (SELECT DISTINCT pr_file_id, line_number::BIGINT AS line_number FROM pn WHERE s IS NULL AND starts_with(line, '+'))"""


def _added(s: SparkSession, d: str) -> DataFrame:
    """Added lines of every patch; rows fetched twice count once."""
    f = table(s, d, "pr_files").select("pr_file_id", "patch").unionByName(fixtures.frame(s, "patches")).filter("patch is not null").distinct()
    return review.added_lines(f.withColumn("patch_hash", F.sha2("patch", 256)), "patch", "pr_file_id", "patch_hash").select("pr_file_id", "line_number").distinct()


@register(f"WITH {_Q_ADDED} SELECT * FROM added")
def pr_added_lines(s: SparkSession, d: str) -> DataFrame:
    """X16, W9."""
    return _added(s, d)


@register(f"""WITH {_Q_FILES}, {_Q_ADDED}, first50 AS (SELECT * FROM fnd QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY {_RANK}, pr_file_id, line_number, title) <= 50)
SELECT pr_id, pr_file_id, line_number, severity, title FROM first50 SEMI JOIN added USING (pr_file_id, line_number)""")
def pr_inline_comments(s: SparkSession, d: str) -> DataFrame:
    """Of the first fifty findings those on added lines."""
    return review.select_comments(_findings(s, d), _added(s, d), ("pr_file_id",)).select("pr_id", "pr_file_id", "line_number", "severity", "title")


@register(f"""WITH {_Q_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY {_RANK}, title, line_number) AS n FROM fnd),
g AS (SELECT pr_id, {_HEALTH}::INT AS health_score, string_agg('- **' || severity || '** ' || title || ' (line ' || line_number || ')', chr(10) ORDER BY n) FILTER (n <= 10) AS items, count(*) AS k, {', '.join(f'''count(*) FILTER (severity = '{x}') AS {x}''' for x in V.SEVERITIES)} FROM r GROUP BY 1)
SELECT pr_id, health_score, '## Review: ' || health_score || ' (' || CASE WHEN health_score >= 80 THEN 'good' WHEN health_score >= 50 THEN 'fair' ELSE 'poor' END || ')' || chr(10) || {" || ' | ' || ".join(f"'{x} ' || {x}" for x in V.SEVERITIES)} || chr(10) || items || CASE WHEN k > 10 THEN chr(10) || 'and ' || (k - 10) || ' more' ELSE '' END AS summary FROM g""")
def pr_review_summary(s: SparkSession, d: str) -> DataFrame:
    """The Markdown summary of each pull request."""
    return review.review_summary(_findings(s, d))


@register()
def pr_review(s: SparkSession, d: str) -> DataFrame:
    """The whole review: detectors, imports, rules on the files' chunks, duplicates and impact, as one findings table.

    Chunks of the files get the vectors of equal code in ``code_chunks`` (S9); other chunks have none and take no part in
    duplicates and impact.
    """
    files = _files(s, d)
    cut = chunker.chunk_files(files.drop("language"), "filename", "content", *_KEYS, mode="review").withColumn("complexity_score", F.col("complexity").cast("double"))
    cut = cut.withColumn("chunk_id", F.concat_ws(":", "pr_file_id", "start_line", "chunk_name")).withColumnRenamed("filename", "file_path").persist()
    v = rules.chunk_violations(cut, queries._CONFIG, ("pr_id", "file_path", "start_line"))
    broken = v.select("pr_id", F.col("file_path").alias("filename"), F.when(F.col("rule_name") == "MAX_COMPLEXITY", "complexity").otherwise("rule").alias("finding_type"), "severity", F.concat_ws(" ", "rule_name", "value").alias("title"), F.col("start_line").alias("line_number"))
    repo = _prs(s, d).select("pr_id", "repo_id")
    cache = table(s, d, "code_chunks").filter("embedding is not null and raw_code is not null").groupBy(F.sha2("raw_code", 256).alias("h")).agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    mine = cut.withColumn("h", F.sha2("raw_code", 256)).join(cache, "h").join(repo, "pr_id")
    old = table(s, d, "code_chunks")
    near = vectors.pairs_within(review.without_copies(old.filter(F.col("chunk_type").isin("function", "method"))), review.embeddable(mine), "chunk_id", "embedding", ("repo_id", "language"), 0.03, "file_path")
    cols = ["chunk_id", "file_path", "chunk_name", "language", "start_line", "end_line", "raw_code"]
    dup = review.semantic_duplicates(near, mine.select(*cols).unionByName(old.select(*cols))).join(mine.select(F.col("chunk_id").alias("query_id"), "pr_id", F.col("file_path").alias("filename"), "chunk_name", "start_line"), "query_id")
    clusters = table(s, d, "semantic_clusters")
    joined = cluster.nearest_centroids(mine, clusters).join(mine.select("chunk_id", "repo_id", "pr_id"), "chunk_id")
    hit = review.debt_impact(joined, cluster.cluster_snapshot(clusters), table(s, d, "cluster_memberships"), old, queries._commits(s, d), ("repo_id", "pr_id"))
    out = _review(s, d).unionByName(broken).unionByName(review.duplicate_findings(dup, "pr_id", "filename"))
    return out.unionByName(review.impact_findings(hit.withColumn("filename", F.lit("")), "pr_id", "filename"))
