"""Queries of the analytics on the tables of code history, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.functions import fixed_values as V
from lodeweave.functions import text as X
from lodeweave.operators import chunker, cluster, debt, detectors, review, rules, tables, vectors
from lodeweave.plans import fixtures
from lodeweave.plans.registry import register
from lodeweave.session import ship, spread, table


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks")


def _commits(s: SparkSession, d: str) -> DataFrame:
    return debt.latest_commits(table(s, d, "commits"))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# SQL that several queries share.
_Q_COMMITS = "(SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at, sha) = 1)"
_Q_CLUSTERS = "(SELECT * FROM semantic_clusters QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY chunk_count DESC, centroid_hash) = 1)"
_Q_SCORES = """
viol AS (
  SELECT repo_id, commit_id, file_path FROM code_chunks WHERE chunk_type IN ('function','method') AND end_line - start_line + 1 > 50
  UNION ALL SELECT repo_id, commit_id, file_path FROM code_chunks WHERE chunk_type IN ('function','method') AND trunc(complexity_score) > 10),
base AS (SELECT repo_id, commit_id, file_path, arg_min(language, chunk_id) AS language, sum(complexity_score) AS c FROM code_chunks GROUP BY ALL),
mem AS (SELECT repo_id, commit_id, file_path, count(*) AS r, count(DISTINCT cluster_id) AS k FROM code_chunks JOIN cluster_memberships USING (chunk_id) GROUP BY ALL),
brk AS (SELECT repo_id, commit_id, file_path, count(*) AS n FROM viol GROUP BY ALL),
scores AS (SELECT repo_id, commit_id, file_path, language, round(c * 0.3e0, 4) AS complexity_component, round(coalesce(r, 0) * 0.3e0, 4) AS duplication_component,
  round(coalesce(n, 0) * 0.2e0, 4) AS violation_component, round(coalesce(k, 0) * 0.2e0, 4) AS cluster_component,
  round(c * 0.3e0 + coalesce(r, 0) * 0.3e0 + coalesce(n, 0) * 0.2e0 + coalesce(k, 0) * 0.2e0, 4) AS total_score
  FROM base LEFT JOIN mem USING (repo_id, commit_id, file_path) LEFT JOIN brk USING (repo_id, commit_id, file_path))"""
_Q_VELOCITY = f"""{_Q_SCORES},
vel AS (SELECT s.*, m.committed_at, m.sha, round(coalesce(total_score - lag(total_score) OVER (PARTITION BY s.repo_id, file_path ORDER BY m.committed_at, m.sha), 0e0), 4) AS velocity
  FROM scores s JOIN {_Q_COMMITS} m USING (commit_id))"""
_Q_LINES = r"""
cut AS (SELECT chunk_id, repo_id, file_path, language, string_split_regex(raw_code, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS a FROM code_chunks WHERE raw_code IS NOT NULL),
cut2 AS (SELECT * REPLACE (CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a) FROM cut),
lines AS (SELECT chunk_id, repo_id, file_path, language, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_number FROM cut2)"""

#: Lines of all chunks and of the fixture code.
_Q_LINES_FX = _Q_LINES.replace("repo_id, file_path, ", "").replace("FROM code_chunks", f"FROM (SELECT chunk_id, language, raw_code FROM code_chunks UNION ALL FROM {fixtures.sql('code')})")


def _code(s: SparkSession, d: str) -> DataFrame:
    """All chunks and the fixture code."""
    return _chunks(s, d).select("chunk_id", "language", "raw_code").unionByName(fixtures.frame(s, "code"))


def _violations(s: SparkSession, d: str) -> DataFrame:
    return rules.chunk_violations(_chunks(s, d), keep=("repo_id", "commit_id", "file_path"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return debt.debt_scores(_chunks(s, d), table(s, d, "cluster_memberships"), _violations(s, d))


def _velocity(s: SparkSession, d: str) -> DataFrame:
    return debt.velocity(_scores(s, d), _commits(s, d))


@register(f"WITH {_Q_SCORES} SELECT * FROM scores")
def debt_score_components(s: SparkSession, d: str) -> DataFrame:
    """B1 with A8, A9, J6, J7."""
    return _scores(s, d)


@register(f"WITH {_Q_VELOCITY} SELECT repo_id, commit_id, file_path, total_score, velocity FROM vel")
def debt_velocity(s: SparkSession, d: str) -> DataFrame:
    """W1."""
    return _velocity(s, d).select("repo_id", "commit_id", "file_path", "total_score", "velocity")


_Q_HISTORY = f"""{_Q_SCORES},
allc AS (SELECT commit_id, sha, committed_at FROM {_Q_COMMITS} UNION ALL SELECT commit_id, sha, TIMESTAMP '2024-01-01' + to_days(day) FROM {fixtures.sql("commits")}),
vel AS (SELECT s.*, m.committed_at, m.sha, round(coalesce(total_score - lag(total_score) OVER (PARTITION BY s.repo_id, file_path ORDER BY m.committed_at, m.sha), 0e0), 4) AS velocity
  FROM (SELECT repo_id, commit_id, file_path, language, total_score FROM scores UNION ALL FROM {fixtures.sql("scores")}) s JOIN allc m USING (commit_id))"""


@register(f"""WITH {_Q_HISTORY}, st AS (SELECT repo_id, commit_id, file_path, velocity, avg(velocity) OVER w AS a, stddev_pop(velocity) OVER w AS sd, count(*) OVER w AS n FROM vel WINDOW w AS (PARTITION BY repo_id, file_path))
SELECT repo_id, commit_id, file_path, velocity FROM st WHERE n >= 3 AND sd > 1e-9 AND velocity > a + 2 * sd AND velocity > 0""")
def debt_inflections(s: SparkSession, d: str) -> DataFrame:
    """W2, A14, over all histories and a long one of the fixtures."""
    c = _commits(s, d).select("commit_id", "sha", "committed_at").unionByName(fixtures.frame(s, "commits").select("commit_id", "sha", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)").alias("committed_at")))
    scores = _scores(s, d).select("repo_id", "commit_id", "file_path", "language", "total_score").unionByName(fixtures.frame(s, "scores"))
    return debt.inflections(debt.velocity(scores, c)).filter("is_inflection").select("repo_id", "commit_id", "file_path", "velocity")


@register(f"WITH {_Q_VELOCITY} SELECT repo_id, commit_id, file_path, total_score, velocity FROM vel WHERE velocity > 0 ORDER BY velocity DESC, repo_id, file_path, commit_id LIMIT 5")
def debt_top_deteriorating(s: SparkSession, d: str) -> DataFrame:
    """O3: the five steepest rises."""
    v = _velocity(s, d).filter("velocity > 0").orderBy(F.col("velocity").desc(), "repo_id", "file_path", "commit_id").limit(5)
    return v.select("repo_id", "commit_id", "file_path", "total_score", "velocity")


@register(f"SELECT commit_id, repo_id FROM {_Q_COMMITS} m WHERE is_processed AND NOT EXISTS (SELECT 1 FROM code_chunks c WHERE c.commit_id = m.commit_id)")
def debt_unscored_commits(s: SparkSession, d: str) -> DataFrame:
    """processed commits without a scored file."""
    return _commits(s, d).filter("is_processed").join(_chunks(s, d).select("commit_id"), "commit_id", "left_anti").select("commit_id", "repo_id")


_Q_BLAME = f"""WITH {_Q_VELOCITY},
rise AS (SELECT commit_id, round(coalesce(sum(velocity) FILTER (velocity > 0), 0e0), 4) AS debt_introduced_score, round(sum(velocity), 4) AS debt_score_delta FROM vel GROUP BY 1),
began AS (SELECT DISTINCT origin_commit_id AS commit_id, cluster_id FROM semantic_clusters WHERE origin_commit_id IS NOT NULL),
pat AS (SELECT commit_id, count(*) AS patterns_originated FROM began GROUP BY 1),
reach AS (SELECT commit_id, count(DISTINCT file_path) AS files_eventually_affected FROM began JOIN cluster_memberships USING (cluster_id) JOIN code_chunks c USING (chunk_id) GROUP BY began.commit_id),
blame AS (SELECT m.commit_id, m.repo_id, m.sha, coalesce(debt_introduced_score, 0e0) AS debt_introduced_score, coalesce(r.debt_score_delta, 0e0) AS debt_score_delta,
  coalesce(patterns_originated, 0) AS patterns_originated, coalesce(files_eventually_affected, 0) AS files_eventually_affected
  FROM {_Q_COMMITS} m LEFT JOIN rise r USING (commit_id) LEFT JOIN pat USING (commit_id) LEFT JOIN reach USING (commit_id))""".replace("SELECT commit_id, count(DISTINCT file_path) AS files", "SELECT began.commit_id, count(DISTINCT c.file_path) AS files")


def _blame(s: SparkSession, d: str) -> DataFrame:
    return debt.blame_map(_commits(s, d), _velocity(s, d), table(s, d, "semantic_clusters"), table(s, d, "cluster_memberships"), _chunks(s, d))


@register(f"{_Q_BLAME} SELECT * FROM blame")
def blame_map(s: SparkSession, d: str) -> DataFrame:
    """B3 with A5, A6, A7, J8."""
    return _blame(s, d)


@register(f"{_Q_BLAME} SELECT left(sha, 8) AS short_sha, debt_introduced_score, patterns_originated, files_eventually_affected FROM blame ORDER BY debt_introduced_score DESC, commit_id LIMIT 100")
def blame_report(s: SparkSession, d: str) -> DataFrame:
    """The hundred commits that brought most debt; what the CSV export writes."""
    top = _blame(s, d).orderBy(F.col("debt_introduced_score").desc(), "commit_id").limit(100)
    return top.select(F.substring("sha", 1, 8).alias("short_sha"), "debt_introduced_score", "patterns_originated", "files_eventually_affected")


@register(f"WITH {_Q_SCORES}, m AS (SELECT * FROM {_Q_COMMITS} ORDER BY committed_at DESC, sha LIMIT 30) SELECT m.commit_id, round(coalesce(avg(total_score), 0e0), 8) AS avg_score, row_number() OVER (ORDER BY committed_at, sha DESC)::INT AS place FROM m LEFT JOIN scores USING (commit_id) GROUP BY m.commit_id, committed_at, sha")
def overview_trend(s: SparkSession, d: str) -> DataFrame:
    """A1, O2: mean score of the thirty newest commits, 0 without one, from old to new by ``place``."""
    newest = _commits(s, d).orderBy(F.col("committed_at").desc(), "sha").limit(30).select("commit_id", "committed_at", "sha")
    newest = newest.withColumn("place", F.row_number().over(W.orderBy("committed_at", F.col("sha").desc()))).select("commit_id", "place")  # thirty rows
    return newest.join(_scores(s, d), "commit_id", "left").groupBy("commit_id", "place").agg(F.round(F.coalesce(F.avg("total_score"), F.lit(0.0)), 8).alias("avg_score"))


@register(f"SELECT (SELECT count(*) FROM {_Q_COMMITS}) AS commits, (SELECT count(DISTINCT (repo_id, file_path)) FROM code_chunks) AS files, (SELECT count(*) FROM {_Q_CLUSTERS} WHERE is_flagged OR growth_rate > 0.10) AS spreading")
def overview_counts(s: SparkSession, d: str) -> DataFrame:
    """Commits, distinct files and spreading clusters."""
    c = _commits(s, d).agg(F.lit("commits").alias("name"), F.count(F.lit(1)).alias("n"))
    f = _chunks(s, d).agg(F.lit("files").alias("name"), F.countDistinct("repo_id", "file_path").alias("n"))
    k = cluster.cluster_snapshot(table(s, d, "semantic_clusters")).agg(F.lit("spreading").alias("name"), F.count_if(F.col("is_flagged") | (F.col("growth_rate") > V.SPREADING_GROWTH)).alias("n"))
    return c.unionByName(f).unionByName(k).agg(*(F.max(F.when(F.col("name") == x, F.col("n"))).alias(x) for x in ("commits", "files", "spreading")))


@register(f"SELECT cluster_id, coalesce(nullif(label, ''), 'Cluster ' || left(cluster_id, 8)) AS label, chunk_count, file_count, growth_rate, left(m.sha, 8) AS origin_sha FROM {_Q_CLUSTERS} k LEFT JOIN {_Q_COMMITS} m ON m.commit_id = k.origin_commit_id ORDER BY chunk_count DESC, cluster_id LIMIT 100")
def cluster_map(s: SparkSession, d: str) -> DataFrame:
    """The hundred largest clusters with their origin."""
    k = cluster.cluster_snapshot(table(s, d, "semantic_clusters")).orderBy(F.col("chunk_count").desc(), "cluster_id").limit(100)
    m = _commits(s, d).select(F.col("commit_id").alias("origin_commit_id"), F.substring("sha", 1, 8).alias("origin_sha"))
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("Cluster "), F.substring("cluster_id", 1, 8)))
    return k.join(m, "origin_commit_id", "left").select("cluster_id", label.alias("label"), "chunk_count", "file_count", "growth_rate", "origin_sha")


_Q_STATUS = "CASE WHEN max_velocity > 5 THEN 'deteriorating' WHEN max_velocity < -1 THEN 'improving' ELSE 'stable' END AS status"


@register(f"WITH {_Q_VELOCITY}, g AS (SELECT repo_id, file_path, language, max(total_score) AS max_score, max(velocity) AS max_velocity FROM vel GROUP BY ALL) SELECT *, {_Q_STATUS} FROM g")
def velocity_heatmap_max(s: SparkSession, d: str) -> DataFrame:
    """B8, A3, P4 over all history."""
    g = _velocity(s, d).groupBy("repo_id", "file_path", "language").agg(F.max("total_score").alias("max_score"), F.max("velocity").alias("max_velocity"))
    return g.withColumn("status", debt.velocity_status("max_velocity"))


@register(f"WITH {_Q_VELOCITY}, g AS (SELECT repo_id, file_path, language, arg_max(velocity, committed_at::VARCHAR || sha) AS max_velocity FROM vel GROUP BY ALL) SELECT repo_id, file_path, language, max_velocity AS velocity, {_Q_STATUS} FROM g")
def velocity_heatmap_latest(s: SparkSession, d: str) -> DataFrame:
    """B8 by the latest score of each file."""
    g = _velocity(s, d).groupBy("repo_id", "file_path", "language").agg(F.max_by("velocity", F.struct("committed_at", "sha")).alias("velocity"))
    return g.withColumn("status", debt.velocity_status("velocity"))


@register(f"WITH {_Q_VELOCITY} SELECT repo_id, file_path, left(sha, 8) AS short_sha, total_score, velocity, strftime(committed_at, '%Y-%m-%d %H:%M:%S') AS committed, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY committed_at, sha, commit_id)::INT AS place FROM vel")
def debt_timeline_file(s: SparkSession, d: str) -> DataFrame:
    """The dated history of every file, in order."""
    place = F.row_number().over(W.partitionBy("repo_id", "file_path").orderBy("committed_at", "sha", "commit_id"))
    return _velocity(s, d).select("repo_id", "file_path", F.substring("sha", 1, 8).alias("short_sha"), "total_score", "velocity", _stamp("committed_at").alias("committed"), place.alias("place"))


@register("SELECT event_id, repo_id, lower(stage) AS stage, status, items_processed FROM (SELECT DISTINCT * FROM pipeline_events) ORDER BY created_at DESC, event_id LIMIT 50")
def pipeline_monitor(s: SparkSession, d: str) -> DataFrame:
    """The fifty newest events."""
    e = table(s, d, "pipeline_events").distinct().orderBy(F.col("created_at").desc(), "event_id").limit(50)
    return e.select("event_id", "repo_id", F.lower("stage").alias("stage"), "status", "items_processed")


@register("""SELECT lower(stage) AS stage, count(*) FILTER (status = 'started') AS started, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
sum(items_processed) AS items, round(avg(duration_ms), 4) AS avg_ms FROM (SELECT DISTINCT * FROM pipeline_events) GROUP BY 1""")
def pipeline_stage_stats(s: SparkSession, d: str) -> DataFrame:
    """A2, A10: conditional counts per stage, repeated rows once."""
    e = table(s, d, "pipeline_events").distinct().groupBy(F.lower("stage").alias("stage"))
    return e.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("started", "completed", "failed", "skipped")), F.sum("items_processed").alias("items"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"))


@register("SELECT c.commit_id FROM commits c WHERE c.repo_id IN (SELECT repo_id FROM repositories WHERE NOT is_private) GROUP BY 1")
def access_semi(s: SparkSession, d: str) -> DataFrame:
    """Commits of the repositories that one may see."""
    return table(s, d, "commits").join(table(s, d, "repositories").filter("not is_private"), "repo_id", "left_semi").select("commit_id").distinct()


@register("SELECT DISTINCT repo_id, file_path FROM code_chunks WHERE starts_with(file_path, 'src/')")
def file_prefix_filter(s: SparkSession, d: str) -> DataFrame:
    """F8: pushed to the scan as a string prefix."""
    return _chunks(s, d).filter(F.col("file_path").startswith("src/")).select("repo_id", "file_path").distinct()


@register(f"SELECT cluster_id, growth_rate FROM {_Q_CLUSTERS} WHERE is_flagged OR growth_rate > 0.10")
def spreading_or_filter(s: SparkSession, d: str) -> DataFrame:
    """F7."""
    return cluster.cluster_snapshot(table(s, d, "semantic_clusters")).filter(F.col("is_flagged") | (F.col("growth_rate") > V.SPREADING_GROWTH)).select("cluster_id", "growth_rate")


@register("SELECT a.repo_id AS repo_id, b.repo_id AS other_id FROM repositories a JOIN repositories b ON lower(a.full_name) = lower(b.full_name) AND a.repo_id <= b.repo_id")
def repository_by_name(s: SparkSession, d: str) -> DataFrame:
    """names are equal whatever their case."""
    r = table(s, d, "repositories").select("repo_id", F.lower("full_name").alias("n"))
    return r.join(r.select(F.col("repo_id").alias("other_id"), "n"), "n").filter("repo_id <= other_id").select("repo_id", "other_id")


@register("SELECT repo_id, owner, name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, (SELECT count(DISTINCT commit_id) FROM commits c WHERE c.repo_id = r.repo_id) AS commits FROM repositories r")
def repository_listing(s: SparkSession, d: str) -> DataFrame:
    """B13, J5."""
    n = table(s, d, "commits").groupBy("repo_id").agg(F.countDistinct("commit_id").alias("commits"))
    return table(s, d, "repositories").join(n, "repo_id", "left").select("repo_id", "owner", "name", _stamp("created_at").alias("created"), F.coalesce("commits", F.lit(0)).alias("commits"))


@register(f"""WITH h AS (SELECT repo_id, file_path, m.commit_id, chunk_id, sha256(coalesce(raw_code, '')) AS content_hash, lag(sha256(coalesce(raw_code, ''))) OVER (PARTITION BY c.repo_id, file_path ORDER BY m.committed_at, m.sha, chunk_id) AS before
FROM code_chunks c JOIN {_Q_COMMITS} m USING (commit_id, repo_id) WHERE chunk_type = 'module') SELECT repo_id, file_path, commit_id, chunk_id, content_hash FROM h WHERE content_hash IS DISTINCT FROM before""")
def fingerprint_changes(s: SparkSession, d: str) -> DataFrame:
    """W3, X1, C6 in batch: versions of a file that differ from the one before."""
    c = _chunks(s, d).filter("chunk_type = 'module'").join(_commits(s, d).select("commit_id", "repo_id", "committed_at", "sha"), ["commit_id", "repo_id"])
    c = c.withColumn("content_hash", F.sha2(F.coalesce("raw_code", F.lit("")), 256))
    before = F.lag("content_hash").over(W.partitionBy("repo_id", "file_path").orderBy("committed_at", "sha", "chunk_id"))
    return c.withColumn("before", before).filter(~F.col("content_hash").eqNullSafe(F.col("before"))).select("repo_id", "file_path", "commit_id", "chunk_id", "content_hash")


@register("SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def first_writer_wins(s: SparkSession, d: str) -> DataFrame:
    """K1, K2: the first document of each text."""
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))


@register("""WITH c AS (SELECT DISTINCT sha256(raw_code) AS h FROM code_chunks WHERE raw_code IS NOT NULL AND embedding IS NOT NULL)
SELECT chunk_id, CASE WHEN trim(raw_code) = '' THEN 'blank' WHEN c.h IS NOT NULL THEN 'cached' ELSE 'to_embed' END AS outcome FROM code_chunks k LEFT JOIN c ON c.h = sha256(k.raw_code) WHERE raw_code IS NOT NULL AND embedding IS NULL""")
def embedding_cache_split(s: SparkSession, d: str) -> DataFrame:
    """Chunks without a vector whose text already has one elsewhere."""
    k = _chunks(s, d).filter("raw_code is not null").withColumn("h", F.sha2("raw_code", 256))
    cached = k.filter("embedding is not null").select("h").distinct().withColumn("hit", F.lit(True))
    todo = k.filter("embedding is null").join(cached, "h", "left")
    return todo.select("chunk_id", F.when(F.trim("raw_code") == "", "blank").when(F.col("hit"), "cached").otherwise("to_embed").alias("outcome"))


_Q_SUFFIX = "CASE regexp_extract(lower(filename), '(\\.[^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.LANGUAGE_OF_SUFFIX.items()) + " END"


@register(f"SELECT pr_file_id, {_Q_SUFFIX} AS language FROM (SELECT DISTINCT pr_file_id, filename FROM pr_files)")
def language_routing(s: SparkSession, d: str) -> DataFrame:
    """F10."""
    return table(s, d, "pr_files").select("pr_file_id", "filename").distinct().select("pr_file_id", X.language_of("filename").alias("language"))


@register(
    "SELECT DISTINCT pr_file_id, len(list_intersect(string_split(filename, '/'), ["
    + ", ".join(f"'{x}'" for x in V.SKIP_DIRS)
    + "])) > 0 AS in_dir, regexp_matches(filename, '"
    + "|".join(f"(?:{p})" for p in V.SKIP_PATTERNS)
    + "') AS by_pattern, coalesce(len(list_filter(string_split_regex(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: length(x) > 500)) > 0, false) AS minified FROM pr_files"
)
def skip_rules(s: SparkSession, d: str) -> DataFrame:
    """F11 to F14."""
    f = table(s, d, "pr_files")
    return f.select("pr_file_id", X.in_skipped_dir("filename").alias("in_dir"), X.matches_skip_pattern("filename").alias("by_pattern"), X.is_minified("content").alias("minified")).distinct()


@register(f"WITH {_Q_LINES} SELECT language, count(*) AS lines, sum(length(line)) AS characters, max(line_number) AS longest FROM lines GROUP BY 1")
def line_explode_stats(s: SparkSession, d: str) -> DataFrame:
    """P10."""
    x = X.explode_lines(_chunks(s, d).filter("raw_code is not null"), "raw_code", "language")
    return x.groupBy("language").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters"), F.max("line_number").cast("long").alias("longest"))


def rule_sql(name: str) -> str:
    """Number of the first rule of a detector that fits a line."""
    quote = lambda p: p.replace("'", "''")
    cases = []
    for i, r in enumerate(detectors.RULES):
        if r.detector == name:
            fits = f"regexp_matches(line, '{quote(r.pattern)}')"
            if "(?!" in r.pattern:  # RE2 has no look-ahead
                fits = r"(regexp_matches(line, '\byaml\s*\.\s*load\s*\(') AND NOT regexp_matches(line, '\byaml\s*\.\s*load\s*\(.*Loader\s*=\s*yaml\.(SafeLoader|FullLoader)'))"
            if name == "HARDCODED_SECRET":
                fits += f" AND NOT regexp_matches(regexp_extract(line, '{quote(r.pattern)}'), '{quote(V.PLACEHOLDER)}')"
            cases.append(f"WHEN {fits} THEN {i}" if not r.language else f"WHEN language = '{r.language}' AND {fits} THEN {i}")
    guard = f"NOT regexp_matches(line, '^\\s*{detectors.COMMENTS[name][1:]}')" if name in detectors.COMMENTS else "true"
    if name == "DANGEROUS_FUNCTION":
        guard += " AND NOT contains(line, '# nosec')"
    return f"CASE WHEN {guard} THEN CASE {' '.join(cases)} END END"


def _detector(name: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        """A line detector over all chunks: the first rule that fits."""
        x = X.explode_lines(spread(_code(s, d)), "raw_code", "chunk_id", "language")
        return x.withColumn("rule", detectors.first_rule(name)).filter("rule is not null").select("chunk_id", "line_number", "rule")

    return run


for _key, _name in (("secrets_explicit", "HARDCODED_SECRET"), ("sqli", "SQL_INJECTION"), ("dangerous", "DANGEROUS_FUNCTION"), ("random", "INSECURE_RANDOM"), ("redirect", "OPEN_REDIRECT")):
    register(f"WITH {_Q_LINES_FX}, f AS (SELECT chunk_id, line_number::INT AS line_number, {rule_sql(_name)} AS rule FROM lines) SELECT * FROM f WHERE rule IS NOT NULL", f"detect_{_key}")(_detector(_name))


@register(rf"""WITH {_Q_LINES}, v AS (SELECT chunk_id, line_number::INT AS line_number, unnest(regexp_extract_all(line, '["'']([A-Fa-f0-9]{{32,64}})["'']', 1)) AS value FROM lines),
e AS (SELECT *, -list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: (length(value) - length(replace(value, c, ''))) / length(value) * log2((length(value) - length(replace(value, c, ''))) / length(value)))) AS x FROM v)
SELECT chunk_id, line_number, value, round(x, 6) AS entropy FROM e WHERE round(x, 6) >= 3.0""")
def detect_secrets_entropy(s: SparkSession, d: str) -> DataFrame:
    """D1b, X4 with the plug-in's threshold of 3 bits."""
    return detectors.entropy_findings(spread(_chunks(s, d).select("chunk_id", "raw_code")), "raw_code", "chunk_id", threshold=3.0)


def auth_sql(keys: str) -> str:
    """D4 over ``lines`` for decorators of one line each, as all of the tables are."""
    words = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return rf"""deco AS (SELECT {keys}, line_number, line, line_number - row_number() OVER (PARTITION BY {keys} ORDER BY line_number) AS g FROM lines WHERE language = 'python' AND regexp_matches(line, '^\s*@\w')),
runs AS (SELECT {keys}, g, min(line_number) AS first, max(line_number) AS last, flatten(list(string_split_regex(regexp_extract(line, '@(.*)', 1), '[\s.(]'))) AS names FROM deco GROUP BY ALL),
auth AS (SELECT {keys}, first::INT AS line_number, regexp_extract(line, 'def\s+(\w+)', 1) AS function_name FROM runs JOIN lines l USING ({keys}) WHERE l.line_number = last + 1 AND regexp_matches(line, '^\s*(async )?def ')
AND list_has_any(names, {words(V.ROUTE_DECORATORS)}) AND NOT list_has_any(names, {words(V.AUTH_DECORATORS)}))"""


@register(f"WITH {_Q_LINES_FX}, {auth_sql('chunk_id')} SELECT * FROM auth")
def detect_missing_auth(s: SparkSession, d: str) -> DataFrame:
    """D4."""
    ship(s)
    return detectors.missing_auth(_code(s, d).filter("language = 'python'"), "raw_code", "chunk_id")


_CONFIG = {"naming_conventions": {"python": "snake_case", "ruby": "snake_case", "javascript": "camelCase", "typescript": "camelCase", "java": "camelCase", "go": "camelCase"}}


@register("SELECT chunk_id, 'medium' AS severity, (end_line - start_line + 1)::VARCHAR AS value FROM code_chunks WHERE chunk_type IN ('function','method') AND end_line - start_line + 1 > 50")
def rules_function_length(s: SparkSession, d: str) -> DataFrame:
    """R1."""
    return rules.chunk_violations(_chunks(s, d)).filter("rule_name = 'MAX_FUNCTION_LINES'").drop("rule_name")


@register("SELECT chunk_id, CASE WHEN trunc(complexity_score) > 20 THEN 'high' ELSE 'medium' END AS severity, trunc(complexity_score)::INT::VARCHAR AS value FROM code_chunks WHERE chunk_type IN ('function','method') AND trunc(complexity_score) > 10")
def rules_complexity(s: SparkSession, d: str) -> DataFrame:
    """R2."""
    return rules.chunk_violations(_chunks(s, d)).filter("rule_name = 'MAX_COMPLEXITY'").drop("rule_name")


@register(
    "SELECT chunk_id, 'low' AS severity, chunk_name AS value FROM code_chunks WHERE chunk_name NOT IN ("
    + ", ".join(f"'{x}'" for x in V.EXEMPT_NAMES)
    + ") AND NOT starts_with(chunk_name, '__') AND NOT regexp_matches(chunk_name, CASE WHEN language IN ('python','ruby') THEN '^_?[a-z][a-z0-9_]*$' ELSE '^[a-z][a-zA-Z0-9]*$' END)"
)
def rules_naming(s: SparkSession, d: str) -> DataFrame:
    """R3."""
    return rules.chunk_violations(_chunks(s, d), _CONFIG).filter("rule_name = 'NAMING_CONVENTION'").drop("rule_name")


_FORBIDDEN = {"python": ["logging", "token"], "java": ["java.util"], "ruby": ["token"], "go": ["log", "corp.example/token"]}


@register(
    rf"WITH {_Q_LINES}, i AS (SELECT chunk_id, line_number::INT AS line_number, language, CASE language "
    + " ".join(f"WHEN '{k}' THEN regexp_extract(line, '{V.IMPORTS[k].replace(chr(39), chr(39) * 2)}', 1)" for k in _FORBIDDEN)
    + " END AS imported FROM lines), p AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{p}')" for k, ps in _FORBIDDEN.items() for p in ps)
    + ") t(language, package)) SELECT DISTINCT chunk_id, line_number, package FROM i JOIN p USING (language) WHERE imported <> '' AND (imported = package OR starts_with(imported, package || '.') OR starts_with(imported, package || '/') OR starts_with(imported, package || ':'))"
)
def rules_imports(s: SparkSession, d: str) -> DataFrame:
    """R4, J15."""
    return rules.forbidden_imports(spread(_chunks(s, d).select("chunk_id", "language", "raw_code")), "raw_code", _FORBIDDEN, "chunk_id")


@register("SELECT chunk_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(replace(regexp_replace(chunk_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '[a-zA-Z]{3,}'), lambda x: lower(x))), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + "], x))), ' ') AS tokens FROM code_chunks")
def name_tokens(s: SparkSession, d: str) -> DataFrame:
    """X5."""
    return _chunks(s, d).select("chunk_id", F.array_join(X.name_tokens("chunk_name"), " ").alias("tokens"))


def _branches_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN len(regexp_extract_all(raw_code, '{p}'))" for k, p in V.BRANCHES.items())
    return f"(CASE language {cases} ELSE len(regexp_extract_all(raw_code, '{V.OTHER_BRANCHES}')) END + 1)::INT"


@register(rf"""WITH b AS (SELECT chunk_id, raw_code, language, CASE WHEN language = 'python' THEN array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(raw_code, '\"\"\"[\s\S]*?\"\"\"', '', 'g'), '''''''[\s\S]*?''''''', '', 'g'), '#[^\n]*', '', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^\s*(import |from \S+ import)')), chr(10))
  WHEN language IN ('javascript', 'typescript', 'tsx') THEN array_to_string(list_filter(string_split(regexp_replace(regexp_replace(raw_code, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^\s*import ')), chr(10))
  WHEN language IN ('java', 'go', 'rust', 'c', 'cpp', 'php', 'ruby') THEN regexp_replace(regexp_replace(raw_code, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g') ELSE raw_code END AS t FROM code_chunks WHERE raw_code IS NOT NULL),
w AS (SELECT *, list_transform(regexp_extract_all(t, '\b[a-zA-Z][a-zA-Z0-9_]{{3,}}\b'), lambda x: lower(x)) AS a FROM b)
SELECT chunk_id, len(list_filter(list_distinct(list_concat(a, list_filter(flatten(list_transform(a, lambda x: string_split(x, '_'))), lambda p: length(p) >= 3))), lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in V.STOP_WORDS)}], x)))::INT AS tokens, {_branches_sql()} AS complexity FROM w""")
def body_tokens(s: SparkSession, d: str) -> DataFrame:
    """Distinct body tokens of each chunk."""
    return _chunks(s, d).filter("raw_code is not null").select("chunk_id", F.size(X.body_tokens("raw_code", "language")).alias("tokens"), X.complexity("raw_code", "language").alias("complexity"))


@register("""WITH v AS (SELECT repo_id, 5 AS w FROM code_chunks WHERE chunk_type IN ('function','method') AND end_line - start_line + 1 > 50
UNION ALL SELECT repo_id, CASE WHEN trunc(complexity_score) > 20 THEN 10 ELSE 5 END FROM code_chunks WHERE chunk_type IN ('function','method') AND trunc(complexity_score) > 10)
SELECT repo_id, greatest(0, 100 - coalesce(sum(w), 0)) AS health_score FROM repositories LEFT JOIN v USING (repo_id) GROUP BY 1""")
def health_score(s: SparkSession, d: str) -> DataFrame:
    """A15 of each repository over all its violations; 100 without any."""
    v = review.health_score(rules.chunk_violations(_chunks(s, d), keep=("repo_id",)), "repo_id")
    return table(s, d, "repositories").select("repo_id").join(v, "repo_id", "left").select("repo_id", F.coalesce(F.col("health_score").cast("long"), F.lit(100)).alias("health_score"))


@register("""WITH v AS (SELECT repo_id, 'medium' AS severity FROM code_chunks WHERE chunk_type IN ('function','method') AND end_line - start_line + 1 > 50
UNION ALL SELECT repo_id, CASE WHEN trunc(complexity_score) > 20 THEN 'high' ELSE 'medium' END FROM code_chunks WHERE chunk_type IN ('function','method') AND trunc(complexity_score) > 10)
SELECT repo_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, count(*) AS total FROM v GROUP BY 1""")
def severity_pivot(s: SparkSession, d: str) -> DataFrame:
    """A2, B5."""
    return review.severity_pivot(rules.chunk_violations(_chunks(s, d), keep=("repo_id",)), "repo_id")


@register("""WITH q AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id)::INT AS rank FROM q QUALIFY rank <= 5""")
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    """The five nearest of every fiftieth vector, against all."""
    ship(s)
    e = table(s, d, "embeddings")
    return vectors.top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding")


@register(f"""WITH n AS (SELECT c.chunk_id, k.cluster_id, round(list_cosine_similarity(c.embedding::DOUBLE[], k.centroid), 9) AS s FROM code_chunks c JOIN {_Q_CLUSTERS} k USING (repo_id, language)
WHERE c.embedding IS NOT NULL AND k.centroid IS NOT NULL AND list_sum(list_transform(c.embedding, lambda x: abs(x))) > 0 AND list_sum(list_transform(k.centroid, lambda x: abs(x))) > 0 QUALIFY row_number() OVER (PARTITION BY c.chunk_id ORDER BY s DESC, k.cluster_id) = 1)
SELECT chunk_id, cluster_id, round(s, 4) AS similarity_score FROM n WHERE s >= 0.85""")
def nearest_centroid(s: SparkSession, d: str) -> DataFrame:
    """J10, V2, W4."""
    ship(s)
    return cluster.nearest_centroids(_chunks(s, d), table(s, d, "semantic_clusters"))


@register("""WITH r AS (SELECT DISTINCT cluster_id, chunk_id FROM cluster_memberships), m AS (SELECT cluster_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM r JOIN code_chunks USING (chunk_id) WHERE embedding IS NOT NULL),
c AS (SELECT cluster_id, i, avg(x) AS x, count(*) AS n FROM m GROUP BY ALL) SELECT cluster_id, max(n) AS members, round(sqrt(sum(x * x)), 4) AS centroid_norm FROM c GROUP BY 1""")
def centroids(s: SparkSession, d: str) -> DataFrame:
    """The mean vector of each cluster, by its length."""
    rows = table(s, d, "cluster_memberships").select("cluster_id", "chunk_id").distinct().join(_chunks(s, d).select("chunk_id", "embedding"), "chunk_id")
    m = vectors.mean_vectors(rows, "cluster_id", "embedding", 12)
    return m.select("cluster_id", "members", F.round(F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("centroid_norm"))


@register(f"""WITH n AS (SELECT cluster_id, count(*) AS new_count, count(DISTINCT file_path) AS new_files FROM (SELECT DISTINCT cluster_id, chunk_id FROM cluster_memberships) JOIN code_chunks USING (chunk_id) GROUP BY 1),
g AS (SELECT k.cluster_id, coalesce(new_count, 0) AS new_count, coalesce(new_files, 0) AS new_files, CASE WHEN chunk_count > 0 THEN (coalesce(new_count, 0) - chunk_count) / chunk_count ELSE 0 END AS x FROM {_Q_CLUSTERS} k LEFT JOIN n USING (cluster_id))
SELECT cluster_id, new_count, new_files, round(x, 4) AS growth, x > 0.20 AND new_count >= 3 AS flagged FROM g""")
def cluster_growth(s: SparkSession, d: str) -> DataFrame:
    """V8, A4, W8."""
    return cluster.cluster_growth(table(s, d, "semantic_clusters"), table(s, d, "cluster_memberships"), _chunks(s, d))


@register()
def centroid_hashes(s: SparkSession, d: str) -> DataFrame:
    """X2."""
    ship(s)
    return cluster.centroid_hash(cluster.cluster_snapshot(table(s, d, "semantic_clusters")).filter("centroid is not null"), "cluster_id", "centroid")


def debt_impact(s: SparkSession, d: str) -> DataFrame:
    """The clusters that the chunks of each commit would grow most."""
    ship(s)
    new = _chunks(s, d).filter(F.col("raw_code").rlike(r"\S"))
    clusters = table(s, d, "semantic_clusters")
    joined = cluster.nearest_centroids(new, clusters).join(new.select("chunk_id", "repo_id", "commit_id"), "chunk_id")
    return review.debt_impact(joined, cluster.cluster_snapshot(clusters), table(s, d, "cluster_memberships"), _chunks(s, d), _commits(s, d))


@register()
def semantic_duplicates(s: SparkSession, d: str) -> DataFrame:
    """For every fiftieth function, close functions elsewhere in its repository that pass the gate."""
    ship(s)
    twins = fixtures.frame(s, "twins").withColumn("embedding", F.split("embedding", ",").cast("array<float>"))
    f = _chunks(s, d).select(*twins.columns).unionByName(twins).filter(F.col("chunk_type").isin("function", "method") & (F.trim("raw_code") != ""))
    q = review.embeddable(f).filter(F.pmod(F.crc32("chunk_id"), F.lit(50)) == 0)
    near = vectors.pairs_within(review.without_copies(f), q, "chunk_id", "embedding", ("repo_id", "language"), 0.03, "file_path")
    return review.semantic_duplicates(near, f)


@register("SELECT chunk_id, array_to_string(string_split(raw_code, chr(10))[1:5], chr(10)) AS head FROM code_chunks WHERE raw_code IS NOT NULL AND chunk_type = 'module'")
def raw_code_slice(s: SparkSession, d: str) -> DataFrame:
    """The first five lines of each whole file."""
    m = _chunks(s, d).filter("raw_code is not null and chunk_type = 'module'")
    return m.select("chunk_id", F.array_join(F.slice(F.split("raw_code", "\n", -1), 1, 5), "\n").alias("head"))


@register(f"WITH allc AS (SELECT chunk_id, repo_id, commit_id, file_path, chunk_type, start_line, end_line, raw_code FROM code_chunks UNION ALL SELECT chunk_id, repo_id, commit_id, file_path, chunk_type, start_line, end_line, raw_code FROM {fixtures.sql('twins')})," + r"""m AS (SELECT repo_id, commit_id, file_path, arg_min(raw_code, chunk_id) AS whole FROM allc WHERE chunk_type = 'module' AND raw_code IS NOT NULL GROUP BY ALL),
n AS (SELECT chunk_id, regexp_replace(array_to_string(string_split_regex(whole, '\r\n|\r|\n')[greatest(1, start_line):end_line], chr(10)), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '') AS raw_code
  FROM allc c JOIN m USING (repo_id, commit_id, file_path) WHERE c.raw_code IS NULL AND end_line >= greatest(1, start_line))
SELECT chunk_id, raw_code FROM n WHERE raw_code <> ''""")
def raw_code_backfill(s: SparkSession, d: str) -> DataFrame:
    """The code of every chunk without one, cut out of its whole file."""
    cols = ["chunk_id", "repo_id", "commit_id", "file_path", "chunk_type", "start_line", "end_line", "raw_code"]
    return tables.backfill_code(_chunks(s, d).select(*cols).unionByName(fixtures.frame(s, "twins").select(*cols)))


@register("SELECT commit_id, left(sha, 8) AS short_sha, left(string_split(message, chr(10))[1], 80) AS first_line FROM (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at, sha) = 1)")
def commit_titles(s: SparkSession, d: str) -> DataFrame:
    """P2, X21."""
    return _commits(s, d).select("commit_id", F.substring("sha", 1, 8).alias("short_sha"), F.substring(F.split("message", "\n")[0], 1, 80).alias("first_line"))


@register(f"SELECT author, count(*) AS commits, count(DISTINCT repo_id) AS repositories, sum(files_changed) AS files FROM (SELECT lower(author_name) AS author, repo_id, files_changed FROM {_Q_COMMITS}) GROUP BY 1")
def author_rollup(s: SparkSession, d: str) -> DataFrame:
    """Distinct authors whatever the case of their names."""
    g = _commits(s, d).groupBy(F.lower("author_name").alias("author"))
    return g.agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("repo_id").alias("repositories"), F.sum("files_changed").alias("files"))


@register("SELECT commit_id FROM commits WHERE contains(lower(message), 'fix') OR contains(lower(author_name), 'an') GROUP BY 1")
def ui_text_search(s: SparkSession, d: str) -> DataFrame:
    """a search over several columns, whatever the case."""
    return table(s, d, "commits").filter(F.lower("message").contains("fix") | F.lower("author_name").contains("an")).select("commit_id").distinct()


@register("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def events_rollup(s: SparkSession, d: str) -> DataFrame:
    """C1 in batch: events by route."""
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("SELECT task_id, count(*) AS retries FROM (SELECT DISTINCT * FROM pipeline_events) WHERE status = 'failed' AND task_id <> '' GROUP BY 1")
def failed_tasks(s: SparkSession, d: str) -> DataFrame:
    """Failed tasks and how often."""
    return table(s, d, "pipeline_events").distinct().filter("status = 'failed' and task_id <> ''").groupBy("task_id").agg(F.count(F.lit(1)).alias("retries"))


@register("SELECT chunk_id FROM code_chunks WHERE chunk_type IN ('function','method') AND trim(raw_code) <> '' AND end_line - start_line + 1 >= 20 AND complexity_score >= 3")
def embeddable_chunks(s: SparkSession, d: str) -> DataFrame:
    """F15."""
    ok = (F.trim("raw_code") != "") & (F.col("end_line") - F.col("start_line") + 1 >= V.MIN_LINES) & (F.col("complexity_score") >= V.MIN_COMPLEXITY)
    return _chunks(s, d).filter(F.col("chunk_type").isin("function", "method") & ok).select("chunk_id")


@register()
def python_chunks(s: SparkSession, d: str) -> DataFrame:
    """Functions and classes of the whole Python files."""
    ship(s)
    files = _chunks(s, d).filter("chunk_type = 'module' and language = 'python'")
    return chunker.chunk_files(spread(files.select("chunk_id", "file_path", "raw_code")), "file_path", "raw_code", "chunk_id")


@register()
def file_chunks(s: SparkSession, d: str) -> DataFrame:
    """Functions and classes of the whole files of every language, as history is cut."""
    ship(s)
    files = _chunks(s, d).filter("chunk_type = 'module'")
    return chunker.chunk_files(spread(files.select("chunk_id", "file_path", "raw_code")), "file_path", "raw_code", "chunk_id")


@register()
def pr_chunks(s: SparkSession, d: str) -> DataFrame:
    """Functions and methods of the files of pull requests, nested ones too."""
    ship(s)
    files = table(s, d, "pr_files").select("pr_file_id", "filename", "content").distinct()
    return chunker.chunk_files(spread(files), "filename", "content", "pr_file_id", mode="review")
