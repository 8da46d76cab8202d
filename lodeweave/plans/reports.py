"""Reports, scans, sinks and scalar expressions over the tables of code history, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.functions import scalars as S
from lodeweave.operators import cluster, debt, tables, vectors
from lodeweave.plans import fixtures, queries
from lodeweave.plans.registry import register
from lodeweave.session import ship, table
from lodeweave.sources import commits as C

_Q_COMMITS, _Q_CLUSTERS, _Q_VELOCITY, _Q_SCORES = queries._Q_COMMITS, queries._Q_CLUSTERS, queries._Q_VELOCITY, queries._Q_SCORES


def _clusters(s: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_snapshot(table(s, d, "semantic_clusters"))


def _place(df: DataFrame, keys: list[str], *order, most: int | None = None) -> DataFrame:
    out = df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return out if most is None else out.filter(F.col("place") <= most)


@register("SELECT repo_id, file_path, row_number() OVER (PARTITION BY repo_id ORDER BY file_path)::INT AS place FROM (SELECT DISTINCT repo_id, file_path FROM code_chunks) QUALIFY place <= 200")
def file_list(s: SparkSession, d: str) -> DataFrame:
    """The first two hundred files of each repository by path."""
    return _place(table(s, d, "code_chunks").select("repo_id", "file_path").distinct(), ["repo_id"], "file_path", most=200)


@register(f"""WITH {_Q_VELOCITY}, g AS (SELECT repo_id, file_path, language, max(total_score) AS max_score, max(velocity) AS max_velocity FROM vel WHERE starts_with(file_path, 'src/') GROUP BY ALL)
SELECT repo_id, file_path, language, max_score, max_velocity, {queries._Q_STATUS}, round(least(100, abs(max_velocity) / 20 * 100), 4) AS bar, row_number() OVER (PARTITION BY repo_id ORDER BY max_velocity DESC, file_path, language)::INT AS place FROM g QUALIFY place <= 200""")
def velocity_heatmap(s: SparkSession, d: str, prefix: str = "src/") -> DataFrame:
    """The two hundred fastest files below a directory in each repository."""
    v = queries._velocity(s, d).filter(F.col("file_path").startswith(prefix)).groupBy("repo_id", "file_path", "language")
    g = v.agg(F.max("total_score").alias("max_score"), F.max("velocity").alias("max_velocity")).withColumn("status", debt.velocity_status("max_velocity")).withColumn("bar", F.round(S.velocity_bar("max_velocity"), 4))
    return _place(g, ["repo_id"], F.col("max_velocity").desc(), "file_path", "language", most=200)


@register(f"SELECT cluster_id, growth_rate, CASE WHEN growth_rate >= 0.30 THEN 'red' WHEN growth_rate >= 0.10 THEN 'amber' ELSE 'green' END AS colour, round(greatest(6, 40 * growth_rate + 6), 4) AS radius, (growth_rate * 100)::DECIMAL(18, 6)::DOUBLE >= 0 AS rising, trunc(growth_rate * 100)::INT AS percent FROM {_Q_CLUSTERS}")
def cluster_bubbles(s: SparkSession, d: str) -> DataFrame:
    """Colour, radius and percentage of each cluster."""
    g = F.col("growth_rate")
    return _clusters(s, d).select("cluster_id", "growth_rate", S.growth_colour("growth_rate").alias("colour"), F.round(S.bubble_radius("growth_rate"), 4).alias("radius"), (g * 100 >= 0).alias("rising"), S.percent("growth_rate").alias("percent"))


_SORTS = {"growth": "growth_rate DESC", "files": "file_count DESC", "chunks": "chunk_count DESC", "date": "first_seen_at DESC", "chunks_up": "chunk_count"}


@register(" UNION ALL ".join(f"(SELECT '{k}' AS sort, cluster_id, row_number() OVER (ORDER BY {o}, cluster_id)::INT AS place FROM {_Q_CLUSTERS} QUALIFY place <= 10)" for k, o in _SORTS.items()))
def cluster_sorts(s: SparkSession, d: str) -> DataFrame:
    """The first ten clusters under each sort option, each a top-k without a full sort."""
    c = _clusters(s, d).persist()
    out = None
    for name, order in _SORTS.items():
        by = F.col(order.split()[0])
        top = c.orderBy(by.desc() if order.endswith("DESC") else by, "cluster_id").limit(10)
        one = top.select(F.lit(name).alias("sort"), "cluster_id", F.row_number().over(W.orderBy(by.desc() if order.endswith("DESC") else by, "cluster_id")).alias("place"))  # ten rows
        out = one if out is None else out.unionByName(one)
    return out


@register("SELECT event_id, lower(stage) AS stage, row_number() OVER (PARTITION BY lower(stage) ORDER BY created_at DESC, event_id)::INT AS place FROM (SELECT DISTINCT * FROM pipeline_events) QUALIFY place <= 20")
def live_events(s: SparkSession, d: str) -> DataFrame:
    """The newest twenty events of each stage."""
    e = table(s, d, "pipeline_events").distinct().select("event_id", F.lower("stage").alias("stage"), "created_at")
    return _place(e, ["stage"], F.col("created_at").desc(), "event_id", most=20).drop("created_at")


@register("SELECT chunk_id FROM code_chunks WHERE embedding IS NOT NULL ORDER BY sha256(chunk_id || ':42'), chunk_id LIMIT 50000")
def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    """Fifty thousand rows without replacement, the same for the same seed, as a top-k by a keyed hash."""
    return tables.seeded_sample(table(s, d, "code_chunks").filter("embedding is not null").select("chunk_id"), "chunk_id", 50000, 42)


@register(f"SELECT id, coalesce(epoch(try_cast(stamp AS TIMESTAMPTZ))::BIGINT, -1) AS seconds FROM {fixtures.sql('stamps')}")
def iso_timestamps(s: SparkSession, d: str) -> DataFrame:
    """ISO texts as timestamps; what cannot be read takes the given default, here the second before 1970."""
    f = fixtures.frame(s, "stamps")
    return f.select("id", F.unix_seconds(S.iso_timestamp("stamp", F.timestamp_seconds(F.lit(-1)))).alias("seconds"))


@register(f"SELECT commit_id, strftime(to_timestamp(epoch(committed_at)::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM {_Q_COMMITS}")
def epoch_timestamps(s: SparkSession, d: str) -> DataFrame:
    """Seconds since 1970 as UTC time."""
    c = queries._commits(s, d).select("commit_id", F.unix_seconds(F.col("committed_at").cast("timestamp")).alias("epoch"))
    return c.select("commit_id", F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@register(f"SELECT u.url, coalesce(starts_with(u.url, 'https://') AND contains(u.url, 'github.com/'), false) AS ok FROM (SELECT 'https://github.com/' || full_name AS url FROM repositories UNION ALL SELECT url FROM {fixtures.sql('urls')}) u")
def url_guard(s: SparkSession, d: str) -> DataFrame:
    """Which clone addresses are allowed."""
    u = table(s, d, "repositories").select(F.concat(F.lit("https://github.com/"), "full_name").alias("url")).unionByName(fixtures.frame(s, "urls").select("url"))
    return u.select("url", S.url_allowed("url").alias("ok"))


@register("SELECT origin_commit_id AS commit_id, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters, count(*) AS n FROM (SELECT DISTINCT origin_commit_id, cluster_id FROM semantic_clusters WHERE origin_commit_id IS NOT NULL) GROUP BY 1")
def clusters_of_commits(s: SparkSession, d: str) -> DataFrame:
    """The clusters that began with each commit as a list."""
    c = table(s, d, "semantic_clusters").filter("origin_commit_id is not null").select(F.col("origin_commit_id").alias("commit_id"), "cluster_id").distinct()
    return c.groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_list("cluster_id")), ",").alias("clusters"), F.count(F.lit(1)).alias("n"))


@register(f"""{queries._Q_BLAME} SELECT left(b.sha, 8) AS commit_sha, author_name, author_email, strftime(committed_at, '%Y-%m-%dT%H:%M:%S') AS committed_at, left(string_split(message, chr(10))[1], 80) AS message, round(debt_introduced_score, 2) AS debt_introduced_score,
patterns_originated, files_eventually_affected FROM blame b JOIN {_Q_COMMITS} USING (commit_id) ORDER BY b.debt_introduced_score DESC, commit_id LIMIT 100""")
def blame_csv(s: SparkSession, d: str) -> DataFrame:
    """The rows and the eight columns that ``tables.export_csv`` writes."""
    b = queries._blame(s, d).orderBy(F.col("debt_introduced_score").desc(), "commit_id").limit(100)
    m = queries._commits(s, d).select("commit_id", "author_name", "author_email", "committed_at", "message")
    return b.join(m, "commit_id").select(
        F.substring("sha", 1, 8).alias("commit_sha"), "author_name", "author_email", F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("committed_at"), F.substring(F.split("message", "\n")[0], 1, 80).alias("message"),
        F.round("debt_introduced_score", 2).alias("debt_introduced_score"), "patterns_originated", "files_eventually_affected",
    )


@register("""SELECT '{"success":true,"data":' || json_object('repo_id', repo_id, 'full_name', full_name) || ',"meta":{},"error":null}' AS body FROM repositories""")
def json_envelope(s: SparkSession, d: str) -> DataFrame:
    """K6: each row inside the response envelope."""
    return table(s, d, "repositories").select(S.envelope(F.struct("repo_id", "full_name")).alias("body"))


@register("""WITH e AS (SELECT DISTINCT * FROM pipeline_events WHERE task_id <> ''), l AS (SELECT *, count(*) FILTER (status = 'failed') OVER (PARTITION BY task_id) AS retries, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, event_id DESC) AS n FROM e)
SELECT task_id, lower(stage) AS stage, left(error_message, 2000) AS error_message, retries FROM l WHERE n = 1 AND status = 'failed'""")
def dead_letters(s: SparkSession, d: str) -> DataFrame:
    """K9: tasks whose last event is a failure, as rows for the table of failed tasks."""
    return tables.dead_letters(table(s, d, "pipeline_events").distinct())


@register("""WITH p AS (SELECT pr_file_id, pr_id, fetched_at FROM pr_files), t AS (SELECT DISTINCT pr_file_id FROM p WHERE fetched_at < TIMESTAMP '2024-06-01'), n AS (SELECT * FROM p WHERE fetched_at >= TIMESTAMP '2024-05-01')
SELECT DISTINCT pr_file_id, pr_id FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.pr_file_id = n.pr_file_id)""")
def insert_new_pr_files(s: SparkSession, d: str) -> DataFrame:
    """K1: of the files fetched since May 2024 those that a table of the files fetched until June 2024 lacks."""
    f = table(s, d, "pr_files").select("pr_file_id", "pr_id", "fetched_at")
    new = tables.insert_if_absent(f.filter("fetched_at < timestamp_ntz'2024-06-01 00:00:00'"), f.filter("fetched_at >= timestamp_ntz'2024-05-01 00:00:00'"), ["pr_file_id"], ["fetched_at", "pr_id"])
    return new.select("pr_file_id", "pr_id")


_Q_AFTER = f"""m AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at, sha) AS n FROM {_Q_COMMITS}),
cp AS (SELECT r.repo_id, max(n) AS done FROM repositories r JOIN m ON m.repo_id = r.repo_id AND m.sha = r.last_analyzed_commit GROUP BY 1),
todo AS (SELECT m.* FROM m LEFT JOIN cp USING (repo_id) WHERE n > coalesce(done, 0))"""


def _todo(s: SparkSession, d: str) -> DataFrame:
    return C.commits_after(queries._commits(s, d), table(s, d, "repositories"), "last_analyzed_commit")


@register(f"WITH {_Q_AFTER} SELECT repo_id, commit_id, n::INT AS ordinal FROM todo")
def commits_to_scan(s: SparkSession, d: str) -> DataFrame:
    """Commits after each repository's checkpoint; all of them where the checkpoint is missing."""
    return _todo(s, d).select("repo_id", "commit_id", "ordinal")


@register("SELECT DISTINCT pr_id, filename, CASE status WHEN 'added' THEN 'A' WHEN 'modified' THEN 'M' WHEN 'renamed' THEN 'R' END AS change FROM pr_files WHERE status IN ('added', 'modified', 'renamed')")
def changed_files(s: SparkSession, d: str) -> DataFrame:
    """S3: added, modified and renamed files; removed ones are not read."""
    return C.changed_files(table(s, d, "pr_files"), "status").select("pr_id", "filename", "change").distinct()


@register("SELECT repo_id, github_pr_number, filename, pr_file_id FROM pr_files QUALIFY row_number() OVER (PARTITION BY repo_id, github_pr_number, filename ORDER BY fetched_at DESC, pr_file_id) = 1")
def pr_file_source(s: SparkSession, d: str) -> DataFrame:
    """The file of each pull request as fetched last."""
    return C.latest(table(s, d, "pr_files"), ["repo_id", "github_pr_number", "filename"], "fetched_at", "pr_file_id").select("repo_id", "github_pr_number", "filename", "pr_file_id")


@register(f"WITH {_Q_VELOCITY}, {_Q_AFTER} SELECT v.repo_id, v.commit_id, file_path, total_score, velocity FROM vel v JOIN todo t ON t.commit_id = v.commit_id")
def debt_run(s: SparkSession, d: str) -> DataFrame:
    """The scores of the unscanned commits only, with the last scores of the scanned ones as what went before."""
    chunks, todo = table(s, d, "code_chunks"), _todo(s, d).select("commit_id")
    commits = queries._commits(s, d)
    done = chunks.join(todo, "commit_id", "left_anti").select("commit_id").distinct()
    fresh = chunks.join(todo, "commit_id", "left_semi")
    return debt.debt_run(queries._scores(s, d).join(done, "commit_id", "left_semi"), fresh, table(s, d, "cluster_memberships"), queries._violations(s, d).join(todo, "commit_id", "left_semi"), commits)


@register("""WITH r AS (SELECT DISTINCT cluster_id, chunk_id FROM cluster_memberships), e AS (SELECT cluster_id, chunk_id, embedding::DOUBLE[] AS e FROM r JOIN code_chunks USING (chunk_id) WHERE embedding IS NOT NULL),
u AS (SELECT cluster_id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM e), m AS (SELECT cluster_id, i, round(avg(x), 12) AS x FROM u GROUP BY ALL), c AS (SELECT cluster_id, list(x ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT cluster_id, chunk_id, CASE WHEN list_sum(list_transform(e, lambda x: x * x)) * list_sum(list_transform(c, lambda x: x * x)) > 0 THEN list_cosine_similarity(e, c) ELSE 0 END AS x FROM e JOIN c USING (cluster_id))
SELECT cluster_id, chunk_id, round(greatest(0, least(1, x)), 4) AS similarity_score FROM s""")
def membership_similarity(s: SparkSession, d: str) -> DataFrame:
    """V7."""
    return cluster.membership_similarity(table(s, d, "cluster_memberships"), table(s, d, "code_chunks"))


_Q_NEAREST = f"""near AS (SELECT c.chunk_id, c.repo_id, c.commit_id, k.cluster_id, round(list_cosine_similarity(c.embedding::DOUBLE[], k.centroid), 9) AS s FROM code_chunks c JOIN {_Q_CLUSTERS} k USING (repo_id, language)
WHERE regexp_matches(raw_code, '\\S') AND c.embedding IS NOT NULL AND k.centroid IS NOT NULL AND list_sum(list_transform(c.embedding, lambda x: abs(x))) > 0 AND list_sum(list_transform(k.centroid, lambda x: abs(x))) > 0 QUALIFY row_number() OVER (PARTITION BY c.chunk_id ORDER BY s DESC, k.cluster_id) = 1)"""


@register(f"""WITH {_Q_NEAREST}, h AS (SELECT repo_id, commit_id, cluster_id, count(*) AS joining FROM near WHERE s >= 0.85 GROUP BY ALL),
g AS (SELECT h.*, k.chunk_count, k.file_count, k.language, k.label, k.origin_commit_id, round(joining / greatest(k.chunk_count, 1), 4) AS growth FROM h JOIN {_Q_CLUSTERS} k USING (cluster_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY repo_id, commit_id ORDER BY growth DESC, cluster_id)::INT AS rank FROM g WHERE growth >= 0.05 QUALIFY rank <= 5),
w AS (SELECT cluster_id, chunk_name FROM cluster_memberships JOIN code_chunks USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY similarity_score DESC, chunk_id) = 1)
SELECT t.repo_id, t.commit_id, rank, cluster_id, coalesce(nullif(label, ''), 'Cluster ' || left(cluster_id, 8)) AS label, language, joining, chunk_count, file_count, growth, chunk_name AS representative, left(m.sha, 8) AS origin_sha, CASE WHEN growth >= 0.30 THEN 'high' ELSE 'medium' END AS severity
FROM t LEFT JOIN w USING (cluster_id) LEFT JOIN {_Q_COMMITS} m ON m.commit_id = t.origin_commit_id""")
def debt_impact(s: SparkSession, d: str) -> DataFrame:
    """The clusters that the chunks of each commit would grow most."""
    return queries.debt_impact(s, d)


@register(f"""WITH RECURSIVE v AS (SELECT chunk_id, repo_id, language, embedding::DOUBLE[] AS e FROM code_chunks WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS MATERIALIZED (SELECT a.chunk_id AS a, b.chunk_id AS b FROM v a JOIN v b USING (repo_id, language) WHERE a.chunk_id <> b.chunk_id AND list_cosine_similarity(a.e, b.e) >= 0.85 - 1e-12),
cores AS MATERIALIZED (SELECT a FROM links GROUP BY a HAVING count(*) >= 2), inner_ AS MATERIALIZED (SELECT a, b FROM links SEMI JOIN cores USING (a) WHERE b IN (SELECT a FROM cores)),
reach AS (SELECT a, a AS b FROM cores UNION SELECT r.a, i.b FROM reach r JOIN inner_ i ON r.b = i.a), lab AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1)
SELECT id, cluster, true AS is_core FROM lab UNION ALL SELECT l.a, min(lab.cluster), false FROM links l JOIN lab ON lab.id = l.b WHERE l.a NOT IN (SELECT a FROM cores) GROUP BY 1""")
def dbscan_labels(s: SparkSession, d: str) -> DataFrame:
    """Density clusters of each repository and language."""
    ship(s)
    return cluster.dbscan(table(s, d, "code_chunks"), "chunk_id", "embedding")


@register()
def clustering_run(s: SparkSession, d: str) -> DataFrame:
    """V9: the whole run over every repository and language: density clusters, centroids, identities, new clusters, growth and flags."""
    ship(s)
    return cluster.clustering_run(table(s, d, "code_chunks"), table(s, d, "semantic_clusters"), queries._commits(s, d))


@register(f"""WITH a AS (SELECT DISTINCT chunk_id FROM cluster_memberships), {_Q_NEAREST.replace("regexp_matches(raw_code, '\\S')", "c.chunk_id NOT IN (SELECT chunk_id FROM a)")}
SELECT chunk_id, cluster_id, round(s, 4) AS similarity_score FROM near WHERE s >= 0.85""")
def fast_assignment(s: SparkSession, d: str) -> DataFrame:
    """Chunks without a cluster join the nearest centroid of their repository and language."""
    ship(s)
    return cluster.fast_assignment(table(s, d, "code_chunks"), table(s, d, "semantic_clusters"), table(s, d, "cluster_memberships"))


@register(f"""WITH r AS (SELECT DISTINCT cluster_id, chunk_id FROM cluster_memberships), u AS (SELECT cluster_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM r JOIN code_chunks USING (chunk_id) WHERE embedding IS NOT NULL),
m AS (SELECT cluster_id, i, round(avg(x), 12) AS x FROM u GROUP BY ALL), c AS (SELECT cluster_id AS new_id, list(x ORDER BY i) AS c FROM m GROUP BY 1), k AS (FROM {_Q_CLUSTERS}),
f AS (SELECT new_id, repo_id, language, c FROM c JOIN k ON k.cluster_id = new_id), n AS (SELECT new_id, k.cluster_id, round(list_cosine_similarity(c, k.centroid), 9) AS s FROM f JOIN k USING (repo_id, language)
  WHERE k.centroid IS NOT NULL AND list_sum(list_transform(c, lambda x: abs(x))) > 0 AND list_sum(list_transform(k.centroid, lambda x: abs(x))) > 0 QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY s DESC, k.cluster_id) = 1)
SELECT f.new_id, n.cluster_id AS continues, round(n.s, 4) AS similarity_score FROM f LEFT JOIN n ON n.new_id = f.new_id AND n.s >= 0.98""")
def centroid_match(s: SparkSession, d: str) -> DataFrame:
    """V4 to V6: the mean of each cluster's members today against the stored centroids of its repository and language."""
    ship(s)
    stored = table(s, d, "semantic_clusters")
    rows = table(s, d, "cluster_memberships").select("cluster_id", "chunk_id").distinct().join(table(s, d, "code_chunks").filter("embedding is not null").select("chunk_id", "embedding"), "chunk_id")
    fresh = vectors.mean_vectors(rows, "cluster_id", "embedding", 12).join(_clusters(s, d).select("cluster_id", "repo_id", "language"), "cluster_id")
    return cluster.match_identities(fresh.withColumnRenamed("cluster_id", "new_id"), stored)


@register()
def missing_embeddings(s: SparkSession, d: str) -> DataFrame:
    """Chunks without a vector: that of the cache, else of the model (here hashed words), unit length."""
    ship(s)
    return C.embed_missing(table(s, d, "code_chunks"), C.hashed_words_model)


