"""Pull-request review: duplicates of changed chunks, impact on clusters, health, comment selection, added lines."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.functions import fixed_values as V
from lodeweave.functions.text import app_of, blended_similarity, body_tokens, code_tokens, file_role, jaccard, name_tokens


def severity_rank(c: str) -> Column:
    """Critical 0 to info 4, others 99."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, s in enumerate(V.SEVERITIES) for x in (s, i)]), F.col(c)), F.lit(99))


def health_score(findings: DataFrame, key: str) -> DataFrame:
    """100 less the weights of all findings, not below 0; repeated findings count each."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.SEVERITY_WEIGHTS.items() for x in kv]), F.col("severity")), F.lit(0))
    return findings.groupBy(key).agg(F.greatest(F.lit(0), F.lit(100) - F.sum(weight)).alias("health_score"))


def severity_pivot(findings: DataFrame, key: str) -> DataFrame:
    """A2: one column per severity, 0 where there is none, and the total; one pass of conditional counts."""
    return findings.groupBy(key).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES), F.count(F.lit(1)).alias("total"))


def duplicate_gate(a: str = "a", b: str = "b") -> Column:
    """Other app, compatible role, line ratio, a common name token and enough of the name in the body."""
    c = lambda side, n: F.col(f"{side}.{n}")
    same_app = F.coalesce(app_of(c(a, "file_path")) == app_of(c(b, "file_path")), F.lit(False))
    ra, rb = file_role(c(a, "file_path")), file_role(c(b, "file_path"))
    role = (ra == rb) | (ra == "other") | (rb == "other")
    la = F.greatest(F.lit(1), c(a, "end_line") - c(a, "start_line") + 1)
    lb = F.greatest(F.lit(1), c(b, "end_line") - c(b, "start_line") + 1)
    na, nb = name_tokens(c(a, "chunk_name")), name_tokens(c(b, "chunk_name"))
    body = body_tokens(c(a, "raw_code"), c(a, "language"))
    enough = (F.size(body) == 0) | (F.size(F.array_intersect(body, nb)) >= V.MIN_BODY_OVERLAP * F.size(nb))
    return ~same_app & role & (F.greatest(la, lb) <= V.MAX_LINE_RATIO * F.least(la, lb)) & (F.size(na) > 0) & (F.size(nb) > 0) & F.arrays_overlap(na, nb) & enough


def embeddable(chunks: DataFrame) -> DataFrame:
    """chunks with code, of enough lines and complexity."""
    return chunks.filter((F.trim("raw_code") != "") & (F.col("end_line") - F.col("start_line") + 1 >= V.MIN_LINES) & (F.col("complexity_score") >= V.MIN_COMPLEXITY))


def without_copies(chunks: DataFrame) -> DataFrame:
    """The least id of chunks that agree in file, name, lines, code and vector: they give the same match, of which one is kept anyway."""
    same = ["repo_id", "language", "file_path", "chunk_name", F.col("end_line") - F.col("start_line"), F.sha2("raw_code", 256), "embedding"]
    return chunks.groupBy(*same).agg(F.min("chunk_id").alias("chunk_id")).select("repo_id", "language", "file_path", "embedding", "chunk_id")


def semantic_duplicates(pairs: DataFrame, chunks: DataFrame, keep: int = 5) -> DataFrame:
    """V10 on all pairs (``query_id``, ``id``, ``cosine``) within the distance: gate, one per (file, name), blended score, the best ``keep``."""
    cols = ["chunk_id", "file_path", "chunk_name", "language", "start_line", "end_line", "raw_code"]
    a, b = chunks.select(*cols).alias("a"), chunks.select(*cols).alias("b")
    j = pairs.alias("p").join(a, F.col("p.query_id") == F.col("a.chunk_id")).join(b, F.col("p.id") == F.col("b.chunk_id")).filter((F.col("a.file_path") != F.col("b.file_path")) & duplicate_gate())
    tokens = jaccard(code_tokens(F.col("a.raw_code"), F.col("a.language")), code_tokens(F.col("b.raw_code"), F.col("b.language")))
    out = j.select("p.query_id", "p.id", "p.cosine", F.col("b.file_path").alias("similar_file"), F.col("b.chunk_name").alias("similar_chunk"), blended_similarity(F.col("p.cosine"), tokens, F.col("b.raw_code")).alias("similarity"))
    one = W.partitionBy("query_id", "similar_file", "similar_chunk").orderBy(F.col("cosine").desc(), "id")
    best = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    out = out.withColumn("_n", F.row_number().over(one)).filter("_n = 1").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep)
    return out.filter("similarity is not null").drop("_n")


def debt_impact(joined: DataFrame, clusters: DataFrame, memberships: DataFrame, chunks: DataFrame, commits: DataFrame, keys: tuple[str, ...] = ("repo_id", "commit_id"), min_growth: float = 0.05, keep: int = 5) -> DataFrame:
    """For each change (``keys``) the ``keep`` clusters that its joining chunks (``chunk_id``, ``cluster_id``) would grow most.

    W5: a cluster is represented by its stored member of highest similarity, ties to the smaller id; null where it has none.
    """
    hits = joined.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("joining"))
    growth = F.round(F.col("joining") / F.greatest(F.col("chunk_count"), F.lit(1)), 4)
    out = hits.join(clusters.select("cluster_id", "chunk_count", "file_count", "language", "label", "origin_commit_id"), "cluster_id").withColumn("growth", growth).filter(F.col("growth") >= min_growth)
    best = W.partitionBy(*keys).orderBy(F.col("growth").desc(), "cluster_id")
    out = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    members = memberships.select("cluster_id", "chunk_id", "similarity_score").join(chunks.select("chunk_id", "chunk_name"), "chunk_id")
    first = W.partitionBy("cluster_id").orderBy(F.col("similarity_score").desc(), "chunk_id")
    members = members.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("cluster_id", F.col("chunk_name").alias("representative"))
    origins = commits.select(F.col("commit_id").alias("origin_commit_id"), F.substring("sha", 1, 8).alias("origin_sha"))
    out = out.join(members, "cluster_id", "left").join(origins, "origin_commit_id", "left")
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("Cluster "), F.substring("cluster_id", 1, 8)))
    severity = F.when(F.col("growth") >= 0.30, "high").otherwise("medium")
    return out.select(*keys, "rank", "cluster_id", label.alias("label"), "language", "joining", "chunk_count", "file_count", "growth", "representative", "origin_sha", severity.alias("severity"))


def impact_score(impacts: DataFrame) -> DataFrame:
    """Sum of the growth of the top five, at most 1, 4 places."""
    return impacts.agg(F.round(F.least(F.lit(1.0), F.coalesce(F.sum("growth"), F.lit(0.0))), 4).alias("impact_score"))


def added_lines(files: DataFrame, patch: str, *keep: str) -> DataFrame:
    """Line numbers in the new file of the lines that a unified diff adds."""
    rows = files.filter(F.col(patch).isNotNull()).select(*keep, F.posexplode(F.split(patch, r"\r?\n")).alias("pos", "line"))
    start = F.when(F.col("line").startswith("@@"), F.try_to_number(F.regexp_extract("line", r"\+(\d+)", 1), F.lit("9999999999")).cast("long"))
    w = W.partitionBy(*keep).orderBy("pos")
    rows = rows.withColumn("_start", start).withColumn("_hunk", F.count("_start").over(w)).filter("_hunk > 0")
    step = F.when(F.col("_start").isNull() & (F.col("line").startswith("+") | F.col("line").startswith(" ")), 1).otherwise(0)
    h = W.partitionBy(*keep, "_hunk").orderBy("pos")
    number = F.first("_start").over(h) - 1 + F.sum(step).over(h)
    return rows.withColumn("line_number", number).filter(F.col("_start").isNull() & F.col("line").startswith("+")).select(*keep, "line_number")


def select_comments(findings: DataFrame, added: DataFrame, keys: tuple[str, ...], limit: int = 50) -> DataFrame:
    """The first findings of each pull request by severity, then those on added lines."""
    w = W.partitionBy("pr_id").orderBy(severity_rank("severity"), *keys, "line_number", "title")
    first = findings.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
    return first.join(added.distinct(), [*keys, "line_number"], "left_semi")


def duplicate_findings(duplicates: DataFrame, *keep: str) -> DataFrame:
    """V12 with P8: a finding of medium severity for each duplicate; the percentage is cut, not rounded."""
    pct = F.floor(F.col("similarity") * 100).cast("int").cast("string")
    title = F.concat(F.lit("Duplicate logic: "), "chunk_name", F.lit(" ("), pct, F.lit("% match)"))
    return duplicates.select(*keep, F.lit("duplicate").alias("finding_type"), F.lit("medium").alias("severity"), title.alias("title"), F.col("start_line").alias("line_number"))


def impact_findings(impacts: DataFrame, *keep: str) -> DataFrame:
    """V13 with P8: a finding for each cluster that a change accelerates, without file and line."""
    pct = F.floor(F.col("growth") * 100).cast("int").cast("string")
    title = F.concat(F.lit("Accelerates pattern '"), F.coalesce("representative", F.lit("")), F.lit("' by ~"), pct, F.lit("%"))
    return impacts.select(*keep, F.lit("debt_impact").alias("finding_type"), F.col("severity"), title.alias("title"), F.lit(None).cast("int").alias("line_number"))


def fingerprint(kind: str, title: str, snippet: str) -> Column:
    """sha256 of type, title and the first 300 characters of the snippet."""
    return F.sha2(F.concat_ws(":", F.col(kind), F.col(title), F.substring(F.col(snippet), 1, 300)), 256)


def signature_valid(secret: str, body: bytes, header: str | None) -> bool:
    """``sha256=`` HMAC of the body; false without a secret or prefix."""
    if not secret or not header or not header.startswith("sha256="):
        return False
    return hmac.compare_digest(hmac.new(secret.encode(), body, hashlib.sha256).hexdigest(), header[7:])


def review_summary(findings: DataFrame, key: str = "pr_id", cap: int = 10) -> DataFrame:
    """A Markdown summary per pull request: score, counts by severity, the first ``cap`` findings and how many more."""
    w = W.partitionBy(key).orderBy(severity_rank("severity"), "title", "line_number")
    ranked = findings.withColumn("_n", F.row_number().over(w))
    line = F.format_string("%03d- **%s** %s (line %d)", F.col("_n"), F.col("severity"), F.col("title"), F.col("line_number"))
    items = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_n") <= cap, line))).alias("_items"), F.count(F.lit(1)).alias("_all"))
    full = items.join(severity_pivot(findings, key), key).join(health_score(findings, key), key)
    emoji = F.when(F.col("health_score") >= 80, "good").when(F.col("health_score") >= 50, "fair").otherwise("poor")
    table = F.concat_ws(" | ", *(F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in V.SEVERITIES))
    more = F.when(F.col("_all") > cap, F.concat(F.lit("\nand "), (F.col("_all") - cap).cast("string"), F.lit(" more"))).otherwise("")
    body = F.array_join(F.transform("_items", lambda x: F.substr(x, F.lit(4))), "\n")
    return full.select(key, "health_score", F.concat(F.lit("## Review: "), F.col("health_score").cast("string"), F.lit(" ("), emoji, F.lit(")\n"), table, F.lit("\n"), body, more).alias("summary"))
