"""Debt scores of (commit, file), their velocity and inflections, and what each commit brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.functions import fixed_values as V


def latest_commits(commits: DataFrame) -> DataFrame:
    """One row per commit: the first delivery."""
    w = W.partitionBy("commit_id").orderBy("ingested_at", "sha")
    return commits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def debt_scores(chunks: DataFrame, memberships: DataFrame, violations: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """B1 per (repo, commit, file): sums of complexity, membership rows, violations and distinct clusters, weighted; 4 places.

    ``violations`` has repo_id, commit_id, file_path and a row for each. Each side is pre-aggregated on its own keys, so the
    chunk table is joined with counts and never multiplied.
    """
    w = V.DEBT_WEIGHTS | (weights or {})
    keys = ["repo_id", "commit_id", "file_path"]
    base = chunks.groupBy(*keys).agg(F.min_by("language", "chunk_id").alias("language"), F.sum("complexity_score").alias("_complexity"))
    member = chunks.select(*keys, "chunk_id").join(memberships.select("chunk_id", "cluster_id"), "chunk_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct("cluster_id").alias("_clusters"))
    broken = violations.groupBy(*keys).agg(F.count(F.lit(1)).alias("_violations"))
    full = base.join(member, keys, "left").join(broken, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = {
        "complexity_component": F.col("_complexity") * w["complexity"], "duplication_component": zero("_rows") * w["duplication"],
        "violation_component": zero("_violations") * w["violations"], "cluster_component": zero("_clusters") * w["cluster_membership"],
    }
    total = sum(parts.values(), F.lit(0.0))
    return full.select(*keys, "language", *(F.round(e, 4).alias(n) for n, e in parts.items()), F.round(total, 4).alias("total_score"))


def velocity(scores: DataFrame, commits: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Score minus the file's score before, in commit order; the first is 0.

    ``previous`` (repo_id, file_path, total_score) gives the last scores of an earlier run, for incremental runs.
    """
    dated = scores.join(commits.select("commit_id", "committed_at", "sha"), "commit_id")
    w = W.partitionBy("repo_id", "file_path").orderBy("committed_at", "sha")
    before = F.lag("total_score").over(w)
    if previous is not None:
        dated = dated.join(previous.select("repo_id", "file_path", F.col("total_score").alias("_last")), ["repo_id", "file_path"], "left")
        before = F.coalesce(before, F.col("_last"))
    return dated.withColumn("velocity", F.round(F.coalesce(F.col("total_score") - before, F.lit(0.0)), 4)).drop("_last")


def debt_run(stored: DataFrame, chunks: DataFrame, memberships: DataFrame, violations: DataFrame, commits: DataFrame) -> DataFrame:
    """B2: scores and velocities of new commits' ``chunks``; ``stored`` (repo_id, commit_id, file_path, total_score) are earlier scores.

    The last stored score of a file precedes its first new one. The new commits are taken to come after the stored ones.
    """
    dated = stored.join(commits.select("commit_id", "committed_at", "sha"), "commit_id")
    last = dated.groupBy("repo_id", "file_path").agg(F.max_by("total_score", F.struct("committed_at", "sha")).alias("total_score"))
    fresh = debt_scores(chunks, memberships, violations)
    return velocity(fresh, commits, last).select("repo_id", "commit_id", "file_path", "total_score", "velocity")


def inflections(with_velocity: DataFrame) -> DataFrame:
    """Of at least three scores of a file, those whose rise exceeds the mean by two population deviations."""
    w = W.partitionBy("repo_id", "file_path")
    v = F.col("velocity")
    limit = F.avg("velocity").over(w) + 2 * F.stddev_pop("velocity").over(w)
    hit = (F.count(F.lit(1)).over(w) >= 3) & (F.stddev_pop("velocity").over(w) > 1e-9) & (v > limit) & (v > 0)
    return with_velocity.withColumn("is_inflection", hit)


def velocity_status(v: str) -> Column:
    """Over 5 deteriorating, under -1 improving, else stable."""
    return F.when(F.col(v) > 5, "deteriorating").when(F.col(v) < -1, "improving").otherwise("stable")


def blame_map(commits: DataFrame, with_velocity: DataFrame, clusters: DataFrame, memberships: DataFrame, chunks: DataFrame) -> DataFrame:
    """B3 per commit: rises introduced, clusters that began with it, files its clusters reach, and the sum of velocities."""
    rises = with_velocity.groupBy("commit_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("velocity") > 0, F.col("velocity"))), F.lit(0.0)), 4).alias("debt_introduced_score"), F.round(F.sum("velocity"), 4).alias("debt_score_delta"))
    began = clusters.filter("origin_commit_id is not null").select(F.col("origin_commit_id").alias("commit_id"), "cluster_id").distinct()
    patterns = began.groupBy("commit_id").agg(F.count(F.lit(1)).alias("patterns_originated"))
    reach = began.join(memberships.select("cluster_id", "chunk_id").distinct(), "cluster_id").join(chunks.select("chunk_id", "file_path"), "chunk_id")
    reach = reach.groupBy("commit_id").agg(F.countDistinct("file_path").alias("files_eventually_affected"))
    out = commits.select("commit_id", "repo_id", "sha").join(rises, "commit_id", "left").join(patterns, "commit_id", "left").join(reach, "commit_id", "left")
    return out.na.fill(0.0, ["debt_introduced_score", "debt_score_delta"]).na.fill(0, ["patterns_originated", "files_eventually_affected"])
