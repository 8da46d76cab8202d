"""Density clusters with stable identities (V3 to V8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.functions import fixed_values as V
from lodeweave.operators.graph import connected_components
from lodeweave.operators.vectors import cosine, mean_vectors, neighbour_edges


def dbscan(df: DataFrame, id_col: str, vector: str, keys: tuple[str, ...] = ("repo_id", "language"), eps: float = V.CLUSTER_DISTANCE, min_samples: int = V.MIN_SAMPLES) -> DataFrame:
    """V3: ``id``, ``cluster`` (its least core id) and ``is_core``; noise has no row.

    Core rows have at least ``min_samples`` rows within ``eps``, themselves included; clusters are the components of links
    between cores; a border row joins the adjacent cluster of the least id.
    """
    edges = neighbour_edges(df, id_col, vector, keys, eps).persist()
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    cores = both.groupBy("src").count().filter(F.col("count") + 1 >= min_samples).select(F.col("src").alias("id")).persist()
    inner = edges.join(cores.withColumnRenamed("id", "src"), "src", "left_semi").join(cores.withColumnRenamed("id", "dst"), "dst", "left_semi")
    comp = connected_components(inner).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    labelled = cores.join(comp, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
    border = both.join(labelled.select(F.col("id").alias("dst"), "cluster"), "dst").join(cores.select(F.col("id").alias("src")), "src", "left_anti")
    border = border.groupBy("src").agg(F.min("cluster").alias("cluster")).select(F.col("src").alias("id"), "cluster")
    return labelled.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))


def centroid_hash(df: DataFrame, key: str, vector: str) -> DataFrame:
    """sha256 of the centroid rounded to 4 places as little-endian float32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["centroid_hash"] = [hashlib.sha256(np.round(np.asarray(v, float), 4).astype("<f4").tobytes()).hexdigest() for v in b["v"]]
            yield b[["k", "centroid_hash"]]

    return df.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"k {dict(df.dtypes)[key]}, centroid_hash string").withColumnRenamed("k", key)


def membership_similarity(memberships: DataFrame, chunks: DataFrame) -> DataFrame:
    """V7: cosine of each member to its cluster's fresh centroid, in [0, 1], 4 places; one row per (cluster, chunk)."""
    rows = memberships.select("cluster_id", "chunk_id").distinct().join(chunks.filter("embedding is not null").select("chunk_id", "embedding"), "chunk_id")
    cen = mean_vectors(rows, "cluster_id", "embedding", 12)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("embedding"), F.col("centroid"))))
    return rows.join(cen, "cluster_id").select("cluster_id", "chunk_id", F.round(s, 4).alias("similarity_score"))


def cluster_snapshot(clusters: DataFrame) -> DataFrame:
    """One row per cluster: of rows delivered twice the one with more chunks."""
    w = W.partitionBy("cluster_id").orderBy(F.col("chunk_count").desc(), "centroid_hash")
    return clusters.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cluster_growth(clusters: DataFrame, memberships: DataFrame, chunks: DataFrame) -> DataFrame:
    """V8: members and files of every cluster now, growth against its stored count (0 where that is 0), and the flag."""
    now = memberships.select("cluster_id", "chunk_id").distinct().join(chunks.select("chunk_id", "file_path"), "chunk_id")
    now = now.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("new_count"), F.countDistinct("file_path").alias("new_files"))
    full = cluster_snapshot(clusters).join(now, "cluster_id", "left").na.fill(0, ["new_count", "new_files"])
    growth = F.when(F.col("chunk_count") > 0, (F.col("new_count") - F.col("chunk_count")) / F.col("chunk_count")).otherwise(0.0)
    flag = (growth > V.FLAG_GROWTH) & (F.col("new_count") >= V.MIN_SAMPLES)
    return full.select("cluster_id", "new_count", "new_files", F.round(growth, 4).alias("growth"), flag.alias("flagged"))


def nearest_centroids(chunks: DataFrame, clusters: DataFrame, max_distance: float = V.CLUSTER_DISTANCE, salts: int = 8) -> DataFrame:
    """The nearest centroid of its repository and language for each chunk, within a cosine distance.

    The chunk side of a key is spread over ``salts`` parts, to each of which the key's centroids are sent, so that a hot key
    is not one task; inside a group the work is one matrix product.
    """
    usable = lambda c: F.col(c).isNotNull() & F.exists(F.col(c), lambda x: x != 0)
    own = [F.col(c).alias(c) for c in ("repo_id", "language")]  # new columns, as both sides may come from one table
    a = chunks.filter(usable("embedding")).select(*own, F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).alias("salt"))
    b = cluster_snapshot(clusters).filter(usable("centroid")).select("repo_id", "language", F.col("cluster_id").alias("id"), F.col("centroid").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"chunk_id": pd.Series([], dtype=str), "cluster_id": pd.Series([], dtype=str), "similarity_score": pd.Series([], dtype=float)})
        right = right.sort_values("id")
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        s = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T, 9)
        j = s.argmax(1)
        v = s[np.arange(len(x)), j]
        ok = v >= 1 - max_distance
        return pd.DataFrame({"chunk_id": left["id"].to_numpy()[ok], "cluster_id": right["id"].to_numpy()[j[ok]], "similarity_score": np.round(v[ok], 4)})

    return a.groupBy("repo_id", "language", "salt").cogroup(b.groupBy("repo_id", "language", "salt")).applyInPandas(match, "chunk_id string, cluster_id string, similarity_score double")


def match_identities(fresh: DataFrame, clusters: DataFrame, max_distance: float = V.MATCH_DISTANCE) -> DataFrame:
    """The stored cluster that each fresh centroid continues, within a cosine distance; null is a new cluster (V6).

    ``fresh`` has repo_id, language, new_id and centroid; two fresh clusters may continue the same stored one.
    """
    named = fresh.select("repo_id", "language", F.col("new_id").alias("chunk_id"), F.col("centroid").alias("embedding"))
    found = nearest_centroids(named, clusters, max_distance)
    return fresh.select("new_id").join(found.select(F.col("chunk_id").alias("new_id"), F.col("cluster_id").alias("continues"), "similarity_score"), "new_id", "left")


def fast_assignment(chunks: DataFrame, clusters: DataFrame, memberships: DataFrame) -> DataFrame:
    """V2: the nearest centroid for the chunks that have no membership yet."""
    return nearest_centroids(chunks.join(memberships.select("chunk_id"), "chunk_id", "left_anti"), clusters)


def clustering_run(chunks: DataFrame, clusters: DataFrame, commits: DataFrame) -> DataFrame:
    """V9, V3 to V8 over all keys at once: a row per density cluster of today.

    ``cluster`` (its least core chunk), ``repo_id``, ``language``, ``continues`` (the stored cluster, null for a new one),
    ``centroid_hash`` (the stored one, else X2), ``members``, ``files``, ``growth`` against the stored count (0 for a new one), ``flagged`` and
    ``origin_commit_id``, the first commit of its members.
    """
    labels = dbscan(chunks, "chunk_id", "embedding").select(F.col("id").alias("chunk_id"), "cluster")
    rows = labels.join(chunks.select("chunk_id", "repo_id", "language", "commit_id", "file_path", "embedding"), "chunk_id").persist()
    cen = mean_vectors(rows, "cluster", "embedding", 12).select("cluster", "centroid")
    when = rows.join(commits.select("commit_id", "committed_at", "sha"), "commit_id", "left")
    stats = when.groupBy("cluster", "repo_id", "language").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("file_path").alias("files"), F.min_by("commit_id", F.struct("committed_at", "sha")).alias("origin_commit_id"))
    fresh = stats.join(cen, "cluster").persist()
    match = match_identities(fresh.select("repo_id", "language", F.col("cluster").alias("new_id"), "centroid"), clusters).select(F.col("new_id").alias("cluster"), "continues")
    own = centroid_hash(fresh, "cluster", "centroid").withColumnRenamed("centroid_hash", "_new")
    old = cluster_snapshot(clusters).select(F.col("cluster_id").alias("continues"), F.col("centroid_hash").alias("_old"), "chunk_count")
    out = fresh.drop("centroid").join(match, "cluster").join(own, "cluster").join(old, "continues", "left")
    growth = F.when(F.col("chunk_count") > 0, (F.col("members") - F.col("chunk_count")) / F.col("chunk_count")).otherwise(0.0)
    flag = (growth > V.FLAG_GROWTH) & (F.col("members") >= V.MIN_SAMPLES)
    return out.select("cluster", "repo_id", "language", "continues", F.coalesce("_old", "_new").alias("centroid_hash"), "members", "files", F.round(growth, 4).alias("growth"), flag.alias("flagged"), "origin_commit_id")
