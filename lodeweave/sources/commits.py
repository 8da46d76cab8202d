"""Scans over landed tables (S2, S3, S6, S11) and vectors of texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def commits_after(commits: DataFrame, checkpoints: DataFrame, sha: str) -> DataFrame:
    """Commits with ``ordinal`` (from old to new in each repository) beyond the one of the checkpoint's ``sha``.

    A repository whose checkpoint is null or unknown is scanned in full; one without a row in ``checkpoints`` as well.
    """
    numbered = commits.withColumn("ordinal", F.row_number().over(W.partitionBy("repo_id").orderBy("committed_at", "sha")))
    at = checkpoints.filter(F.col(sha).isNotNull()).select("repo_id", F.col(sha).alias("sha"))
    reached = numbered.select("repo_id", "sha", "ordinal").join(at, ["repo_id", "sha"]).groupBy("repo_id").agg(F.max("ordinal").alias("_done"))
    return numbered.join(reached, "repo_id", "left").filter(F.col("ordinal") > F.coalesce("_done", F.lit(0))).drop("_done")


def changed_files(files: DataFrame, status: str) -> DataFrame:
    """S3: rows whose status is added, modified or renamed, with ``change`` A, M or R."""
    change = F.when(F.col(status) == "added", "A").when(F.col(status) == "modified", "M").when(F.col(status) == "renamed", "R")
    return files.withColumn("change", change).filter("change is not null")


def latest(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The row of each key that was fetched last."""
    w = W.partitionBy(*keys).orderBy(F.col(time).desc(), tie)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def synced_statuses(requests: DataFrame, snapshot: DataFrame, key: str = "pr_id") -> DataFrame:
    """Open and analysing requests take the state of the snapshot, others keep theirs."""
    now = snapshot.select(key, F.col("status").alias("_now")).dropDuplicates([key])
    joined = requests.join(now, key, "left")
    fresh = F.when(F.col("status").isin("open", "analyzing"), F.coalesce("_now", "status")).otherwise(F.col("status"))
    return joined.withColumn("status", fresh).drop("_now")


def hashed_words_model() -> Callable[[list[str]], np.ndarray]:
    """A model without weights: words hashed to 64 signed places."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 64), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=2).digest()
                out[i, h[0] % 64] += 1 if h[1] % 2 else -1
        return out

    return embed


def embed_texts(df: DataFrame, text: str, model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """``embedding`` of each text, of unit length, by a model that each worker loads once; ``batch`` texts a call. Blank and null texts get null."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = model()
        for s in series:
            out: list = [None] * len(s)
            at = [i for i, t in enumerate(s) if isinstance(t, str) and t.strip()]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                v = embed([s.iloc[i] for i in part]).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, r in zip(part, v, strict=True):
                    out[i] = r.astype(np.float32).tolist()
            yield pd.Series(out)

    return df.withColumn("embedding", run(text))


def embed_missing(chunks: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``chunk_id``, ``origin`` (cache, model or blank) and ``embedding`` of the chunks with code but no vector.

    A text is looked up by its sha256; each different text that the cache lacks is embedded once.
    """
    c = chunks.filter("raw_code is not null").select("chunk_id", "raw_code", F.sha2("raw_code", 256).alias("_h"), "embedding")
    cache = c.filter("embedding is not null").groupBy("_h").agg(F.min_by("embedding", "chunk_id").alias("embedding")).withColumn("origin", F.lit("cache"))
    todo = c.filter("embedding is null").drop("embedding")
    fresh = todo.join(cache, "_h", "left_anti").groupBy("_h").agg(F.first("raw_code").alias("raw_code"))
    made = embed_texts(fresh, "raw_code", model).select("_h", "embedding", F.when(F.trim("raw_code") == "", "blank").otherwise("model").alias("origin"))
    return todo.join(cache.unionByName(made), "_h").select("chunk_id", "origin", "embedding")
