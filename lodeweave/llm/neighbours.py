"""Problem 7: the most similar vectors of every vector, by robust-pruned graphs on shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.llm import trees
from lodeweave.llm.robust_graph import RobustGraph
from lodeweave.llm.vectors import pack, unpack


def _fit(nodes: DataFrame, n: int, shard_rows: int, sample_rows: int, most_coarse: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A tree of two levels: coarse centres, and under each its shards' centres.

    The coarse tree is fitted on about ``sample_rows`` rows. Up to ``most_coarse`` shards make one level (one coarse centre). Beyond that each coarse
    cell fits its own part of the tree in a task of its own, on sixteen rows a shard: a sample in proportion to the
    collection that no task holds as a whole. What comes back are the centres, 4 bytes a dimension for each shard.
    """
    every = max(1, n // sample_rows)
    x = unpack(nodes.filter(F.pmod("k1", F.lit(every)) == 0).select("vec").limit(2 * sample_rows).toArrow().column(0))
    if len(x) == 0:
        return np.ones((1, 1), np.float32), [np.ones((1, 1), np.float32)]
    shards = max(1, round(n / shard_rows))
    if shards <= most_coarse:
        return x[:1] * 0, [trees.centres(x, trees.bisect(x, max(8, -(-len(x) // shards))))]
    coarse = trees.centres(x, trees.bisect(x, max(8, -(-len(x) // most_coarse))))
    per_shard = 16
    keep = max(1, shard_rows // per_shard)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array((unpack(b.column(0)) @ coarse.T).argmax(1).astype(np.int32)), b.column(0)], names=["coarse", "vec"])

    def fit(t: pa.Table) -> pa.Table:
        own = unpack(t.column("vec"))
        c = trees.centres(own, trees.bisect(own, per_shard))
        return pa.table({"coarse": pa.array(np.full(len(c), t.column("coarse")[0].as_py(), np.int32)), "vec": pa.array([r.tobytes() for r in c], pa.binary())})

    sample = nodes.filter(F.pmod("k1", F.lit(keep)) == 0).select("vec").mapInArrow(place, "coarse int, vec binary")
    got = sample.groupBy("coarse").applyInArrow(fit, "coarse int, vec binary").toArrow()
    at, c = got.column("coarse").to_numpy(), unpack(got.column("vec"))
    return coarse, [c[at == i] if (at == i).any() else coarse[i : i + 1] for i in range(len(coarse))]


def _probes(v: np.ndarray, coarse: np.ndarray, fine: list[np.ndarray], most: int, slack: float, walk: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Shards of every row as by ``trees.probes``, looked for below the ``walk`` nearest coarse centres only."""
    if len(fine) == 1:
        return trees.probes(v, fine[0], most, slack)
    first = np.concatenate([[0], np.cumsum([len(f) for f in fine])])
    near, _ = trees.probes(v, coarse, walk, 9.0)
    cells = np.full((len(v), near.shape[1] * most), -1, np.int32)
    sims = np.full(cells.shape, -9, np.float32)
    for c in np.unique(near):
        r, j = np.nonzero(near == c)
        s = v[r] @ fine[c].T
        k = min(most, s.shape[1])
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        for i in range(k):
            cells[r, j * most + i] = first[c] + top[:, i]
            sims[r, j * most + i] = s[np.arange(len(r)), top[:, i]]
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    cells, sims = np.take_along_axis(cells, order, 1), np.take_along_axis(sims, order, 1)
    good = (sims >= sims[:, :1] - slack) & (cells >= 0)
    good[:, 0] = True
    return cells, good


def nearest(df: DataFrame, id_col: str, vector: str, k: int = 5, min_cos: float = 0.85, shard_rows: int = 16384,
            sample_rows: int = 40000, shards_per_query: int = 5, slack: float = 0.2, degree: int = 18, beam: int = 24, most_coarse: int = 1024) -> DataFrame:
    """The ``k`` most similar other vectors of every vector, among those with a cosine of at least ``min_cos``.

    Columns ``id``, ``neighbour``, ``cosine``; ties go to the smaller neighbour id. Every row is indexed and every row is a
    query. A bisecting k-means tree cuts the collection into shards of about ``shard_rows`` rows; each shard gets a
    robust-pruned graph over its own rows and answers its own rows and those whose centre it is nearly as near to (``slack``,
    at most ``shards_per_query``). Queries travel to foreign shards in half precision, which moves a cosine by about 1e-4.
    The recall against brute force is measured in the tests and the README. Copies of one vector are searched once, so a group of copies, however large, is
    one node, named by a 64-bit hash of the vector; its members get their own copies as neighbours by rule.

    Null, zero, NaN-bearing vectors and null ids are left out; the vectors must be of one length; repeated ids count once
    (the least vector); an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = pack(rows.filter(F.col("id").isNotNull()), "v", ["id"])
    rows = rows.withColumn("k1", F.xxhash64("vec")).persist()
    nodes = rows.groupBy("k1").agg(F.first("vec").alias("vec")).persist()
    members = rows.groupBy("id").agg(F.min("k1").alias("k1")).persist()
    first = members.withColumn("nth", F.row_number().over(W.partitionBy("k1").orderBy("id"))).filter(F.col("nth") <= k + 1)
    low = first.groupBy("k1").agg(F.array_sort(F.collect_list("id")).alias("ids")).persist()  # at most k + 1 ids of a vector
    coarse, fine = _fit(nodes, nodes.count(), shard_rows, sample_rows, most_coarse)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = unpack(b.column(1))
            cells, good = _probes(v, coarse, fine, shards_per_query, slack)
            r, c = np.nonzero(good)
            half = v.astype(np.float16)
            vec = [v[i].tobytes() if j == 0 else half[i].tobytes() for i, j in zip(r.tolist(), c.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cells[r, c]), b.column(0).take(pa.array(r)), pa.array(vec, pa.binary())], names=["cell", "node", "vec"])

    def answer(t: pa.Table) -> pa.Table:
        raw, dim = t.column("vec").to_pylist(), fine[0].shape[1]
        home = np.array([len(x) == 4 * dim for x in raw])
        if not home.any():  # only queries from elsewhere
            return pa.table({"q": pa.array([], pa.int64()), "nb": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        v = np.empty((len(raw), dim), np.float32)
        v[home] = np.frombuffer(b"".join([x for x, h in zip(raw, home, strict=True) if h]), np.float32).reshape(-1, dim)
        if not home.all():
            w = np.frombuffer(b"".join([x for x, h in zip(raw, home, strict=True) if not h]), np.float16).reshape(-1, dim).astype(np.float32)
            v[~home] = w / np.linalg.norm(w, axis=1, keepdims=True)
        base = np.nonzero(home)[0]
        g = RobustGraph(v[base], degree, beam)
        entry = np.full(len(v), -1, np.int32)
        entry[base] = np.arange(len(base))
        ids, sims = g.search(v, beam=max(k + 3, beam * 3 // 4), entry=entry, expand=4)
        sims = np.where((ids < 0) | (ids == entry[:, None]), -9, sims)
        ids, sims = ids[:, : k + 3], sims[:, : k + 3]  # best first; one may be the query itself
        r, c = np.nonzero(sims >= min_cos - 1e-3)
        to = base[ids[r, c]]
        cos = np.einsum("nd,nd->n", v[r].astype(np.float64), v[to].astype(np.float64))
        ok = cos >= min_cos
        names = t.column("node").to_numpy()
        return pa.table({"q": names[r[ok]], "nb": names[to[ok]], "cosine": cos[ok]})

    routed = nodes.select("k1", "vec").mapInArrow(route, "cell int, node long, vec binary")
    found = routed.groupBy("cell").applyInArrow(answer, "q long, nb long, cosine double")
    best = W.partitionBy("q").orderBy(F.col("cosine").desc(), "nb")  # a node is indexed by one shard, so no pair comes twice
    classes = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).select("q", "nb", "cosine")
    own = low.filter(F.size("ids") > 1).select(F.col("k1").alias("q"), F.col("k1").alias("nb"), F.lit(1.0).alias("cosine"))
    wide = classes.unionByName(own).join(low.select(F.col("k1").alias("nb"), "ids"), "nb").select(F.col("q").alias("k1"), "cosine", F.explode("ids").alias("neighbour"))
    listed = wide.withColumn("nth", F.row_number().over(W.partitionBy("k1").orderBy(F.col("cosine").desc(), "neighbour"))).filter(F.col("nth") <= k + 1)
    out = members.join(listed, "k1").filter("id <> neighbour")
    out = out.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("nth")))
    return out.filter(F.col("nth") <= k).select("id", "neighbour", "cosine")


def pairs(found: DataFrame) -> DataFrame:
    """Undirected pairs of ``nearest``: at least one of the two is among the most similar of the other."""
    return found.select(F.least("id", "neighbour").alias("vector_id_a"), F.greatest("id", "neighbour").alias("vector_id_b")).distinct()


def collection(chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Chunk embeddings and cluster centroids as one collection: ``id``, ``v``; a null id is kept for ``nearest`` to drop."""
    a = chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return a.unionByName(clusters.select(F.col("cluster_id").alias("id"), F.col("centroid").cast("array<double>").alias("v")))
