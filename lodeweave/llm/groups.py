"""Problem 1: groups of mutually similar vectors within a key, by bisecting k-means to compact leaves and exact links between leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeweave.llm import trees
from lodeweave.llm.vectors import pack, unpack
from lodeweave.operators.graph import connected_components


def link(x: np.ndarray, min_cos: float) -> np.ndarray:
    """Component label (least row number) of each unit row, rows being linked at a cosine of ``min_cos`` or more.

    Bisecting k-means splits the rows until each leaf lies within half the linking angle of its centre, so that all its
    rows are linked by the triangle inequality; two leaves are compared row by row only where the angle between their
    centres does not rule a link out.
    """
    n = len(x)
    theta = np.arccos(min_cos)
    leaves = trees.bisect(x, n, float(np.cos(theta / 2)) + 1e-6)
    c = trees.centres(x, leaves)
    radius = np.array([0.0 if len(r) == 1 else float(np.arccos(np.clip((x[r] @ c[i]).min(), -1, 1))) for i, r in enumerate(leaves)])
    compact = radius <= theta / 2 - 1e-7
    parent = np.arange(len(leaves))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x64 = x.astype(np.float64)
    for i in range(len(leaves)):
        reach = np.cos(np.minimum(theta + radius[i] + radius[i + 1 :] + 1e-4, np.pi))
        for j in i + 1 + np.nonzero(c[i + 1 :] @ c[i] >= reach)[0]:
            a, b = root(i), root(int(j))
            if a != b and (x64[leaves[i]] @ x64[leaves[j]].T).max() >= min_cos:
                parent[max(a, b)] = min(a, b)
    label = np.empty(n, np.int64)
    for i, r in enumerate(leaves):
        label[r] = root(i)
    for i in np.nonzero(~compact)[0]:  # a leaf of equal rows that rounding kept from being compact
        assert np.allclose(x[leaves[i]], x[leaves[i]][0], atol=1e-3)
    least = np.full(len(leaves), n)
    np.minimum.at(least, label, np.arange(n))
    return least[label]


def _home(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the cosine to it."""
    cells, cos = np.empty(len(x), np.int32), np.empty(len(x), np.float32)
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ centres.T
        cells[i : i + 4096] = s.argmax(1)
        cos[i : i + 4096] = s.max(1)
    return cells, cos


def cross(x: np.ndarray, y: np.ndarray, min_cos: float, block: int = 512) -> np.ndarray:
    """Label (least number) of each row of ``x`` and then of ``y`` under the links between the two; links within one are not looked at."""
    n = len(x)
    label = np.arange(n + len(y))
    for i in range(0, n, block):
        r, c = np.nonzero(x[i : i + block] @ y.T >= min_cos - 1e-5)
        src, dst = r + i, c + n
        near = np.concatenate([np.einsum("nd,nd->n", x[src[k : k + 65536]].astype(np.float64), y[c[k : k + 65536]].astype(np.float64)) for k in range(0, len(c), 65536)]) if len(c) else np.empty(0)
        src, dst = src[near >= min_cos], dst[near >= min_cos]
        while len(src):
            least = np.minimum(label[src], label[dst])
            if (label[src] == least).all() and (label[dst] == least).all():
                break
            for at in (label[src], label[dst], src, dst):  # roots first, so that what hangs on them comes along
                np.minimum.at(label, at, least)
            while (label[label] != label).any():
                label = label[label]
    return label


def _partners(centres: np.ndarray, radius: np.ndarray, parts: np.ndarray, theta: float) -> list[list[list[tuple[int, int]]]]:
    """For each cell and part of it the pairs of blocks it takes part in: two cells meet unless their centres are further apart than both radii and the linking angle."""
    first = np.concatenate([[0], np.cumsum(parts)])
    out: list[list[list[tuple[int, int]]]] = [[[] for _ in range(p)] for p in parts]
    for i in range(len(centres)):
        angle = np.arccos(np.clip(centres[i:].astype(np.float64) @ centres[i].astype(np.float64), -1, 1))
        for j in i + np.nonzero(angle <= radius[i] + radius[i:] + theta + 1e-3)[0]:
            for p in range(parts[i]):
                for q in range(p if i == j else 0, parts[j]):
                    pair = (int(first[i] + p), int(first[j] + q))
                    out[i][p].append(pair)
                    if (i, p) != (j, q):
                        out[j][q].append(pair)
    return out


def stars_of(t: pa.Table, min_cos: float) -> pa.Table:
    """Links ``src``, ``dst`` of each component's nodes to its least one, for every cell or meeting of two cells in ``t``.

    Rows are taken by name, not as they arrive: executors may compute a cached part twice, from rows in another order, and both must name the same nodes.
    """
    t = t.sort_by("rep")
    key, low, high, me = (t.column(c).to_numpy() for c in ("key", "low", "high", "me"))
    x, rep = unpack(t.column("vec")), t.column("rep").combine_chunks()
    order = np.lexsort((high, low, key))
    cuts = np.nonzero((np.diff(key[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0))[0] + 1
    src, dst = [], []
    for rows in np.split(order, cuts):
        if len(rows) > 1:
            if low[rows[0]] == high[rows[0]]:
                label = link(x[rows], min_cos)
            else:
                rows = rows[np.argsort(me[rows], kind="stable")]
                n = int((me[rows] == low[rows[0]]).sum())
                label = cross(x[rows[:n]], x[rows[n:]], min_cos)
            other = label != np.arange(len(rows))
            src.append(rows[other])
            dst.append(rows[label[other]])
    a = np.concatenate(src) if src else np.empty(0, np.int64)
    b = np.concatenate(dst) if dst else np.empty(0, np.int64)
    return pa.table({"src": rep.take(pa.array(a)), "dst": rep.take(pa.array(b)), "final": pa.array(low[a] < 0)})


def similarity_groups(df: DataFrame, id_col: str, vector: str, keys: list[str], min_cos: float = 0.85, min_size: int = 3,
                      cell_rows: int = 8192, sample_rows: int = 65536, with_vectors: bool = False) -> DataFrame:
    """Groups of linked vectors: ``keys``, ``id``, ``group_id`` (its least id), ``chunk_count`` and, on demand, ``vec``.

    Two rows of equal ``keys`` are linked at a cosine of at least ``min_cos``; groups are the components of at least
    ``min_size`` rows, exactly, whatever the size of a key. Keys of up to ``cell_rows`` distinct vectors form one cell each. A larger
    key is first split across the cluster by a bisecting k-means tree fitted on a bounded sample (``sample_rows`` in all, chosen by
    hash), whose overfull cells are cut again by a hash; every two cells meet whose centres and radii (measured on all rows) do
    not rule a link out, and components are joined over all of them. Copies of a vector within a key are one node.

    Null, zero and NaN-bearing vectors belong to no group; null keys are a key of their own; rows that repeat an id and its vector count once; an
    empty table gives an empty result. Columns other than those named are ignored, whatever their names.
    """
    names = [f"g{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).cast("string").alias(a) for k, a in zip(keys, names, strict=True)), F.col(id_col).cast("string").alias("id"), F.col(vector).alias("v"))
    rows = pack(rows.filter(F.col("id").isNotNull()), "v", [*names, "id"])
    rows = rows.withColumn("key", F.xxhash64(*(F.coalesce(F.col(n), F.lit("\0")) for n in names)))
    rows = rows.withColumn("k1", F.xxhash64("vec", "key")).withColumn("k2", F.xxhash64("key", "vec", F.lit(1))).persist()
    nodes = rows.groupBy("key", "k1", "k2").agg(F.min("id").alias("rep"), F.first("vec").alias("vec")).persist()
    sizes_of = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).persist()
    large = sizes_of.filter(F.col("n") > cell_rows)
    got = large.toArrow().to_pydict()  # one row for at least cell_rows rows
    sizes = dict(zip(got["key"], got["n"], strict=True))
    total = sizes_of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    centres: dict[int, np.ndarray] = {}
    partners: dict[int, list[list[list[tuple[int, int]]]]] = {}
    theta = float(np.arccos(min_cos))
    if sizes:
        every = max(1, sum(sizes.values()) // sample_rows)
        drawn = nodes.filter(F.pmod("k1", F.lit(every)) == 0).join(F.broadcast(large.select("key")) if len(sizes) < 100_000 else large.select("key"), "key", "left_semi").select("key", "vec").toArrow()
        at, x = drawn.column(0).to_numpy(), unpack(drawn.column(1))
        for key, n in sizes.items():
            own = x[at == key]
            if len(own):
                centres[key] = trees.centres(own, trees.bisect(own, max(8, -(-len(own) * cell_rows // (2 * n)))))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = b.column(0).to_numpy()
                for k, c in centres.items():
                    mine = np.nonzero(key == k)[0]
                    if len(mine):
                        cells, cos = _home(unpack(b.column(1).take(pa.array(mine))), c)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k)), pa.array(cells), pa.array(cos.astype(np.float64))], names=["key", "cell", "cos"])

        told = nodes.select("key", "vec").mapInArrow(measure, "key long, cell int, cos double").groupBy("key", "cell").agg(F.min("cos").alias("cos"), F.count(F.lit(1)).alias("n")).toArrow().to_pydict()  # a row a cell
        radius = {k: np.zeros(len(c)) for k, c in centres.items()}
        parts = {k: np.ones(len(c), int) for k, c in centres.items()}
        for k, cell, cos, n in zip(told["key"], told["cell"], told["cos"], told["n"], strict=True):
            radius[k][cell], parts[k][cell] = np.arccos(np.clip(cos - 1e-6, -1, 1)), -(-n // cell_rows)
        partners = {k: _partners(c, radius[k], parts[k], theta) for k, c in centres.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            alone = np.nonzero(~np.isin(key, list(centres)))[0]
            r, low, high, me = [alone], [np.full(len(alone), -1)], [np.full(len(alone), -1)], [np.full(len(alone), -1)]
            for k, c in centres.items():
                mine = np.nonzero(key == k)[0]
                if not len(mine):
                    continue
                cells, _ = _home(unpack(b.column(2).take(pa.array(mine))), c)
                part = (b.column(3).take(pa.array(mine)).to_numpy() >> 7) % np.array([len(p) for p in partners[k]])[cells]
                first = np.concatenate([[0], np.cumsum([len(p) for p in partners[k]])])
                for i, p in {*zip(cells.tolist(), part.tolist(), strict=True)}:
                    at = mine[(cells == i) & (part == p)]
                    pairs = np.array(partners[k][i][p])
                    r.append(np.repeat(at, len(pairs)))
                    low.append(np.tile(pairs[:, 0], len(at)))
                    high.append(np.tile(pairs[:, 1], len(at)))
                    me.append(np.full(len(at) * len(pairs), first[i] + p))
            take = pa.array(np.concatenate(r))
            three = [pa.array(np.concatenate(v).astype(np.int32)) for v in (low, high, me)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), *three, b.column(1).take(take), b.column(2).take(take)], names=["key", "low", "high", "me", "rep", "vec"])

    def components(t: pa.Table) -> pa.Table:
        return stars_of(t, min_cos)

    placed = nodes.select("key", "rep", "vec", "k1").mapInArrow(assign, "key long, low int, high int, me int, rep string, vec binary")
    copies = sum(sizes[k] * max(1, np.mean([len(q) for p in ps for q in p])) for k, ps in partners.items())
    buckets = max(12, int(copies + total) // cell_rows)
    stars = placed.groupBy(F.pmod(F.xxhash64("key", "low", "high"), F.lit(buckets)).alias("bucket")).applyInArrow(components, "src string, dst string, final boolean").persist()
    comp = stars.filter("final").select(F.col("src").alias("rep"), F.col("dst").alias("root"))
    comp = comp.unionByName(comp.select(F.col("root").alias("rep"), "root").distinct())
    if centres:
        comp = comp.unionByName(connected_components(stars.filter("not final")).select(F.col("node").alias("rep"), F.col("component").alias("root")))
    # rows -> nodes -> roots; a node without links is its own root, its copies may still make a group
    rooted = nodes.select("k1", "k2", "rep").join(comp, "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    out = rows.dropDuplicates(["id", "k1"]) if with_vectors else rows.drop("vec").dropDuplicates(["id", "k1"])
    out = out.join(rooted, ["k1", "k2"])
    groups = out.groupBy("root").agg(F.count(F.lit(1)).alias("chunk_count"), F.min("id").alias("group_id")).filter(F.col("chunk_count") >= min_size)
    out = out.join(groups, "root")
    return out.select(*(F.col(a).alias(k) for k, a in zip(keys, names, strict=True)), "id", "group_id", "chunk_count", *(["vec"] if with_vectors else []))


def group_pairs(groups: DataFrame) -> DataFrame:
    """Every pair within a group, the form that the stated result has."""
    a = groups.select("group_id", F.col("id").alias("chunk_id_a"))
    b = groups.select("group_id", F.col("id").alias("chunk_id_b"))
    return a.join(b, "group_id").filter("chunk_id_a < chunk_id_b").select("chunk_id_a", "chunk_id_b")


def describe(groups: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """A row per group and typical member: size, rank and similarity to the group's centroid.

    The centroid is the mean of the unit vectors, a per-dimension average that is combined before the shuffle.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack(b.column(1)).astype(np.float64)
            gid = b.column(0).to_pylist()
            names, inv = np.unique(np.array(gid, object), return_inverse=True) if gid else ([], [])
            if gid:
                s = np.zeros((len(names), x.shape[1]))
                np.add.at(s, inv, x)
                yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array([r.tolist() for r in s], pa.list_(pa.float64()))], names=["group_id", "part"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unpack(b.column("vec")).astype(np.float64)
                c = np.array(b.column("centroid").to_pylist(), np.float64)
                s = np.einsum("nd,nd->n", x, c) / np.maximum(np.linalg.norm(c, axis=1), 1e-12)
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keys) + 3)] + [pa.array(np.round(np.clip(s, 0, 1), 4))], names=[*keys, "group_id", "chunk_count", "chunk_id", "similarity_score"])

    parts = groups.select("group_id", "vec").mapInArrow(spread, "group_id string, part array<double>")
    sums = parts.select("group_id", F.posexplode("part")).groupBy("group_id", "pos").agg(F.sum("col").alias("s"))
    cen = sums.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("centroid"))
    full = groups.join(cen, "group_id").select(*keys, "group_id", "chunk_count", F.col("id").alias("chunk_id"), "vec", "centroid")
    fields = ", ".join(f"`{k}` string" for k in keys)
    scored = full.mapInArrow(score, f"{fields}, group_id string, chunk_count long, chunk_id string, similarity_score double")
    best = W.partitionBy("group_id").orderBy(F.col("similarity_score").desc(), "chunk_id")
    return scored.withColumn("member_rank", F.row_number().over(best)).filter(F.col("member_rank") <= top)
