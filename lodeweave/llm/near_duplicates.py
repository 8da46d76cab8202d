"""Problem 2: near-duplicate records by Golay-code fuzzy hashing, join and exact verification.

The fingerprint of a record has segments of 23 bits. Segment j orders the record's shingles by a hash j: the first ones (one or
two) are the segment's address and give its base word, each of the ``follow`` next shingles flips one bit of it. A shingle that
is replaced among these is at most two bit errors, and words within two errors share a Golay codeword index; so a segment
yields its up to six nearby codeword indices as keys, together with its address. By the pigeonhole principle the errors
cannot spoil all segments at once. Pairs that share a key are verified on their whole shingle sets.

Shingles that stand in very many records would make keys of huge groups. They are counted over all records in one pass (a
count sketch of fixed size) and left out of a first family of segments; records that consist of them for a large part get a
second family over all their shingles, addressed by two of them. Verification always takes the whole sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm import golay
from lodeweave.session import spread

_WORDS = re.compile(rb"[a-z0-9_]+").findall
_U = np.uint64


class _Hashes(dict):
    """64-bit hashes of words, remembered within bounds."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` successive words (ASCII letters, digits, underscore; ASCII lower case)."""
    words = _WORDS(text.encode("utf-8", "surrogatepass").lower())
    if len(words) < width:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    s = h[:n]
    for k in range(1, width):
        s = s * _U(0x100000001B3) + h[k : k + n] * _U(2 * k + 1)
    return np.unique(_mix(s))


def fingerprints(sets: list[np.ndarray], segments: int, follow: int, pivots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all segments of the non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mult = np.random.default_rng(seed).integers(1, 1 << 63, segments, dtype=np.uint64) * _U(2) + _U(1)
    top = _U(0xFFFFFFFFFFFFFFFF)
    rows, out = [], []
    for j in range(segments):
        h = _mix(flat * mult[j])
        least = np.minimum.reduceat(h, start)
        address = least
        for _ in range(pivots - 1):
            h[h == np.repeat(least, sizes)] = top
            least = np.minimum.reduceat(h, start)
            address = _mix(address) ^ least
        word = (_mix(address) & _U(0x7FFFFF)).astype(np.int64)
        for _ in range(follow):
            h[h == np.repeat(least, sizes)] = top
            least = np.minimum.reduceat(h, start)
            word ^= np.where(least == top, 0, np.int64(1) << (least % _U(23)).astype(np.int64))
        r, index = golay.keys(word)
        rows.append(r)
        out.append(_mix(address[r] * _U(4096) + index.astype(np.uint64) + _U(((seed * 64 + j) * 0x51ED270B7F4A7C15) % (1 << 64))))
    return np.concatenate(rows), np.concatenate(out).view(np.int64)


def shingle_sets(df: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """``id``, ``node`` (a 64-bit hash of the shingle set), ``n`` and ``set`` (packed 32-bit shingles, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            node = [int(np.bitwise_xor.reduce(_mix(s + _U(len(s))), initial=_U(len(s)))) for s in sets]
            small = [np.unique((s >> _U(32)).astype(np.uint32)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array([len(s) for s in small], pa.int32()), pa.array([s.tobytes() for s in small], pa.binary())],
                names=["id", "node", "n", "set"],
            )

    picked = df.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("t"))
    return spread(picked).mapInArrow(run, "id string, node long, n int, set binary")


_SLOTS, _SLICES = 1 << 20, 64


def common_shingles(nodes: DataFrame, limit: float) -> np.ndarray:
    """For each of 2^20 slots of shingles, whether it holds more than ``limit`` records above the average slot.

    Every task sums its records in one table of fixed size; the tables are added slice by slice.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int32)
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32)
            total += np.bincount(flat >> 12, minlength=_SLOTS).astype(np.int32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(total, _SLICES)], pa.binary())], names=["slice", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int32).astype(np.int64) for x in t.column("counts").to_pylist()], axis=0)
        return pa.table({"slice": t.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = nodes.select("set").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").toArrow().to_pydict()
    counts = np.zeros((_SLICES, _SLOTS // _SLICES), np.int64)
    for i, x in zip(parts["slice"], parts["counts"], strict=True):
        counts[i] = np.frombuffer(x, np.int64)
    counts = counts.ravel()
    return counts > limit + 2 * counts.mean()


def near_duplicates(df: DataFrame, id_col: str, text: str, width: int = 3, threshold: float = 0.6, segments: int = 14, follow: int = 3, common: float = 0.1, mixed: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``id, node, n`` of every record, and ``node_a, node_b, agreement`` of every similar pair of nodes.

    A shingle is common that stands in more than ``common`` times the square root of the number of records; a record gets the
    second family of segments where less than ``mixed`` of its shingles are not common.

    Records of one shingle set are one node, so copies are never paired with each other, however many there are. The
    agreement is the exact Jaccard similarity of the sets of ``width``-word runs. A null text or id is left out; a text with
    fewer than ``width`` words has an empty set, which agrees with nothing; rows of a repeated id count each. An empty table
    gives empty results; other columns are ignored, whatever their names.
    """
    sets = shingle_sets(df, id_col, text, width).filter("n > 0").persist()
    members = sets.select("id", "node", "n")
    nodes = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("set").alias("set")).persist()
    frequent = common_shingles(nodes, max(8.0, common * nodes.count() ** 0.5))
    packed = np.packbits(frequent)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(packed).astype(bool)
        for b in batches:
            node, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i in range(0, len(raw), 1024):
                all_ = [np.frombuffer(x, np.uint32) for x in raw[i : i + 1024]]
                rare = [x[~flags[x >> 12]] for x in all_]
                for pivots, at, chosen in (
                    (1, [k for k, x in enumerate(rare) if len(x)], rare),
                    (2, [k for k, x in enumerate(rare) if len(x) < mixed * len(all_[k])], all_),
                ):
                    if at:
                        r, key = fingerprints([chosen[k] for k in at], segments, follow, pivots, pivots)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[i + np.array(at)[r]])], names=["key", "node"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, value = [], []
            for i, (x, y) in enumerate(zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                    keep.append(i)
                    value.append(common / (len(x) + len(y) - common))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("node_a").take(at), b.column("node_b").take(at), pa.array(value, pa.float64())], names=["node_a", "node_b", "agreement"])

    keys = nodes.select("node", "set").mapInArrow(keyed, "key long, node long").repartition("key").persist()
    a, b = keys.toDF("key", "node_a"), keys.toDF("key", "node_b")
    cand = a.hint("merge").join(b, "key").filter("node_a < node_b").select("node_a", "node_b").distinct()  # both sides keep the partitioning of ``keys``
    sizes = nodes.select("node", "n")
    cand = cand.join(sizes.toDF("node_a", "n_a"), "node_a").join(sizes.toDF("node_b", "n_b"), "node_b").filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9).select("node_a", "node_b")
    cand = cand.join(nodes.select(F.col("node").alias("node_a"), F.col("set").alias("set_a")), "node_a")
    cand = cand.join(nodes.select(F.col("node").alias("node_b"), F.col("set").alias("set_b")), "node_b")
    links = cand.select("node_a", "node_b", "set_a", "set_b").mapInArrow(verify, "node_a long, node_b long, agreement double")
    return members, links


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of records, copies included: ``chunk_id_a``, ``chunk_id_b``; the form that the stated result has."""
    m = members.select("id", "node")
    x, y = m.select(F.col("id").alias("x"), F.col("node").alias("node_a")), m.select(F.col("id").alias("y"), F.col("node").alias("node_b"))
    across = links.select("node_a", "node_b").join(x, "node_a").join(y, "node_b").select("x", "y")
    within = x.join(y, F.col("node_a") == F.col("node_b")).filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def record_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: its class (least record of its connected group) and the number of other texts it is linked to."""
    from lodeweave.operators.graph import connected_components

    comp = connected_components(links, "node_a", "node_b")
    ends = links.select(F.col("node_a").alias("node")).unionByName(links.select(F.col("node_b").alias("node"))).groupBy("node").count()
    full = members.join(comp, "node", "left").join(ends, "node", "left")
    full = full.withColumn("component", F.coalesce("component", "node")).withColumn("links", F.coalesce("count", F.lit(0)))
    least = full.groupBy("component").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return full.join(least, "component").select("id", "class_id", "class_size", "links")
