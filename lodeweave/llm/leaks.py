"""Problem 9: passages of held-out items inside documents, by size-partitioned MinHash containment and exact verification.

A passage of ``run`` words is a small query set of word shingles, sought inside long documents. A document of ``n`` words
belongs to the size class of the power of two below ``n``; a query of ``q`` shingles that a document of a class up to ``u`` words
contains has a Jaccard similarity of no more than ``q / u``, so a signature of fixed length would miss it, the longer the document
the likelier. Each class therefore keeps as many MinHashes as it needs to miss none: one for each window of the query's length,
about ``2 n / (q + 1)`` different ones. A class whose documents are shorter than a passage is not searched at all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import spread

#: Words of a passage's shingles; a passage of ``run`` words has ``run - SHINGLE + 1`` of them.
SHINGLE = 5
_WORD = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    """64-bit hash of a word; at most a million words are remembered."""

    def __missing__(self, w: str) -> int:
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) > 1_000_000:
            self.clear()
        self[w] = h
        return h


_hashes = _Hashes()


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` values; the last ``k - 1`` places are cut."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _P + h[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def minima(lists: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash of every window of ``run`` words of all lists joined, and whether the window lies within one list."""
    sizes = np.array([len(x) for x in lists], np.int64)
    n = int(sizes.sum())
    h = np.fromiter((_hashes[w] for x in lists for w in x), np.uint64, n)
    inner = run - SHINGLE + 1
    g = _rolled(h, SHINGLE)
    m = max(0, len(g) - inner + 1)
    least = np.full(m, _NONE)
    for i in range(inner):
        np.minimum(least, g[i : i + m], out=least)
    end = np.repeat(np.cumsum(sizes), sizes)[:m]
    return least, np.arange(m) + run <= end


def size_class(n_words: int) -> int:
    """Power of two below the number of words."""
    return max(n_words, 1).bit_length() - 1


def _passages(w: list[str], run: int) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", run: int = 10, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """Documents and the items they share at least ``run`` successive words with: ``doc_id``, ``item_id``, ``shared_passages``.

    The MinHash of an item's passage equals that of the same passage in a document, so no passage is missed; candidates are
    verified by exact containment of their ``run``-word shingles. Items of up to ``broadcast_bytes`` of text (its sum is measured)
    are sent to every task, where each text is read once; beyond it the MinHashes of documents and items meet in a join, in
    which a passage that stands in many documents is spread over their size classes.

    Null texts and ids leak nothing, nor do texts of fewer than ``run`` words; repeated rows of an id count once; an empty
    table gives an empty result.
    """
    asked = items.filter(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    read = docs.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    doc_kind, item_kind = dict(read.dtypes)["doc"], dict(asked.dtypes)["item"]
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fields = f"doc {doc_kind}, item {item_kind}, shared_passages int"
    out = _against_all(read, asked, fields, run) if size <= broadcast_bytes else _joined(read, asked, fields, run)
    out = out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "shared_passages")
    return out.groupBy(doc_id, item_id).agg(F.max("shared_passages").alias("shared_passages"))


def _against_all(docs: DataFrame, items: DataFrame, fields: str, run: int) -> DataFrame:
    of: dict[tuple[str, ...], list] = {}
    for r in items.toLocalIterator():  # its bytes were measured
        for p in _passages(words(r["text"]), run):
            of.setdefault(p, []).append(r["item"])
    sent = docs.sparkSession.sparkContext.broadcast(of)
    item = items.select("item").schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        of = sent.value
        wanted = np.unique(minima([list(p) for p in of], run)[0][:: run] if of else np.empty(0, np.uint64))
        for b in batches:
            texts = [words(t) for t in b.column(1).to_pylist()]
            held = [i for i, w in enumerate(texts) if size_class(len(w)) >= size_class(run) and len(w) >= run]  # classes that can hold a passage
            lists = [texts[i] for i in held]
            least, whole = minima(lists, run)
            at = np.nonzero(whole)[0]
            at = at[wanted[np.minimum(np.searchsorted(wanted, least[at]), len(wanted) - 1)] == least[at]] if len(wanted) else at[:0]
            ends = np.cumsum([len(x) for x in lists])
            which = np.searchsorted(ends, at, side="right")
            found: dict[tuple, set] = {}
            for p, k in zip(at.tolist(), which.tolist(), strict=True):
                start = p - (int(ends[k - 1]) if k else 0)
                passage = tuple(lists[k][start : start + run])
                for i in of.get(passage, ()):
                    found.setdefault((held[k], i), set()).add(passage)
            pairs = sorted(found, key=lambda x: x[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([i for _, i in pairs], to_arrow_type(item[0].dataType)), pa.array([len(found[p]) for p in pairs], pa.int32())], names=["doc", "item", "shared_passages"]
            )

    return spread(docs.filter(F.length("text") >= 2 * run - 1)).mapInArrow(search, fields)


def _joined(docs: DataFrame, items: DataFrame, fields: str, run: int) -> DataFrame:
    def signed(df: DataFrame, key: str) -> DataFrame:
        """A row for each different MinHash of a text, with its size class."""

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, cls, hs = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    w = words(t)
                    h = np.unique(minima([w], run)[0])
                    row.append(np.full(len(h), i, np.int64))
                    cls.append(np.full(len(h), size_class(len(w)), np.int32))
                    hs.append(h.view(np.int64))
                r = np.concatenate(row) if row else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(np.concatenate(cls) if cls else np.empty(0, np.int32)), pa.array(np.concatenate(hs) if hs else np.empty(0, np.int64))], names=[key, "size_class", "h"])

        kind = dict(df.dtypes)[key]
        return df.select(key, "text").mapInArrow(sign, f"{key} {kind}, size_class int, h long")

    classes = F.sequence(F.lit(size_class(run)), F.lit(31))
    put = signed(spread(docs), "doc")
    asked = signed(items, "item").drop("size_class").withColumn("size_class", F.explode(classes))
    cand = put.join(asked, ["size_class", "h"]).select("doc", "item").distinct()
    full = cand.join(docs, "doc").join(items.withColumnRenamed("text", "item_text"), "item").select("doc", "item", "text", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(_passages(words(x), run) & _passages(words(y), run)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            ok = pa.array([i for i, k in enumerate(n) if k], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(ok), b.column(1).take(ok), pa.array([k for k in n if k], pa.int32())], names=["doc", "item", "shared_passages"])

    return full.mapInArrow(verify, fields)
