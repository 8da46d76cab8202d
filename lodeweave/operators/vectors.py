"""Vector expressions and joins: cosine, exact top-k of a query set against all rows in blocks, nearest in a key, means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays (V1); 0 where one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _met(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, keys: tuple[str, ...], block: int, parts: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Queries and rows of every block ``_b`` and part ``_p``: ``keys``, ``id``, ``v``, ``keep``, ``is_query``; and the type of the ids."""
    usable = lambda c: F.col(c).isNotNull() & F.exists(F.col(c), lambda x: x != 0)
    side = lambda df, is_query: df.filter(usable(vector)).select(*keys, F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), *keep, F.lit(is_query).alias("is_query"))
    q, r = side(queries, True), side(rows, False)
    blocks = max(1, -(-q.count() // block))
    at = lambda n: F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(n))
    q = q.withColumn("_b", at(blocks)).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    r = r.withColumn("_p", at(parts)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return q.unionByName(r), dict(q.dtypes)["id"]


def top_k(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 5, keys: tuple[str, ...] = (), max_distance: float | None = None, block: int = 4096, parts: int = 16) -> DataFrame:
    """The ``k`` rows nearest to each query by cosine, exactly: ``query_id``, ``id``, ``cosine`` to 6 places, ``rank``.

    Queries and rows of equal ``keys`` meet in blocks: queries are cut into blocks of about ``block``, rows into ``parts``
    parts by a hash of the id, and a task holds one block against one part; each keeps its ``k`` best, which are merged. A
    query never finds itself. Null and zero vectors take no part; ties go to the smaller id.
    """
    met, kind = _met(rows, queries, id_col, vector, keys, block, parts)

    def best(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["is_query"]], g[~g["is_query"]]
        empty = pd.DataFrame({"query_id": a["id"].iloc[:0], "id": a["id"].iloc[:0], "cosine": pd.Series([], dtype=float)})
        if a.empty or b.empty:
            return empty
        x, y = _unit(np.stack(a["v"].to_numpy())), _unit(np.stack(b["v"].to_numpy()))
        ids, names = b["id"].to_numpy(), a["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, y = ids[order], y[order]
        out = []
        for i in range(0, len(x), 512):
            s = np.round(x[i : i + 512] @ y.T, 9)
            s[names[i : i + 512][:, None] == ids[None, :]] = -9
            if max_distance is not None:
                s[s < 1 - max_distance - 1e-9] = -9
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            v = np.take_along_axis(s, top, 1)
            rr, cc = np.nonzero(v > -2)
            out.append(pd.DataFrame({"query_id": names[i : i + 512][rr], "id": ids[top[rr, cc]], "cosine": v[rr, cc]}))
        return pd.concat(out) if out else empty

    near = met.groupBy(*keys, "_b", "_p").applyInPandas(best, f"query_id {kind}, id {kind}, cosine double")
    w = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    ranked = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def pairs_within(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, keys: tuple[str, ...], max_distance: float, apart: str, block: int = 4096, parts: int = 16) -> DataFrame:
    """Every pair of a query and a row of equal ``keys`` and another ``apart`` within a cosine distance: ``query_id``, ``id``, ``cosine`` to 6 places.

    Blocks meet as in ``top_k``, but no pair is dropped; pairs leave a block 512 queries at a time, whatever their number.
    """
    met, kind = _met(rows, queries, id_col, vector, keys, block, parts, (apart,))

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(frames))
        a, b = g[g["is_query"]], g[~g["is_query"]]
        if a.empty or b.empty:
            return
        x, y = _unit(np.stack(a["v"].to_numpy())), _unit(np.stack(b["v"].to_numpy()))
        names, ids, own, other = a["id"].to_numpy(), b["id"].to_numpy(), a[apart].to_numpy(), b[apart].to_numpy()
        for i in range(0, len(x), 512):
            s = np.round(x[i : i + 512] @ y.T, 9)
            rr, cc = np.nonzero(s >= 1 - max_distance - 1e-9)
            ok = own[i : i + 512][rr] != other[cc]
            rr, cc = rr[ok], cc[ok]
            yield pd.DataFrame({"query_id": names[i : i + 512][rr], "id": ids[cc], "cosine": s[rr, cc]})

    found = met.groupBy(*keys, "_b", "_p").applyInPandas(link, f"query_id {kind}, id {kind}, cosine double")
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"))


def mean_vectors(df: DataFrame, key: str, vector: str, places: int = 6) -> DataFrame:
    """Element-wise mean per key, averaged per dimension before the shuffle; ``key``, ``centroid``, ``members``."""
    long = df.filter(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("_i", "_x"))
    mean = long.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    packed = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", F.round("_m", places).alias("_m")))).alias("_a"), F.max("_n").alias("members"))
    return packed.select(key, F.transform("_a", lambda e: e["_m"]).alias("centroid"), "members")


def neighbour_edges(df: DataFrame, id_col: str, vector: str, keys: tuple[str, ...], max_distance: float, block: int = 2048) -> DataFrame:
    """All pairs of rows of equal ``keys`` within a cosine distance, ``src`` < ``dst``; exact, block against block.

    Rows of a key are spread over blocks of about ``block`` rows by a hash; each pair of blocks is one group, so no task holds
    more than two blocks whatever the size of a key.
    """
    usable = F.col(vector).isNotNull() & F.exists(F.col(vector), lambda x: x != 0)
    rows = df.filter(usable).select(*keys, F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy(*keys).count().withColumn("_n", F.ceil(F.col("count") / block).cast("int")).drop("count")
    rows = rows.join(sizes, list(keys)).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumn("_x", F.least("_b", "_o")).withColumn("_y", F.greatest("_b", "_o"))

    def link(g: pd.DataFrame) -> pd.DataFrame:
        x, y = int(g["_x"].iloc[0]), int(g["_y"].iloc[0])
        a, b = g[g["_b"] == x], g[g["_b"] == y]
        if a.empty or b.empty:
            return pd.DataFrame({"src": [], "dst": []}, dtype=str)
        u, v = _unit(np.stack(a["v"].to_numpy())), _unit(np.stack(b["v"].to_numpy()))
        i, j = np.nonzero(u @ v.T >= 1 - max_distance - 1e-12)
        p, q = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        keep = p < q if x == y else p != q
        p, q = p[keep].astype(str), q[keep].astype(str)
        return pd.DataFrame({"src": np.where(p < q, p, q), "dst": np.where(p < q, q, p)}).drop_duplicates()

    return rows.groupBy(*keys, "_x", "_y").applyInPandas(link, "src string, dst string")
