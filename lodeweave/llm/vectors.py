"""Vectors in Arrow batches: unit rows as packed float32, so that a shuffle carries 4 bytes a number and no list offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """True for a non-null vector with a number other than zero and without null or NaN."""
    c = F.col(col)
    return c.isNotNull() & F.exists(c, lambda x: x != 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))


def pack(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``vec``, the unit vector as bytes; rows of an unusable vector are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(keep_n)
            sizes = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(sizes) and (sizes == sizes[0]).all():
                x = flat.reshape(len(sizes), -1)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                raw = [r.tobytes() for r in x]
            else:
                raw, at = [], 0
                for n in sizes:
                    v = flat[at : at + n]
                    raw.append((v / np.linalg.norm(v)).astype(np.float32).tobytes())
                    at += n
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keep_n)), pa.array(raw, pa.binary())], names=[*keep, "vec"])

    keep_n = len(keep)
    picked = df.filter(usable(vector)).select(*keep, F.col(vector).cast("array<double>").alias("_v"))
    fields = ", ".join(f"`{n}` {t}" for n, t in picked.select(*keep).dtypes)
    return picked.mapInArrow(run, f"{fields}, vec binary")


def unpack(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Matrix of the packed rows; all rows must have the same length."""
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(len(col), -1) if len(col) else np.empty((0, 1), np.float32)
