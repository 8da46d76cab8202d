"""Problem 6: oversized texts cut into pieces of whole lines at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANK = re.compile(r"[ \t\r]*\Z")
#: Strength of the boundary after a line, from strong to weak: blank line, end of a block, end of a statement.
_CLOSE = re.compile(r"[ \t]*(?:[}\])]+[;,]?|end)[ \t\r]*\Z")


def greedy_pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces as (first line, last line, from, to): each runs as far as fits and is shortened to its last new blank line.

    ``from`` and ``to`` are character offsets within the one line of a piece that is part of an overlong line, else 0, -1.
    """
    lines = text.split("\n")
    n, out, start, held = len(lines), [], 0, 0  # held: lines below it are in an earlier piece
    size = [len(x) for x in lines]
    while held < n:
        if size[held] > limit:
            out += [(held, held, a, min(a + limit, size[held])) for a in range(0, size[held], limit)]
            held += 1
            start = held
            continue
        total, end = size[start], start
        while end + 1 < n and total + 1 + size[end + 1] <= limit:
            end += 1
            total += 1 + size[end]
        if end < n - 1:
            for i in range(end, held - 1, -1):
                if _BLANK.match(lines[i]):
                    end = i
                    break
        out.append((start, end, 0, -1))
        first, held = start, end + 1
        if held < n and size[held] > limit:
            start = held
            continue
        start = held
        for back in range(overlap, 0, -1):
            s = held - back
            if s > first and s >= 0 and held < n and sum(size[s : held + 1]) + back <= limit:
                start = s
                break
    return out


def balanced_pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces near equal targets: the least count whose snapped pieces all keep the limit.

    Targets divide the text evenly; each is snapped to the strongest boundary nearby (blank line, end of a block, any line
    end; then the nearest). A line over the limit is cut into equal stretches.
    """
    lines = text.split("\n")
    size = [len(x) + 1 for x in lines]
    if max(size) - 1 > limit:
        out, a = [], 0
        for i, s in enumerate(size):
            if s - 1 > limit:
                if i > a:
                    out += [(x + a, y + a, p, q) for x, y, p, q in balanced_pieces("\n".join(lines[a:i]), limit, overlap)]
                count = -(-(s - 1) // limit)
                step = -(-(s - 1) // count)
                out += [(i, i, p, min(p + step, s - 1)) for p in range(0, s - 1, step)]
                a = i + 1
        if a < len(lines):
            out += [(x + a, y + a, p, q) for x, y, p, q in balanced_pieces("\n".join(lines[a:]), limit, overlap)]
        return out
    ends = [0]
    for s in size:
        ends.append(ends[-1] + s)
    total, n = ends[-1] - 1, len(lines)
    strength = [2 if _BLANK.match(x) else 1 if _CLOSE.match(x) else 0 for x in lines]
    count = max(1, -(-total // limit))
    while True:
        step, cuts, i = total / count, [], 0
        for k in range(1, count):
            target, reach = k * step, step * 0.2
            near = []
            while i < n and ends[i + 1] < target - reach:
                i += 1
            j = i
            while j < n - 1 and ends[j + 1] <= target + reach:
                near.append((-strength[j], abs(ends[j + 1] - target), j))
                j += 1
            if not near:
                near = [(0, abs(ends[j + 1] - target), j) for j in (max(0, min(i, n - 1)), max(0, min(i - 1, n - 1)))]
            cuts.append(min(near)[2])
        cuts = sorted({*cuts, n - 1})
        out, prev = [], -1
        for c in cuts:
            a = prev + 1
            for back in range(overlap, 0, -1):
                if out and prev + 1 - back > out[-1][0] and ends[c + 1] - ends[prev + 1 - back] - 1 <= limit:
                    a = prev + 1 - back
                    break
            out.append((a, c, 0, -1))
            prev = c
        if all(ends[y + 1] - ends[x] - 1 <= limit for x, y, _, _ in out):
            return out
        if count >= n:
            return greedy_pieces(text, limit, overlap)
        count += 1


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text: str = "raw_code", start_line: str = "start_line", limit: int = 3000, overlap: int = 2, method: str = "greedy", with_text: bool = False) -> DataFrame:
    """Pieces of each text of more than ``limit`` characters (code points): id, ``piece_no``, ``first_line``, ``last_line``.

    ``method`` is ``greedy`` (as far as fits, then back to the last blank line) or ``balanced`` (equal targets, snapped).
    Lines end at ``\\n``; line numbers are ``start_line`` (1 where null) plus the offset. Null, empty and short texts give no
    row; a repeated id is cut once for each of its rows. ``with_text`` adds ``piece``. Only long texts reach Python.
    """
    cut = greedy_pieces if method == "greedy" else balanced_pieces

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, s in zip(b["i"], b["t"], b["s"], strict=True):
                lines = t.split("\n") if with_text else None
                for k, (x, y, p, q) in enumerate(cut(t, limit, overlap), 1):
                    piece = ("\n".join(lines[x : y + 1]) if q < 0 else lines[x][p:q]) if with_text else None
                    rows.append((i, k, s + x, s + y, *([piece] if with_text else [])))
            yield pd.DataFrame(rows, columns=["i", "piece_no", "first_line", "last_line", *(["piece"] if with_text else [])])

    kind = dict(df.select(id_col).dtypes)[id_col]
    picked = df.filter(F.length(text) > limit).select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.coalesce(F.col(start_line).cast("int"), F.lit(1)).alias("s"))
    out = picked.mapInPandas(run, f"i {kind}, piece_no int, first_line int, last_line int" + ", piece string" * with_text)
    return out.withColumnRenamed("i", id_col)
