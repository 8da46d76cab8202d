"""Chunks of source files as a table function (T1, T2, T4): one row per file in, one per function or class out.

Python files are cut by the standard syntax tree, ten other languages by the scanners of ``scanners``; a chunker of one's own is
registered with ``register_chunker``. Files of other languages give no rows.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import language_of, should_skip
from lodeweave.operators.scanners import LANGUAGES, scanner

#: (name, type, first line, last line, complexity) of every chunk of a text.
Chunks = list[tuple[str, str, int, int, int]]
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)


def branches(node: ast.AST) -> int:
    """1 + branches, else parts and boolean operators, nested functions included."""
    n = 1
    for x in ast.walk(node):
        n += isinstance(x, _BRANCH)
        n += isinstance(x, (ast.If, ast.For, ast.While)) and bool(x.orelse) and not (isinstance(x, ast.If) and len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If))
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
    return n


def python_chunks(text: str, mode: str = "history") -> Chunks:
    """``history`` does not look into functions and names methods ``function``; ``review`` goes into nested ones."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: Chunks = []

    def walk(node: ast.AST) -> None:
        for x in ast.iter_child_nodes(node):
            function = isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))
            if function or isinstance(x, ast.ClassDef):
                out.append((x.name, "function" if function else "class", x.lineno, x.end_lineno or x.lineno, branches(x)))
            if not function or mode != "history":
                walk(x)

    walk(tree)
    return out


_CHUNKERS: dict[str, Callable[[str, str], Chunks]] = {"python": python_chunks, **{n: scanner(n) for n in LANGUAGES}}


def register_chunker(language: str, chunker: Callable[[str, str], Chunks]) -> None:
    """The chunker of a language; it is called in the Python workers."""
    _CHUNKERS[language] = chunker


def chunk_files(files: DataFrame, path: str, text: str, *keep: str, mode: str = "history") -> DataFrame:
    """T4: ``keep``, language, chunk_name, chunk_type, start_line, end_line, complexity, raw_code of the files that are not skipped.

    A text that does not parse, a null text and a language without a chunker give no rows.
    """
    chunkers = dict(_CHUNKERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                lines = None
                for name, kind, first, last, score in chunkers[r[-2]](r[-1], mode):
                    lines = r[-1].split("\n") if lines is None else lines
                    rows.append((*r[:-1], name, kind, first, last, score, "\n".join(lines[first - 1 : last])))
            yield pd.DataFrame(rows, columns=[*keep, "language", "chunk_name", "chunk_type", "start_line", "end_line", "complexity", "raw_code"])

    picked = files.filter(F.col(text).isNotNull() & ~should_skip(path, text)).select(*keep, language_of(path).alias("language"), F.col(text).alias("_t"))
    picked = picked.filter(F.col("language").isin(list(chunkers)))
    kinds = "".join(f"`{n}` {t}, " for n, t in picked.select(*keep).dtypes)
    return picked.mapInPandas(run, f"{kinds}language string, chunk_name string, chunk_type string, start_line int, end_line int, complexity int, raw_code string")
