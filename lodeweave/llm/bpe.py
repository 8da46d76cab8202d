"""Problem 8: byte-level BPE by a tokenization automaton.

The automaton reads token labels; a sequence of labels is accepted iff it is the BPE encoding of its text. It is built from
the one-state automaton of single bytes by one gadget per merge ``(u, v)``, in order of rank: the state that ``u`` leads to
is replaced by a copy without the arc ``v``, and every state with the arc ``u`` gets the arc ``uv`` to where ``v`` leads. All
arcs of one label lead to one state, so a state is named by a label, and whether it has an arc follows from the gadgets along
the right spine of the state's label and the left spine of the arc's label.

The labels' texts are compiled into one table of byte transitions (a trie with failure links, flattened into arrays), which
gives the longest label that ends at each byte, and a chain of the next shorter ones. Encoding a word walks that table once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import spread

_loaded: dict[str, BpeAutomaton] = {}
_NEVER = 1 << 60


class _Words(dict):
    """Ids of the words of the split; forgets all when it holds half a million of them."""

    def __init__(self, automaton: BpeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> list[int]:
        ids = self.automaton.encode_word(word)
        if len(self) >= 500_000:
            self.clear()
        self[word] = ids
        return ids


class BpeAutomaton:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        n = max(ranks.values()) + 1
        self.text: list[bytes] = [b""] * n
        for t, i in ranks.items():
            self.text[i] = t
        if any(len(self.text[i]) != 1 for i in range(min(256, n))):
            raise ValueError("the first 256 labels must be the single bytes")
        self.left, self.right = [-1] * n, [-1] * n  # the merge of each label; its rank is its time
        self.merge: dict[tuple[int, int], int] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1:
                a, b = self._last_two(t, i)
                self.left[i], self.right[i] = a, b
                self.merge[(a, b)] = i
        self._compile()
        self.arcs: dict[int, bool] = {}
        self.words = _Words(self)

    def _compile(self) -> None:
        """``step``: node and byte -> node; ``fail``: where a node without the byte goes on; ``longest``: the longest label that ends at a
        node; ``shorter``: the longest label that properly ends a label."""
        step: dict[int, int] = {}
        label, parents = [-1], [(0, 0)]
        for i, t in enumerate(self.text):
            node = 0
            for c in t:
                key = node << 8 | c
                to = step.get(key)
                if to is None:
                    to = step[key] = len(label)
                    label.append(-1)
                    parents.append((node, c))
                node = to
            if t:
                label[node] = i
        depth = np.zeros(len(label), np.int64)
        for node in range(1, len(label)):
            depth[node] = depth[parents[node][0]] + 1
        fail, longest = [0] * len(label), [-1] * len(label)
        self.shorter = [-1] * len(self.text)
        for node in np.argsort(depth, kind="stable").tolist()[1:]:
            at, c = parents[node]
            back = fail[at]
            while at and back and back << 8 | c not in step:
                back = fail[back]
            fail[node] = step.get(back << 8 | c, 0) if at else 0
            below = longest[fail[node]]
            longest[node] = label[node] if label[node] >= 0 else below
            if label[node] >= 0:
                self.shorter[label[node]] = below
        self.step, self.fail, self.ends = step, fail, longest

    def _last_two(self, t: bytes, rank: int) -> tuple[int, int]:
        """The two labels whose merge makes ``t``: its encoding by the merges before it."""
        parts = [t[k : k + 1] for k in range(len(t))]
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda j: self.ranks.get(parts[j] + parts[j + 1], _NEVER))
            if self.ranks.get(parts[k] + parts[k + 1], _NEVER) >= rank:
                raise ValueError(f"label {rank} is not made by one merge")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def has_arc(self, state: int, label: int) -> bool:
        """Whether the state that label ``state`` leads to has the arc ``label`` after the last gadget; at most a million answers are kept."""
        key = state << 32 | label
        got = self.arcs.get(key)
        if got is None:
            if len(self.arcs) > 1_000_000:
                self.arcs.clear()
            got = self.arcs[key] = self._has_arc(state, label)
        return got

    def _has_arc(self, u: int, v: int) -> bool:
        limit = _NEVER  # the first time by which the pair at hand no longer stood side by side
        while True:
            if self.merge.get((u, v), _NEVER) < limit:
                return False  # that merge's gadget took the arc away
            if u > v:
                if self.left[u] < 0:
                    return True
                limit, u = u, self.right[u]
            else:  # a merge goes from left to right: at equal time the one further left comes first
                if self.left[v] < 0:
                    return True
                limit, v = v + 1, self.left[v]

    def encode_word(self, word: str) -> list[int]:
        """Labels along the one accepted path that spells the word: for each prefix, one last label follows its predecessor's state."""
        step, fail, ends, shorter, text = self.step, self.fail, self.ends, self.shorter, self.text
        b = word.encode("utf-8", "surrogatepass")
        last: list[int] = [-1] * (len(b) + 1)
        node = 0
        for end, c in enumerate(b, 1):
            while (to := step.get(node << 8 | c)) is None:
                node = fail[node]
            node = to
            label = ends[node]
            while True:
                start = end - len(text[label])
                if not start or self.has_arc(last[start], label):
                    break
                label = shorter[label]
            last[end] = label
        ids, at = [], len(b)
        while at:
            ids.append(last[at])
            at -= len(text[last[at]])
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of every text as an Arrow column."""
        flat: list[list[int]] = []
        sizes = []
        for t in texts:
            got = list(map(self.words.__getitem__, self.split(t))) if t else []
            sizes.append(sum(map(len, got)))
            flat += got
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(flat), np.int32, int(offsets[-1]))))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other."""
        return b"".join([self.text[i] for i in ids]).decode("utf-8", "replace")


def load(path: str, pattern: str) -> BpeAutomaton:
    """The automaton of a file of base64 labels and ranks, once per Python process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = BpeAutomaton({base64.b64decode(a): int(r) for a, r in map(bytes.split, f)}, pattern)
    return _loaded[path]


def default_vocabulary() -> tuple[str, str]:
    """Path and splitting pattern of byte_bpe_50k from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_column(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` of every row; null and empty texts give an empty list.

    Nothing is trimmed or normalised and strings of special tokens are ordinary text. A word-to-ids memo of bounded size lives
    in each Python worker, to which the vocabulary file is sent. Repeated rows are encoded each for itself.
    """
    if path is None or pattern is None:
        path, pattern = default_vocabulary()

    df.sparkSession.sparkContext.addFile(path)  # to every worker, whatever stands at that path there
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        bpe = load(SparkFiles.get(name), pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), bpe.encode_all(b.column(1).to_pylist())], names=[id_col, "ids"])

    kind = dict(df.select(id_col).dtypes)[id_col]
    return spread(df.select(id_col, text)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
