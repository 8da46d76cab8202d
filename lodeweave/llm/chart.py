"""Error-correcting chart parsing: the least number of token insertions, deletions and substitutions that makes a sequence valid.

A grammar is a text of rules ``name = alternatives``. Literals stand in quotes, upper-case names are token classes,
lower-case names are rules, ``( ) ? * + |`` have their usual meaning. A symbol of a sequence is either a token's text, a token
class, or a bracketed group written ``(abc``, ``[abc`` or ``{abc``: the bracket and the kinds of contents it may be; the
grammar's ``(a`` matches a group with kind ``a``. The chart holds, for a rule and a start, the least cost of each end.
"""

from __future__ import annotations

import re
import sys
from functools import cache
from heapq import heappop, heappush

_TOKEN = re.compile(r"\s*(?:'([^']*)'|([A-Z][A-Z]*)|([a-z][a-z_0-9]*)|([(){}?*+|\[\]]))")


_NONE: dict[int, int] = {}


def deep(frames: int) -> None:
    """Room for ``frames`` calls more; such calls of Python functions lie on the heap, so their depth may follow the input."""
    if sys.getrecursionlimit() < frames + 50_000:
        sys.setrecursionlimit(2 * frames + 50_000)


@cache
def _wants(symbol: str) -> frozenset:
    """The grammar's tokens that a symbol is: itself, of a group each of its kinds."""
    return frozenset([symbol, *(symbol[0] + k for k in symbol[1:])]) if symbol[0] in "([{" else frozenset([symbol])


def _shorten(s: tuple[str, ...], keep: int = 4) -> tuple[str, ...]:
    """The sequence with long runs of one and the same item between commas cut to ``keep``: lists are valid at any length."""
    if len(s) < 3 * keep or "," not in s:
        return s
    out: list[str] = []
    i, n = 0, len(s)
    while i < n:
        if i + 2 * keep < n and s[i + 1] == ",":
            j = i
            while j + 2 < n and s[j + 2] == s[i] and s[j + 1] == ",":
                j += 2
            times = (j - i) // 2  # items after the first that repeat it
            if times > keep:
                out += [s[i], ","] * keep
                i = j
                continue
        out.append(s[i])
        i += 1
    return tuple(out)


class Grammar:
    def __init__(self, text: str):
        self.rules: dict[str, tuple] = {}
        for line in re.sub(r"\n[ \t]+", " ", text).strip().split("\n"):
            if line.strip():
                name, body = line.split(" = ", 1)
                self.rules[name.strip()] = self._parse(body)
        self._firsts()
        self.memo: dict[tuple, int] = {}

    def _parse(self, body: str) -> tuple:
        toks = []
        at = 0
        while at < len(body):
            m = _TOKEN.match(body, at)
            if not m:
                if body[at:].strip():
                    raise ValueError(f"grammar: {body[at : at + 30]!r}")
                break
            toks.append(m)
            at = m.end()
        pos = 0

        def alt() -> tuple:
            nonlocal pos
            options = [seq()]
            while pos < len(toks) and toks[pos][4] == "|":
                pos += 1
                options.append(seq())
            return options[0] if len(options) == 1 else ("alt", tuple(options))

        def seq() -> tuple:
            nonlocal pos
            items = []
            while pos < len(toks) and toks[pos][4] not in ("|", ")"):
                m = toks[pos]
                pos += 1
                if m[4] == "(":
                    item = alt()
                    pos += 1
                elif m[1] is not None:
                    item = ("tok", m[1])
                elif m[2]:
                    item = ("tok", m[2])
                else:
                    item = ("rule", m[3])
                while pos < len(toks) and toks[pos][4] in ("?", "*", "+"):
                    item = ({"?": "opt", "*": "many", "+": "some"}[toks[pos][4]], item)
                    pos += 1
                items.append(item)
            return items[0] if len(items) == 1 else ("seq", tuple(items))

        return alt()

    def _firsts(self) -> None:
        """What each node may start with and whether it may be empty, so that exact parsing skips what cannot fit."""
        firsts: dict[str, frozenset] = dict.fromkeys(self.rules, frozenset())
        empty = dict.fromkeys(self.rules, False)

        def look(node: tuple) -> tuple[frozenset, bool]:
            kind, arg = node
            if kind == "tok":
                return frozenset([arg]), False
            if kind == "rule":
                return firsts[arg], empty[arg]
            if kind == "alt":
                got = [look(x) for x in arg]
                return frozenset().union(*(f for f, _ in got)), any([e for _, e in got])
            if kind == "seq":
                out: frozenset = frozenset()
                for x in arg:
                    f, e = look(x)
                    out |= f
                    if not e:
                        return out, False
                return out, True
            f, e = look(arg)
            return f, e or kind != "some"

        def build(node: tuple) -> tuple:
            kind, arg = node
            f, e = look(node)
            if kind in ("alt", "seq"):
                return kind, tuple(build(x) for x in arg), f, e
            if kind == "some":  # one and then any number
                return "seq", (build(arg), build(("many", arg))), f, e
            return kind, build(arg) if kind in ("opt", "many") else arg, f, e

        while True:
            got = {name: look(node) for name, node in self.rules.items()}
            if all(got[k] == (firsts[k], empty[k]) for k in got):
                break
            firsts, empty = {k: f for k, (f, _) in got.items()}, {k: e for k, (_, e) in got.items()}
        self.nodes = {name: build(node) for name, node in self.rules.items()}

    def cost(self, start: str, symbols: tuple[str, ...], most: int = 3) -> int:
        """Least edits at any length, or ``most + 1`` where more are needed; results are remembered by the sequence's symbols."""
        symbols = _shorten(symbols, max(4, most + 1))
        key = (start, symbols, most)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = most + 1
            for bound in range(most + 1):
                if self._run(start, symbols, bound) <= bound:
                    got = bound
                    break
            self.memo[key] = got
        return got

    def _run(self, start: str, s: tuple[str, ...], bound: int) -> int:
        """Least edits up to ``bound``. A rule is parsed with the edits that are left at its start, so what follows the last one is parsed exactly."""
        n = len(s)
        deep(200 * n)
        have = [_wants(x) for x in s]
        chart: list[dict[tuple[str, int], dict[int, int]]] = [{} for _ in range(n + 1)]
        nodes = self.nodes
        done = 0

        def walk(node: tuple, i: int, b: int) -> dict[int, int]:
            kind, arg, first, empty = node
            if not b and not empty and (i >= n or have[i].isdisjoint(first)):
                return _NONE
            if kind == "tok":
                if not b:
                    return {i + 1: 0}
                out = {}
                if i < n:
                    out[i + 1] = 0 if arg in have[i] else 1  # as it is, or substituted
                out[i] = 1  # insertion
                for d in range(1, min(b, n - i - 1) + 1):  # deletions before the token
                    if arg in have[i + d]:
                        out[i + d + 1] = min(out.get(i + d + 1, 99), d)
                return out
            if kind == "rule":
                here, key = chart[i], (arg, b)
                got = here.get(key)
                if got is None:
                    here[key] = _NONE  # a rule that starts with itself finds nothing
                    got = here[key] = walk(nodes[arg], i, b)
                return got
            if kind == "seq":
                ends = {i: 0}
                for item in arg:
                    new: dict[int, int] = {}
                    for e, c in ends.items():
                        for f, d in walk(item, e, b - c).items():
                            if c + d < new.get(f, 99):
                                new[f] = c + d
                    if not new:
                        return new
                    ends = new
                return ends
            if kind == "alt":
                ends = {}
                for item in arg:
                    for f, d in walk(item, i, b).items():
                        if d < ends.get(f, 99):
                            ends[f] = d
                return ends
            if kind == "opt":
                ends = dict(walk(arg, i, b))
                ends[i] = 0
                return ends
            return many(arg, i, b, False)

        def many(item: tuple, i: int, b: int, outer: bool) -> dict[int, int]:
            """Any number of an item, place by place; behind the outermost one nothing is asked again, so its chart can go."""
            nonlocal done
            ends, front = {i: 0}, [i]
            while front:
                e = heappop(front)
                c = ends[e]
                if outer:
                    for k in range(done, e):
                        chart[k] = {}
                    done = max(done, e)
                for f, d in walk(item, e, b - c).items():
                    if f > e and c + d < ends.get(f, 99):
                        if f not in ends:
                            heappush(front, f)
                        ends[f] = c + d
            return ends

        def top(node: tuple) -> dict[int, int]:
            """The start rule, whose lists are not inside of another one."""
            ends = {0: 0}
            for item in node[1] if node[0] == "seq" else (node,):
                new: dict[int, int] = {}
                for e, c in ends.items():
                    for f, d in (many(item[1], e, bound - c, True) if item[0] == "many" else walk(item, e, bound - c)).items():
                        if c + d < new.get(f, 99):
                            new[f] = c + d
                ends = new
            return ends

        best = bound + 1
        for e, c in top(nodes[start]).items():
            best = min(best, c + n - e)  # what is left over is deleted
        return best
