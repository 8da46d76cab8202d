"""Python files for the chart parser: a lexer with nested f-strings, logical lines by indentation, blocks by the kinds of their lines.

Python's own parser comes first. What it accepts is valid; what it rejects has its edits counted and placed by the chart; what
only its fixed limits keep it from reading (nesting, depth of its stack, digits of a number) is judged by the chart alone.
"""

from __future__ import annotations

import ast
import re
import warnings

from lodeweave.llm import syntax_grammars as G
from lodeweave.llm.chart import Grammar
from lodeweave.llm.syntax import _CLOSE, Broken, Group

_STR = re.compile(r"(?i)(r[bf]?|[bf]r?|u)?('''|\"\"\"|'|\")")
_LEX = re.compile(
    r"(?P<nl>\r\n?|\n)|(?P<ws>[ \t\f]+|\\\r?\n|#[^\r\n]*)|(?P<num>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?[\d_]+)?[jJ]?)|(?P<name>[^\W\d]\w*)|(?P<br>[()\[\]{}])"
    r"|(?P<op>\*\*=|//=|<<=|>>=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%&|^~<>=:,.;@])|(?P<bad>[\s\S])"
)
_WORDS = frozenset("None True False and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_OWN = frozenset("* ** , . : ; = := -> @ ~ ... /".split())
_KINDS = {"if": "IF", "elif": "ELIF", "else": "ELSE", "for": "FOR", "while": "WHILE", "try": "TRY", "except": "EXCEPT", "finally": "FINALLY", "with": "WITH", "def": "DEF", "class": "CLASS"}
#: Messages of limits of CPython, which its grammar does not have.
_LIMITS = ("too many nested", "too many levels", "too complex", "Exceeds the limit")
_grammar: list[Grammar] = []


def _string(text: str, at: int) -> int:
    """End of the string literal at ``at``."""
    m = _STR.match(text, at)
    quote, formatted = m[2], "f" in (m[1] or "").lower()
    i, n = m.end(), len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif text.startswith(quote, i):
            return i + len(quote)
        elif c == "\n" and len(quote) == 1:
            raise Broken(at, False)
        elif formatted and c == "{":
            i = i + 2 if text.startswith("{{", i) else _field(text, i + 1)
        else:
            i += 1
    raise Broken(at, True)


def _field(text: str, at: int) -> int:
    """End of a replacement field whose expression starts at ``at``."""
    i, n, depth = at, len(text), 0
    while i < n:
        c = text[i]
        if _STR.match(text, i) and not (text[i - 1].isalnum() or text[i - 1] == "_"):
            i = _string(text, i)
            continue
        if c == "}" and not depth:
            return i + 1
        if c == ":" and not depth:  # a format, in which quotes are characters
            i += 1
            while i < n and text[i] != "}":
                i = _field(text, i + 1) if text[i] == "{" else i + 1
            return i + 1
        depth += (c in "([{") - (c in ")]}")
        i += 1
    raise Broken(at, True)


def rows(text: str) -> tuple[list[tuple[int, list, int]], list[tuple[int, int]], bool]:
    """Logical lines as (indentation, items, offset), the edits of tokens and brackets, and whether something is left open."""
    out: list[tuple[int, list, int]] = []
    root = Group("", 0)
    stack, edits, at, n, indent = [root], [], 0, len(text), 0
    fresh = True  # at the start of a physical line
    while at < n:
        m = _STR.match(text, at) or _LEX.match(text, at)
        if m.re is _STR:
            try:
                end = _string(text, at)
            except Broken as e:
                if e.args[1]:
                    return out, [*edits, (at, 1)], True
                edits.append((at, 1))
                end = text.find("\n", at)
                end = n if end < 0 else end
            kind, t = "STR", "STR"
        else:
            kind, t, end = m.lastgroup, m[0], m.end()
        if kind == "nl":
            if len(stack) == 1:
                if root.items:
                    out.append((indent, root.items, root.items[0][1]))
                root = stack[0] = Group("", end)
                fresh = True
        elif kind == "ws":
            pass
        else:
            if fresh and len(stack) == 1 and not root.items:
                start = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
                indent, fresh = len(text[start:at].replace("\f", "").expandtabs(8)), False
            if kind == "num" and end < n and (text[end].isalnum() or text[end] == "_") and not re.match(r"(?:and|else|for|if|in|is|not|or)\b", text[end : end + 5]):
                edits.append((at, 1))
            if kind == "bad":
                edits.append((at, 1))
            elif kind == "br":
                if t in "([{":
                    g = Group(t, at)
                    stack[-1].items.append((g, at, False))
                    stack.append(g)
                elif len(stack) > 1 and _CLOSE[stack[-1].open] == t:
                    stack.pop()
                else:
                    return out, [*edits, (at, 1)], False
            else:
                if kind == "op":
                    t = t if t in _OWN else "BINUN" if t in "+-" else "AUG" if t[-1] == "=" and t not in ("==", "!=", "<=", ">=") else "BIN"
                elif kind == "name":
                    t = t if t in _WORDS else "I"
                elif kind == "num":
                    t = "LIT"
                stack[-1].items.append((t, at, False))
        at = end
    if len(stack) > 1:
        return out, edits + [(g.at, 1) for g in stack[1:]], True
    if root.items:
        out.append((indent, root.items, root.items[0][1]))
    return out, edits, False


def chart_edits(text: str, most: int = 2) -> tuple[list[tuple[int, int]], bool]:
    """(edits as offset and cost, whether something is left open at the end) by the chart alone."""
    if not _grammar:
        _grammar.append(Grammar(G.PYTHON))
    g = _grammar[0]
    lines, edits, unclosed = rows(text)
    if edits:
        return edits, unclosed

    def symbol(x: str | Group) -> str:
        if not isinstance(x, Group):
            return x
        syms = tuple([symbol(it[0]) for it in x.items])
        kinds = {"(": "ap", "[": "a", "{": "a"}[x.open]
        rule = {"(a": "parens", "(p": "params", "[a": "index", "{a": "braces"}
        good = "".join(k for k in kinds if g.cost(rule[x.open + k], syms, 0) == 0)
        if not good:
            edits.append((x.at, max(1, min(g.cost(rule[x.open + k], syms, most) for k in kinds))))
        return x.open + (good or kinds)

    def block(i: int, rule: str) -> int:
        """The lines from ``i`` on of one indentation; the first line beyond them."""
        indent, _, start = lines[i]
        kinds: list[str] = []
        while i < len(lines) and lines[i][0] >= indent:
            own, items, at = lines[i]
            if own > indent:  # indented for no reason
                edits.append((at, 1))
                i = block(i, "block")
                continue
            inner = i + 1 < len(lines) and lines[i + 1][0] > indent
            syms = tuple([symbol(it[0]) for it in items])
            first = syms[1] if syms[0] == "async" and len(syms) > 1 else syms[0]
            kind, head, body = _KINDS.get(first, ""), "head", "block"
            if rule == "cases" and text.startswith("case", at):
                kind, head = "CASE", "case"
            elif not kind and text.startswith("match", at) and inner and text.startswith("case", lines[i + 1][2]):
                kind, head, body = "MATCH", "match", "cases"
            i += 1
            if not kind:
                kind = "DECO" if first == "@" else "SIMPLE"
                c = g.cost("deco" if first == "@" else "line", syms, most)
            elif inner or syms[-1] == ":":
                c = g.cost(head, syms, most)
                if not inner:  # no body
                    edits.append((at, 1))
            else:
                c = g.cost(head + "line", syms, most)
            if c:
                edits.append((at, c))
            if inner and kind not in ("SIMPLE", "DECO"):
                i = block(i, body)
            kinds.append(kind)
        c = g.cost(rule, tuple(kinds), most)
        if c:
            edits.append((start, c))
        return i

    at = 0
    while at < len(lines):
        if at or lines[0][0]:  # the file's first line is indented, or a later one less than it
            edits.append((lines[at][2], 1))
        at = block(at, "block")
    return edits, False


def check(text: str, most: int = 2) -> tuple[list[tuple[int, int]], bool]:
    """(edits as offset and cost, whether something is left open at the end)."""
    lead = len(text) - len(text.lstrip("﻿"))
    text = text[lead:]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return [], False
        except RecursionError:  # raised while the tree is handed over: the parser has accepted the text
            return [], False
        except MemoryError:  # its stack was too small
            return chart_edits(text, most)
        except ValueError:  # null characters
            return [(0, 1)], False
        except SyntaxError as e:
            error = e
    said = str(error)
    if any(x in said for x in _LIMITS):
        return chart_edits(text, most)
    line = error.lineno or 1
    where = sum(len(x) + 1 for x in text.split("\n")[: line - 1])
    unclosed = "never closed" in said or "EOF" in said or "unterminated" in said and ("triple-quoted" in said or where + 1 > text.rfind("\n"))
    edits, left_open = chart_edits(text, most) if most else ([], False)
    return [(at + lead, c) for at, c in edits or [(where, 1)]], unclosed or left_open
