"""Ruby files for the chart parser: a lexer with heredocs and interpolation, blocks by keyword, statements by line."""

from __future__ import annotations

import re

from lodeweave.llm import syntax_grammars as G
from lodeweave.llm.chart import Grammar
from lodeweave.llm.syntax import _CLOSE, _RUBY_WORDS, Broken, Group

_OP = re.compile(r"\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|\*\*|==|!=|>=|<=|=>|=~|!~|&&|\|\||\.\.|::|&\.|->|<<|>>|\+=|-=|\*=|/=|%=|\|=|&=|\^=|[-+*/%&|^!~<>=?:,.;@]")
_NAME = re.compile(r"(?:@@?|\$)?[^\W\d]\w*[?!]?(?!=[^=~>])|(?:@@?|\$)?[^\W\d]\w*|\$[\W\d]")
_NUM = re.compile(r"0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][-+]?\d+)?[ri]?")
_HEREDOC = re.compile(r"<<([~-]?)([\"'`]?)([A-Za-z_]\w*)\2")
_PERCENT = re.compile(r"%([wWiIqQrsx]?)([^\w\s])")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_VALUE = frozenset("I CONST LIT ) ] } end self nil".split())
_grammar: list[Grammar] = []


def _string(text: str, at: int, close: str, open_: str = "", interpolate: bool = True) -> int:
    """End of a string whose text starts at ``at``."""
    i, n, depth = at, len(text), 0
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if interpolate and c == "#" and text.startswith("#{", i):
            d, i = 1, i + 2
            while i < n and d:
                if text[i] in "\"'":
                    i = _string(text, i + 1, text[i])
                    continue
                d += (text[i] == "{") - (text[i] == "}")
                i += 1
            continue
        if open_ and open_ != close and c == open_:
            depth += 1
        elif c == close:
            if not depth:
                return i + 1
            depth -= 1
        i += 1
    raise Broken(at, True)


def lex(text: str) -> list[tuple[str, int, bool]]:
    """(symbol, offset, line end before); brackets are their own symbols, ``NL`` stands for an end of a statement's line."""
    out: list[tuple[str, int, bool]] = []
    at, n, last, space = 0, len(text), "", True
    pending: list[tuple[str, str]] = []

    def put(s: str, pos: int) -> None:
        nonlocal last, space
        out.append((s, pos, False))
        last, space = s, False

    while at < n:
        c = text[at]
        if c == "\n":
            at += 1
            for squiggly, word in pending:
                m = re.compile(rf"^{'[ \t]*' if squiggly else ''}{word}\r?$", re.M).search(text, at)
                if not m:
                    raise Broken(at, True)
                at = m.end()
            pending = []
            if last not in ("NL", ""):
                put("NL", at - 1)
            space = True
            if text.startswith("=begin", at):
                e = text.find("\n=end", at)
                if e < 0:
                    raise Broken(at, True)
                at = text.find("\n", e + 1)
                at = n if at < 0 else at
            elif text.startswith("__END__\n", at) or text[at:] == "__END__":
                break
            continue
        if c in " \t\r\f":
            at, space = at + 1, True
            continue
        if c == "\\" and text[at + 1 : at + 2] in ("\n", "\r"):
            at = text.find("\n", at) + 1
            continue
        if c == "#":
            e = text.find("\n", at)
            at = n if e < 0 else e
            continue
        value = last in _VALUE
        if c in "\"'`":
            e = _string(text, at + 1, c, interpolate=c != "'")
            label = e < n and text[e] == ":" and text[e : e + 2] != "::" and last in ("{", ",", "(", "NL", "|", "I")
            put("LABEL" if label else "LIT", at)
            at = e + label
            continue
        m = _HEREDOC.match(text, at)
        if m and (not value or (last == "I" and space and (m[1] or m[2] or m[3].isupper()))):
            pending.append((m[1], m[3]))
            put("LIT", at)
            at = m.end()
            continue
        m = _PERCENT.match(text, at)
        if m and (not value or (last == "I" and space and text[m.end() : m.end() + 1] != " " and m[2] != "=")):
            at_ = _string(text, m.end(), _PAIRS.get(m[2], m[2]), m[2], m[1] not in ("w", "i", "q"))
            put("LIT", at)
            at = at_
            continue
        if c == "/" and (not value or (last == "I" and space and text[at + 1 : at + 2] not in (" ", "="))):
            e = _string(text, at + 1, "/")
            while e < n and text[e].isalpha():
                e += 1
            put("LIT", at)
            at = e
            continue
        if c == ":" and text[at + 1 : at + 2] == '"' and not value:
            put("LIT", at)
            at = _string(text, at + 2, '"')
            continue
        if c == ":" and not text.startswith("::", at) and (not value or space):
            m = re.compile(r":(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*|\[\]=?|[-+*/<>=!~%&|^]{1,3}|@\w+)").match(text, at)
            if m and not (value and text[at + 1 : at + 2] == " "):
                put("LIT", at)
                at = m.end()
                continue
        if c == "?" and not value and re.match(r"\?[^\s](?!\w)", text[at : at + 3]):
            put("LIT", at)
            at += 2
            continue
        m = _NAME.match(text, at)
        if m:
            t, e = m[0], m.end()
            after_dot = last in (".", "&.")
            if e < n and text[e] == ":" and text[e : e + 2] != "::" and not after_dot and last != "?" and (t[-1] not in "?!" or True) and not (last in ("I", "LIT") and not space):
                put("LABEL", at)
                at = e + 1
                continue
            if after_dot or (last == "def" and t not in ("self",)):
                put("CONST" if t[0].isupper() else "I", at)
            elif t in ("true", "false", "__FILE__", "__LINE__", "__dir__"):
                put("LIT", at)
            elif t in _RUBY_WORDS:
                put(t, at)
            else:
                put("CONST" if t[0].isupper() else "I", at)
            at = e
            continue
        m = _NUM.match(text, at)
        if m:
            if m.end() < n and (text[m.end()].isalpha() or text[m.end()] == "_"):
                raise Broken(at, False)
            put("LIT", at)
            at = m.end()
            continue
        if c in "()[]{}":
            put(c, at)
            at += 1
            continue
        m = _OP.match(text, at)
        if not m:
            raise Broken(at, False)
        t = m[0]
        if t in ("+", "-"):
            s = "BINUN"
        elif t == "&":
            s = "BITAND"
        elif t == "=" or t.endswith("=") and t not in ("==", "!=", ">=", "<=", "==="):
            s = "ASG"
        elif t in ("..", "..."):
            s = ".."
        elif t in ("*", "**", "<", ">", "|", "<<", "=>", "=~", "::", "&.", ".", "->", "!", "~", "?", ":", ",", ";"):
            s = "NL" if t == ";" else t
        else:
            s = "BIN"
        put(s, at)
        at = m.end()
    return out


_GOES_ON = frozenset("BIN BINUN BITAND ASG , . &. :: * ** < > << => =~ ! ~ ? : -> and or not".split())
_HEADS = {"def": "def_head", "class": "class_head", "module": "module_head", "if": "cond_head", "unless": "cond_head", "while": "loop_head", "until": "loop_head", "case": "case_head", "for": "for_head", "begin": "begin_head", "do": "do_head"}
_STARTS = frozenset(["NL", "", "ASG", "(", "[", "{", ",", "=>", "BIN", "|", "then", "do", "else", "begin", "ensure", "and", "or", "not", "!", "LABEL", "->", "?", ":", "elsif", "when", "<<"])


class _Block(Group):
    """A keyword block up to its ``end``; ``open`` is the keyword."""


def check(text: str, most: int = 2) -> tuple[list[tuple[int, int]], bool]:
    """(edits as offset and cost, whether something is left open at the end)."""
    if not _grammar:
        _grammar.append(Grammar(G.RUBY))
    g = _grammar[0]
    try:
        toks = lex(text)
    except Broken as e:
        return [(e.args[0], 1)], e.args[1]
    root = Group("", 0)
    stack, edits = [root], []
    loop_do = 0  # a while, until or for whose own ``do`` may follow on its line
    last = ""
    for i, (s, at, _) in enumerate(toks):
        top = stack[-1]
        if s in ("(", "[", "{"):
            new = Group(s, at)
            top.items.append((new, at, False))
            stack.append(new)
        elif s in (")", "]", "}"):
            if _CLOSE.get(top.open) == s:
                stack.pop()
            else:
                return [(at, 1)], False
        elif s == "end":
            if isinstance(top, _Block):
                stack.pop()
            else:
                return [(at, 1)], False
        elif s == "do" and loop_do == len(stack):
            loop_do = 0
            top.items.append(("do", at, False))
        elif s in ("def", "class", "module", "begin", "case", "for", "do") or (s in ("if", "unless", "while", "until") and (last in _STARTS)):
            if s in ("while", "until", "for"):
                loop_do = len(stack) + 1
            new = _Block(s, at)
            top.items.append((new, at, False))
            stack.append(new)
            if s == "def":  # endless definition
                j, depth = i + 1, 0
                while j < len(toks) and toks[j][0] != "NL" and not (depth == 0 and toks[j][0] == "ASG"):
                    depth += (toks[j][0] in "([{") - (toks[j][0] in ")]}")
                    j += 1
                if j < len(toks) and toks[j][0] == "ASG" and depth == 0 and j >= i + 2 and text[toks[j][1] - 1] in " \t":
                    stack.pop()
                    top.items.pop()
                    top.items.append(("DEFX", at, False))
        else:
            if s == "NL":
                nxt = toks[i + 1][0] if i + 1 < len(toks) else ""
                if loop_do == len(stack):
                    loop_do = 0
                if last in _GOES_ON and not (last in ("*", "BITAND", "?", "!") and False) or nxt in (".", "&.") or top.open in ("[",):
                    continue
                if top.open in ("(", "{") and (last in ("", "(", "{") or nxt in (")", "}")):
                    continue
            top.items.append((s, at, False))
        last = s
    if len(stack) > 1:
        return [(stack[-1].at, 1)], True

    def symbol(x: str | Group) -> str:
        if not isinstance(x, Group):
            return x
        if isinstance(x, _Block):
            block(x)
            return "DO" if x.open == "do" else "GRP"
        items = [it for it in x.items]
        syms = tuple([symbol(it[0]) for it in items])
        good = ""
        if x.open == "(":
            plain = tuple(s for s in syms if s != "NL")
            if g.cost("args", plain, 0) == 0 or all(g.cost("stmt", p, 0) == 0 for p in parts(syms)):
                good += "a"
            if g.cost("params", plain, 0) == 0:
                good += "p"
        elif x.open == "[":
            good = "a" if g.cost("array", tuple(s for s in syms if s != "NL"), 0) == 0 else ""
        else:
            if g.cost("hash", tuple(s for s in syms if s != "NL"), 0) == 0:
                good += "h"
            body = syms
            if body and body[0] == "|" and "|" in body[1:]:
                k = body.index("|", 1)
                ok = g.cost("blockp", body[: k + 1], 0) == 0
                body = body[k + 1 :]
            else:
                ok = True
            if ok and all(g.cost("stmt", p, 0) == 0 for p in parts(body)):
                good += "k"
        if not good:
            edits.append((x.at, 1))
            good = "aphk"
        return x.open + good

    def parts(syms: tuple[str, ...]) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        cur: list[str] = []
        for s in syms:
            if s == "NL":
                if cur:
                    out.append(tuple(cur))
                cur = []
            else:
                cur.append(s)
        if cur:
            out.append(tuple(cur))
        return out

    def split(items: list) -> list[list]:
        out, cur = [], []
        for it in items:
            if it[0] == "NL":
                out.append(cur)
                cur = []
            else:
                if it[0] in ("else", "elsif", "when", "ensure") and cur:
                    out.append(cur)
                    cur = []
                cur.append(it)
        out.append(cur)
        return out

    def line(start: str, items: list) -> None:
        syms = tuple([symbol(it[0]) for it in items])
        if syms[:1] == ("DEFX",):
            start, syms = "def_head", syms[1:]
            k = syms.index("ASG") if "ASG" in syms else 0
            syms = (*syms[: k + 1], *syms[k + 1 :])
        if syms[:1] in (("else",), ("elsif",), ("when",), ("in",), ("rescue",), ("ensure",)) and start == "stmt":
            start = "part"
        c = g.cost(start, syms, most)
        if c:
            edits.append((items[0][1] if items else 0, c))

    def block(x: _Block) -> None:
        rows = split(x.items)
        head = rows[0]
        if x.open == "begin" and not head:
            pass
        elif x.open in ("do", "case", "begin") and not head:
            pass
        else:
            line(_HEADS[x.open], head)
        for r in rows[1:]:
            if r:
                line("stmt", r)

    for r in split(root.items):
        if r:
            line("stmt", r)
    return edits, False
