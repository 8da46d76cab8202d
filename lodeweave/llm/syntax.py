"""Problem 4: source files that do not parse, by the cost of the least syntax repair.

A file is cut into tokens and bracket groups; the groups and statements are parsed from the inside out by error-correcting
chart parsing (``chart``) with the grammar of the file's language. The cost of a file is the sum of the edits of its
statements, its unbalanced brackets and its broken tokens. A cost of zero is a valid file. Marks, what is left open at the end
and the other languages' grammars tell merge conflicts, truncated files and files in another language apart. Sequences of equal
token kinds are parsed once in a worker, so the work is mainly the lexer's. Python's own parser tells valid Python files first;
the others, and those too deep for it, go through the chart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm import syntax_grammars as G
from lodeweave.llm.chart import Grammar, deep
from lodeweave.session import spread

_CONFLICT = re.compile(r"(?m)^(?:<{7}(?: .*)?|\|{7}(?: .*)?|={7}|>{7}(?: .*)?)\r?$")
_CLOSE = {"(": ")", "[": "]", "{": "}"}

_JS_WORDS = frozenset(
    """async of get set from as let static type declare namespace module abstract readonly keyof unique infer is asserts satisfies global override accessor out public private protected
    implements interface yield await if else for while do try catch finally switch case default return throw break continue const var export extends import function class new this super null typeof
    void delete in instanceof debugger with enum""".split()
)
_JAVA_WORDS = frozenset(
    """if else for while do try catch finally switch case default return throw break continue yield assert new this super class interface enum extends implements permits throws import package
    public private protected static final abstract native synchronized transient volatile strictfp instanceof null void""".split()
)
#: Words of Java that are names elsewhere, with what follows them where they are words.
_JAVA_CONTEXT = {
    "record": re.compile(r"\s+[A-Z]\w*\s*[(<]"), "sealed": re.compile(r"\s+(?:\w+\s+)*?(?:class|interface)\b"), "permits": re.compile(r"\s+[A-Z][\w.]*\s*[,{]"),
    "when": re.compile(r"[ \t]+[^\n=;]*(?:->|:)"), "module": re.compile(r"\s+java\."),
}
_JAVA_TYPES = frozenset("int long double float boolean char byte short".split())
_GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_RUBY_WORDS = frozenset("alias and begin case class def defined? do else elsif end ensure for if in module next nil not or redo rescue retry return self super then undef unless until when while yield break __method__".split())

_OPS = {
    "js": r">>>=|===|!==|\*\*=|<<=|\?\?=|&&=|\|\|=|\.\.\.|=>|==|!=|<=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||\?\?|\?\.(?!\d)|<<|\*\*|>>=|>=|[-+*/%&|^!~<>=?:,.;@#]",
    "java": r">>>=|<<=|>>=|\.\.\.|->|::|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||<<|[-+*/%&|^!~<>=?:,.;@]",
    "go": r"<<=|>>=|&\^=|&\^|\.\.\.|<-|:=|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||<<|>>|[-+*/%&|^!~<>=:,.;]",
}
_ASSIGN_TS = {">=", ">>=", ">>>="}
_SPECIAL = {"*", "<", ">", "=", "?", ":", ",", ".", ";", "...", "=>", "!", "~", "@", "<-", ":=", "|"}


def _symbol(op: str, lang: str) -> str:
    if op in ("+", "-"):
        return "BINUN"
    if op == "&":
        return "BITAND"
    if op in ("++", "--"):
        return "INC"
    if op == "?.":
        return "QDOT"
    if op == "::":
        return "DCOLON"
    if op == "->":
        return "ARROW"
    if op in _SPECIAL:
        return op
    if lang == "go" and op.endswith("=") and op not in ("==", "!=", "<=", ">="):
        return "OPEQ"
    return "BIN"


_SPACE = r"[ \t\r\f\v﻿\xa0]+"
_NAME = r"[^\W\d]\w*"
_NUM = r"0[xXbBoO][\da-fA-F_]+[nLlp]?[-+]?\d*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?[\d_]+)?[nLlfFdDi]?"
_LEX = {
    "js": re.compile(
        rf"(?P<nl>\n)|(?P<ws>{_SPACE}|//[^\n]*|\A#![^\n]*)|(?P<com>/\*[\s\S]*?\*/)|(?P<str>\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<num>{_NUM})|(?P<name>(?:[^\W\d]|\$|\\u)(?:\w|\$)*)|(?P<priv>#(?:[^\W\d]|\$)(?:\w|\$)*)|(?P<br>[()\[\]{{}}])|(?P<op>{_OPS['js']})|(?P<tick>`)|(?P<bad>[\s\S])"
    ),
    "java": re.compile(
        rf"(?P<nl>\n)|(?P<ws>{_SPACE}|//[^\n]*)|(?P<com>/\*[\s\S]*?\*/)|(?P<str>\"\"\"[ \t]*\r?\n(?:\\[\s\S]|[^\\])*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]+?|[^'\\\n])')|(?P<num>{_NUM})|(?P<name>non-sealed\b|(?:[^\W\d]|\$)(?:\w|\$)*)|(?P<br>[()\[\]{{}}])|(?P<op>{_OPS['java']})|(?P<bad>[\s\S])"
    ),
    "go": re.compile(
        rf"(?P<nl>\n)|(?P<ws>{_SPACE}|//[^\n]*)|(?P<com>/\*[\s\S]*?\*/)|(?P<str>`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]+?|[^'\\\n])')|(?P<num>{_NUM})|(?P<name>{_NAME})|(?P<br>[()\[\]{{}}])|(?P<op>{_OPS['go']})|(?P<bad>[\s\S])"
    ),
}
_LANG = {"javascript": "js", "typescript": "js", "java": "java", "go": "go"}
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


class Broken(Exception):
    """A token that cannot be read: its offset, and whether the text ends inside of it."""


class Group:
    __slots__ = ("at", "items", "open")

    def __init__(self, open_: str, at: int):
        self.open, self.at, self.items = open_, at, []


#: An item of a group: (symbol or Group, offset, whether a line ends before it).
def _template(text: str, at: int) -> int:
    """End of the template literal that starts at ``at``."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template(text, i)
                    continue
                if c in "\"'":
                    j = i + 1
                    while j < n and text[j] != c and text[j] != "\n":
                        j += 2 if text[j] == "\\" else 1
                    i = j
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    raise Broken(at, True)


def tokens(text: str, lang: str) -> list[tuple[str, str, int, bool]]:
    """(kind, text, offset, line end before) of every token; kinds: LIT, I, word, op, br, PRIV, bad."""
    lex, out, at, nl, n = _LEX[lang], [], 0, False, len(text)
    words = {"js": _JS_WORDS, "java": _JAVA_WORDS, "go": _GO_WORDS}[lang]
    last = ""
    while at < n:
        m = lex.match(text, at)
        kind, t = m.lastgroup, m[0]
        end = m.end()
        if kind == "nl":
            nl = True
            if lang == "go" and (last in ("LIT", "I", ")", "]", "}", "break", "continue", "fallthrough", "return", "INC")):
                out.append(("EOL", ";", at, False))
                last = ";"
        elif kind == "ws":
            pass
        elif kind == "com":
            if "\n" in t:
                nl = True
                if lang == "go" and (last in ("LIT", "I", ")", "]", "}", "break", "continue", "fallthrough", "return", "INC")):
                    out.append(("EOL", ";", at, False))
                    last = ";"
        else:
            if kind == "op" and t == "/" and text.startswith("/*", at):
                raise Broken(at, True)
            if kind == "op" and t[0] == "/" and lang == "js" and last not in ("LIT", "I", ")", "]", "}", "INC", "this", "super", "null"):
                r = _REGEX.match(text, at)
                if not r:
                    raise Broken(at, "\n" not in text[at:])
                kind, t, end = "LIT", r[0], r.end()
            elif kind == "tick":
                end = _template(text, at)
                kind, t = "TPL", text[at:end]
            elif kind in ("str", "num"):
                if kind == "num" and end < n and (text[end].isalpha() or text[end] == "_"):
                    raise Broken(at, False)
                kind = "LIT"
            elif kind == "name":
                if t in ("true", "false") and lang != "go":
                    kind = "LIT"
                elif lang == "java" and t in _JAVA_CONTEXT and _JAVA_CONTEXT[t].match(text, end):
                    kind = "word"
                elif t in words and not (last in (".", "QDOT") and lang == "js"):
                    kind = "word"
                else:
                    kind = "PT" if lang == "java" and t in _JAVA_TYPES else "I"
            elif kind == "priv":
                kind = "PRIV"
            elif kind == "bad":  # of a quote that nothing closes the rest of its line is the token, of raw strings and text blocks the rest of the file
                raise Broken(at, t == "`" or lang == "java" and text[max(0, at - 2) : at + 1] == '"""' or t in "\"'" and "\n" not in text[at:])
            out.append((kind, t, at, nl))
            last = kind if kind in ("LIT", "I", "TPL") else t if kind in ("word", "br") else _symbol(t, lang) if kind == "op" else "I"
            last = "LIT" if last == "TPL" else last
            nl = False
        at = end
    if lang == "go" and last in ("LIT", "I", ")", "]", "}", "break", "continue", "fallthrough", "return", "INC"):
        out.append(("EOL", ";", n, False))
    return out


def tree(toks: list[tuple[str, str, int, bool]], lang: str) -> tuple[Group, list[tuple[int, str]]]:
    """The file as nested groups, and the brackets without a partner."""
    root = Group("", 0)
    stack, bad = [root], []
    for kind, t, at, nl in toks:
        if kind == "br":
            if t in "([{":
                g = Group(t, at)
                stack[-1].items.append((g, at, nl))
                stack.append(g)
            elif len(stack) > 1 and _CLOSE[stack[-1].open] == t:
                stack.pop()
            else:
                bad.append((at, "closed"))
                if any(_CLOSE[g.open] == t for g in stack[1:]):
                    while _CLOSE[stack[-1].open] != t:
                        stack.pop()
                    stack.pop()
        elif kind == "op":
            s = _symbol(t, lang)
            if t in _ASSIGN_TS and lang == "js":
                s = "BIN"
            stack[-1].items.append((s, at, nl))
        elif kind == "word":
            stack[-1].items.append((t, at, nl))
        else:
            stack[-1].items.append((kind, at, nl))
    bad += [(g.at, "open") for g in stack[1:]]
    return root, bad


_CONTINUES = frozenset("BIN BINUN BITAND QDOT . ? : , => = * < > | else catch finally instanceof in of as satisfies ; )".split())
_ENDS = frozenset("I LIT TPL INC PRIV this super null break continue return debugger ! ".split()) | frozenset("async of get set from as type".split())


#: Words of statements, which no list of members, types or values has at its own level.
_STATEMENT = frozenset("return if else for while do try switch throw break continue defer go select fallthrough goto synchronized assert var let const :=".split())


class Checker:
    """Cost of the groups of one language; the kinds of a bracket say what it may hold."""

    KINDS = {
        "js": {"(": {"a": "args", "p": "params", "f": "forhead"}, "[": {"a": "array", "e": "", "t": ""}, "{": {"b": "line", "o": "object", "c": "member_line", "s": "caseline", "i": "specs"}},
        "ts": {
            "(": {"a": "args", "p": "params", "f": "forhead", "t": "onetype"}, "[": {"a": "array", "e": "", "t": "types", "x": "index"},
            "{": {"b": "line", "o": "object", "c": "member_line", "s": "caseline", "i": "specs", "t": "tmembers", "e": "enums"},
        },
        "java": {
            "(": {"a": "args", "p": "params", "f": "forhead", "k": "catchp", "r": "resources", "y": "onetype", "v": "annargs"}, "[": {"a": "expr", "e": ""},
            "{": {"b": "line", "c": "members", "s": "cases", "n": "init", "u": "enums"},
        },
        "go": {
            "(": {"a": "args", "p": "params", "y": "onetype", "z": "zkind", "v": "vspecl", "w": "tspec", "m": "impl"}, "[": {"a": "index", "e": "", "t": "index", "l": "slice", "d": "", "q": "tparams"},
            "{": {"b": "line", "n": "elements", "s": "caseline", "f": "fieldl", "j": "ifacel"},
        },
    }
    #: Kinds whose contents are cut into statements.
    SPLIT = {"js": "bs", "ts": "bs", "java": "b", "go": "bsfjvwm"}

    def __init__(self, lang: str):
        self.lang = lang
        self.grammar = Grammar({"js": G.JS, "ts": G.TS, "java": G.JAVA, "go": G.GO}[lang])
        self.kinds = self.KINDS[lang]
        self.edits: list[tuple[int, int]] = []
        self.most = 2  # edits that are counted in one statement or list; 0 asks for the verdict only

    def lines(self, items: list) -> list[list]:
        """Statements: at ``;``, in JavaScript also at line ends where the next token does not go on."""
        out, cur = [], []
        js = self.lang in ("js", "ts")
        for it in items:
            s = it[0]
            if s == ("EOL" if self.lang == "go" else ";"):
                out.append(cur)
                cur = []
                continue
            if js and cur and it[2]:
                prev = cur[-1][0]
                ended = isinstance(prev, Group) or prev in _ENDS
                goes = s in _CONTINUES if isinstance(s, str) else s.open in "([" and not (isinstance(prev, Group) and prev.open == "{")
                if ended and not goes:
                    out.append(cur)
                    cur = []
            cur.append(it)
        out.append(cur)
        return [x for x in out if x]

    def symbols(self, items: list) -> tuple[str, ...]:
        return tuple([self.group(s) if isinstance(s, Group) else s for s, _, _ in items])  # a list, whose calls may go to any depth

    def group(self, g: Group) -> str:
        """The symbol of a group: its bracket and the kinds of contents that fit without edits."""
        kinds = self.kinds[g.open]
        items = g.items
        if not items:
            return g.open + "".join(k for k in kinds if not (g.open == "[" and k in "xdlq") and not (g.open == "(" and k in "fkryz") and not (g.open == "[" and self.lang in ("java", "go") and k != "e"))
        syms = self.symbols(items)
        good = ""
        statements = g.open == "{" and any(s in _STATEMENT and syms[i + 1 : i + 2] != (":",) for i, s in enumerate(syms))
        for k, start in kinds.items():
            if g.open == "{" and (
                statements and k not in "bs" or k == "s" and "case" not in syms and "default" not in syms or k in "oienu" and ";" in syms and not (k == "u" and self.lang == "java") and self.lang != "go"
            ):
                continue  # a token that only statements have
            if not start:
                if k == "d" and syms == ("...",):
                    good += k
                continue
            if all(self.grammar.cost(start, x, 0) == 0 for x in self.contents(g, k, items, syms)):
                good += k
        if not good:
            self.edits.append((g.at, self.least(g, items, syms)))
            good = "".join(kinds)
        return g.open + good

    def contents(self, g: Group, k: str, items: list, syms: tuple[str, ...]) -> list[tuple[str, ...]]:
        """What a group holds if it is of kind ``k``: its statements, or all of it as one sequence."""
        if g.open == "{" and k in self.SPLIT[self.lang] or g.open == "(" and k in "vwm" and self.lang == "go":
            at = {id(it): s for it, s in zip(items, syms, strict=True)}
            return [tuple([at[id(it)] for it in x]) for x in self.lines(items)]
        if k in "ct" and g.open == "{" and self.lang in ("js", "ts"):
            return [self.with_ends(items, syms, ";" if k == "c" else "NL")]
        return [syms[:-1] if self.lang == "go" and syms[-1] == "EOL" and k != "n" else syms]

    def with_ends(self, items: list, syms: tuple[str, ...], end: str) -> tuple[str, ...]:
        out: list[str] = []
        for it, s in zip(items, syms, strict=True):
            if out and it[2] and out[-1] not in (";", ",", "NL") and (out[-1] in _ENDS or out[-1][0] in "([{" or end == "NL") and (s not in _CONTINUES or s == "*") and not (end == "NL" and (out[-1] in _CONTINUES or s[0] == "(" and False)):
                out.append(end)
            out.append(s)
        return tuple(out)

    def least(self, g: Group, items: list, syms: tuple[str, ...]) -> int:
        """Least edits of a group's contents, over the kinds that it may be."""
        found = self.most + 1
        for most in range(1, self.most + 1):
            found = min(sum([self.grammar.cost(start, x, most) for x in self.contents(g, k, items, syms)]) for k, start in self.kinds[g.open].items() if start)
            if found <= most:
                break
        return max(1, found)

    def file(self, root: Group) -> None:
        if self.lang == "java":
            syms = self.symbols(root.items)
            c = self.grammar.cost("top", syms, self.most)
            if c:
                self.edits.append((root.items[0][1] if root.items else 0, c))
            return
        start = "top" if self.lang == "go" else "line"
        for line in self.lines(root.items):
            c = self.grammar.cost(start, self.symbols(line), self.most)
            if c:
                self.edits.append((line[0][1], c))


_checkers: dict[str, Checker] = {}
_PYTHON = "python"
LANGUAGES = (_PYTHON, "ruby", *_LANG)


def _edits(text: str, language: str, most: int = 2) -> tuple[list[tuple[int, int]], bool]:
    """The edits of a text as (offset, cost), up to ``most`` counted in one statement, and whether something is left open at its end."""
    deep(8 * len(text))
    if language == _PYTHON:
        from lodeweave.llm.syntax_python import check

        return check(text, most)
    if language == "ruby":
        from lodeweave.llm.syntax_ruby import check

        return check(text, most)
    try:
        toks = tokens(text, _LANG[language])
    except Broken as e:
        return [(e.args[0], 1)], e.args[1]
    root, bad = tree(toks, _LANG[language])
    if bad:
        return [(at, 1) for at, _ in bad], any(k == "open" for _, k in bad)
    key = "ts" if language == "typescript" else _LANG[language]
    c = _checkers.get(key) or _checkers.setdefault(key, Checker(key))
    c.edits, c.most = [], most
    c.file(root)
    return list(c.edits), False


def repair(text: str, language: str) -> tuple[int, str, int]:
    """(least edits, their kind, line of the first).

    Kinds are none, conflict (marks of a merge), truncation (something is left open at the end), mismatch (valid in another
    of the languages) and edit; none of them depends on the text's length.
    """
    language = (language or "").lower()
    if language not in LANGUAGES:
        return 0, "none", 0
    edits, unclosed = _edits(text, language)
    if not edits:
        return 0, "none", 0
    first = min(at for at, _ in edits)
    cost = sum(c for _, c in edits)
    if _CONFLICT.search(text):
        kind = "conflict"
    elif unclosed:
        kind = "truncation"
    else:
        kind = "mismatch" if any(not _edits(text, x, 0)[0] for x in LANGUAGES if x != language) else "edit"
    return cost, kind, text.count("\n", 0, first) + 1


def unparsable(df: DataFrame, keys: tuple[str, ...], text: str = "raw_code", language: str = "language") -> DataFrame:
    """``keys``, ``language``, ``cost``, ``error_kind`` and ``error_line`` of every row with a non-null text.

    A cost of 0 is a valid file; languages without a grammar and null languages cost 0. An empty text is valid in every
    language except Go and is taken as it is parsed. Rows of a repeated key are judged each for itself; texts are read whole;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [repair(t, lang) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(1, 2 + len(keys))), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())],
                names=[language, *keys, "cost", "error_kind", "error_line"],
            )

    picked = df.filter(F.col(text).isNotNull()).select(F.col(text), F.col(language).cast("string").alias(language), *keys)
    fields = ", ".join(f"`{n}` {k}" for n, k in picked.select(language, *keys).dtypes)
    return spread(picked).mapInArrow(run, f"{fields}, cost int, error_kind string, error_line int")
