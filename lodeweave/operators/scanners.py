"""Chunks of languages without a parser here: a scanner that masks literals and comments, finds headers and matches their ends.

Headers are those of functions, methods and types; a chunk ends with the bracket that closes its body (Ruby: with its ``end``).
Masked characters keep their places, so line numbers and texts are those of the file. What is cut is what the headers show:
bodies inside macros or templates that unbalance brackets end at the end of the text.
"""

from __future__ import annotations

import re

#: (name, type, first line, last line, complexity) of every chunk of a text.
Chunks = list[tuple[str, str, int, int, int]]

_BRACE_NOISE = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?")
_RUST_NOISE = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.[^']*|[^'\\\n])'")
_PHP_NOISE = re.compile(r"//[^\n]*|\#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?")
_RUBY_NOISE = re.compile(r"(?m)^=begin[\s\S]*?^=end[^\n]*|\#[^\n]*|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?")
_NOT_NAMES = frozenset("if for while switch catch return else do try new throw sizeof match loop unsafe with function elseif foreach synchronized case default".split())
_ARGUMENTS = r"\((?:[^(){}]|\{[^{}]*\}|\([^()]*\))*\)"  # with destructured and default values
_SCRIPT_TYPES = r"(?P<class>\bclass\s+(?P<c>[A-Za-z_$][\w$]*)[^{;]*\{)"
_SCRIPT = (
    _SCRIPT_TYPES
    + r"|(?P<function>\b(?:async\s+)?function\s*\*?\s*(?P<f>[A-Za-z_$][\w$]*)?\s*(?:<[^>{]*>)?"
    + _ARGUMENTS
    + r"\s*(?::[^{;]*)?\{)"
    + r"|(?P<arrow>(?:\b(?:const|let|var)\s+(?P<a>[A-Za-z_$][\w$]*)\s*(?::[^=;\n]*)?=\s*)?(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\s*:[^=;{}\n]*)?|[A-Za-z_$][\w$]*)\s*=>\s*\{)"
    + r"|(?P<method>(?m:^)[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*(?P<m>[A-Za-z_$#][\w$]*)\s*(?:<[^>{]*>)?"
    + _ARGUMENTS
    + r"\s*(?::[^;{=]*)?\{)"
)
_JAVA = (
    r"(?P<class>\b(?:class|interface|enum|record)\s+(?P<c>[A-Za-z_]\w*)[^{;]*\{)"
    r"|(?P<method>(?m:^)[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>{]*>\s*)?(?:[\w.]+(?:<[^{;()]*>)?(?:\[\])*\s+)?(?P<m>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:throws\s[^{;]*)?\{)"
)
_GO = r"(?P<class>\btype\s+(?P<c>[A-Za-z_]\w*)\s+(?:struct|interface)\s*\{)|(?P<function>\bfunc\s+(?:\([^)]*\)\s*)?(?P<f>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\([^{;]*?\{(?=[ \t]*\r?(?:\n|\})))"
_RUST = r"(?P<class>\b(?:struct|enum|trait|impl)\b\s*(?:<[^>{]*>\s*)?(?P<c>[A-Za-z_]\w*)[^{;]*\{)|(?P<function>\bfn\s+(?P<f>[A-Za-z_]\w*)[^{;]*\{)"
_C = r"(?P<class>\b(?:class|struct)\s+(?P<c>[A-Za-z_]\w*)[^{;()]*\{)|(?P<function>(?m:^)[ \t]*(?:[A-Za-z_][\w:<>,*&]*[\s*&]+)+(?P<f>[A-Za-z_~][\w:~]*)\s*\([^;{}]*\)\s*(?:const|noexcept|override|\s)*(?::[^{;]*)?\{)"
_PHP = r"(?P<class>\b(?:class|interface|trait|enum)\s+(?P<c>[A-Za-z_]\w*)[^{;]*\{)|(?P<function>\bfunction\s*&?\s*(?P<f>[A-Za-z_]\w*)?\s*\([^{;]*\{)"
_HEADERS = {k: re.compile(v) for k, v in {"javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT, "java": _JAVA, "go": _GO, "rust": _RUST, "c": _C, "cpp": _C, "php": _PHP}.items()}
_NOISE = {"rust": _RUST_NOISE, "php": _PHP_NOISE, "ruby": _RUBY_NOISE}
_BRANCH = re.compile(r"\b(?:if|else|elsif|elseif|for|foreach|while|until|unless|case|when|catch|rescue|match|and|or)\b|&&|\|\||\?(?![.?:>])")
_ELSE_IF = re.compile(r"\belse\s+if\b")
_RUBY_HEAD = re.compile(r"(?m)^[ \t]*(?:(?P<def>def)\s+(?P<d>(?:self\.)?[A-Za-z_]\w*[?!=]?)|(?P<class>class|module)\s+(?P<c>[A-Z][\w:]*))")
_RUBY_OPEN = re.compile(r"(?m)(?:^|;|=)[ \t]*(?:if|unless|while|until|case|for|begin|def|class|module)\b|\bdo\b(?=[ \t]*(?:\||$|\r|;))|^[ \t]*end\b|;[ \t]*end\b|[ \t]end\b(?=[ \t]*(?:$|\r|[.)\]]))")


def masked(text: str, language: str) -> str:
    """The text with literals and comments blanked out, line ends kept."""
    return _NOISE.get(language, _BRACE_NOISE).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def complexity(masked_body: str) -> int:
    """1 and the branches, else parts and boolean operators; an ``else if`` counts once."""
    return 1 + len(_BRANCH.findall(masked_body)) - len(_ELSE_IF.findall(masked_body))


def _closing(mask: str, at: int) -> int:
    """Place of the brace that closes the one at ``at``, or the last place."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(mask, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return len(mask) - 1


def brace_chunks(text: str, mode: str, language: str) -> Chunks:
    """Chunks of a language with braces; ``history`` does not look into functions and calls methods functions, ``review`` does both."""
    mask = masked(text, language)
    found: list[tuple[int, int, str, str]] = []
    at, head = 0, _HEADERS[language]
    classes: list[int] = []  # ends of the classes around the place
    while m := head.search(mask, at):
        kind = next(k for k in ("class", "function", "arrow", "method") if k in m.groupdict() and m[k])
        name = next((m[k] for k in ("c", "f", "a", "m") if k in m.groupdict() and m[k]), None)
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        brace = m.end() - 1
        while classes and classes[-1] < start:
            classes.pop()
        if name in _NOT_NAMES or kind == "method" and not classes:
            at = m.start() + max(1, len(m[0]) - len(m[0].lstrip()) + 1)
            continue
        end = _closing(mask, brace)
        if kind == "class":
            classes.append(end)
            if mode == "history":
                found.append((start, end, name or "", "class"))
            at = m.end()
            continue
        label = "method" if mode == "review" and (language == "java" or kind == "method") else "function"
        if name or mode == "review":
            found.append((start, end, name or "(anonymous)", label))
        at = end + 1 if mode == "history" else m.end()
    return [(n, k, text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1, complexity(mask[a : b + 1])) for a, b, n, k in found]


def ruby_chunks(text: str, mode: str, language: str = "ruby") -> Chunks:
    """Chunks of Ruby, as ``brace_chunks``; one-line definitions without an end are left out."""
    mask = masked(text, "ruby")
    found, at = [], 0
    while m := _RUBY_HEAD.search(mask, at):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        depth, end = 0, len(mask) - 1
        for t in _RUBY_OPEN.finditer(mask, m.start()):
            depth += -1 if t[0].strip(" \t;").startswith("end") else 1
            if depth == 0:
                end = t.end() - 1
                break
        if m["def"]:
            found.append((start, end, m["d"], "method" if mode == "review" else "function"))
        elif mode == "history":
            found.append((start, end, m["c"], "class"))
        at = end + 1 if m["def"] and mode == "history" else m.end()
    return [(n, k, text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1, complexity(mask[a : b + 1])) for a, b, n, k in found]


LANGUAGES = [*_HEADERS, "ruby"]


def scanner(language: str):
    """The chunker of a language: text and mode to chunks."""
    if language == "ruby":
        return lambda text, mode: ruby_chunks(text, mode)
    return lambda text, mode: brace_chunks(text, mode, language)
