"""Problem 3: credentials in source code and configuration, found by a calibrated logistic regression, and their redaction.

Candidates are literal values on a line with the identifier in front of them. Pattern matches label a part of them weakly;
character Markov models of the weakly positive and negative values, identifier words, shape and path features feed a
logistic regression that is fitted on a bounded sample, calibrated on a part held out, and applied to every candidate.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import spread

#: Formats of issued credentials (fixed values): key ids, personal and chat tokens, service keys, signed tokens.
_FORMAT = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|xox[abeprs]-[A-Za-z0-9-]{16,}|glpat-[\w-]{18,}|sk-(?:[a-z]+-)*[A-Za-z0-9_-]{24,}"
    r"|[A-Za-z]{2,12}_(?:live|test|prod)_[A-Za-z0-9]{16,}|AIza[\w-]{35}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{36}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,})(?![A-Za-z0-9_])"
)
_SECRET_WORD = r"pass(?:word|wd|phrase|code)?|pwd|pw|secrets?|tokens?|api_?key|apikey|(?:svc|signing|access|account|auth|client|private|secret|encryption|master|storage|shared|service)_?key|credentials?|creds?|bearer|auth_?token|login|key|auth"
_SECRET_NAME = re.compile(rf"(?:^|[_\-.\s])(?:{_SECRET_WORD})\d*$")
_PLAIN_NAME = re.compile(r"(?:^|[_\-.])(?:id|uuid|guid|sha\d*|hash|digest|checksum|etag|commit|revision|version|fingerprint|integrity|public(?:_key)?|pub|url|uri|endpoint|path|file|name|type|length|count|expiry|ttl|field|header|verifier|salt_rounds)$")
_PEM = re.compile(r"-----BEGIN (?!PUBLIC|CERTIFICATE|ENCRYPTED)(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\\r|\\n|[\s\"'`+,;(){}\[\]\\#/*>|]|Proc-Type: [^\n]*|Version: [^\n]*)*([A-Za-z0-9+/]{32,}|[A-Za-z0-9+/=]{24,})")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'<>`]*:([^\s@/\"'<>`]+)@")
_USER = re.compile(r"(?:-u|--user|--proxy-user)[ =][\"']?[^\s:\"']+:([^\s\"']+)")
_PAIR = re.compile(r"(?i)[;&?\"']((?:[a-z]+_?)?(?:password|passwd|pwd|secret|token|api_?key|access_?key|account_?key))=([^;&\s\"'<>`]+)")
_SCHEME = re.compile(r"\b(Bearer|Basic|Token)\s+([A-Za-z0-9+/_.=~-]{8,})")
_JOINED = re.compile(r"([\"'`])([^\"'`\n]{2,})\1\s*(?:\+|\.\.?|\\\n)\s*([\"'`])([^\"'`\n]{2,})\3")
_NAME = r"[A-Za-z_$@][\w$.\-]*"
_QUOTED = re.compile(rf"({_NAME})[\"'\]]*\s*(?::=|=>|=|:|\s*:\s*[\w<>\[\]., ]+=)\s*[A-Za-z]?([\"'`])((?:\\.|(?!\2)[^\\\n])+?)\2")
_BARE = re.compile(rf"^\s*(?:(?:#|//|;|--|/?\*+)\s*)?(?:(?:export|ENV|ARG|set|SET|-)\s+)*[\"']?({_NAME})[\"']?\s*[=:]\s*([^\s\"'`<>(){{}}\[\],]+(?:\[[^\]\s]*\])?)\s*[;,]?\s*$")
_ENV = re.compile(rf"^\s*(?:ENV|ARG)\s+({_NAME})[ =]([^\s\"'`]+)\s*$")
_XML = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\s]+)</\1>")
_NOTE = re.compile(rf"(?:^|\s)(?:#|//|/\*|\*|--|<!--|;)\s[^\n]*?\b({_SECRET_WORD})\b\s*(?:is|was|[:=])\s*[\"'`]?([^\s\"'`<>]+)", re.I)
_PASS_NOTE = re.compile(rf"(?:#|//|/\*)[^\n]*\b(?:{_SECRET_WORD})\s*\)?\s*(?:\*/)?$", re.I)
_CALL = re.compile(r"[\"']([A-Za-z_][\w-]*)[\"']\s*,\s*([\"'])([^\"'\n]{6,})\2")
#: Strings, in lower case, one of which stands on every line with a candidate.
_HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "bearer", "auth", "login", "pw", "private", "basic ", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "glpat-", "sk-", "eyj", "_live_", "_test_", "_prod_", "aiza", "sg.", "npm_", "://", "-u ", "--user", "user=")
_LOWER = {c: c + 32 for c in range(65, 91)}
_hints = None


def hinted_lines(text: str) -> list[tuple[int, int, int]]:
    """(number, start, end) of the lines with a hint, in order."""
    global _hints
    if _hints is None:
        import ahocorasick

        _hints = ahocorasick.Automaton()
        for h in _HINTS:
            _hints.add_word(h, len(h))
        _hints.make_automaton()
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    out, number, start, end = [], 1, 0, -2
    for at, _ in _hints.iter(low):
        if at < end:
            continue
        new = text.rfind("\n", 0, at) + 1
        number += text.count("\n", start, new)
        start, end = new, text.find("\n", at)
        end = len(text) if end < 0 else end
        out.append((number, start, end))
    return out


_PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-+|_+|0+|1234\w*|abc123|change[_-]?me\w*|replace[_-]?\w*|your[_-].*|my[_-].*|insert[_-].*|todo\w*|tbd|none|null|nil|undefined|true|false|default|dummy\w*|sample\w*|placeholder\w*|redacted|hidden|secret|password|passwd|token|test|foo\w*|bar|fake\w*|not[_-]?set|unset|empty|n/?a)$"
    r"|x{6,}|\*{4,}|example|redacted|placeholder|changeme|dummy|your[_-]|from[_-]?(?:vault|env)|<[^>]*>"
)
_REFERENCE = re.compile(r"\$\{|\$\(|^\$\w|\{\{|%\(|%s|%[A-Z_]+%|#\{|^@|^ENC[\[(]|^AQICAH|^vault:|^kms:|^!|^sops|^\{cipher\}|^secret:|^arn:|^op://|^ssm:|^env[:.(]|process\.env|environ|getenv|^\$2[aby]\$|^\{SSHA")
_DIGEST = re.compile(r"^(?:sha\d+|md5|sha\d*sum|bcrypt|argon2\w*|pbkdf2\w*)[-:$=]|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_CONFIG = re.compile(r"(?i)(?:\.(?:env|ya?ml|ini|cfg|conf|properties|toml|json|xml|sh|tf|tfvars|txt|md|config|npmrc|plist|gradle)|(?:^|/)(?:\.env[\w.]*|dockerfile[\w.]*|makefile|\.npmrc|\.netrc))$|\.env\.")
_WORDY = re.compile(r"^(?:[A-Za-z]?[a-z]+|[A-Z]+)(?:[-_ ./](?:[A-Za-z]?[a-z]+|[A-Z]+))*$")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

COLUMNS = ["line_number", "start", "end", "kind", "name", "value"]


def candidates(text: str, path: str) -> list[tuple[int, int, int, str, str, str]]:
    """(line, start, end, kind, identifier, value) of every literal that may be a credential; offsets within the text."""
    out: dict[tuple[int, int], tuple[int, int, int, str, str, str]] = {}
    config = bool(_CONFIG.search(path or ""))
    for number, start, end in hinted_lines(text):
        line = text[start:end]
        if (m := _PEM.search(line)) and (b := _PEM_BODY.match(text, start + m.end())) and b[1]:
            out[(start + m.start(), 0)] = (number, start + m.start(), start + m.end(), "pem", "", m[0])
            continue
        line = line.rstrip("\r")

        def add(kind: str, name: str, a: int, b: int, value: str | None = None) -> None:
            key = (start + a, start + b)
            if b - a >= 4 and (key not in out or out[key][3] in ("quoted", "bare")):
                out[key] = (number, start + a, start + b, kind, name, value or line[a:b])

        for m in _QUOTED.finditer(line):
            rest = _JOINED.match(line, m.start(2))
            add("quoted", m[1], m.start(3), m.end(3) if not rest else rest.end(4), None if not rest else rest[2] + rest[4])
        for m in _CALL.finditer(line):
            add("quoted", "password" if _PASS_NOTE.search(line, m.end()) else m[1], m.start(3), m.end(3))
        for m in _XML.finditer(line):
            add("quoted", m[1], m.start(2), m.end(2))
        if config or line.lstrip()[:1] == "#" or line.lstrip()[:2] == "//":
            for p in (_BARE, _ENV):
                if m := p.match(line):
                    add("bare", m[1], m.start(2), m.end(2))
        for m in _NOTE.finditer(line):
            add("note", m[1], m.start(2), m.end(2))
        for m in _FORMAT.finditer(line):
            add("format", "", m.start(), m.end())
        for m in _URL.finditer(line):
            add("url", "password", m.start(1), m.end(1))
        for m in _USER.finditer(line):
            add("user", "password", m.start(1), m.end(1))
        for m in _PAIR.finditer(line):
            add("pair", m[1], m.start(2), m.end(2))
        for m in _SCHEME.finditer(line):
            add("scheme" + m[1].lower(), "bearer", m.start(2), m.end(2))
    return list(out.values())


def _snake(name: str) -> str:
    return _CAMEL.sub("_", name).replace("-", "_").lower()


def weak_label(kind: str, name: str, value: str) -> int:
    """1 and 0 where a pattern says so, -1 where none does."""
    if kind == "pem":
        return 1
    n = _snake(name)
    if _REFERENCE.search(value) or _PLACEHOLDER.search(value) or _DIGEST.search(value):
        return 0
    if _FORMAT.fullmatch(value):
        return 1
    if kind in ("url", "user"):
        return 1
    if kind == "schemebasic":
        try:
            return int(b":" in base64.b64decode(value + "=" * (-len(value) % 4)))
        except ValueError:
            return 0
    if "://" in value or _PLAIN_NAME.search(n) or _WORDY.match(value) and kind != "pair":
        return 0
    if not _SECRET_NAME.search(n):
        return 0
    digits, letters = sum(map(str.isdigit, value)), sum(map(str.isalpha, value))
    if " " in value or not letters and digits < 6:
        return 0
    return 1 if len(value) >= 8 and digits and letters else -1


def features(kind: str, name: str, value: str, path: str, secret: np.ndarray, plain: np.ndarray) -> list[float]:
    codes = [min(max(ord(c) - 31, 0), 95) for c in value]
    pairs = list(zip(codes, codes[1:], strict=False))
    llr = sum(secret[a, b] - plain[a, b] for a, b in pairs) / max(1, len(pairs))
    n, size = _snake(name), max(1, len(value))
    freq = [value.count(c) / size for c in set(value)]
    fmt = _FORMAT.fullmatch(value) is not None
    reference = _REFERENCE.search(value) is not None
    placeholder = _PLACEHOLDER.search(value) is not None or _DIGEST.search(value) is not None
    return [
        1.0, llr, -sum(p * math.log2(p) for p in freq), math.log(size), sum(map(str.isdigit, value)) / size, sum(map(str.isupper, value)) / size,
        sum(not c.isalnum() for c in value) / size, float(fmt), float(reference), float(placeholder), float(_WORDY.match(value) is not None), float("://" in value), float(" " in value),
        float(_SECRET_NAME.search(n) is not None), float(_PLAIN_NAME.search(n) is not None), float(kind == "pem"), float(kind in ("url", "user")), float(kind == "schemebasic"), float(kind == "note"),
        float(re.fullmatch(r"[0-9a-f]{16,}", value) is not None), float(bool(re.search(r"(?i)(?:^|/)(?:tests?|spec|examples?|docs?|fixtures?)/", path or ""))), float(bool(_CONFIG.search(path or ""))),
        float(len(value) < 6),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def find(df: DataFrame, keys: list[str], text: str, path: str, sample_rows: int = 20000, threshold: float = 0.5) -> DataFrame:
    """Credentials of every text: ``keys``, ``line_number``, ``start``, ``end`` (offsets), ``score``.

    The regression is fitted on at most ``sample_rows`` weakly labelled candidates, chosen by a hash; the Markov counts cover
    all of them. Null and empty texts have none; a null path has no path features; repeated rows give the same rows once;
    texts are searched whole. An empty table gives an empty result.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    texts = df.filter(F.col(text).isNotNull()).select(*(F.col(k).cast("string").alias(a) for k, a in zip(keys, ks, strict=True)), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for c in candidates(r.text, r.path or ""):
                    rows.append((*r[: len(ks)], r.path, *c, weak_label(*c[3:])))
            yield pd.DataFrame(rows, columns=[*ks, "path", *COLUMNS, "weak"])

    fields = ", ".join(f"{k} string" for k in ks)
    cand = spread(texts).mapInPandas(extract, f"{fields}, path string, line_number int, start int, end int, kind string, name string, value string, weak int").persist()
    spots = F.sequence(F.lit(1), F.greatest(F.length("value") - 1, F.lit(1)))
    pairs = cand.filter("weak >= 0 and kind <> 'pem' and length(value) > 1").select("weak", F.explode(F.transform(spots, lambda i: F.substr("value", i, F.lit(2)))).alias("pair"))
    code = lambda k: F.least(F.greatest(F.ascii(F.substring("pair", k, 1)) - 31, F.lit(0)), F.lit(95))
    counts = pairs.groupBy("weak", code(1).alias("a"), code(2).alias("b")).count().toPandas()  # at most 2 * 96 * 96 rows
    models = np.full((2, 96, 96), 0.5)
    for r in counts.itertuples(index=False):
        models[r.weak, r.a, r.b] += r.count if isinstance(r.count, (int, np.integer)) else r[3]
    logs = np.log(models / models.sum(2, keepdims=True))
    plain, secret = logs[0], logs[1]
    order = F.xxhash64(*ks, "start")
    sample = cand.filter("weak >= 0").select("kind", "name", "value", "path", "weak", order.alias("h")).orderBy("h").limit(sample_rows).toPandas()
    w, a, b = np.zeros(23), 1.0, 0.0
    if sample["weak"].nunique() == 2:
        x = np.array([features(r.kind, r.name, r.value, r.path or "", secret, plain) for r in sample.itertuples(index=False)])
        y = sample["weak"].to_numpy(float)
        held = np.arange(len(y)) % 4 == 3
        w = fit(x[~held], y[~held])
        if len(set(y[held])) == 2:
            z = x[held] @ w
            b, a = fit(np.stack([np.ones(held.sum()), z], 1), y[held], ridge=1.0)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            x = np.array([features(r.kind, r.name, r.value, r.path or "", secret, plain) for r in d.itertuples(index=False)]) if len(d) else np.empty((0, 23))
            d = d[[*ks, "line_number", "start", "end"]].copy()
            d["score"] = 1 / (1 + np.exp(-np.clip(a * (x @ w) + b, -30, 30)))
            yield d[d["score"] >= threshold]

    out = cand.mapInPandas(score, f"{fields}, line_number int, start int, end int, score double").groupBy(*ks, "line_number", "start", "end").agg(F.max("score").alias("score"))
    return out.select(*(F.col(a_).alias(k) for k, a_ in zip(keys, ks, strict=True)), "line_number", "start", "end", "score")


def redact_text(text: str, spans: list[tuple[int, int]], mark: str = "REDACTED") -> str:
    """The text with the spans replaced; a private key's body goes up to its END mark. Quotes and line ends around stay."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        if text.startswith("-----BEGIN", a):
            end = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----").search(text, b)
            stop = end.end() if end else b
            out += [text[at:a], mark, "\n" * text.count("\n", a, stop)]
            at = stop
            continue
        out += [text[at:a], re.sub(r"[^\"'`+\s\\]+(?:[^\"'`]*[^\"'`+\s\\]+)?", mark, text[a:b], count=0) if any(q in text[a:b] for q in "\"'`") else mark]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, found: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``redacted`` of the texts with at least one credential."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["redacted"] = [redact_text(t, [(s["start"], s["end"]) for s in spans]) for t, spans in zip(b["t"], b["spans"], strict=True)]
            yield b[[*keys, "redacted"]]

    spans = found.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    full = df.filter(F.col(text).isNotNull()).select(*(F.col(k).cast("string").alias(k) for k in keys), F.col(text).alias("t")).dropDuplicates(keys).join(spans, keys)
    return full.mapInPandas(run, ", ".join(f"`{k}` string" for k in keys) + ", redacted string")
