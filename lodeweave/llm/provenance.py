"""Problem 5: generated, minified, vendored and data files, told from hand-written source.

Character trigram models of the identifiers are trained per language on the whole corpus. A file is minified where its names
are mangled (short, and of no low cross-entropy under its language's model) and its lines are dense; data where hardly anything
but literals is left. A file is generated where its names and the shapes of its lines are far less diverse than those of files of
its length in its language, and vendored where its naming style is foreign to the rest of its repository. Beside that, generated
and vendored files are told by their path and by the comment at their head, as most of them are as diverse as others (figures in the README).
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm import syntax
from lodeweave.llm.syntax_python import _WORDS as _PYTHON_WORDS
from lodeweave.session import spread

#: Directories of copied code and of tools' output; names of generated and minified files (fixed values).
VENDOR_DIRS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "jspm_packages", "externals", "deps", "site-packages", "Godeps", "_vendor", "extern", "Pods", "Carthage")
GENERATED_DIRS = ("generated", "__generated__", "autogen", "auto_generated", "autogenerated", "generated-sources", "gensrc", "_generated")
GENERATED_NAMES = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw|\.validate)?\.go|_grpc\.pb\.go|\.pb\.(?:cc|h|rb|ts|js)|_pb\.(?:js|ts|rb|d\.ts)|_grpc_pb\.js|\.g\.(?:dart|cs|ts)|\.designer\.cs|[._-]generated\.\w+|\.gen\.\w+|_gen\.go|_string\.go|OuterClass\.java|Grpc\.java)$|(?:^|/)(?:zz_generated[._]|bindata\.go$|wire_gen\.go$)"
MINIFIED_NAMES = r"(?:[.-]min\.(?:js|mjs|cjs|css)|[.-](?:bundle|packed|pack)\.js|\.chunk\.js)$"

_GENERATED = re.compile(
    r"(?i)@generated\b|\bcode generated\b|\bgenerated (?:code|file|by|from|with|automatically|using)\b|\bauto-?\s?generated\b|<auto-?generated|\bautomatically generated\b|\bdo not edit\b|\bdo not modify\b|\bmachine[- ]generated\b"
    r"|\bchanges made by hand\b|\bchanges (?:will be|are) (?:lost|overwritten)\b|\boutput of [`'\"]|\bregenerate (?:with|by|using)\b|\bproduced by [`'\"\w-]+ (?:v?\d|from)"
)
_VENDORED = re.compile(
    r"(?i)\bbundled copy of\b|\bvendored (?:from|copy|in from)\b|\bimported unchanged\b|\bcopied (?:verbatim |unchanged )?from https?:|\bupstream: ?https?:|\bupstream tarball\b|\bsend (?:changes|patches) upstream\b|\bdo not patch here\b|\bv?\d+\.\d+(?:\.\d+)?\s*\|\s*\(c\)|\|\s*(?:mit|bsd|apache|isc|mpl)\b[\w\s.-]*licen[cs]e|^\W*!?\s*[\w.-]+ v\d+\.\d+\.\d+ .*\(c\)|\bthird[- ]party (?:code|library|copy)\b"
)
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|<!--|--|;|\"\"\"|'''|=begin)")
#: How blocks of comment, doc strings included, begin and end.
_CLOSE = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''", "=begin": "=end"}
_OPEN = re.compile(r"[rRuU]?(/\*|<!--|\"\"\"|'''|=begin)")
#: What a line at the head does when it only speaks of such marks.
_SPEAKS = re.compile(r"(?i)\b(?:detect|skip|ignor|check|look|search|parse|reject|strip|remove|find|match|recogni[sz]|flag|filter|warn|whether|unless|should|never|not generated|hand-?written|instead of|used to be|once was|no longer|e\.g\.|such as|contain|mention|like)\w*\b")
_LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|\b(?:0[xX][0-9a-fA-F_]+|\d[\d_.eE+-]*)\b|[\s,\[\]{}();]+")
_IDENT = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$]*")
_K = 38
_CODE = np.full(256, 37, np.int64)  # 37: not part of a name
_CODE[97:123] = _CODE[65:91] = np.arange(26)
_CODE[48:58], _CODE[95], _CODE[36] = 26, 27, 28


def _trigrams(text: bytes) -> np.ndarray:
    c = _CODE[np.frombuffer(text, np.uint8)]
    c = np.concatenate([[37, 37], c, [37]])
    t = (c[:-2] * _K + c[1:-1]) * _K + c[2:]
    return t[(c[2:] != 37) | (c[1:-1] != 37)]


def head_marks(text: str) -> tuple[bool, bool]:
    """(generated, vendored) by all comments before the first line of code: line comments, blocks and the doc string, of any length."""
    generated = vendored = False
    end = ""  # what closes the block that a line stands in
    for line in io.StringIO(text):
        s = line.strip()
        if not s:
            continue
        opened = None if end else _OPEN.match(s)
        comment = end or opened or _COMMENT.match(s) is not None
        if not comment and not s.startswith(("package ", "#!", "'use strict'", '"use strict"', "import ", "from ")):
            break
        if comment:
            if opened:
                end = _CLOSE[opened[1]]
                end = "" if end in s[opened.end() :] else end
            elif end and end in s:
                end = ""
            g, v = _GENERATED.search(s) is not None, _VENDORED.search(s) is not None
            if (g or v) and not (_SPEAKS.search(s) and not s.lower().endswith(("do not edit.", "do not edit"))):
                generated, vendored = generated or g, vendored or v
    return generated, vendored


#: Words of each language, by which a file under a wrong language is told from one in a foreign style.
_WORDS = {k: frozenset(w.encode() for w in v) for k, v in {"python": _PYTHON_WORDS, "ruby": syntax._RUBY_WORDS, "javascript": syntax._JS_WORDS, "typescript": syntax._JS_WORDS, "java": syntax._JAVA_WORDS | syntax._JAVA_TYPES, "go": syntax._GO_WORDS}.items()}
#: Literals and comments, or a name of the code (the only group); strings of Ruby go over lines.
_TEXTS = r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"(?:\\[\s\S]|[^\"\\LINE])*\"|'(?:\\[\s\S]|[^'\\LINE])*'|`[^`]*`|COMMENT|([A-Za-z_$][A-Za-z0-9_$]*)"
_CODE_NAMES = {k: re.compile(_TEXTS.replace("LINE", line).replace("COMMENT", comment).encode()) for k, line, comment in (("python", r"\n", r"#[^\n]*"), ("ruby", "", r"#[^\n]*"), ("", r"\n", r"//[^\n]*|/\*[\s\S]*?\*/"))}
_SHAPE = bytes(120 if chr(i).isalnum() or i in (95, 36) or i > 127 else i for i in range(256))
_RUN = re.compile(rb"x+")
#: A file is of low diversity this many deviations below its language's files of its length, and as many below what chance gives.
_LOW, _CHANCE = 6.0, 3.0
#: A style is foreign from this difference in the share of names in snake case on, and from this likelihood ratio (twice its logarithm) on.
_GAP, _RATIO = 0.5, 30.0


def _code_names(raw: bytes, language: str) -> list[bytes]:
    """The names of a file without those in its literals and comments, such as columns in a query."""
    return [x for x in _CODE_NAMES.get(language, _CODE_NAMES[""]).findall(raw) if x]


def _styles(names: set[bytes]) -> tuple[int, int]:
    """Names of several words in snake case and in camel case; constants and names of types are alike in all styles."""
    snake = camel = 0
    for x in names:
        if b"_" in x:
            x = x.strip(b"_")
            snake += b"_" in x and x.islower()
        elif x[:1].islower() and not x.islower():
            camel += 1
    return snake, camel


def _shapes(raw: bytes) -> tuple[int, int]:
    """(lines with text, different shapes of them); the shape of a line is what is left where words are all alike."""
    lines = [x for x in map(bytes.strip, _RUN.sub(b"x", raw.translate(_SHAPE)).split(b"\n")) if x]
    return len(lines), len(set(lines))


def _bin(n: int, kinds: int) -> int:
    """Logarithms of a length and of a number of kinds, as one number."""
    return min(127, round(8 * math.log(n))) * 512 + min(511, round(32 * math.log(kinds)))


def _growth(bins: dict[int, int]) -> tuple[float, float, float]:
    """How the number of kinds grows with the length (offset and power), and the deviation, in logarithms, without outliers."""
    prior = [(math.log(n), 0.85 * math.log(n), 5.0) for n in (10, 100, 1000)]  # decides where there are few files
    x, y, w = (np.array(v, float) for v in zip(*[(b // 512 / 8, b % 512 / 32, n) for b, n in sorted(bins.items())], *prior, strict=True))
    keep = np.ones(len(x), bool)
    for _ in range(20):
        v = w * keep
        mx, my = (v * x).sum() / v.sum(), (v * y).sum() / v.sum()
        power = (v * (x - mx) * (y - my)).sum() / (v * (x - mx) ** 2).sum()
        rest = y - my - power * (x - mx)
        deviation = max(0.05, math.sqrt((v * rest**2).sum() / v.sum()))
        again = (np.abs(rest) < 3 * deviation) | (np.arange(len(x)) >= len(x) - 3)
        if (again == keep).all():
            break
        keep = again
    return my - power * mx, power, deviation


def _low(growth: tuple[float, float, float], n: int, kinds: int) -> bool:
    """Whether ``kinds`` among ``n`` are far fewer than in files of that length."""
    offset, power, deviation = growth
    usual = math.exp(offset + power * math.log(n))
    return math.log(kinds / usual) < -_LOW * deviation and (usual - kinds) / math.sqrt(usual) > _CHANCE


def _foreign(own: tuple[int, int], others: tuple[int, int], language: tuple[int, int]) -> bool:
    """Whether a file's naming style is not that of the repository's other files; where these are few, the language's counts."""
    n = sum(own)
    if not n:
        return False
    p = (others[0] + 10 * (language[0] + 0.5) / (sum(language) + 1)) / (sum(others) + 10)
    q = own[0] / n
    ratio = 2 * n * sum(a * math.log(a / b) for a, b in ((q, p), (1 - q, 1 - p)) if a)
    return abs(q - p) > _GAP and ratio > _RATIO


def _under(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def classify(df: DataFrame, keys: tuple[str, ...] = ("repo_id",), path: str = "file_path", text: str = "raw_code", language: str = "language", kind: str = "chunk_type", whole: str = "module") -> DataFrame:
    """Each file that nobody in the project wrote by hand: ``keys``, ``path``, ``reason``.

    Rows of ``kind`` ``whole`` hold whole files, whose contents are judged; of a file without such a row (at its commit, where
    the table has one) the joined texts of its other rows are. Of every row the path is judged. A null text leaves the path, a
    null path leaves the row out; rows of one file are one; empty texts are hand-written; an empty table gives an empty
    result. The counts of trigrams, lengths and styles cover all files; ``keys`` name the repository whose style is asked.
    """
    p = F.col(path)
    by_path = F.when(_under(p, VENDOR_DIRS), "vendored").when(_under(p, GENERATED_DIRS) | p.rlike(GENERATED_NAMES), "generated").when(p.rlike(MINIFIED_NAMES), "minified")
    named = df.filter(p.isNotNull())
    paths = named.select(*keys, path, by_path.alias("reason")).filter("reason is not null")
    at = [*keys, path, *(c for c in ("commit_id",) if c in df.columns)]
    first, last = (F.col(c) if c in df.columns else F.lit(0) for c in ("start_line", "end_line"))
    texts = named.filter(F.col(text).isNotNull() & by_path.isNull()).select(F.coalesce(F.col(language).cast("string"), F.lit("")).alias("_l"), F.col(text).alias("_t"), (F.coalesce(F.col(kind), F.lit("")) == whole).alias("_w"), first.alias("_s"), last.alias("_e"), *at)
    wholes = texts.filter("_w")
    pieces = texts.filter("not _w").join(wholes.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(at))).distinct(), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(at))), "left_anti")
    pieces = pieces.groupBy("_l", *at).agg(F.array_sort(F.collect_set(F.struct("_s", (-F.col("_e")).alias("_e"), "_t"))).alias("_a"))
    strings = F.array().cast("array<string>")
    outer = F.aggregate(  # a method inside of its class once; what overlaps the piece before it apart, as it may be the same code at an older place
        "_a",
        F.struct(F.lit(None).cast("int").alias("e"), strings.alias("t"), strings.alias("o")),
        lambda g, x: F.when(
            g["e"].isNull() | (-x["_e"] > g["e"]) | (-x["_e"] == 0),
            F.when(x["_s"] < g["e"], F.struct((-x["_e"]).alias("e"), g["t"].alias("t"), F.concat(g["o"], F.array(x["_t"])).alias("o"))).otherwise(
                F.struct((-x["_e"]).alias("e"), F.concat(g["t"], F.array(x["_t"])).alias("t"), g["o"].alias("o"))
            ),
        ).otherwise(g),
    )
    joined = pieces.select("_l", outer.alias("_j"), *keys, path).select("_l", F.array_join("_j.t", "\n").alias("_t"), F.when(F.size("_j.o") > 0, F.array_join("_j.o", "\n")).alias("_o"), *keys, path)
    files = spread(wholes.select("_l", "_t", F.lit(None).cast("string").alias("_o"), *keys, path).unionByName(joined).withColumnsRenamed({"_l": "l", "_t": "t", "_o": "o"}))

    def owner(b: pa.RecordBatch) -> list[str]:
        return list(map(repr, zip(*(b.column(i).to_pylist() for i in range(3, 3 + len(keys))), strict=True))) if keys else [""] * b.num_rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        more: dict[tuple[str, str, str, int], int] = {}
        for b in batches:
            for lang, t, o, g in zip(*(b.column(i).to_pylist() for i in range(3)), owner(b), strict=True):
                c = total.setdefault(lang, np.zeros(_K**3, np.int64))
                raw = t.encode("utf-8", "replace")
                c += np.bincount(_trigrams(raw), minlength=_K**3)
                if o:
                    c += np.bincount(_trigrams(o.encode("utf-8", "replace")), minlength=_K**3)
                names = _code_names(raw, lang)
                if not names:
                    continue
                kinds = set(names)
                snake, camel = _styles(kinds)
                for key, n in (((lang, "shapes", "", _bin(*_shapes(raw))), 1), ((lang, "names", "", _bin(len(names), len(kinds))), 1), ((lang, "style", g, 0), snake), ((lang, "style", g, 1), camel)):
                    more[key] = more.get(key, 0) + n
        for lang, c in total.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(["trigrams"] * len(at), pa.string()), pa.array([""] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["l", "what", "g", "tri", "n"])
        if more:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in more], pa.string()) for i in range(3)), pa.array([k[3] for k in more], pa.int32()), pa.array(list(more.values()), pa.int64())], names=["l", "what", "g", "tri", "n"])

    counts = files.select("l", "t", "o", *keys).mapInArrow(count, "l string, what string, g string, tri int, n long").groupBy("l", "what", "g", "tri").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # a language: at most 38^3 trigrams, 2 x 65,536 lengths; a repository and language: two numbers
    models: dict[str, np.ndarray] = {}
    bins: dict[tuple[str, str], dict[int, int]] = {}
    styles: dict[tuple[str, str], list[int]] = {}
    usual: dict[str, list[int]] = {}
    for lang, what, g, tri, n in zip(*(counts[k] for k in ("l", "what", "g", "tri", "n")), strict=True):
        if what == "trigrams":
            models.setdefault(lang, np.full(_K**3, 0.05))[tri] += n
        elif what == "style":
            styles.setdefault((lang, g), [0, 0])[tri] += n
            usual.setdefault(lang, [0, 0])[tri] += n
        else:
            bins.setdefault((what, lang), {})[tri] = n
    growth = {k: _growth(v) for k, v in bins.items()}
    bits, mean = {}, {}
    for lang, c in models.items():
        m = c.reshape(-1, _K)
        bits[lang] = -np.log2(m / m.sum(1, keepdims=True)).ravel()
        seen = c - 0.05
        mean[lang] = float((bits[lang] * seen).sum() / max(1.0, seen.sum()))

    def foreign(own: tuple[int, int], lang: str, g: str) -> bool:
        others, all_ = styles.get((lang, g), (0, 0)), usual.get(lang, (0, 0))
        return _foreign(own, tuple(max(0, a - b) for a, b in zip(others, own, strict=True)), tuple(max(0, a - b) for a, b in zip(all_, own, strict=True)))

    def wrong_language(code: str, lang: str, kinds: set[bytes]) -> bool:
        """Whether a file is written in another language than its row says: a style is foreign within one language only."""
        words = {k: len(kinds & v) for k, v in _WORDS.items()}
        if words.get(lang, len(kinds)) < max(words.values()):
            return True
        return lang in syntax.LANGUAGES and bool(syntax._edits(code, lang, 0)[0]) and any(not syntax._edits(code, x, 0)[0] for x in syntax.LANGUAGES if x != lang)

    def judge(code: str, overlapping: str | None, lang: str, g: str) -> str | None:
        t = code if overlapping is None else code + "\n" + overlapping
        if not t.strip():
            return None
        generated, vendored = head_marks(t)
        if generated or vendored:
            return "generated" if generated else "vendored"
        raw = t.encode("utf-8", "replace")
        names = _IDENT.findall(raw)
        lines = t.count("\n") + 1
        if len(names) >= 30:
            short = sum(len(x) <= 2 for x in names) / len(names)
            entropy = float(bits[lang][_trigrams(raw)].mean()) if lang in bits else 9.0
            if short > 0.4 and len(t) / lines > 100 and entropy > mean.get(lang, 0.0) - 1:
                return "minified"
        rest = len(re.sub(r"\s+", "", _LITERAL.sub("", t)))
        if len(t) >= 200 and rest < 0.12 * len(t):
            literals = sum(len(m[0]) for m in re.finditer(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\b(?:0[xX][0-9a-fA-F]+|\d[\d.]*)\b", t))
            if literals > 0.5 * len(re.sub(r"\s+", "", t)) and not re.search(r"\b(?:def|function|func|class|return|if|for|while)\b", _LITERAL.sub(" ", t)):
                return "data"
        raw = code.encode("utf-8", "replace")
        names = _code_names(raw, lang)
        if names:
            kinds = set(names)
            if _low(growth["names", lang], len(names), len(kinds)) and _low(growth["shapes", lang], *_shapes(raw)):
                return "generated"
            own = _styles(kinds)
            if foreign(own, lang, g) and not wrong_language(code, lang, kinds):
                return "vendored"
        return None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons = [judge(t, o, lang, g) for lang, t, o, g in zip(*(b.column(i).to_pylist() for i in range(3)), owner(b), strict=True)]
            at = [i for i, r in enumerate(reasons) if r]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3, 4 + len(keys))), pa.array([reasons[i] for i in at], pa.string())], names=[*keys, path, "reason"])

    fields = ", ".join(f"`{n}` {k}" for n, k in df.select(*keys, path).dtypes)
    judged = files.mapInArrow(score, f"{fields}, reason string")
    return paths.unionByName(judged).groupBy(*keys, path).agg(F.min("reason").alias("reason"))
