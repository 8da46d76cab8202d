"""Problem 10: abusive, hateful or sexual content by weak supervision.

Voters (word lists and phrases in English, German, French and Spanish) vote on every sentence. A generative label model takes
the counts of all vote patterns of the corpus, estimates each voter's accuracies by expectation maximisation under Beta priors
and discounts voters that agree beyond what the label explains; a linear classifier over word features is trained on its
posterior labels and gives the score of every sentence, so that no vote alone flags one and sentences on which no voter is sure
are known as well. A document's score is that of its worst sentence.

The text is read once: one pass of Arrow batches turns a document into word codes and votes; the label model, the sample and
the scoring work on the codes.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import spread

INSULTS = frozenset(
    """idiot idiots moron morons imbecile imbeciles cretin cretins loser losers clown clowns jerk jerks muppet muppets scumbag scum parasite parasites cockroach
    cockroaches weasel weasels halfwit halfwits dimwit dimwits numbskull blockhead dumbass dumbasses asshole assholes bastard bastards bitch bitches cunt prick twat wanker
    retard retards retarded pig swine douchebag fool fools imbecil idiota idiotas tarado tarados gilipollas cabron estupido estupida tonto subnormal payaso
    inutil idiote idiotes imbecile cretin connard connasse abruti abrutis debile salaud salope ordure minable versager vollidiot vollpfosten trottel depp
    idioten dummkopf arschloch penner wichser spast missgeburt hurensohn schwachkopf blodmann dimwitted witted brainless spineless clueless worthless useless pathetic stupid disgusting miserable
    lazy dumb lying sorry trash garbage mull""".split()
)
#: Insults that are ordinary words as well; they count with a person only.
MILD = frozenset("stupid dumb lazy sorry lying trash garbage useless worthless clown pig fool weasel parasite cockroach mull disgusting miserable pathetic clueless witted ordure minable inutil payaso tonto trottel".split())
GROUP = frozenset("vermin filth thieves liars subhuman subhumans savages parasites rats ungeziefer abschaum gesindel pack untermenschen vermine racaille parasites basura escoria alimanas ratas plaga".split())
SEXUAL = frozenset(
    """porn porno pornos porns nude nudes naked sexy sex sexo sexe horny slut whore boobs tits cock dick pussy cum blowjob orgasm erotic erotik escort nacktbilder nackt
    geil geile ficken fick sexkontakte kontakte desnuda desnudas desnudo follar polla tetas puta caliente nue nues nu baise baiser bite chatte salope coquine webcam milf hentai xxx uncensored adult""".split()
)
MILD_SEX = frozenset("sex sexo sexe naked nackt adult cock dick escort nu bite chatte kontakte caliente webcam uncensored".split())
THREAT = frozenset("hurt kill choke strangle beat stab shoot umbringen verprugeln tuer frapper matar golpear".split())
OBSCENE = frozenset("fuck fucking fucked fucker screw shit shitty fuckers scheisse scheiss merde joder mierda encule foutre verpiss fick arsch cono".split())
LEXICON = INSULTS | GROUP | SEXUAL | THREAT | OBSCENE
STRONG = LEXICON - MILD - MILD_SEX - THREAT - frozenset(["sorry"])
_PERSON = frozenset("you your yours yourself u ur du dein deine deinen dir dich ihr euch tu ton ta tes toi te vous votre usted eres tus ti vosotros sois he she her him his".split())
_COPULA = frozenset("are sind sont son".split())
#: General phrases of each kind, folded, as whole words.
PHRASES = {
    "command": """shut up|shut the hell up|shut the fuck up|halt die klappe|haltet die klappe|halt das maul|halt s maul|halt den mund|ferme la|fermez la|ferme ta|ta gueule|callate|cierra la boca|cierra el pico|go screw yourself
        |go fuck yourself|go kill yourself|go hang yourself|get lost|verschwinde|verpiss dich|degage|casse toi|largate|vete a la|vete al|piss off|drop dead|go to hell|fuck you|fuck off""",
    "contempt": """make me sick|makes me sick|make me puke|makes me puke|make me vomit|makes me vomit|choke on it|stop breathing|go cry|nobody wants you|nobody wants your|nobody likes you|nobody likes your|nobody needs you|nobody needs your
        |nobody cares about you|crawl back|sad little|your mother|with a brain like|excuse for a|excuse for an|piece of trash|piece of shit|piece of garbage|piece of crap|want to throw up|wants to throw up|learn to read|done with you|people like you|do the world a favor|do the world a favour
        |nadie quiere|personne ne veut|ein kompletter|un parfait|un completo|espece d|espece de|never find work|hope you get|hope you lose""",
    "threat": """find you|hurt you|kill you|beat you|stab you|shoot you|strangle you|destroy you|hurt him|kill him|beat him|hurt her|kill her|beat her|kill them|hurt them|hope you die|hope you rot|burn the place|you will regret|watch your back
        |ich finde dich|ich kriege dich|ich bring dich|vais te trouver|te retrouver|te retrouverai|te trouverai|vais te tuer|te voy a|te encontrare|te matare""",
    "group": """driven out|send them back|send them all back|do not belong here|in their blood|whole people|they are all|left the country|go back to your|go back to where|are too stupid|are too dumb|are too lazy|gehoren alle|gehoren nicht|gehoren aus|raus mit
        |qu on les chasse|qu on les renvoie|qu on les expulse|sont tous des|sont de la|son basura|son escoria|son ladrones|son una plaga|echarlos|sind ungeziefer|sind abschaum|sind alle|sind dreck|never let a|never let an""",
    "sexual_phrase": """in her bed|in his bed|in my bed|in your bed|into bed|into my bed|into her bed|to your body|singles want|uncensored adult|nude pictures|naked on|you naked|so sexy|sex videos|sex video|sex chat|sex dates|sex tonight|sex clips|adult sex
        |photos de toi nue|photo de toi nue|fotos desnuda|foto desnuda|heisse|meet you tonight|send me your nude|send me your naked|send me your pictures|send me your photos|schick mir|nuit chaude|nuits chaudes|femmes chaudes|femmes coquines|mujeres calientes|chicas calientes""",
}
_REPORTED = re.compile(
    r"\b(?:word ?list|wortliste|lista de palabras|liste de mots|code of conduct|verhaltenskodex|code de conduite|codigo de conducta|reported (?:that|a|an|the user|by)|had been called|(?:was|were|being|been|is) called|calling (?:somebody|someone|people|others|a)"
    r"|called (?:him|her|me|them|somebody|someone) an?|gets you removed|account was (?:blocked|closed)|comment filter|profanity|slurs?|blocklist|asserts that|must be masked|is masked|are masked|words like|terms like|such as|the words?|phrases? (?:like|such)|is (?:forbidden|banned|not allowed|prohibited)|are (?:forbidden|banned|not allowed|prohibited)"
    r"|meldete dass|wurde (?:als|gemeldet)|beleidigung\w*|beschimpft|a signale|a ete (?:traite|appele|qualifie)|traite de|reporto que|fue llamado|habia sido|insultos?|insultes?|moderation (?:log|queue|report))\b"
)
_NOUNS = "|".join(sorted(INSULTS))
_SELF = re.compile(
    rf"\b(?:i (?:was|am|feel|felt|m|must be|must have been|have been|look|looked) (?:an? |so |such an? |too |being |just |really |the )*(?:{_NOUNS})|ich (?:war|bin) (?:ein |so |zu )*(?:{_NOUNS})|je (?:suis|me sens) (?:un |une |trop |vraiment )*(?:{_NOUNS})|soy (?:un |una |muy )*(?:{_NOUNS}))\b"
    r"|\bj etais\b|\b(?:stupid|dumb) (?:question|me|of me)\b|\bquestion from me\b|\bmy (?:own )?(?:stupid|dumb|lazy|fault|bad|mistake)\b|\bsorry for the\b|\bshame on me\b|\bmea culpa\b|\bidiot of myself\b|\bcall me\b"
)
#: A word of the lexicon next to what it means in technical use.
_TECHNICAL = re.compile(
    r"\b(?:kill(?:s|ed|ing)? (?:the |a |all |every |its )*(?:\w+ )?(?:child|children|process|processes|worker|workers|job|jobs|thread|threads|server|daemon|connection|session|container|task|query|signal|switch)"
    r"|(?:naked|nude|nackter?) (?:pointer|eye|type|return|new|domain|exception|zeiger|except)|\w+ proof|proof against|(?:dumb|stupid|useless) (?:terminal|pipe|client|mode|proxy|mistake|mistakes|bug|bugs|typo|error|default|warning|thing|code|branch|check|cache|loop|test|hack|workaround|import)"
    r"|garbage (?:collect\w*|data|values?|bytes|after|in|output|characters|text|heap)|prints garbage|trash (?:folder|can|bin|icon|table)|(?:column|field|attribute|table) sex|sex (?:column|field|of the|is nullable|attribute)|adult (?:and|or) (?:child|minor)|child(?:ren)? and adult|adult (?:records?|tickets?|fares?)"
    r"|hurts? (?:performance|latency|throughput|readability|the|our|cache)|performance badly|beat the|(?:hot|slow) path|lazy (?:load\w*|eval\w*|init\w*|import\w*|val\w*|seq\w*|list|field|join|iterator)|shoot (?:the|a) (?:worker|process|node)|race condition|parasite (?:capacitance|thread)|choke (?:on the|point)|strangler?|(?:escort|pig) (?:latin|query|script)|stab(?:le)? at|screw (?:up|ups|driver|thread))\b"
)
_AGAINST = (_REPORTED, _SELF, _TECHNICAL)
_ZERO = re.compile("[\\u00ad\\u200b-\\u200f\\u2028-\\u202e\\u2060-\\u2064\\ufeff]")
#: Letters of other scripts that look like Latin ones, in pairs (fixed values).
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһӏкмтвнгпАЕОРСУХІЈЅКМТВНαοερτυικνη", "aeopcyxijsdhlkmtbhrnaeopcyxijskmtbhaoeptuikvn")
_LEET = str.maketrans("0134578@$!|+", "oieastbasilt")
_SPACED = re.compile(r"(?<!\w)(\w)([-_.·*~ /|])(\w)((?:\2\w)+)(?![\w])")
_TOKEN = re.compile(r"[^\W\d_]+(?:[*#@$!?0-9.+|]+[^\W\d_]+)+|\d*[^\W\d_]+(?:[\d$@!]+[^\W_]+|[\d$@]+)?|[\d$@!]+[^\W\d_]+|\w+|[.!?]+(?=\s)|\n|:\)")
_STRETCH = re.compile(r"(.)\1{2,}")
_MASKED = re.compile(r"[*#@?.$!+]")
_MARKS = dict.fromkeys(c for c in range(0x300, 0x370)) | {ord("ß"): "ss"}
_by_shape: dict[tuple[str, str, int], list[str]] = {}
for _w in sorted(LEXICON):
    _by_shape.setdefault((_w[0], _w[-1], len(_w)), []).append(_w)

VOTERS = ["insult", "person_insult", "command", "contempt", "threat", "group", "sexual", "sexual_phrase", "disguised", "obscene", "reported", "self", "technical"]
_FOR = 10  # the voters before this number vote for, the others against
_KINDS = list(PHRASES)
# A word's code: 16 bits of hash, then its lists, then whether it ends a sentence.
_BITS = 16
_FLAGS = {name: 1 << (_BITS + i) for i, name in enumerate(("strong", "insult", "group", "sexual", "mild_sex", "threat", "obscene", "person", "copula", "disguised"))}
_LISTS = sum(_FLAGS[n] for n in ("strong", "insult", "group", "sexual", "mild_sex", "threat", "obscene"))
_BREAK = 1 << 30
_HASH = (1 << _BITS) - 1
_FEATURES = 1 << 18
#: A sentence counts as one of this many features at least, so that two words alone do not weigh much.
_SHORT = 40


def fold(text: str) -> str:
    """Lower-case Latin letters without accents, look-alikes, invisible characters or letters set apart."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _ZERO.sub("", text).translate(_LOOKALIKE)).translate(_MARKS)
    return _SPACED.sub(lambda m: m[0].replace(m[2], ""), text.lower())


def lexicon_word(token: str) -> tuple[str, bool] | None:
    """The word of the lexicon that a folded token stands for, and whether it was disguised."""
    if token in LEXICON:
        return token, False
    t = token
    if not t.isalpha() and any(map(str.isalpha, t)):
        u = t.translate(_LEET)
        for v in (u, _STRETCH.sub(r"\1", u)):
            if v in STRONG or v in LEXICON and (len(v) > 4 or v in SEXUAL):
                return v, True
        if _MASKED.search(t[1:-1]) and t[0].isalpha() and t[-1].isalpha():
            for w in _by_shape.get((t[0], t[-1], len(t)), ()):
                if all(a == b or not a.isalnum() for a, b in zip(t, w, strict=True)):
                    return w, True
        return None
    if _STRETCH.search(t):
        for r in (r"\1", r"\1\1"):
            v = _STRETCH.sub(r, t)
            if v in LEXICON:
                return v, True
    return None


class _Codes(dict):
    """Code of a folded token; at most a million tokens are remembered."""

    def __missing__(self, t: str) -> int:
        if t[0] in ".!?\n:":
            code = _BREAK
        else:
            got = lexicon_word(t)
            w = got[0] if got else t if t.isalpha() else "#"
            code = zlib.crc32(w.encode()) & _HASH
            on = {
                "strong": w in INSULTS and w not in MILD, "insult": w in INSULTS, "group": w in GROUP, "sexual": w in SEXUAL and w not in MILD_SEX, "mild_sex": w in MILD_SEX, "threat": w in THREAT,
                "obscene": w in OBSCENE, "person": w in _PERSON, "copula": w in _COPULA, "disguised": bool(got and got[1]),
            }
            code |= sum(_FLAGS[k] for k, v in on.items() if v)
        if len(self) > 1_000_000:
            self.clear()
        self[t] = code
        return code


@lru_cache(1)
def _phrases():
    """All phrases as one Aho-Corasick automaton over words between blanks."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, text in PHRASES.items():
        for p in text.split("|"):
            p = " ".join(p.split())
            a.add_word(f" {p} ", (_KINDS.index(kind), p.count(" ")))
    a.make_automaton()
    return a


_codes = _Codes()


def encode(text: str) -> tuple[np.ndarray, list[str]]:
    """Codes and tokens of a text; every sentence ends with a break."""
    toks = _TOKEN.findall(fold(text))
    toks.append("\n")
    return np.fromiter(map(_codes.__getitem__, toks), np.uint32, len(toks)), toks


def votes(codes: np.ndarray, toks: list[str]) -> list[tuple[int, int, int]]:
    """(first word, end, pattern) of every sentence with a vote for: bit i of the pattern is the vote of voter i."""
    hits: dict[int, int] = {}
    flags = np.bitwise_or.reduce(codes) if len(codes) else 0
    flat = " " + " ".join(toks) + " "
    if flags & _FLAGS["disguised"]:
        flat = " " + " ".join([(lexicon_word(t) or (t,))[0] for t in toks]) + " "
    for end, (kind, inner) in _phrases().iter(flat):
        hits[flat.count(" ", 0, end) - 1 - inner] = hits.get(flat.count(" ", 0, end) - 1 - inner, 0) | 1 << kind
    if not hits and not flags & _LISTS:
        return []
    ends = np.nonzero(codes & _BREAK)[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    all_flags = np.bitwise_or.reduceat(codes, np.minimum(starts, len(codes) - 1))
    spoken: dict[int, int] = {}
    for word, kinds in hits.items():
        i = int(np.searchsorted(ends, word))
        spoken[i] = spoken.get(i, 0) | kinds
    out = []
    for i in sorted({*np.nonzero(all_flags & _LISTS)[0].tolist(), *spoken}):
        a, b = int(starts[i]), int(ends[i])
        if a >= b:
            continue
        f, ph = int(all_flags[i]), spoken.get(i, 0)
        has = lambda n, f=f: bool(f & _FLAGS[n])
        said = lambda k, ph=ph: bool(ph & 1 << _KINDS.index(k))
        person = has("person") or said("command") or said("contempt")
        v = [
            has("strong"), has("insult") and person, said("command"), said("contempt"), said("threat") or has("threat") and has("person"), said("group") or has("group") and has("copula"),
            has("sexual") or has("mild_sex") and person, said("sexual_phrase"), has("disguised"), has("obscene") and has("person"),
        ]
        if any(v):
            s = " ".join([(lexicon_word(t) or (t,))[0] for t in toks[a:b]])
            v += [p.search(s) is not None for p in _AGAINST]
            out.append((a, b, sum(1 << j for j, x in enumerate(v) if x)))
    return out


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word (one row per word: the word, its lists, and the pairs and triples that end with it) and the sentence of each word."""
    brk = (codes & _BREAK) > 0
    sentence = np.cumsum(brk) - brk
    word = (codes & _HASH).astype(np.uint64)
    lists = codes & _LISTS
    kind = np.where(brk, np.uint64(1), np.where(lists > 0, (lists.astype(np.uint64) + 77) * 40503 & _HASH, word))  # all words of a list are alike
    before = np.concatenate([np.ones(1, np.uint64), kind[:-1]])
    before2 = np.concatenate([np.ones(1, np.uint64), before[:-1]])
    mix = lambda a: (a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)  # noqa: E731  # 18 bits
    one, two = mix(word + np.uint64(1 << 40)), mix(kind + np.uint64(2 << 40))
    pair = mix(before * np.uint64(1 << 16) + kind + np.uint64(3 << 40))
    three = mix((before2 * np.uint64(1 << 16) + before) * np.uint64(1 << 16) + kind + np.uint64(4 << 50))
    ids = np.stack([one, two, pair, three], 1).astype(np.int32)
    return ids[~brk], sentence[~brk]


class LabelModel:
    """Accuracies of the voters and the posterior label of every vote pattern, by expectation maximisation.

    A voter is right with probability ``acc`` where it votes. The accuracies are estimated from the counts of the corpus under a
    Beta prior of mean ``prior_for`` or ``prior_against`` that weighs ``strength`` times as much as the voter's own votes, so that
    the estimate behaves alike at every size; both labels are taken as equally likely where a vote for was cast. Voters of one side
    that agree beyond what the label explains are discounted by their residual correlations.
    """

    def __init__(self, counts: dict[int, float], rounds: int = 40, strength: float = 2.0, prior_for: float = 0.75, prior_against: float = 0.95):
        pats = sorted(p for p in counts if p & ((1 << _FOR) - 1))  # a sentence without any vote for it is taken as clean
        n = np.array([counts[p] for p in pats], float)
        k = len(VOTERS)
        on = np.array([[p >> j & 1 for j in range(k)] for p in pats], float).reshape(len(pats), k)
        side = np.arange(k) < _FOR
        mean = np.where(side, prior_for, prior_against)
        cast = n @ on
        q = np.where(on[:, ~side].any(1), 1 - prior_against, prior_for)
        self.accuracy, self.weight = mean, np.ones(k)
        for _ in range(rounds if len(pats) else 0):
            y1, y0 = n * q, n * (1 - q)
            self.accuracy = (np.where(side, y1 @ on, y0 @ on) + (strength * cast + 1) * mean) / ((1 + strength) * cast + 1)
            p1, p0 = (y1 @ on + 0.5) / (y1.sum() + 1), (y0 @ on + 0.5) / (y0.sum() + 1)
            res, ww = np.concatenate([on - p1, on - p0]), np.concatenate([y1, y0])
            cov = (res * ww[:, None]).T @ res / ww.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.where(side[:, None] == side[None, :], np.clip(cov / sd[:, None] / sd[None, :], 0, 1), 0)
            np.fill_diagonal(corr, 0)
            self.weight = 1 / (1 + corr.sum(1))
            log_odds = np.where(side, 1, -1) * np.log(self.accuracy / (1 - self.accuracy))
            q = 1 / (1 + np.exp(-(on @ (log_odds * self.weight))))
        self.posterior = dict(zip(pats, q.tolist(), strict=True))


def train(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rounds: int = 30, rate: float = 0.3, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on hashed features with weighted labels, by Adagrad over shuffled blocks; the last weight is the bias."""
    d = _FEATURES
    w, g2 = np.zeros(d + 1), np.full(d + 1, 1e-4)
    rng = np.random.default_rng(3)
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int32)
    start = np.concatenate([[0], np.cumsum(sizes)])
    once = np.bincount(np.concatenate([np.unique(r) for r in rows]) if len(rows) else flat, minlength=d) < 2  # a feature of one sentence only would learn it by heart
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 256):
            b = order[i : i + 256]
            n = sizes[b]
            idx = flat[np.repeat(start[b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            row = np.repeat(np.arange(len(b)), n)
            norm = np.sqrt(np.maximum(n, _SHORT))
            z = np.bincount(row, w[idx] / norm[row], len(b)) + w[d]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) * weight[b]
            at, inv = np.unique(idx, return_inverse=True)
            g = np.where(once[at], 0, np.bincount(inv, (err / norm)[row]) + ridge * w[at])
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            gb = err.sum()
            g2[d] += gb * gb
            w[d] -= rate * gb / np.sqrt(g2[d])
    return w


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text", sample_rows: int = 40000) -> DataFrame:
    """``id_col``, ``score`` (of the worst sentence, 0 to 1) and ``worst`` (its number) for every row.

    The vote patterns of all sentences are counted; the classifier is trained on a sample of at most ``sample_rows`` sentences,
    half of them with a vote for, chosen by a hash; its label is
    the likelier one of the posterior, its weight how sure that is, times how many sentences of its half it stands for. A null, empty
    or blank text scores 0; texts are read whole; every row of a repeated id is scored. An empty table gives an empty result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, first, end, pattern, sizes, many = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                codes, toks = encode(t) if t else (np.empty(0, np.uint32), [])
                got = votes(codes, toks) if t else []
                words.append(codes.tobytes())
                many.append(int((codes & _BREAK > 0).sum()))
                sizes.append(len(got))
                for x, y, p in got:
                    first.append(x), end.append(y), pattern.append(p)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (first, end, pattern)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array(many, pa.int32()), *lists], names=["i", "words", "sentences", "first", "end", "pattern"])

    kind = dict(df.select(id_col).dtypes)[id_col]
    coded = spread(df.select(F.col(id_col).alias("i"), F.col(text).alias("t"))).mapInArrow(read, f"i {kind}, words binary, sentences int, first array<int>, end array<int>, pattern array<int>").persist(StorageLevel.MEMORY_AND_DISK)
    total = coded.agg(F.sum("sentences")).first()[0] or 0
    counts = {r["p"]: float(r["n"]) for r in coded.select(F.explode("pattern").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2^13 patterns of 13 voters
    model = LabelModel(counts)
    half, voted = sample_rows // 2, sum(counts.values())
    share1, share0 = min(1.0, half / max(1.0, voted)), min(1.0, half / max(1.0, total - voted))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, pats, rows = [], [], []
            for raw, firsts, patterns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                codes, of = np.frombuffer(raw, np.uint32), dict(zip(firsts, patterns, strict=True))
                ends = np.nonzero(codes & _BREAK)[0]
                a = 0
                for e in ends.tolist():
                    if e > a:
                        p = of.get(a, 0)
                        x = zlib.crc32(codes[a:e])
                        if x < (share1 if p else share0) * 1.2 * (1 << 32):
                            h.append(x), pats.append(p), rows.append(codes[a : e + 1].tobytes())
                    a = e + 1
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(pats, pa.int32()), pa.array(rows, pa.binary())], names=["h", "p", "codes"])

    drawn = coded.select("words", "first", "pattern").mapInArrow(sample, "h long, p int, codes binary")
    sides = [drawn.filter(c).orderBy("h", "codes").limit(half).toArrow().to_pydict() for c in (F.col("p") > 0, F.col("p") == 0)]
    rows = [features(np.frombuffer(c, np.uint32))[0].ravel() for s in sides for c in s["codes"]]
    q = np.array([model.posterior.get(p, 0.0) for s in sides for p in s["p"]])
    n1, n0 = len(sides[0]["p"]), len(sides[1]["p"])
    heavy = np.concatenate([np.full(n1, voted / max(1, n1)), np.full(n0, (total - voted) / max(1, n0))])
    w = train(rows, (q > 0.5).astype(float), np.abs(2 * q - 1) * heavy / (heavy[0] if len(heavy) else 1.0)).astype(np.float32)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            codes = np.frombuffer(b"".join(raw), np.uint32)
            many = b.column(2).to_numpy()
            ids, sentence = features(codes)
            total_ = int(many.sum())
            z = np.bincount(sentence, w[ids].sum(1), total_)
            n = np.bincount(sentence, minlength=total_)
            p = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z / np.sqrt(np.maximum(4 * n, _SHORT)) + w[-1], -30, 30))), 0.0)
            best, worst, at = [], [], 0
            for k in many.tolist():
                s = p[at : at + k]
                j = int(s.argmax()) if k else -1
                best.append(float(s[j]) if k else 0.0)
                worst.append(j if k and s[j] > 0 else -1)
                at += k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.float64()), pa.array(worst, pa.int32())], names=["i", "score", "worst"])

    return coded.select("i", "words", "sentences").mapInArrow(rate, f"i {kind}, score double, worst int").withColumnRenamed("i", id_col)
