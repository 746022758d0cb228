"""Template residue and error pages, found by positive-unlabelled naive Bayes.

Passages of the corpus that trusted patterns name as residue (unfilled slots, filler, error pages, notices
that scripts are needed) are the positive class; all others are unlabelled. Expectation-maximization learns
from them what residue and what ordinary text looks like: the labels of the unlabelled passages are
estimated, the word statistics re-estimated, over all passages of the corpus in every round. The model, whose
size is fixed, then scores every distinct passage, and a record is residue if one of its passages is. The patterns only
label passages for the learning; the score alone decides.

Quoted and code-formatted stretches are taken out before scoring, since text that reports residue or shows
code is none; so are the project's own masks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.runtime import cut

#: Feature buckets of the model, which bound its size.
FEATURES = 1 << 17
#: Rounds of expectation-maximization.
ROUNDS = 4
#: Log odds above which a passage is residue, and what one counts as that is residue by its best stretch.
THRESHOLD, STRETCHED = -2.0, 1.0
#: Words and pairs of words say much the same twice over: their evidence counts this much.
TEMPER = 0.4
#: A stretch of at least so many words with so much evidence is residue whatever follows it in the same passage.
STRETCH_WORDS, STRETCH_ODDS = 4, 8.0
SMOOTHING = 0.05
#: A trusted passage of at most so many words is residue as a whole.
SHORT = 9
#: Lines whose passages a task remembers.
MEMO = 50_000

# The project's own masks, which are no slots.
MASKS = ("<ID>", "<DATE>", "<UUID>")

# The shapes of slots that only templates have. Names are words with blanks, dots, dashes or underscores.
_NAME = r"[A-Za-zÀ-ÿ][\wÀ-ÿ .\-]{0,40}?"
SURE_SLOTS = [
    r"\{\{\s*" + _NAME + r"\s*\}\}", r"(?<![\w/:=])\$\{\s*" + _NAME + r"\s*\}(?![\w/:])", r"#\{\s*" + _NAME + r"\s*\}", r"\{%-?\s*" + _NAME + r"\s*-?%\}", r"\[\[\s*" + _NAME + r"\s*\]\]",
    r"<<\s*" + _NAME + r"\s*>>", r"%\(" + _NAME + r"\)[sd]", r"%%" + _NAME + r"%%", r"(?<![\w@])@[A-Za-zÀ-ÿ_]{2,40}@(?!\w)", r"(?<!\w)__[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ_]{1,40}?__(?!\w)",
    r"(?<!\w)_{4,}(?!\w)", r"\bXX \w[\w ]{1,40} XX\b", r"\[(?:insert|fill in|your|enter)\b[^\]\n]{0,60}\]", r"\((?:insert|fill in|enter)\b[^)\n]{0,60}\)",
]
#: Slots whose shape ordinary text has too: they are features, never trusted alone.
MAYBE_SLOTS = [r"(?<!^)\[[A-ZÀ-Ý][\w ]{1,40}\]", r"<[^\W\d_][\w ]{1,40}>", r"(?<![\w$#{%])\{[A-Za-zÀ-ÿ][\wÀ-ÿ]{1,40}\}(?!\})"]
_SURE = re.compile("|".join(SURE_SLOTS))
_MAYBE = re.compile("|".join(MAYBE_SLOTS))

# What whole passages of trusted error pages, script notices and filler say, in lower case, digits as 0.
TRUSTED = [
    r"(?:error |http )?0+\b[ :\-]*(?:page not found|not found|the page you asked for is not here|nothing lives at this address|forbidden|internal server error|bad gateway|service unavailable|gateway time-?out|too many requests)",
    r"(?:error|http) 0+[ :\-]+.{3,60}", r"access denied\.?", r"you have no permission .{4,40}", r"application error: .{4,80}", r"oops!?", r"something (?:broke|went wrong) .{3,40}",
    r"too many requests .{3,40}", r"your session has expired\.?", r"sign in again .{3,20}", r"we are down for maintenance.{0,40}", r"slow down and retry .{3,20}", r"the page you asked for .{3,30}",
    r"(?:diese )?seite (?:wurde )?(?:leider )?nicht gefunden.{0,20}", r"zugriff verweigert\.?", r"der dienst ist zurzeit nicht .{4,20}", r"page (?:introuvable|non trouvée).{0,20}", r"l'adresse demandée .{4,30}",
    r"service (?:momentanément|temporairement) indisponible.{0,20}", r"accès refusé.{0,40}", r"página no encontrada.{0,20}", r"la dirección ya no existe\.?", r"servicio no disponible.{0,30}", r"acceso denegado.{0,40}",
    r".{0,40}\b(?:enable|allow|needs?|requires?|turn on|activate)\b.{0,30}\b(?:javascript|scripts?|scripting|cookies)\b.{0,40}", r".{0,40}\b(?:javascript|scripts?|scripting)\b.{0,12}\b(?:must be on|turned off|disabled|required)\b.{0,30}",
    r"noscript.{0,60}", r"checking your browser.{0,40}", r".{0,12}aktivieren sie (?:javascript|cookies|skripte).{0,50}", r"ohne (?:skripte|javascript) .{4,60}", r".{0,12}activer (?:javascript|les cookies).{0,50}",
    r".{0,30}exige que les scripts.{0,40}", r"active (?:javascript|las cookies).{0,50}", r".{0,30}necesita que los scripts.{0,40}",
    r"(?:tbd|todo|tba|fixme)(?: ?[-:].{0,40})?\.?", r"to be filled\.?", r".{0,20}\b(?:replace|delete) (?:this|it|me)\b.{0,40}", r"write a short paragraph .{4,40}", r"your (?:headline|title|text) here\.?", r"title of the section\.?",
    r"untitled block\.?", r"this is a sample .{4,40}", r"blindtext.{0,40}", r"hier steht später .{4,20}", r"texte provisoire.{0,40}", r"texto de relleno.{0,40}",
]
_TRUSTED = re.compile("(?:" + "|".join(TRUSTED) + r")[.!]?", re.I)
#: Words that fillers are known by.
_FILLER = re.compile(r"\blorem\b|\bdolor(?:e)? ipsum\b|\basdf\b|\bqwer\b.*\bqwer\b")

_TAG = re.compile(r"</?(?:html|body|head|title|h[1-6]|p|b|i|em|strong|div|span|br|hr|ul|ol|li|a|table|tr|td|th|pre|code|noscript|script|style|meta|link|img|main|nav|footer|header|section|article)\b[^<>]{0,200}>", re.I)
_FENCE = re.compile(r"```.*?(?:```|$)", re.S)
_CODE_LINE = re.compile(r"^\s*(?:def \w+\(.*|for \w+ in .*:.*|class \w+.*:|import \w+.*|from \w+ import .*|return .*|print\(.*|[\w.]+\s*=\s*[^=].*|\w+\(.*\);?)$")
_TICKS = re.compile(r"`[^`\n]{1,200}`")
_QUOTED = re.compile(r"(?<!\w)(?:'[^'\n]{2,120}'|\"[^\"\n]{2,120}\"|«[^»\n]{2,120}»|„[^“\n]{2,120}“|“[^”\n]{2,120}”)(?!\w)")
#: What quotes begin with; what slots have in them.
_MARKS, _BRACKETS, _OPENERS = re.compile(r"['\"«„“]"), re.compile(r"[{\[<%@_(]|XX"), re.compile(r"[{\[<]")
_HEX, _DIGITS = re.compile(r"\b(?=\w*\d)(?=\w*[a-f])[0-9a-f]{6,}\b"), re.compile(r"\d+")
_NOTE = re.compile(r"^\s*\{\"[^\n]*\}\s*$")
_SPLIT = re.compile(r"\n+|(?<=[.!?])\s+")
_SPEAKER = re.compile(r"^\s*(?:\[\w+\]|\d{1,4}[.)]|[>*•\-]+)\s+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|0+|[^\w\s]")


def _passages_of_line(line: str) -> list[str]:
    parts = [line]
    if '{"' in line and _NOTE.match(line):  # a record line: its text values are passages
        values = re.findall(r'"(?:[^"\\]|\\.)*"\s*:\s*"((?:[^"\\]|\\.)*)"', line)
        parts = [v for v in values if " " in v]
    out = []
    for part in parts:
        if _CODE_LINE.match(part) and not _SURE.search(part.split("=")[0]):
            continue
        while (m := _SPEAKER.match(part)) and m.end() < len(part):
            part = part[m.end() :]
        if "`" in part:
            part = _TICKS.sub(" code ", part)
        for s in _SPLIT.split(part):
            s = " ".join(s.split())
            while (m := _SPEAKER.match(s)) and m.end() < len(s):
                s = s[m.end() :]
            if s:
                whole = _QUOTED.sub(" quoted ", s).strip() if _MARKS.search(s) else s
                out.append(s if whole == "quoted" else " ".join(whole.split()))
    return out


def _lines_of(text: str) -> list[str]:
    t = _FENCE.sub("\n", text) if "```" in text else text
    if "<" in t:
        t = _TAG.sub("\n", t)
        for m in MASKS:
            t = t.replace(m, "mask")
    return t.split("\n")


def passages_of(text: str | None) -> list[str]:
    """The passages of a text, without code, quotes and masks, white space as single blanks."""
    return [p for line in _lines_of(text) for p in _passages_of_line(line)] if text else []


def slots_of(passage: str) -> tuple[int, int]:
    """How many sure and possible slots a passage has."""
    return len(_SURE.findall(passage)), len(_MAYBE.findall(passage))


def normal(passage: str) -> str:
    """The passage as the model reads it: lower case, digits as 0, slots as one word each."""
    p = passage
    if _BRACKETS.search(p):
        p = _SURE.sub(" surelyslot ", p)
        if _OPENERS.search(p):
            p = _MAYBE.sub(" maybeslot ", p)
    p = p.lower()
    if _DIGITS.search(p):
        p = _DIGITS.sub("0", _HEX.sub("hexid", p))
    return " ".join(p.split())


def repeats(words: list[str]) -> bool:
    """Whether one or two words make up the whole of a long passage."""
    return len(words) >= 6 and len(set(words)) <= 2


def is_trusted(key: str) -> int:
    """2 if all of a passage is what trusted patterns name, 1 if it holds a sure slot or filler, else 0."""
    words = re.findall(r"[^\W\d_]+", key)
    if _TRUSTED.fullmatch(key) or repeats(words):
        return 2
    return int("surelyslot" in key or bool(_FILLER.search(key)))


def tokens_of(key: str) -> list[str]:
    return [t for t in _TOKEN.findall(key) if t.isalpha() or t == "0" or "'" in t or t in "|<>{}[]_@%#"]


def words_and_pairs(key: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a passage's words and of its neighbouring pairs, each in order; the passage's two ends count as neighbours, so pair i ends with word i."""
    t = tokens_of(key)
    h = lambda s: zlib.crc32(s.encode()) & (FEATURES - 1)
    alike = ["slot" if w in ("surelyslot", "maybeslot") else w for w in t]  # what is said around slots does not depend on their shape
    alike = ["^", *alike, "$"] if t else []
    return np.array([h(w) for w in t], np.int64), np.array([h(f"{a} {b}") for a, b in zip(alike, alike[1:], strict=False)], np.int64)


def best_stretch(odds: np.ndarray) -> tuple[int, int]:
    """First and end of the run of words with the most evidence."""
    c = np.cumsum(np.r_[0.0, odds])
    end = int(np.argmax(c[1:] - np.minimum.accumulate(c[:-1]))) + 1
    return int(np.argmin(c[:end])), end


class Model:
    """Log odds of every feature bucket and of the class, as arrays of fixed size."""

    def __init__(self, positive: np.ndarray, negative: np.ndarray, prior: float):
        p, n = positive + SMOOTHING, negative + SMOOTHING
        self.odds = TEMPER * (np.log(p / p.sum()) - np.log(n / n.sum()))
        self.odds = self.odds.astype(np.float32)
        # buckets that no passage filled say nothing
        self.odds[(positive + negative) < 1e-9] = 0.0
        self.prior = math.log(prior) - math.log1p(-prior)

    def score(self, words: np.ndarray, pairs: np.ndarray) -> float:
        """Log odds that a passage is residue; each feature counts once."""
        return self.prior + float(self.odds[np.unique(np.r_[words, pairs])].sum()) if len(words) else -50.0

    def stretch(self, words: np.ndarray) -> float:
        """Evidence of the best stretch of STRETCH_WORDS words or more."""
        if len(words) < STRETCH_WORDS:
            return 0.0
        c = np.cumsum(np.r_[0.0, self.odds[words]])
        return float((c[STRETCH_WORDS:] - np.minimum.accumulate(c[: len(c) - STRETCH_WORDS])).max())


def passage_rows(documents: DataFrame) -> DataFrame:
    """doc_id, key, n: the distinct passages of every document as the model reads them, and how often it has each."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}  # what lines come to; lines recur
        for b in batches:
            at: list[int] = []
            keys: list[str] = []
            counts: list[int] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                seen: dict[str, int] = {}
                for line in _lines_of(t):
                    ks = known.get(line)
                    if ks is None:
                        if len(known) >= MEMO:
                            known.clear()
                        ks = known[line] = [normal(p) for p in _passages_of_line(line)]
                    for k in ks:
                        seen[k] = seen.get(k, 0) + 1
                at += [i] * len(seen)
                keys += seen
                counts += seen.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "key", "n"])

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(run, f"doc_id {kind}, key string, n long")


def passage_table(rows: DataFrame) -> DataFrame:
    """Distinct passages of the whole corpus: key, n, trusted and their feature buckets words and pairs, made once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            made = [words_and_pairs(k) for k in keys]
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(m[j]) for m in made)]), pa.int32()), pa.array(np.concatenate([*(m[j] for m in made), np.empty(0, np.int64)]).astype(np.int32))) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([is_trusted(k) for k in keys], pa.int32()), *lists], names=["key", "n", "trusted", "words", "pairs"])

    return rows.groupBy("key").agg(F.sum("n").alias("n")).mapInArrow(run, "key string, n long, trusted int, words array<int>, pairs array<int>")


def _features(b: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """words and pairs of every row, from the list columns at and at + 1."""
    off, flat = zip(*((c.offsets.to_numpy(), c.values.to_numpy().astype(np.int64)) for c in (b.column(at), b.column(at + 1))), strict=True)
    for i in range(b.num_rows):
        yield flat[0][off[0][i] : off[0][i + 1]], flat[1][off[1][i] : off[1][i + 1]]


def _totals(passages: DataFrame, model: Model | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Feature counts of both classes and their numbers of passages, under a model (None: only trusted ones are positive)."""
    sent = passages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        pos, neg = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
        for b in batches:
            for n, trusted, (words, pairs) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _features(b, 2), strict=True):
                if not len(words):
                    continue
                f, w = np.unique(np.concatenate([words, pairs])), math.sqrt(n)  # a copied passage counts more, but does not outweigh all others
                if trusted:
                    r = 1.0
                elif m is None:
                    r = 0.0
                else:
                    r = 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, m.prior + float(m.odds[f].sum())))))
                if m is not None and trusted < 2 and r > 0.01 and not (trusted and len(words) <= SHORT):
                    # residue may share its passage with ordinary words: only its best stretch is positive
                    s, e = best_stretch(m.odds[words])
                    own = np.unique(np.concatenate([words[s:e], pairs[s + 1 : max(s + 1, e)]]))
                    neg[np.setdiff1d(f, own)] += w
                    f = own
                pos[f] += r * w
                neg[f] += (1.0 - r) * w
                pos[FEATURES] += r * w
                neg[FEATURES] += (1.0 - r) * w
        at = np.flatnonzero(pos + neg)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(pos[at]), pa.array(neg[at])], names=["f", "p", "n"])

    pos, neg = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    # at most FEATURES + 1 rows come back, whatever the corpus
    for r in passages.select("n", "trusted", "words", "pairs").mapInArrow(run, "f int, p double, n double").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect():
        pos[r["f"]], neg[r["f"]] = r["p"], r["n"]
    return pos[:FEATURES], neg[:FEATURES], float(pos[FEATURES]), float(neg[FEATURES])


def fit(passages: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of a corpus's passage_table. With no trusted passage at all, everything scores as ordinary text."""
    pos, neg, p, n = _totals(passages, None)
    model = Model(pos, neg, min(0.5, max(1e-6, p / (p + n) if p + n else 1e-6)))
    if p == 0:
        model.prior = -1e6
        return model
    for _ in range(rounds):
        pos, neg, p, n = _totals(passages, model)
        model = Model(pos, neg, min(0.5, max(1e-6, p / (p + n))))
    return model


def learn(documents: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of a corpus."""
    return fit(cut(passage_table(passage_rows(documents))), rounds)


def judge_passage(model: Model, key: str, words: np.ndarray, pairs: np.ndarray) -> tuple[float, str]:
    """(log odds, what kind of residue the passage is or ''). The model alone decides, by the whole passage or by its best stretch."""
    score = model.score(words, pairs)
    if score <= THRESHOLD and model.stretch(words) >= STRETCH_ODDS:
        score = STRETCHED
    return score, ("slot" if "surelyslot" in key or "maybeslot" in key else "text") if score > THRESHOLD else ""


def judge(model: Model, text: str | None) -> tuple[float, str]:
    """(highest log odds of a passage, what kind of residue it is or '') of one text."""
    keys = [normal(p) for p in passages_of(text)]
    return max((judge_passage(model, k, *words_and_pairs(k)) for k in keys), default=(-50.0, ""))


def find_residue(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, odds and kind of every record that is residue. documents: doc_id, text; a null or empty text is none. Other columns are not read.

    Every document is split once; every distinct passage is scored once, however many documents hold it. A repeated doc_id is one record.
    """
    rows = cut(passage_rows(documents))
    passages = cut(passage_table(rows))
    sent = documents.sparkSession.sparkContext.broadcast(fit(passages) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = [judge_passage(m, k, *f) for k, f in zip(b.column(0).to_pylist(), _features(b, 1), strict=True)]
            hit = np.flatnonzero([bool(g[1]) for g in got])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit)), pa.array([got[i][0] for i in hit], pa.float64()), pa.array([got[i][1] for i in hit], pa.string())], names=["key", "odds", "kind"])

    hits = passages.select("key", "words", "pairs").mapInArrow(run, "key string, odds double, kind string")
    best = rows.select("doc_id", "key").join(hits, "key").groupBy("doc_id").agg(F.max(F.struct("odds", "kind")).alias("b"))
    return best.select("doc_id", "b.odds", "b.kind")
