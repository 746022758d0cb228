"""Evaluation texts inside a training corpus, found by pigeonhole pieces and Myers' bit-parallel distance.

An item leaks into a document if the document holds LEAST consecutive words of it with at most BUDGET of
them changed, dropped or put in between. Cut such a window into BUDGET + 1 pieces and one of them is there
exactly; so every window's pieces are looked up in the document's words, and wherever one is found the
windows around it are verified with the bit-parallel edit distance, all windows at once.

The items are a stated query set: the pieces of a block of them, of fixed size, are sent to every task, and the
corpus is scanned once for each block, in place, without a shuffle. Words that several items have in common are no pieces
and part of no window, whatever block the items are in.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.runtime import cut

#: Words in a window, and the edits it may hold: about one word in ten.
LEAST, BUDGET = 20, 2
#: Runs of at least this many words that two items have in common do not count; shorter ones are chance.
COMMON = 16
#: Items that are sent to every task at a time; windows verified side by side; documents searched at a time.
BLOCK, LANES, DOCUMENTS = 20_000, 1 << 16, 2_000

_ESCAPES = {"n": "\n", "t": " ", "r": "\n", "b": " ", "f": " ", '"': '"', "'": "'", "/": "/", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([ntrbf\"'/\\]))")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->", re.S)
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2028-\u202e\u2060\ufeff]")
#: What may stand before a line: quote marks, speakers, times, numbers and bullets.
_PREFIX = re.compile(r"^[ \t]*(?:(?:>+|\[[^\]\n]{1,48}\]|\(?\d{1,5}[.):|]|\d{1,2}:\d{2}(?::\d{2})?|[|#*+\-\u2022]+|//+|--+)[ \t]*)+", re.M)
_BROKEN = re.compile(r"(?<=\w)-\n[ \t]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, whatever its letter case, punctuation, white space, escapes, markup and line prefixes."""
    if not text:
        return []
    t = _INVISIBLE.sub("", text)
    if "\\" in t:
        t = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES[m[3]], t)
    if "%" in t:
        t = _PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), t)
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    t = unicodedata.normalize("NFKC", t)
    t = _BROKEN.sub("", t)
    t = _PREFIX.sub("", t)
    return _WORD.findall(t.lower())


def pieces(least: int = LEAST, budget: int = BUDGET) -> int:
    """Words in the shortest of a window's budget + 1 pieces."""
    return least // (budget + 1)


def common_words(items: dict[int, list[str]], length: int = COMMON) -> dict[int, np.ndarray]:
    """For each item which of its words lie in a run of at least length words that another item has too."""
    seen: dict[tuple, set[int]] = defaultdict(set)
    for i, w in items.items():
        for p in range(len(w) - length + 1):
            seen[tuple(w[p : p + length])].add(i)
    out = {}
    for i, w in items.items():
        mask = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            if len(seen[tuple(w[p : p + length])]) > 1:
                mask[p : p + length] = True
        out[i] = mask
    return out


def myers(patterns: np.ndarray, texts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Smallest edit distance of each pattern to any stretch of its text that ends with the pattern's last word (a large number if none does).

    patterns: (windows, words) of word numbers, at most 63 words; texts: (texts, words), padded with -1; of: the row of texts
    of each pattern. One step a text word, all windows of all texts side by side in 64-bit words.
    """
    n, m = patterns.shape
    wide = np.full((n, next(w for w in (8, 16, 32, 64) if w >= m)), -2, np.int32)
    wide[:, :m] = patterns
    kind = {8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}[wide.shape[1]]
    one, top = np.uint64(1), np.uint64(m - 1)
    pv, mv = np.full(n, (1 << m) - 1, np.uint64), np.zeros(n, np.uint64)
    score, best = np.full(n, m, np.int64), np.full(n, 1 << 30, np.int64)
    last = patterns[:, -1]
    for t in range(texts.shape[1]):
        c = texts[of, t]
        eq = np.packbits(wide == c[:, None], axis=1, bitorder="little").view(kind)[:, 0].astype(np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best, where=last == c)
    return best


class Matcher:
    """The pieces of a block of items, ready to be looked up in batches of documents.

    shared: for each item which of its words other items have too; by default it is found among texts alone. Windows that other items
    hold as well are taken out by drop_rivals.
    """

    def __init__(self, texts: dict[int, str], least: int = LEAST, budget: int = BUDGET, common: int = COMMON, shared: dict[int, np.ndarray] | None = None):
        self.least, self.budget, self.piece = least, budget, pieces(least, budget)
        # an edit spoils at most ``piece`` of a window's pieces, so a window within the budget has at least this many left
        self.need = max(1, least - self.piece + 1 - budget * self.piece)
        split = {i: words_of(t) for i, t in texts.items()}
        shared = common_words(split, common) if shared is None else shared
        self.vocabulary: dict[str, int] = {}
        for w in split.values():
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.items = list(split)
        words = [np.array([self.vocabulary[x] for x in split[i]], np.int64) for i in self.items]
        self.offset = np.cumsum([0, *map(len, words)])
        self.flat = np.concatenate([*words, np.empty(0, np.int64)])
        # windows lie within stretches that no other item shares
        self.windows: list[np.ndarray] = []
        keys, owners, places = [], [], []
        for k, (i, w) in enumerate(zip(self.items, words, strict=True)):
            run = np.cumsum(np.r_[0, ~shared[i]])
            starts = np.flatnonzero(run[least:] - run[:-least] == least) if len(w) >= least else np.empty(0, np.int64)
            self.windows.append(starts)
            inside = np.zeros(len(w) + 1, np.int64)
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + least, -1)
            held = np.cumsum(np.r_[0, np.cumsum(inside)[:-1] > 0])
            at = np.flatnonzero(held[self.piece :] - held[: -self.piece] == self.piece) if len(w) >= self.piece else np.empty(0, np.int64)
            keys.append(self._hash(w)[at]), owners.append(np.full(len(at), k)), places.append(at)
        key, owner, place = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (keys, owners, places))
        order = np.lexsort((place, owner, key))
        self.key, self.owner, self.place = key[order], owner[order], place[order]

    def _hash(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.piece + 1
        if n <= 0:
            return np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for k in range(self.piece):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[k : k + n].astype(np.uint64) + np.uint64(1))
            h ^= h >> np.uint64(29)
        return h.astype(np.int64)

    def drop_rivals(self, hits: Iterable[tuple[int, int, dict[int, int]]]) -> Matcher:
        """Without the windows that another item holds as well, with as many edits: they tell nothing. hits: (item that holds, item, its windows)."""
        at = {i: k for k, i in enumerate(self.items)}
        for holder, item, windows in hits:
            if holder != item:
                self.windows[at[item]] = np.setdiff1d(self.windows[at[item]], np.array(list(windows), np.int64))
        return self

    def search(self, texts: list[str | None]) -> list[tuple[int, int, dict[int, int]]]:
        """(place of the text, item, window's first word: edits) of every text and item with a window within the budget."""
        known, docs, at = self.vocabulary, [], []
        for i, t in enumerate(texts):
            ids = [known.get(w, 0) for w in words_of(t)]
            if len(ids) >= self.piece:
                docs.append(ids), at.append(i)
        if not docs or not len(self.key):
            return []
        # all texts one after another, a word that no item has between them
        length = np.array([len(d) + 1 for d in docs])
        begin = np.cumsum(length) - length
        ids = np.fromiter((x for d in docs for x in (*d, 0)), np.int64, int(length.sum()))
        # only stretches of the items' own words are long enough for a piece
        own = np.cumsum(np.r_[0, ids > 0])
        spots = np.flatnonzero(own[self.piece :] - own[: -self.piece] == self.piece)
        h = self._hash(ids)[spots]
        low, high = np.searchsorted(self.key, h), np.searchsorted(self.key, h, side="right")
        n = high - low
        spots, low, n = spots[n > 0], low[n > 0], n[n > 0]
        if not len(spots):
            return []
        row = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        p, owner, q = np.repeat(spots, n), self.owner[row], self.place[row]
        span = np.arange(self.piece)
        same = (ids[p[:, None] + span] == self.flat[(self.offset[owner] + q)[:, None] + span]).all(1)
        p, owner, q = p[same], owner[same], q[same]
        doc = np.searchsorted(begin, p, side="right") - 1
        order = np.lexsort((q, p, owner, doc))
        p, owner, q, doc = p[order], owner[order], q[order], doc[order]
        # hits near one another in the text are verified together: the windows around them against the text around them
        reach = self.least + self.budget
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (p[1:] - p[:-1] > reach)]) if len(p) else np.empty(0, np.int64)
        jobs: list[tuple[int, int, np.ndarray, int, int]] = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(p)], strict=True):
            k, d = int(owner[a]), int(doc[a])
            starts, qs = self.windows[k], np.unique(q[a:b])
            held = np.searchsorted(qs, starts + self.least - self.piece, side="right") - np.searchsorted(qs, starts)
            use = starts[held >= self.need]
            if len(use):
                jobs.append((d, k, use, max(int(begin[d]), int(p[a]) - reach), min(int(begin[d] + length[d]) - 1, int(p[b - 1]) + self.piece + reach)))
        jobs.sort(key=lambda j: j[4] - j[3])
        found: dict[tuple[int, int], dict[int, int]] = {}
        part: list[tuple[int, int, np.ndarray, int, int]] = []
        lanes = 0
        for job in [*jobs, None]:
            if part and (job is None or lanes + len(job[2]) > LANES):
                self._verify(part, ids, found)
                part, lanes = [], 0
            if job is not None:
                part.append(job)
                lanes += len(job[2])
        return [(at[d], self.items[k], best) for (d, k), best in found.items()]

    def _verify(self, jobs: list[tuple[int, int, np.ndarray, int, int]], ids: np.ndarray, found: dict[tuple[int, int], dict[int, int]]) -> None:
        texts = np.full((len(jobs), max(j[4] - j[3] for j in jobs)), -1, np.int32)
        for i, (_, _, _, a, b) in enumerate(jobs):
            texts[i, : b - a] = ids[a:b]
        first = np.concatenate([self.offset[j[1]] + j[2] for j in jobs])
        of = np.repeat(np.arange(len(jobs)), [len(j[2]) for j in jobs])
        edits = myers(self.flat[first[:, None] + np.arange(self.least)], texts, of)
        for i in np.flatnonzero(edits <= self.budget).tolist():
            d, k = jobs[of[i]][:2]
            best = found.setdefault((d, k), {})
            start, e = int(first[i] - self.offset[k]), int(edits[i])
            best[start] = min(e, best.get(start, e))

    def leaks(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, matching windows, fewest edits) of every item that leaks into a text."""
        return [(item, len(best), min(best.values())) for _, item, best in self.search([text])]


def _shared_words(items: DataFrame, length: int) -> DataFrame:
    """item_id and starts: first words of the runs of length words that another item has too, over all items."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p, hashlib.blake2b("\0".join(w[p : p + length]).encode(), digest_size=16).digest()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in [words_of(t)] for p in range(len(w) - length + 1)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["item_id", "at", "gram"])

    g = items.mapInArrow(grams, "item_id long, at int, gram binary")
    several = g.groupBy("gram").agg((F.min("item_id") < F.max("item_id")).alias("several")).where("several").select("gram")
    return g.join(several, "gram", "left_semi").groupBy("item_id").agg(F.collect_list("at").alias("starts"))


def matchers(items: DataFrame, least: int = LEAST, budget: int = BUDGET, common: int = COMMON, block: int = BLOCK) -> Iterator[Matcher]:
    """One matcher for each block of items (item_id, text: distinct ids). What several items have in common is judged over all items, whatever the block."""
    rows = sorted(items.select("item_id", "text", F.length("text").alias("n")).limit(block + 1).collect())
    if len(rows) <= block:
        m = Matcher({r[0]: r[1] for r in rows}, least, budget, common)
        yield m.drop_rivals((m.items[i], item, w) for i, item, w in m.search([r[1] for r in rows]))
        return
    spark = items.sparkSession
    items = cut(items.select("item_id", "text"))
    starts = cut(_shared_words(items, common))
    blocks = -(-items.count() // block)
    for k in range(2 * blocks):  # hash blocks of about half the size
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(2 * blocks)) == k)
        texts = {r[0]: r[1] for r in part.collect()}
        runs = {r[0]: r[1] for r in starts.join(part.select("item_id"), "item_id", "left_semi").collect()}
        shared = {}
        for i, t in texts.items():
            shared[i] = np.zeros(len(words_of(t)), bool)
            for p in runs.get(i, ()):
                shared[i][p : p + common] = True
        m = Matcher(texts, least, budget, common, shared)
        sent = spark.sparkContext.broadcast(m)

        def rivals(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.column(0).to_pylist()
                hits = [(names[i], item, s) for i, item, w in sent.value.search(b.column(1).to_pylist()) if names[i] != item for s in w]
                yield pa.RecordBatch.from_arrays([pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32())], names=["item", "start"])

        # at most the windows of the block come back
        yield m.drop_rivals((None, r["item"], {r["start"]: 0}) for r in items.mapInArrow(rivals, "item long, start int").distinct().collect())


def find_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, budget: int = BUDGET, common: int = COMMON, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, windows (how many of the item's windows match) and edits (the fewest in a window).

    documents: doc_id, text; items: item_id, text, a query set of any size: every block of items is sent to all tasks and scans
    the corpus once, in place. Null and empty texts hold nothing. A repeated item_id is read as one text, the smallest. A window counts where
    it ends with its own last word. Extra columns are not read.
    """
    queries = items.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    spark, found = documents.sparkSession, None
    corpus = documents.select("doc_id", "text").where("text is not null")
    for matcher in matchers(queries, least, budget, common, block):
        sent = spark.sparkContext.broadcast(matcher)  # its size is bounded by block

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in range(0, b.num_rows, DOCUMENTS):
                    part = b.slice(start, DOCUMENTS)
                    rows = [(i, item, len(w), min(w.values())) for i, item, w in sent.value.search(part.column(1).to_pylist())]
                    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int32(), pa.int32()), strict=True))], names=["doc_id", "item_id", "windows", "edits"])

        kind = dict(documents.dtypes)["doc_id"]
        one = corpus.mapInArrow(run, f"doc_id {kind}, item_id long, windows int, edits int")
        found = one if found is None else found.unionByName(one)
    return found
