"""Evaluation items that leaked into a corpus.

A distributed positional inverted index.  Every task writes the postings of the
documents it reads in segments of bounded size: a row holds a term (a word), the
segment, and the delta-coded positions of the term in it; documents follow one
another in a segment with a gap between, so a position says the document too.  A
frequent term has one row in every segment and no task ever holds its whole list.
The index is stored in the shared folder and serves any number of searches.

A search reads the rows of the terms that the items have.  The rarest pairs of
neighbouring terms of every window of an item are its anchors: the list of the rarer of both is
walked and intersected with the other one, moved by one.  Hits are put together by
offset (position in the document less position in the item); where enough anchors
agree, neighbouring terms near that offset are counted, and the passage is matched
as a phrase or, with words changed, added or dropped, by proximity.  All this needs
the postings alone; the texts are read once, for the index.

The items are a stated query set; they are taken in blocks of bounded size.
"""

import hashlib
import math
import re
from collections import defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgflow.session import empty, materialize, require

LEAST = 20  # words of an item, one after the other, that make a leak
KEPT = 0.75  # share of the words of such a passage that must be there unchanged
PAIRS = 10  # neighbouring words of the item that must be neighbours in the passage as well, within
WITHIN = 32  # words
RAREST = 6  # pairs of every window of ``LEAST`` words of an item that are its anchors
AGREE = 2  # anchors that must agree on an offset
DRIFT = 16  # words that offsets may differ by within one passage
ITEM_GAP, TEXT_GAP = 6, 14  # longest stretch of changed words of the item, and of inserted ones in the text
SEEN = 16  # matched words about the anchors without which no passage around them can have ``LEAST``
SKIP, INSERT = 0.6, 0.25  # costs of a word of the item that is missing, and of one of the text that is added
OPENING = 5  # least words of a standing instruction
SHARED = 3  # items that must open with it
BLOCK_WORDS = 1_000_000  # words of items in one block
SEGMENT = 400_000  # words from which a segment is closed
APART = 64  # positions between two documents

WORD = re.compile(r"[^\W_]+")
RESULT = "item_id {item}, kind string, matched int, first_word int, last_word int"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


# --- index -----------------------------------------------------------------------------


def encode(terms: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray]:
    """Postings of every term: delta-coded positions, seven bits a byte, and how many there are.

    ``terms`` holds the term (0 to ``size`` - 1) of every position, or -1.
    """
    at = np.flatnonzero(terms >= 0)
    order = at[np.argsort(terms[at], kind="stable")]
    n = np.bincount(terms[at], minlength=size)
    ends = np.cumsum(n)
    delta = np.diff(order, prepend=0)
    delta[(ends - n)[n > 0]] = order[(ends - n)[n > 0]]
    length = 1 + (delta >= 1 << 7).astype(np.int8) + (delta >= 1 << 14) + (delta >= 1 << 21) + (delta >= 1 << 28)
    stop = np.cumsum(length, dtype=np.int64)
    start = stop - length
    raw = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    for k in range(5):
        here = length > k
        raw[start[here] + k] = (delta[here] >> (7 * k)) & 0x7F | np.where(length[here] > k + 1, 0x80, 0)
    data = raw.tobytes()
    bounds = np.concatenate(([0], stop))[np.concatenate(([0], ends))].tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])], n


def decode(parts: list[bytes], n: np.ndarray) -> np.ndarray:
    """Positions of all lists, one after the other."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    stop = np.flatnonzero(raw < 0x80)
    start = np.concatenate(([0], stop[:-1] + 1))
    delta = np.zeros(len(stop), np.int64)
    for k in range(5):
        here = start + k <= stop
        delta[here] |= (raw[start[here] + k].astype(np.int64) & 0x7F) << (7 * k)
    sums = np.cumsum(delta)
    n = n[n > 0]
    first = np.cumsum(n) - n
    base = sums[first] - delta[first]
    return sums - np.repeat(base, n)


class Segment:
    """Documents of a task until the segment is closed."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.starts: list[int] = []
        self.keys: list = []
        self.size = 0

    def add(self, key, ws: list[str]) -> None:
        known = self.known
        self.keys.append(key)
        self.starts.append(self.size)
        self.ids.append([known.setdefault(w, len(known)) for w in ws])
        self.size += len(ws) + APART

    def postings(self) -> tuple[list[str], list[bytes], np.ndarray]:
        terms = np.full(self.size, -1, np.int32)
        for a, ids in zip(self.starts, self.ids):
            terms[a : a + len(ids)] = ids
        parts, n = encode(terms, len(self.known))
        return list(self.known), parts, n


def build_index(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings ``segment, term, n, postings`` of a corpus; the row of a segment without a term holds ``docs`` and their first positions.

    NULL and empty texts have no postings.  The rows of a segment follow one another in one partition.
    """
    require(corpus, key, text)
    kind = corpus.schema[key].dataType.simpleString()
    schema = f"segment long, term string, n int, postings binary, docs array<{kind}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = Segment(), TaskContext.get().partitionId() << 32
        doc_type = None

        def rows() -> pa.RecordBatch:
            terms, parts, n = own.postings()
            starts = np.array(own.starts, np.int64).astype("<i8").tobytes()
            docs = pa.array([own.keys, *([None] * len(terms))], pa.list_(doc_type))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(terms) + 1, number)), pa.array([None, *terms], pa.string()), pa.array(np.concatenate(([len(own.keys)], n)), pa.int32()), pa.array([starts, *parts], pa.binary()), docs],
                names=["segment", "term", "n", "postings", "docs"],
            )

        for b in batches:
            doc_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t) if t else ()
                if ws:
                    own.add(k, ws)
                    if own.size >= SEGMENT:
                        yield rows()
                        own, number = Segment(), number + 1
        if own.keys:
            yield rows()

    return materialize(corpus.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema))


# --- items -----------------------------------------------------------------------------


def instruction_lengths(items: DataFrame) -> DataFrame:
    """``i, t, skip``: words of the standing instruction that each item opens with: the longest opening shared by ``SHARED`` items.

    Openings of any length are compared over all items, by running hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, length, digest = [], [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = hashlib.blake2b(digest_size=16)
                for n, w in enumerate(words(t), 1):
                    h.update(w.encode("utf-8", "surrogatepass") + b" ")
                    if n >= OPENING:
                        row.append(r)
                        length.append(n)
                        digest.append(h.copy().digest())
            yield pa.RecordBatch.from_pydict({"r": pa.array(row, pa.binary()), "n": pa.array(length, pa.int32()), "h": pa.array(digest, pa.binary())})

    held = items.withColumn("r", F.unhex(F.md5(F.concat_ws("\x00", F.col("i").cast("string"), F.col("t")))))
    opens = held.select("r", "t").mapInArrow(run, "r binary, n int, h binary")
    shared = opens.groupBy("n", "h").agg(F.count("*").alias("c")).filter(F.col("c") >= SHARED).select("n", "h")
    longest = opens.join(shared, ["n", "h"]).groupBy("r").agg(F.max("n").alias("skip"))
    return held.join(longest, "r", "left").select("i", "t", F.coalesce("skip", F.lit(0)).alias("skip"))


def choose_anchors(counts: list[list[int]], rarest: int | None = RAREST) -> list[tuple[int, int]]:
    """``(item, position)`` of the ``rarest`` pairs of every window of ``LEAST`` words of every item, from how often the corpus has each pair of it; None takes all.

    A pair that the corpus doesn't hold can't be matched and is passed over.
    """
    out = []
    for k, own in enumerate(counts):
        held = [(n, i) for i, n in enumerate(own) if n]
        chosen: set[int] = set() if rarest else {i for _, i in held}
        a = 0
        for first in range(len(own) - LEAST + 2) if rarest else ():
            while a < len(held) and held[a][1] < first:
                a += 1
            b = a
            while b < len(held) and held[b][1] < first + LEAST - 1:
                b += 1
            chosen.update(i for _, i in sorted(held[a:b])[:rarest])
        out += [(k, i) for i in sorted(chosen)]
    return out


def positions(item: list) -> dict:
    at = defaultdict(list)
    for i, w in enumerate(item):
        at[w].append(i)
    return dict(at)


def align(text: list[int], at: dict[int, list[int]], offset: int, low: int, high: int) -> tuple[float, int, int, int]:
    """Best local alignment near a diagonal between positions ``low`` and ``high`` of the text.

    Returns ``(score, words matched, first, last word of the item)``; a match counts
    one, missing and added words cost ``SKIP`` and ``INSERT`` each.
    """
    recent: list[tuple[int, int, float, int, int]] = []  # position in text, in item, score, matched, first
    best = (0.0, 0, 0, -1)
    for d in range(max(0, low), min(high, len(text))):
        here = at.get(text[d])
        if not here:
            continue
        for i in here:
            if abs(d - i - offset) > DRIFT:
                continue
            top, matched, first = 1.0, 1, i
            for d2, i2, s2, m2, f2 in reversed(recent):
                if d - d2 > TEXT_GAP:
                    break
                if d2 < d and 0 < i - i2 <= ITEM_GAP:
                    s = s2 + 1.0 - SKIP * (i - i2 - 1) - INSERT * (d - d2 - 1)
                    if s > top:
                        top, matched, first = s, m2 + 1, f2
            recent.append((d, i, top, matched, first))
            if top > best[0]:
                best = (top, matched, first, i)
    return best


class Search:
    """Items of a block, ready to be looked up in segments.

    ``words`` counts the terms in the corpus, ``pairs`` the pairs of neighbours by code; without the latter every pair is an anchor.
    """

    def __init__(self, items: list[list[str]], words: dict[str, int], pairs: dict[int, int] | None = None, rarest: int | None = RAREST, agree: int = AGREE):
        self.items, self.agree = items, agree
        self.terms = {t: k for k, t in enumerate(sorted({w for ws in items for w in ws}))}
        self.names = list(self.terms)
        n = np.array([words.get(t, 0) for t in self.terms] or [0], np.int64)
        self.size = len(n)
        coded = [np.array([self.terms[w] for w in ws], np.int64) for ws in items]
        self.starts = np.concatenate(([0], np.cumsum([len(ws) + 1 for ws in items])))  # a -2 after each item
        self.flat = np.concatenate([np.append(c, -2) for c in coded]) if items else np.empty(0, np.int64)
        codes = [c[:-1] * self.size + c[1:] for c in coded]
        at = choose_anchors([[1 if pairs is None else pairs.get(x, 0) for x in c.tolist()] for c in codes], rarest if pairs is not None else None)
        item, i = np.array(at, np.int64).reshape(-1, 2).T
        code = self.flat[self.starts[item] + i] * self.size + self.flat[self.starts[item] + i + 1]
        order = np.argsort(code, kind="stable")
        self.code, self.begin, self.many = np.unique(code[order], return_index=True, return_counts=True)
        self.item, self.i = item[order], i[order]
        rarer = n[self.code // self.size] <= n[self.code % self.size]  # the list that is walked: of the first or of the second word
        self.walked = [np.zeros(self.size, bool), np.zeros(self.size, bool)]
        self.walked[0][self.code[rarer] // self.size] = True
        self.walked[1][self.code[~rarer] % self.size] = True
        self.at = [positions(c.tolist()) for c in coded]

    def read(self, parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and terms of all lists of a segment, from ``(term, n, postings)``, and the term at every position."""
        n = np.array([x[1] for x in parts], np.int64)
        lists = decode([x[2] for x in parts], n)
        terms = np.repeat(np.array([x[0] for x in parts], np.int64), n)
        filled = np.full(int(lists.max()) + 2, -1, np.int32)
        filled[lists] = terms
        return lists, terms, filled

    def pairs(self, lists: np.ndarray, terms: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors' pairs, and which: the lists of the rarer terms are walked and intersected with those of the others, moved by one."""
        found = []
        for side in (0, 1):
            p = lists[self.walked[side][terms]] - side
            p = p[p >= 0]
            a, b = filled[p].astype(np.int64), filled[p + 1].astype(np.int64)
            live = (a >= 0) & (b >= 0)
            p, code = p[live], (a * self.size + b)[live]
            if len(self.code):
                at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
                same = self.code[at] == code
                found.append((p[same], at[same]))
        if not found:
            return (np.empty(0, np.int64),) * 2
        p, keep = np.unique(np.concatenate([f[0] for f in found]), return_index=True)  # a pair may be walked from both sides
        return p, np.concatenate([f[1] for f in found])[keep]

    def hits(self, lists: np.ndarray, terms: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``item, position in the item, position in the segment`` of every anchor, ordered by item and position."""
        p, at = self.pairs(lists, terms, filled)
        many = self.many[at]
        each = np.repeat(self.begin[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, i, p = self.item[each], self.i[each], np.repeat(p, many)
        order = np.lexsort((i, p, item))
        return item[order], i[order], p[order]

    def agreeing(self, item: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Hits that ``agree`` anchors in the length of a passage confirm, itself included, on about the same offset."""
        offset = p - i
        n = np.ones(len(p), np.int32)
        lag = 1
        while lag < len(p):
            near = (item[lag:] == item[:-lag]) & (p[lag:] - p[:-lag] <= LEAST + DRIFT)
            if not near.any():
                break
            same = near & (np.abs(offset[lag:] - offset[:-lag]) <= DRIFT // 2) & (p[lag:] > p[:-lag])
            n[lag:] += same
            n[:-lag] += same
            lag += 1
        return np.flatnonzero(n >= self.agree)

    def neighbours(self, item: np.ndarray, offset: np.ndarray, low: np.ndarray, high: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """Most pairs of neighbouring words, in ``WITHIN`` words of ``[low, high)``, that stand in the item near the offset."""
        most, recent = np.zeros(len(item), np.int32), []
        n = np.zeros(len(item), np.int32)
        for step in range(int((high - low).max()) if len(item) else 0):
            p = low + step
            live = p < np.minimum(high, len(filled) - 1)
            a, b = filled[np.minimum(p, len(filled) - 2)], filled[np.minimum(p + 1, len(filled) - 1)]
            here = np.flatnonzero(live & (a >= 0) & (b >= 0))
            at = p[here] - offset[here]
            begin, end = self.starts[item[here]], self.starts[item[here] + 1] - 1
            a, b = a[here], b[here]
            hit = np.zeros(len(here), bool)
            for drift in range(-(DRIFT // 2), DRIFT // 2 + 1):
                j = begin + at - drift
                j = np.where((j >= begin) & (j < end), j, end)  # the end holds -2
                same = np.flatnonzero(self.flat[j] == a)
                hit[same[self.flat[j[same] + 1] == b[same]]] = True
            new = np.zeros(len(item), bool)
            new[here[hit]] = True
            recent.append(new)
            n += new
            if len(recent) > WITHIN:
                n -= recent.pop(0)
            np.maximum(most, n, out=most)
        return most

    def look_up(self, parts: list[tuple[int, int, bytes]], starts: np.ndarray) -> list[tuple[int, int, str, int, int, int]]:
        """``(document, item, kind, words matched, first, last word of the item)`` in one segment, from ``(term, n, postings)``."""
        if not parts:
            return []
        lists, terms, filled = self.read(parts)
        item, i, p = self.hits(lists, terms, filled)
        good = self.agreeing(item, i, p)
        item, i, p = item[good], i[good], p[good]
        if not len(p):
            return []
        offset = p - i
        cut = (np.diff(item) != 0) | (np.diff(p) > LEAST) | (np.abs(np.diff(offset)) > DRIFT // 2)
        first = np.concatenate(([0], np.flatnonzero(cut) + 1))
        last = np.concatenate((first[1:], [len(p)])) - 1
        item, offset, low, high = item[first], offset[first], p[first], p[last]
        doc = np.searchsorted(starts, low, side="right") - 1
        begin, end = starts[doc], np.append(starts[1:] - APART, len(filled))[doc]
        enough = self.neighbours(item, offset, np.maximum(begin, low - LEAST - DRIFT // 2), np.minimum(end, high + LEAST + DRIFT // 2), filled) >= PAIRS
        best: dict[tuple[int, int], tuple] = {}
        done: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        texts: dict[int, list[int]] = {}
        for k, o, lo, hi, d, a, b in zip(*(x[enough].tolist() for x in (item, offset, low, high, doc, begin, end))):
            if any(abs(o - o2) <= DRIFT // 2 and lo2 <= lo and hi < hi2 for o2, lo2, hi2 in done[k, d]):
                continue  # the alignment before went past here, in the same band
            size = len(self.items[k])
            if d not in texts:
                texts[d] = filled[a:b].tolist()
            a2, b2 = max(a, lo - LEAST - DRIFT), min(b, hi + LEAST + DRIFT + 1)
            if align(texts[d], self.at[k], o - a, a2 - a, b2 - a)[1] < SEEN:
                continue
            a2, b2 = max(a, lo - size), min(b, hi + size + 1)
            score, matched, one, other = align(texts[d], self.at[k], o - a, a2 - a, b2 - a)
            done[k, d].append((o, a2, b2))
            span = other - one + 1
            if matched >= LEAST and matched >= KEPT * span and ((k, d) not in best or matched > best[k, d][3]):
                best[k, d] = (d, k, "phrase" if matched == span == score else "proximity", matched, one, other)
        return list(best.values())


def _segments(batches: Iterator[pa.RecordBatch], terms: dict[str, int]) -> Iterator[tuple[list[tuple[int, int, bytes]], np.ndarray, pa.Scalar]]:
    """``(term, n, postings)`` of every segment, the first positions of its documents, and these."""
    segment, parts, starts, docs = None, [], None, None
    for b in batches:
        for r, (g, t, n, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
            if g != segment:
                if parts:
                    yield parts, starts, docs
                segment, parts, starts, docs = g, [], None, None
            if t is None:
                starts, docs = np.frombuffer(raw, "<i8"), b.column(4)[r]
            else:
                parts.append((terms[t], n, raw))
    if parts:
        yield parts, starts, docs


def _pair_counts(kept: DataFrame, share) -> dict[int, int]:
    """How often the corpus has each pair of neighbouring words of the items, by code; from the postings, counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Search(*share.value)
        total = np.zeros(len(own.code), np.int64)
        for parts, _, _ in _segments(batches, own.terms):
            total += np.bincount(own.pairs(*own.read(parts))[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(own.code[total > 0]), pa.array(total[total > 0])], names=["code", "n"])

    rows = kept.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {r["code"]: r["n"] for r in rows}


def search(index: DataFrame, block: list[tuple[object, list[str]]], schema: str, key: str, rarest: int | None = RAREST, agree: int = AGREE) -> DataFrame:
    """Rows of the items of one block in the stored index; only the rows of their terms are read."""
    spark = index.sparkSession
    items = [ws for _, ws in block]
    vocabulary = spark.createDataFrame([(t,) for t in sorted({w for ws in items for w in ws})], "term string")
    kept = index.join(F.broadcast(vocabulary.withColumn("_m", F.lit(True))), "term", "left").filter(F.col("_m") | F.col("term").isNull()).select("segment", "term", "n", "postings", "docs")
    counts = {r["term"]: r["n"] for r in kept.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    pairs = _pair_counts(kept, spark.sparkContext.broadcast((items, counts)))
    share = spark.sparkContext.broadcast(([i for i, _ in block], items, counts, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *rest = share.value
        own = Search(*rest, rarest, agree)
        for parts, starts, docs in _segments(batches, own.terms):
            found = own.look_up(parts, starts)
            if found:
                cols = [docs.values.take(pa.array([f[0] for f in found])), pa.array([ids[f[1]] for f in found]), pa.array([f[2] for f in found]), *(pa.array([f[c] for f in found], pa.int32()) for c in (3, 4, 5))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "item_id", "kind", "matched", "first_word", "last_word"])

    return kept.mapInArrow(run, schema)


def find_leaks(corpus: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, rarest: int | None = RAREST, agree: int = AGREE) -> DataFrame:
    """One row per document and item that leaked into it.

    Result: ``key, item_id, kind, matched, first_word, last_word``; ``kind`` is ``phrase``
    (word for word) or ``proximity``; words are those of the item without its standing
    instruction.  A passage has at least ``LEAST`` matched words of the item, ``KEPT`` of its
    span, and ``PAIRS`` pairs of neighbours that are neighbours in both.  NULL and empty texts hold
    nothing; items of fewer than ``LEAST`` words can't leak; an empty corpus or item table gives no
    rows; repeated documents are found each time, an item id that occurs twice counts with each of
    its texts.  The blocks don't change the result.  ``rarest`` None takes every pair of an item for an anchor, and
    ``agree`` 1 leaves no hit out: so the loss by pruning can be measured.
    """
    require(corpus, key, text)
    require(items, item_key, item_text)
    spark = corpus.sparkSession
    kinds = {k: f.schema[c].dataType.simpleString() for k, f, c in (("key", corpus, key), ("item", items, item_key))}
    schema = f"`{key}` {kinds['key']}, " + RESULT.format(item=kinds["item"])
    query = items.select(F.col(item_key).alias("i"), F.col(item_text).cast("string").alias("t")).filter(F.col("t").isNotNull() & F.col("i").isNotNull()).distinct()
    query = materialize(instruction_lengths(query))
    total = query.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    index = build_index(corpus, key, text)
    out = empty(spark, schema)
    for block in range(blocks):
        rows = query.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        live = [(r["i"], ws) for r in rows if len(ws := words(r["t"])[r["skip"] :]) >= LEAST]
        if live:
            out = out.unionByName(search(index, live, schema, key, rarest, agree))
    return out
