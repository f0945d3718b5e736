"""Text decoded with the wrong character encoding: found and put right.

Adjacent character pairs are scored by their mutual information in the corpus;
maximum-scoring segments of improbable pairs are isolated, and inverse mappings
(encode as it was read, decode as it was meant) are tried inside those runs only.

The mutual information is taken over all documents except those that show a plain
mark of a wrong encoding (``SUSPECT``): a garbled sequence that recurs often would
otherwise look like a habit of the language.  Such documents are examined like all
others; they only don't teach.
"""

import math
import re
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgflow.session import materialize, require

# Encodings in which text may have been read or meant.
SINGLE_BYTE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r", "cp866", "iso8859-2")
SKIPPED = {("cp1252", "latin-1"), ("latin-1", "cp1252"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250")}

CHAR_PRIOR = 5e-4  # share added to that of every character, so that rare ones aren't trusted
PAIR_PRIOR = 2e-8  # share added to that of every pair
TYPICAL = 2.0  # mutual information is held against this: pairs below it are improbable
MOST = 8.0  # most that one pair can speak for a run
LEAST_RUN = 1.5  # total of a run that is looked into
GAIN = 4.0  # least drop of a run's total for a mapping between single-byte encodings
REMEMBERED = 100_000
ROUNDS = 3  # text may have been garbled more than once
LONE = 1e-5  # a lone character that is no rarer than this is not put down to a wrong single-byte encoding

C1 = re.compile("[\x80-\x84\x86-\x9f]")
LOST = "�"
UNMEANT = re.compile("[\ufffd\x80-\x84\x86-\x9f]")


def _byte_table(encoding: str) -> list[str]:
    """Character of every byte; bytes without one stand for the control character of the same number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


TABLES = {e: _byte_table(e) for e in SINGLE_BYTE}
TO_BYTE = {e: {c: b for b, c in reversed(list(enumerate(t)))} for e, t in TABLES.items()}


def _class(encoding: str, low: int, high: int) -> str:
    return "[" + "".join(re.escape(TABLES[encoding][b]) for b in range(low, high + 1)) + "]"


def _utf8_shapes(e: str) -> list[str]:
    """What follows the first character of multi-byte UTF-8 sequences read in encoding ``e``.

    Latin letters and punctuation count when there is one, Cyrillic ones from two on.
    """
    tail = _class(e, 0x80, 0xBF)
    box = e in ("cp437", "cp850")  # the lead 0xC4 is a horizontal line there, as tables have it
    lead = "[" + re.escape("".join(TABLES[e][x] for x in (0xC2, 0xC3, 0xC5, *(() if box else (0xC4,))))) + "]"
    shapes = [f"(?<={lead}){tail}", f"(?<={re.escape(TABLES[e][0xE2])}){tail}{tail}", f"(?<={_class(e, 0xD0, 0xD1)}){tail}{_class(e, 0xD0, 0xD1)}{tail}"]
    return [*shapes, f"(?<={re.escape(TABLES[e][0xC4])}){_class(e, 0x80, 0xAF)}"] if box else shapes


_LOWER = "a-zß-öø-ÿąćęłńśźżăľĺş"
#: One character outside ASCII, and what makes it suspect.
SUSPECT = re.compile(
    "[^\x00-\x7f](?:"
    + "|".join(
        [
            "(?<=[\x80-\x84\x86-\x9f\ufffd])",
            *(x for e in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250") for x in _utf8_shapes(e)),
            "(?<=[РС])[\u0080-¿Ђ-џҐґ‘-›€№][РС][\u0080-¿Ђ-џҐґ‘-›€№]",
            "(?<=[À-ÖØ-ÿ])[À-ÖØ-ÿ]{3}",
            f"(?<=[{_LOWER}][^\\w\\s\x00-\x7f–—‘’“”…«»])(?=[{_LOWER}])",
            f"(?<=[{_LOWER}][²³¹¼½¾ºª])(?=[{_LOWER}])",
            f"(?<=[{_LOWER}][À-ÖØ-Þ])|(?<=[а-яё][А-ЯЁ])",
        ]
    )
    + ")"
)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of all texts, a zero before each and at the end."""
    return np.frombuffer(("\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)


def _pair_counts(texts: list[str]) -> Counter:
    """Counts by ``(first << 21) | second`` over the texts that teach."""
    own = [t for t in texts if t and not (not t.isascii() and SUSPECT.search(t))]
    if not own:
        return Counter()
    codes = _codes(own)
    chars = np.flatnonzero(np.bincount(codes))
    local = np.zeros(int(chars[-1]) + 1, np.int64)
    local[chars] = np.arange(len(chars))
    ids = local[codes]
    k = len(chars)
    if k > 3000:  # many scripts in one batch: count by sorting
        keys, n = np.unique((codes[:-1].astype(np.int64) << 21) | codes[1:], return_counts=True)
        return Counter(dict(zip(keys.tolist(), n.tolist())))
    n = np.bincount(ids[:-1] * k + ids[1:], minlength=k * k)
    at = np.flatnonzero(n)
    keys = (chars[at // k].astype(np.int64) << 21) | chars[at % k]
    return Counter(dict(zip(keys.tolist(), n[at].tolist())))


DENSE = 1024  # most frequent characters whose pairs have a table; the other pairs are looked up in a sorted list
LEAST_SHARE = 1e-9  # pairs rarer than this tell nothing beyond ``PAIR_PRIOR`` (they move a score by less than 0.05) and stay where they are


class PairModel:
    """Improbability of pairs of characters, of all characters that the corpus has.

    ``chars`` are code points, the most frequent first, with their ``shares``; ``keys`` (first row << 32 | second row, rows
    counted from 1, 0 is any unseen character) and ``joint`` hold the shares of the pairs that occur, in order.
    """

    def __init__(self, chars: np.ndarray, shares: np.ndarray, keys: np.ndarray, joint: np.ndarray):
        self.chars, self.keys, self.joint = chars, keys, joint
        self.shares = np.concatenate(([0.0], shares))
        self.ids = np.zeros(0x110000, np.int32)
        self.ids[chars] = np.arange(1, len(chars) + 1)
        self.logs = np.log(self.shares + CHAR_PRIOR)
        size = min(len(chars), DENSE) + 1
        table = np.full((size, size), PAIR_PRIOR)
        a, b = keys >> 32, keys & 0xFFFFFFFF
        small = (a < size) & (b < size)
        table[a[small], b[small]] += joint[small]
        self.size = size
        self.flat = self._score(self.logs[:size, None], self.logs[None, :size], table).astype(np.float32).ravel()
        self.seen: dict = {}  # results for runs met before, while a document has shown no encoding yet

    @staticmethod
    def _score(first: np.ndarray, second: np.ndarray, joint: np.ndarray) -> np.ndarray:
        return np.minimum(first + second - np.log(joint) - TYPICAL, MOST)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        ids = self.ids.take(codes)
        a, b = ids[:-1], ids[1:]
        if not len(a) or int(ids.max()) < self.size:
            return self.flat.take(a * self.size + b)
        dense = (a < self.size) & (b < self.size)
        out = self.flat.take(np.where(dense, a * self.size + b, 0))
        rare = np.flatnonzero(~dense)
        a, b = a[rare].astype(np.int64), b[rare].astype(np.int64)
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        joint = PAIR_PRIOR + np.where(self.keys[at] == key, self.joint[at], 0.0) if len(self.keys) else PAIR_PRIOR
        out[rare] = self._score(self.logs[a], self.logs[b], joint)
        return out

    def share(self, ch: str) -> float:
        """Share of a character in the documents that teach."""
        return float(self.shares[self.ids[ord(ch)]])

    def total(self, text: str) -> float:
        """Improbability of a piece of text: the sum over its pairs that are improbable."""
        s = self.scores(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        return float(np.maximum(s, 0).sum())


def model_from_counts(pairs: dict[int, int], ones: dict[int, int] | None = None) -> PairModel:
    """From counts of pairs and, where those leave out rare pairs, of characters (as the first of a pair)."""
    if ones is None:
        ones = Counter()
        for key, n in pairs.items():
            ones[key >> 21] += n
    total = sum(ones.values()) or 1
    chars = np.array([c for c, _ in sorted(ones.items(), key=lambda x: (-x[1], x[0]))], np.int64)
    row = np.zeros(0x200000, np.int64)
    row[chars] = np.arange(1, len(chars) + 1)
    key = np.fromiter(pairs, np.int64, len(pairs))
    n = np.fromiter(pairs.values(), np.float64, len(pairs))
    key = (row[key >> 21] << 32) | row[key & 0x1FFFFF]
    order = np.argsort(key)
    return PairModel(chars, np.array([ones[c] for c in chars.tolist()], np.float64) / total, key[order], n[order] / total)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximum-scoring segments ``(first pair, last pair, total)``; only improbable pairs can begin or end one."""
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    value, before, after = scores[hot].tolist(), sums[hot].tolist(), sums[hot + 1].tolist()
    out = []
    at = hot.tolist()
    start = end = 0
    run = best = value[0]
    for k in range(1, len(at)):
        gap = before[k] - after[k - 1]
        if run + gap <= 0 or best + gap <= 0 and run + gap + value[k] <= value[k]:
            out.append((at[start], at[end], best))
            start = end = k
            run = best = value[k]
            continue
        run += gap + value[k]
        if run >= best:
            best, end = run, k
    out.append((at[start], at[end], best))
    return out


def _as_bytes(text: str, encoding: str) -> bytes | None:
    table = TO_BYTE[encoding]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _meant(run: str, read_as: str, meant: str) -> str | None:
    raw = _as_bytes(run, read_as)
    if raw is None:
        return None
    if meant == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    table = TABLES[meant]
    return "".join([table[b] for b in raw])


UTF8 = tuple((e, "utf-8") for e in SINGLE_BYTE)
SINGLE = tuple((a, b) for a in SINGLE_BYTE for b in SINGLE_BYTE if a != b and (a, b) not in SKIPPED)


def _from_utf8(run: str, around: tuple[str, str], model: PairModel, first: list[tuple[str, str]], before: float) -> tuple[float, str, tuple[str, str]] | None:
    """Best reading of a run as UTF-8, garbled up to ``ROUNDS`` times; one that the document showed before needs no gain."""
    best = None
    for pair in [*(p for p in first if p[1] == "utf-8"), *(p for p in UTF8 if p not in first)]:
        out = run
        for _ in range(ROUNDS):
            out = _meant(out, *pair)
            if out is None:
                break
            if len(run) <= 3 and pair not in first and any(c > "\x7f" and model.share(c) <= 0 for c in out):
                continue  # a lone sequence that means a character which no other document has
            left = model.total(around[0] + out + around[1])
            if not C1.search(out) and (best is None or left < best[0]) and (left < before or pair in first):
                best = (left, out, pair)
        if best and pair in first:
            break
    return best


def _from_single(run: str, around: tuple[str, str], model: PairModel, first: list[tuple[str, str]], before: float) -> tuple[float, str, tuple[str, str]] | None:
    """Best mapping between two single-byte encodings; it must make the run probable."""
    outside = [c for c in run if c > "\x7f"]
    if len(outside) == 1 and model.share(outside[0]) > LONE and not any(p[1] != "utf-8" for p in first):
        return None
    best = None
    for pair in [*(p for p in first if p[1] != "utf-8"), *(p for p in SINGLE if p not in first)]:
        out = _meant(run, *pair)
        if out is None or out == run or C1.search(out):
            continue
        left = model.total(around[0] + out + around[1])
        if before - left >= GAIN and left < 0.34 * before and (best is None or left < best[0] - 1e-6):
            best = (left, out, pair)
            if pair in first:
                break
    return best


def _inverse(text: str, a: int, b: int, model: PairModel, first: list[tuple[str, str]]) -> list[tuple[int, int, str, tuple[str, str]]]:
    """Replacements inside the run ``text[a:b]``: of the whole run if it has an inverse, else of its stretches outside ASCII."""
    out = []
    for how in (_from_utf8, _from_single):
        for spans in ([(a, b)], _pieces(text, a, b)):
            for c, d in spans:
                around = (text[max(0, c - 2) : c], text[d : d + 2])
                key = None if first or d - c > 40 else (how is _from_utf8, text[c:d], around)
                if key in model.seen:
                    best = model.seen[key]
                else:
                    best = how(text[c:d], around, model, first, model.total(around[0] + text[c:d] + around[1]))
                    if key:
                        if len(model.seen) > REMEMBERED:
                            model.seen.clear()
                        model.seen[key] = best
                if best:
                    out.append((c, d, best[1], best[2]))
                    first[:] = [best[2], *(p for p in first if p != best[2])]
            if out:
                return out
            if (c, d) == (a, b) and len(spans) == 1 and all(x > "\x7f" for x in text[a:b]):
                break
    return out


def _widen(text: str, a: int, b: int) -> tuple[int, int]:
    """A run without half sequences: it takes in the neighbouring characters outside ASCII."""
    while a > 0 and text[a - 1] > "\x7f":
        a -= 1
    while b < len(text) and text[b] > "\x7f":
        b += 1
    while a < b and text[a] <= "\x7f":
        a += 1
    while b > a and text[b - 1] <= "\x7f":
        b -= 1
    return a, b


def _pieces(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Stretches outside ASCII inside a run, where the whole run has no inverse."""
    return [(a + m.start(), a + m.end()) for m in re.finditer("[^\x00-\x7f]+", text[a:b])]


def repair(text: str, model: PairModel, scores: np.ndarray | None = None) -> tuple[str, bool]:
    """``(restored text, found)``; found also where an improbable run holds what no encoding means, so that nothing can be restored."""
    found = False
    first: list[tuple[str, str]] = []
    for turn in range(ROUNDS):
        if text.isascii():
            break
        if scores is None:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            scores = model.scores(codes)
        spans: list[tuple[int, int]] = []
        for a, b, value in segments(scores):
            if value >= LEAST_RUN:
                found = found or bool(UNMEANT.search(text, a, b + 2))
                a, b = _widen(text, a, b + 2)
                if a < b and not (spans and a < spans[-1][1]):
                    spans.append((a, b))
                elif a < b and spans:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        scores = None
        parts, last, changed = [], 0, False
        for a, b in spans:
            for c, d, new, _ in _inverse(text, a, b, model, first):
                parts += [text[last:c], new]
                last, changed = d, True
        if not changed:
            break
        found = True
        text = "".join([*parts, text[last:]])
    return text, found


COUNT_SCHEMA = pa.schema([("pair", pa.int64()), ("n", pa.int64())])


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """``pair, n`` over the documents that teach, counted per partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            total.update(_pair_counts([t for t in b.column(0).to_pylist() if t]))
        yield pa.RecordBatch.from_pydict({"pair": list(total), "n": list(total.values())}, schema=COUNT_SCHEMA)

    return df.select(F.col(text).cast("string")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str) -> PairModel:
    """Pair statistics of all documents that teach.

    The driver gets one count per character in use (at most some 150,000 are assigned) and one per pair
    with a share of at least ``LEAST_SHARE``: bounded by the alphabets, not by the documents.
    """
    counts = materialize(pair_counts(df, text))
    ones = {r["c"]: r["n"] for r in counts.groupBy(F.shiftright("pair", 21).alias("c")).agg(F.sum("n").alias("n")).collect()}
    kept = counts.filter(F.col("n") >= LEAST_SHARE * sum(ones.values())).toPandas()
    return model_from_counts(dict(zip(kept["pair"].tolist(), kept["n"].tolist())), ones)


def repair_encoding(df: DataFrame, key: str = "doc_id", text: str = "text", model: PairModel | None = None) -> DataFrame:
    """One row ``key, restored`` for every row whose text was in part decoded wrongly.

    ``restored`` is the text with every run put right for which an inverse mapping was
    found; runs that lost characters stay.  NULL and empty texts are never found; texts
    of any length are examined whole; repeated rows are found each time; other columns are ignored.
    """
    require(df, key, text)
    model = model or train(df, text)
    share = df.sparkSession.sparkContext.broadcast((model.chars, model.shares[1:], model.keys, model.joint))
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key), F.col(text).cast("string").alias("t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PairModel(*share.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            at, out = [], []
            for i, t in enumerate(texts):
                if t and not t.isascii():
                    fixed, found = repair(t, own)
                    if found:
                        at.append(i)
                        out.append(fixed)
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(out, pa.string())], names=[key, "restored"])

    return slim.mapInArrow(scan, f"`{key}` {kind}, restored string")
