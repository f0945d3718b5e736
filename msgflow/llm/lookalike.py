"""One consistent form for text that looks the same but differs in its characters.

1. Compatibility normalisation, except where it would change how the text looks
   (raised and lowered digits, fractions, circled and squared signs).
2. Deletion of ignorable characters (zero-width, joiners, soft hyphens, marks of
   direction), except joiners that change the glyphs around them.
3. Every letter is replaced by the representative of its look-alike class.  What
   is left depends on the looks of the text alone.
4. For every run of letters the lattice of possible readings is searched with
   Viterbi under character bigram scores of each script; readings in one script go
   first, and only where there is none the script may change at a cost of ``SWITCH``.

Steps 1 to 3 are a function of the looks, and so is the reading chosen in step 4;
each reading leads back to one class string.  Hence two texts have the same form
exactly if they look the same.
"""

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgflow.operators.skew import split_join
from msgflow.session import materialize, require

# Letters of other scripts that have the shape of the Latin letter above them.
CYRILLIC_FOR = dict(zip("aceopxyijsdhqwl", "асеорхуіјѕԁһԛԝӏ")) | dict(zip("ABEKMHOPCTXIJSGQWY", "АВЕКМНОРСТХІЈЅԌԚԜҮ"))
GREEK_FOR = dict(zip("ocjv", "οϲϳν")) | dict(zip("ABEZHIKMNOPTYXCJ", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"))
OTHER_FOR = {"У": "Y", "ɡ": "g", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮇ": "M", "Ⅰ": "I"}
KEPT_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<small>")
IGNORABLE = (
    "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮"
    "⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿ㅤﾠ"
)
ZWNJ, ZWJ = "‌", "‍"
HELD = {ZWNJ: "", ZWJ: ""}  # stand-ins for joiners that stay, while the others are deleted
JOINERS = re.compile("[‌‍]")

SCRIPTS = "LCG"  # Latin, Cyrillic, Greek
SWITCH = -14.0  # change of script inside a run of letters
UNSEEN = -8.5  # score of a pair of letters that the corpus never shows
CONTEXT = 6.0  # for the script of the letters of the text that have one shape only
CACHE = 200_000  # readings a worker remembers; the cache is emptied when full

_READING = {"C": CYRILLIC_FOR, "G": GREEK_FOR}
_CLASS = {v: k for m in (CYRILLIC_FOR, GREEK_FOR) for k, v in m.items()} | OTHER_FOR


def _ignorable(ch: str) -> bool:
    return ch in IGNORABLE or "︀" <= ch <= "️" or "\U000e0000" <= ch <= "\U000e0fff" or "⁪" <= ch <= "⁯"


class _Fold(dict):
    """Code point -> look-alike class string, worked out when first met."""

    def __missing__(self, cp: int) -> str | None:
        ch = chr(cp)
        if _ignorable(ch):
            out = ""
        else:
            tag = unicodedata.decomposition(ch).partition(" ")[0]
            if tag in KEPT_TAGS:
                out = ch
            else:
                out = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch) if tag.startswith("<") else ch)
                if unicodedata.category(ch) == "Zs":
                    out = " "
                elif ch in "\u2010\u2011":
                    out = "-"
                out = "".join(_CLASS.get(c, c) for c in out)
        self[cp] = out
        return out


_FOLD = _Fold()


def _pictograph(ch: str) -> bool:
    return unicodedata.category(ch) in ("So", "Sk") or ch == "️"


def _joining(ch: str) -> bool:
    """Letters whose glyphs a joiner changes (Arabic, Indic and South-East Asian blocks)."""
    return "؀" <= ch <= "ࣿ" or "ऀ" <= ch <= "෿" or "က" <= ch <= "᫿"


def _hold_joiners(text: str) -> str:
    """Joiners that change what is seen are replaced by stand-ins."""

    def hold(m: re.Match) -> str:
        i = m.start()
        a, b = text[i - 1 : i], text[i + 1 : i + 2]
        shown = a and b and ((m.group() == ZWJ and _pictograph(a) and _pictograph(b)) or (_joining(a) and _joining(b)))
        return HELD[m.group()] if shown else ""

    return JOINERS.sub(hold, text)


def looks(text: str) -> str:
    """Class string of a text: equal for texts that look the same."""
    if text.isascii():
        return text.strip()
    if JOINERS.search(text):
        text = _hold_joiners(text)
    out = unicodedata.normalize("NFC", text.translate(_FOLD)).strip()
    for joiner, stand_in in HELD.items():
        out = out.replace(stand_in, joiner)
    return out


_RUN = re.compile(r"[^\W\d_]+")
_AMBIGUOUS = re.compile("(?<![A-Za-z])[" + "".join(sorted(set(CYRILLIC_FOR) | set(GREEK_FOR))) + "]+(?![A-Za-z])")
_LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZßæøœđłþıŁØÆŒ"
_LATIN_ONLY = re.compile("[" + "".join(sorted(set(_LATIN_LETTERS) - set(CYRILLIC_FOR) - set(GREEK_FOR))) + "]")
_CYRILLIC_ONLY = re.compile("[\u0400-\u052f]")
_GREEK_ONLY = re.compile("[\u0370-\u03ff]")


def _context(s: str) -> str:
    """Script that the letters of one shape speak for, or ''."""
    found = [k for k, p in zip(SCRIPTS, (_LATIN_ONLY, _CYRILLIC_ONLY, _GREEK_ONLY)) if p.search(s)]
    return found[0] if len(found) == 1 else ""


def _script(ch: str) -> str:
    return "C" if "Ѐ" <= ch <= "ԯ" else "G" if "Ͱ" <= ch <= "Ͽ" else "L"


def _options(ch: str) -> list[tuple[str, str]]:
    """Readings of one class letter as (script, letter); the letter is a base letter."""
    if ch.isascii():
        return [("L", ch), *((s, m[ch]) for s, m in _READING.items() if ch in m)]
    return [(_script(ch), ch)]


class Reader:
    """Viterbi over the readings of letter runs, with remembered results."""

    def __init__(self, scores: dict[str, float] | None = None, prior: dict[str, float] | None = None):
        self.scores = scores or {}
        self.prior = prior or {s: -4.0 * i for i, s in enumerate(SCRIPTS)}
        self.cache: dict[tuple[str, str], str] = {}

    def _pair(self, script: str, a: str, b: str) -> float:
        return self.scores.get(a.lower() + b.lower(), UNSEEN)

    def run(self, run: str, context: str) -> str:
        key = (run, context)
        got = self.cache.get(key)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[key] = self._search(run, context)
        return got

    def _search(self, run: str, context: str) -> str:
        """Best reading in one script if there is any such reading, else the best one with changes of script."""
        split = unicodedata.normalize("NFD", run)
        lattice = [() if unicodedata.combining(ch) else _options(ch) for ch in split]
        whole = [s for s in SCRIPTS if all(not o or any(k == s for k, _ in o) for o in lattice)]
        paths: dict[str, tuple[float, str, str]] = {}
        for ch, options in zip(split, lattice):
            if not options:
                paths = {s: (v, text + ch, last) for s, (v, text, last) in paths.items()}
                continue
            step: dict[str, tuple[float, str, str]] = {}
            for script, letter in options:
                if whole and script not in whole:
                    continue
                if not paths:
                    step[script] = (self.prior[script] + (CONTEXT if script == context else 0.0) + self._pair(script, "^", letter), letter, letter)
                    continue
                best = None
                for before, (v, text, last) in paths.items():
                    if before == script:
                        v += self._pair(script, last, letter)
                    elif whole:
                        continue
                    else:
                        v += SWITCH
                    if best is None or v > best[0]:
                        best = (v, text + letter, letter)
                step[script] = best
            paths = step
        if not paths:
            return run
        best = max((s for s in SCRIPTS if s in paths), key=lambda s: paths[s][0])
        return unicodedata.normalize("NFC", paths[best][1])

    def canonical(self, text: str) -> str:
        s = looks(text)
        context = _context(s)
        run = self.run
        # a run with a letter of one shape in plain Latin has one reading in one script: itself
        return (_AMBIGUOUS if s.isascii() else _RUN).sub(lambda m: run(m.group(), context), s)


def _bigrams(texts: Iterable[str | None]) -> Counter:
    """Bigrams (of base letters, '^' before the first) of letter runs whose text has one script."""
    runs: Counter = Counter()
    for t in texts:
        if t:
            s = looks(t)
            context = _context(s)
            if context == "L":
                runs.update(_RUN.findall(s.lower() if s.isascii() else s))
            elif context:
                m = _READING[context]
                runs.update("".join(m.get(c, c) for c in r) for r in _RUN.findall(s))
    out: Counter = Counter()
    for r, n in runs.items():
        last = "^"
        for ch in unicodedata.normalize("NFD", r.lower()):
            if not unicodedata.combining(ch) and (ch.isascii() or "Ͱ" <= ch <= "ԯ"):
                out[last + ch] += n
                last = ch
    return out


def bigram_counts(df: DataFrame, text: str) -> DataFrame:
    """``pair, n`` over all texts; counted per partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            total.update(_bigrams(b.column(0).to_pylist()))
        yield pa.RecordBatch.from_pydict({"pair": list(total), "n": list(total.values())}, schema=pa.schema([("pair", pa.string()), ("n", pa.int64())]))

    return df.select(F.col(text).cast("string")).mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str) -> Reader:
    """Script-wise bigram scores from all texts.

    What reaches the driver is at most one count per pair of base letters of three
    alphabets (some 250 letters), whatever the size of the corpus.
    """
    counts = {r["pair"]: r["n"] for r in bigram_counts(df, text).collect()}
    return from_counts(counts)


def from_counts(counts: dict[str, int]) -> Reader:
    """Conditional scores of the second letter of a pair, and the share of each script among the runs."""
    first: Counter = Counter()
    for pair, n in counts.items():
        first[_script(pair[1]), pair[0]] += n
    scores = {p: math.log((n + 0.5) / (first[_script(p[1]), p[0]] + 20.0)) for p, n in counts.items() if p[0] == "^" or _script(p[1]) == _script(p[0])}
    runs = {s: first[s, "^"] + 1 for s in SCRIPTS}
    total = sum(runs.values())
    return Reader(scores, {s: math.log(n / total) for s, n in runs.items()})


def canonicalize(df: DataFrame, text: str = "content", out: str = "canonical", reader: Reader | None = None) -> DataFrame:
    """``df`` with a column ``out`` holding the consistent form of ``text``.

    NULL stays NULL, empty text stays empty, white space at the ends is dropped (it
    can't be seen); texts of any length are processed whole.  A column called
    ``out`` is replaced; all other columns, and repeated rows, stay as they are.
    """
    require(df, text)
    reader = reader or train(df, text)
    share = df.sparkSession.sparkContext.broadcast((reader.scores, reader.prior))

    @F.pandas_udf("string")
    def form(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Reader(*share.value)
        for s in it:
            yield pd.Series([None if t is None else own.canonical(t) for t in s], dtype=object)

    return df.withColumn(out, form(F.col(text).cast("string")))


SALT_ROWS = 5_000  # copies of one spelling that one task pairs


def spellings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, f, s``: digests of the consistent form and of the text as it stands, of every row that has a visible text; each text of a batch is read once."""
    reader = train(df, text)
    share = df.sparkSession.sparkContext.broadcast((reader.scores, reader.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(*share.value)
        for b in batches:
            coded = b.column(1).dictionary_encode()
            texts = coded.dictionary.to_pylist()
            forms = [own.canonical(t) for t in texts]
            at = coded.indices.to_numpy(zero_copy_only=False)
            seen = np.array([f != "" for f in forms], bool)[at]
            held = pa.array(at[seen])
            digests = [pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in x], pa.binary()).take(held) for x in (forms, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(seen)), *digests], names=["id", "f", "s"])

    base = df.filter(F.col(key).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(key).cast("string").alias("id"), F.col(text).cast("string"))
    return base.mapInArrow(run, "id string, f binary, s binary")


def _members(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, f, s`` of all rows whose form has several spellings, each row once."""
    require(df, key, text)
    rows = materialize(spellings(df, key, text))
    several = rows.groupBy("f").agg(F.min("s").alias("a"), F.max("s").alias("b")).filter(F.col("a") != F.col("b")).select("f")
    return materialize(split_join(rows, several, ["f"]).distinct())


def lookalike_classes(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """One row ``id, class_id, spelling_id, n_links`` per key and text that looks the same as a differently spelled one.

    ``n_links`` is the number of rows with another spelling of the class: the pairs of ``lookalike_pairs`` without writing them out.
    """
    members = _members(df, key, text)
    spelled = members.groupBy("f", "s").agg(F.count("*").alias("n"))
    links = spelled.select("f", "s", (F.sum("n").over(Window.partitionBy("f")) - F.col("n")).alias("n_links"))
    return split_join(members, links, ["f", "s"]).select("id", F.lower(F.hex("f")).alias("class_id"), F.lower(F.hex("s")).alias("spelling_id"), "n_links")


def lookalike_pairs(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """Pairs of keys whose texts are different strings of the same form: ``id_a, id_b``, smaller first.

    Spellings, not rows, are paired first; a spelling with many copies is spread over
    salted parts on both sides, so a task pairs at most ``SALT_ROWS`` copies of one spelling with as many of
    another at a time, and no two copies of the same spelling ever meet.  NULL and empty texts have
    no partner; a key that occurs several times (with the same or another text) counts once per text.
    ``lookalike_classes`` gives the same links in one row per key.
    """
    members = _members(df, key, text)
    size = members.groupBy("f", "s").agg(F.ceil(F.count("*") / SALT_ROWS).alias("p"))
    one, two = (size.select("f", F.col("s").alias(f"s{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    pairs = one.join(two, "f").filter(F.col("sa") < F.col("sb"))
    cells = pairs.withColumn("parta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pa") - 1))).withColumn("partb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb") - 1)))
    cells = cells.select("f", "sa", "parta", "sb", "partb")
    salted = split_join(members, size, ["f", "s"]).select("f", "s", "id", F.pmod(F.xxhash64("id"), F.col("p")).alias("part"))
    sides = [cells.join(salted.select("f", F.col("s").alias(f"s{x}"), F.col("part").alias(f"part{x}"), F.col("id").alias(f"i{x}")), ["f", f"s{x}", f"part{x}"]) for x in "ab"]
    out = sides[0].join(sides[1], ["f", "sa", "parta", "sb", "partb"]).filter(F.col("ia") != F.col("ib"))
    return out.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
