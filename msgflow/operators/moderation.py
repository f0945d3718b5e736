"""Censoring of listed words, however they are written, and what is counted of it."""

import unicodedata
from functools import lru_cache
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgflow.errors import EmptyWords
from msgflow.functions.text import LEET, LEET_LETTERS, normalize_leet
from msgflow.session import fresh

MAX_WORDS = 1_000_000  # a dictionary is shipped to every worker; beyond this it is refused
_LEET = dict(zip(LEET, LEET_LETTERS))
_SPACE = "\u0085"


def _letter(ch: str) -> str:
    """The letter a character stands for; '' for noise."""
    if ch in _LEET:
        return _LEET[ch]
    if ch.isspace() or ch == _SPACE or unicodedata.category(ch)[0] in "PSZ":
        return ""
    low = ch.lower()
    return low if len(low) == 1 else low[0]


@lru_cache(maxsize=65_536)
def _cached_letter(ch: str) -> str:
    return _letter(ch)


def letters(text: str) -> tuple[str, list[int]]:
    """Letters of a text, and where each stands in it."""
    out, at = [], []
    for i, ch in enumerate(text):
        x = _cached_letter(ch)
        if x:
            out.append(x)
            at.append(i)
    return "".join(out), at


class Automaton:
    """All occurrences of many patterns in one pass over the letters; without the automaton library each pattern is sought by itself, with the same result."""

    def __init__(self, patterns: list[str]):
        self.patterns = sorted({p for p in patterns if p})
        try:
            import ahocorasick
        except ImportError:
            self.machine = None
            return
        self.machine = ahocorasick.Automaton()
        for p in self.patterns:
            self.machine.add_word(p, p)
        if self.patterns:
            self.machine.make_automaton()

    def find(self, s: str) -> list[tuple[int, int, str]]:
        """``(end, start, pattern)``, ordered."""
        if not self.patterns:
            return []
        if self.machine is not None:
            return sorted((end, end - len(p) + 1, p) for end, p in self.machine.iter(s))
        found = []
        for p in self.patterns:
            k = s.find(p)
            while k != -1:
                found.append((k + len(p) - 1, k, p))
                k = s.find(p, k + 1)
        return sorted(found)


def censor_text(text: str, machine: Automaton, mask: str = "*") -> tuple[str, list[str]]:
    """Masked text and the patterns found, one for each occurrence; noise inside an occurrence is masked too."""
    s, at = letters(text)
    hits = machine.find(s)
    if not hits:
        return text, []
    out = list(text)
    for end, start, _ in hits:
        for i in range(at[start], at[end] + 1):
            out[i] = mask
    return "".join(out), [p for _, _, p in hits]


def load_words(words: DataFrame, column: str = "word") -> list[str]:
    """Patterns of a dictionary: in letters, each once, without blanks; raises ``EmptyWords`` if none is left."""
    rows = words.select(normalize_leet(F.col(column)).alias("w")).filter(F.col("w") != "").distinct().limit(MAX_WORDS + 1).collect()
    if not rows:
        raise EmptyWords("the dictionary holds no word")
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a dictionary may hold {MAX_WORDS} words")
    return sorted(r["w"] for r in rows)


def censor(df: DataFrame, patterns: list[str], text: str = "content", mask: str = "*") -> DataFrame:
    """``df`` with ``sanitized`` and ``censored_words``.  NULL stays NULL with no words; columns of those names are replaced.

    Each text is examined once, whatever is filtered on the result later; a text that recurs in a batch is examined once.
    """
    share = df.sparkSession.sparkContext.broadcast(patterns)
    kept = df.drop("sanitized", "censored_words")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(share.value)
        for b in batches:
            coded = b.column(b.num_columns - 1).dictionary_encode()
            done = [censor_text(t, machine, mask) for t in coded.dictionary.to_pylist()]
            at = coded.indices.fill_null(len(done))
            new = pa.array([d[0] for d in done] + [None], pa.string()).take(at)
            words = pa.array([d[1] for d in done] + [[]], pa.list_(pa.string())).take(at)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], new, words], names=[*names, "sanitized", "censored_words"])

    schema = T.StructType([*kept.schema.fields, T.StructField("sanitized", T.StringType()), T.StructField("censored_words", T.ArrayType(T.StringType()))])
    return kept.select("*", F.col(text).cast("string").alias(fresh(kept, "_text"))).mapInArrow(run, schema)


def word_hits(censored: DataFrame, words: str = "censored_words") -> DataFrame:
    """``word, hits``: every occurrence counts."""
    return censored.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("hits"))


def within(df: DataFrame, now: Column, hours: int = 24, at: str = "at_ts") -> DataFrame:
    """Rows of the last hours before ``now``: filter with it before the texts are censored."""
    return df.filter((F.col(at) > now - F.expr(f"interval {hours} hours")) & (F.col(at) <= now))


def has_hit(words: str = "censored_words") -> Column:
    """Whether a listed word was found."""
    return F.coalesce(F.size(words) > 0, F.lit(False))


def top_words(censored: DataFrame, now: Column, k: int = 10, hours: int = 24, at: str = "at_ts") -> DataFrame:
    """The k words found most often in the last hours before ``now``."""
    return word_hits(within(censored, now, hours, at)).orderBy(F.desc("hits"), "word").limit(k)
