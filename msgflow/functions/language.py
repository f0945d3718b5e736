"""Language of a text: by its function words, without leaving the JVM, or by letter trigrams learned from labelled texts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgflow.functions.text import tokens

# Frequent words of each language.
WORDS = {
    "en": "the of and to in is was for that with this our an by on who are not",
    "fr": "le la les des du et une est pour dans que qui sur pas avec au aux",
    "de": "der die das und ist nicht ein eine im den mit von für auf dem zu",
    "es": "el los las una es por con para que del en y se su al como",
    "pt": "o os as uma não com para do da dos no na em que é ao",
    "pl": "w i na z do nie się jest po od za dla przez przy",
    "ru": "и в на не с по из для от до это к за",
}


def detect(text: Column) -> Column:
    """ISO 639-1 code with most function words, ``und`` if there is none; ties go to the first in the list."""
    ts = tokens(text)
    counts = F.array(*(F.struct(F.size(F.filter(ts, _among(ws.split()))).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, ws) in enumerate(WORDS.items())))
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["lang"]).otherwise("und")


def _among(words: list[str]):
    return lambda t: t.isin(*words)


LEAST_COUNT = 2  # trigrams met less often tell nothing
RARE = 0.5  # added to every count


class LanguageModel:
    """Scores of letter trigrams per language, from labelled texts."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.languages = sorted({lang for lang, _ in counts})
        at = {lang: k for k, lang in enumerate(self.languages)}
        self.rows = {t: k for k, t in enumerate(sorted({t for _, t in counts}), 1)}
        table = np.full((len(self.rows) + 1, len(at)), RARE)
        for (lang, t), n in counts.items():
            table[self.rows[t], at[lang]] += n
        self.table = np.log(table / table.sum(axis=0))
        self.table[0] = 0.0  # an unknown trigram speaks for no language

    def detect(self, text: str) -> str:
        """ISO code of the language whose trigrams the text has; ``und`` where it has none that is known."""
        get = self.rows.get
        found = [k for t in trigrams(text) if (k := get(t))]
        return self.languages[int(self.table[found].sum(axis=0).argmax())] if found else "und"


def trigrams(text: str) -> list[str]:
    """Trigrams of the words, in lower case, with a blank before and behind each."""
    s = f" {' '.join(_WORDS.findall(text.lower()))} "
    return [t for a, b, c in zip(s, s[1:], s[2:]) if (t := a + b + c)[1] != " "]


_WORDS = re.compile(r"[^\W\d_]+")


def trigram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, trigram, n`` over all labelled texts, counted per task before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("trigram", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[l].update(trigrams(t))
        rows = [(l, t, n) for l, c in total.items() for t, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(3)], schema=schema)

    known = df.filter(F.col(lang).isNotNull() & ~F.col(lang).isin("", "und", "unknown") & F.col(text).isNotNull())
    return known.select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(count, "lang string, trigram string, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from labelled texts; wrong labels are outvoted.  The driver gets the trigrams of the alphabets, whatever the number of texts."""
    return LanguageModel({(r["lang"], r["trigram"]): r["n"] for r in trigram_counts(df, text, lang).filter(F.col("n") >= LEAST_COUNT).collect()})


def detect_by(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``df`` with the language of each whole text; NULL and texts without a known trigram are ``und``."""
    share = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own = share.value
        return texts.map(lambda t: own.detect(t) if t else "und")

    return df.withColumn(out, run(F.col(text).cast("string")))
