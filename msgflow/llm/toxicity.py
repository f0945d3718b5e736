"""Score of abusive, hateful or sexual content.

A linear classifier over words, pairs and triples of neighbouring words, made from
labelled lines and counterfactually regularised: in every labelled line that names
a group of people the group is swapped for others, and a difference between the
scores of both lines is penalised.  So the score rests on what is said about a
group and not on its being named.

A text is as bad as its worst sentence.  Words are compared in a folded form that
undoes look-alike letters, hidden characters, digits for letters, spaced-out and
repeated letters; a masked letter matches any.
"""

import re
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgflow.llm.lookalike import looks
from msgflow.session import require

MAX_CASES = 20_000  # bound on the labelled rows that reach the driver; of more, those first by the hash of their text
# Terms for groups of people, swapped for one another; those that the labelled lines name are learned and added.
IDENTITY = (
    "women", "men", "girls", "boys", "old people", "young people", "immigrants", "migrants", "refugees", "foreigners", "gay people", "lesbians", "trans people",
    "black people", "white people", "asians", "africans", "europeans", "americans", "arabs", "jews", "muslims", "christians", "hindus", "buddhists", "atheists", "disabled people", "poor people",
)
LEAST_NAMED = 3  # lines in which a group must be named to be learned
SWAPS = 6  # other groups that each named one is swapped for, in turn
SWAP_WEIGHT = 2.0
RIDGE = 2e-3
STEPS = 400
THRESHOLD = 0.2  # of held-out labelled lines nearly all harmless ones lie below and nearly all others above (four-fold, three seeds: 5 of 2,400 on the wrong side)
REMEMBERED = 200_000

# Characters written in place of letters.
LEET = str.maketrans("4@83€1!|0$57", "aabeeiiiosst")
MASKS = "#*$%&+"
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ ._\-*]){2,}[^\W_](?![^\W_])")
_TOKEN = re.compile(r"(?:(?<![^\W_])[\"'“«])?@?[^\W_](?:[^\W_]|[#*$%&+@!|€](?=[^\W_]))*")
_SENTENCE = re.compile(r"[.!?;:]+(?:\s|$)|\n+")
_REPEAT = re.compile(r"(.)\1+")
_SEPARATORS = re.compile(r"[ ._\-*]")


def fold(token: str) -> str:
    """Form of a word in which it is compared; '?' stands for a masked letter."""
    if token[0] in "\"'“«":  # a quoted word is another word
        return "'" + fold(token[1:])
    if token[0] == "@" and len(token) > 2:
        return ""  # a handle says nothing
    if token.isdigit():
        return "0"
    plain = token
    if not token.isalpha():
        plain = "".join("?" if c in MASKS and 0 < i < len(token) - 1 else c for i, c in enumerate(token)).translate(LEET)
    return _REPEAT.sub(r"\1", plain.replace("l", "i"))


class Sentences:
    """Text -> folded words of each sentence, with remembered words."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def _word(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[token] = fold(token)
        return got

    def __call__(self, text: str) -> list[list[str]]:
        s = looks(text).lower()
        if _SPACED.search(s):
            s = _SPACED.sub(lambda m: _SEPARATORS.sub("", m.group()), s)
        word = self._word
        return [ws for part in _SENTENCE.split(s) if (ws := [w for t in _TOKEN.findall(part) if (w := word(t))])]


def features(ws: list[str], listed: frozenset[str] = frozenset()) -> list:
    """Words, pairs and triples of a sentence; a word of the moderators' list counts under a common name as well."""
    out: list = [*ws, *zip(ws, ws[1:]), *zip(ws, ws[1:], ws[2:])]
    if not listed.isdisjoint(ws):
        named = ["<listed>" if w in listed else w for w in ws]
        out += [x for x in (*named, *zip(named, named[1:]), *zip(named, named[1:], named[2:])) if x == "<listed>" or "<listed>" in x and not isinstance(x, str)]
    return out


class Model:
    """Weights by feature; ``bias`` is the score (in log odds) of a sentence without any."""

    def __init__(self, weights: dict, bias: float, listed: frozenset[str] = frozenset()):
        self.weights, self.bias, self.listed = weights, bias, listed
        self.sentences = Sentences()
        self.known: dict[str, float] = {}

    def sentence(self, ws: list[str]) -> float:
        get = self.weights.get
        total = self.bias
        for f in features(ws, self.listed):
            w = get(f)
            if w is not None:
                total += w
        return total

    def score(self, text: str) -> float:
        """Probability that the worst sentence of a text is abusive, hateful or sexual."""
        short = len(text) <= 48
        if short and text in self.known:
            return self.known[text]
        worst = max((self.sentence(ws) for ws in self.sentences(text)), default=-20.0)
        out = 1.0 / (1.0 + float(np.exp(-max(min(worst, 30.0), -30.0))))
        if short:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = out
        return out


_NAME = re.compile(r"(?<=[^\W\d_] )[A-Z][a-z]{3,}")


def named_groups(cases: list[tuple[str, bool, str | None]], least: int = LEAST_NAMED) -> list[str]:
    """Groups of people that labelled lines name, from ``(text, is malicious, category)``; without categories all malicious lines are looked at.

    A group has a name (capital inside a line) or is a fixed pair of words, it is named in hateful lines
    (a pair in harmless ones too), and lines that are abusive or sexual in another way don't name it.
    """
    hateful, harmless, other = (
        [t for t, y, c in cases if t and y and c in (None, "hate")],
        [t for t, y, _ in cases if t and not y],
        [t for t, y, c in cases if t and y and c not in (None, "hate")],
    )
    split = lambda lines: [re.findall(r"[^\W\d_]+", t.lower()) for t in lines]
    bad, good = split(hateful), split(harmless)
    words = Counter(w for ws in bad + good for w in ws)
    pairs = Counter(p for ws in bad for p in zip(ws, ws[1:]))
    fine = Counter(p for ws in good for p in zip(ws, ws[1:]))
    elsewhere = {w for ws in split(other) for w in ws}
    names = Counter(w.lower() for t in hateful for w in set(_NAME.findall(t)))
    fixed = {(a, b): n for (a, b), n in (pairs + fine).items() if n >= 0.9 * words[a] and min(len(a), len(b)) > 3}
    out = set()
    for a, b in fixed:
        if pairs[a, b] >= least and fine[a, b] and a not in elsewhere:
            out.add(f"{a} {b}")
    for w, n in names.items():
        if n >= least and w not in elsewhere:
            tail = next((b for a, b in fixed if a == w), "")
            out.add(f"{w} {tail}".strip())
    return sorted(out)


def swapped(text: str, terms: tuple[str, ...] = IDENTITY) -> list[str]:
    """The text with each group it names replaced by ``SWAPS`` other ones."""
    low = text.lower()
    out = []
    for k, a in enumerate(terms):
        if a in low and (m := re.compile(rf"(?<![^\W_]){re.escape(a)}(?![^\W_])")).search(low):
            turned = terms[k + 1 :] + terms[:k]
            out += [m.sub(b, low) for b in turned[:SWAPS] if b != a]
    return out


def _fit(rows: list[list], labels: np.ndarray, pairs: list[tuple[list, list]], weight: np.ndarray) -> tuple[dict, float]:
    """Ridge logistic regression with the counterfactual penalty, by accelerated gradient steps."""
    held = Counter(f for r in rows for f in set(r))
    names = {f: i for i, f in enumerate(f for f, n in held.items() if n >= 2)}
    size = len(names)

    def flat(docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
        at = [(k, names[f]) for k, d in enumerate(docs) for f in set(d) if f in names]
        a = np.array(at, np.int64).reshape(-1, 2)
        return a[:, 0], a[:, 1]

    r, c = flat(rows)
    pr, pc = flat([a for a, _ in pairs])
    qr, qc = flat([b for _, b in pairs])
    w, b = np.zeros(size), -1.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(r, w[c], len(rows)) + b
        err = weight * (1.0 / (1.0 + np.exp(-z)) - labels) / weight.sum()
        grad = np.bincount(c, err[r], size) + RIDGE * w / 10
        if pairs:
            gap = (np.bincount(pr, w[pc], len(pairs)) - np.bincount(qr, w[qc], len(pairs))) * SWAP_WEIGHT / len(pairs) / 10
            grad += np.bincount(pc, gap[pr], size) - np.bincount(qc, gap[qr], size)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * min(1.0, 2 * (1 - step / (STEPS + 1)))
        w, b = w - move[:-1], b - move[-1]
    return {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-4}, float(b)


def fit(cases: list[tuple[str, bool]], listed: list[str] = (), terms: tuple[str, ...] = IDENTITY) -> Model:
    """Model from ``(text, is malicious)``; the sentence of a malicious text that speaks loudest carries its label."""
    split = Sentences()
    words = frozenset(fold(w.strip().lower()) for w in listed if w and w.strip())
    texts = [(split(t), bool(y)) for t, y in cases if t]
    swaps = [(max(split(t), key=len, default=[]), max(split(s), key=len, default=[])) for t, _ in cases if t for s in swapped(t, terms)]
    pairs = [(features(a, words), features(b, words)) for a, b in swaps if a and b]
    model = None
    harmless = {w for parts, y in texts if not y for p in parts for w in p}
    for _ in range(3):
        rows, labels, weight = [], [], []
        for parts, y in texts:
            if not parts:
                continue
            if y and model:
                parts = [max(parts, key=model.sentence)]
            elif y:  # to begin with, the sentence with most words that no harmless text has
                parts = [max(parts, key=lambda p: (sum(w not in harmless for w in p) / len(p), len(p)))]
            for p in parts:
                rows.append(features(p, words))
                labels.append(float(y))
                weight.append(1.0)
        if not rows:
            return Model({}, -5.0, words)
        weights, bias = _fit(rows, np.array(labels), pairs, np.array(weight))
        model = Model(weights, bias, words)
    masked = {}
    for f, x in model.weights.items():
        if isinstance(f, str) and x > 0.3 and len(f) >= 4 and f[0] != "<":
            for i in range(1, len(f) - 1):
                masked.setdefault(f[:i] + "?" + f[i + 1 :], x)
    masked.update(model.weights)
    return Model(masked, model.bias, words)


MOST_LISTED = 1_000_000  # words of the moderators' list that every task can hold; a longer one is refused, not cut


def train(cases: DataFrame, listed: DataFrame | None = None, *, text: str = "text", label: str = "is_malicious", category: str = "category", word: str = "word", max_cases: int = MAX_CASES, terms: tuple[str, ...] = IDENTITY) -> Model:
    """Model from at most ``max_cases`` labelled rows (a bounded sample, by the hash of the text) and the whole moderators' list.

    ``terms`` are groups of people; those that the labelled rows name are added.
    """
    require(cases, text, label)
    kind = F.col(category).cast("string") if category in cases.columns else F.lit(None).cast("string")
    rows = cases.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(label).cast("boolean").alias("y"), kind.alias("c")).orderBy(F.xxhash64("t"), "t", "y", "c").limit(max_cases).collect()
    words: list[str] = []
    if listed is not None:
        held = listed.select(word).distinct()
        if held.count() > MOST_LISTED:
            raise ValueError(f"more than {MOST_LISTED} listed words")
        words = [r[0] for r in held.orderBy(word).collect()]
    groups = named_groups([(r["t"], r["y"], r["c"]) for r in rows])
    return fit([(r["t"], r["y"]) for r in rows], words, tuple(dict.fromkeys([*groups, *terms])))


def score_texts(df: DataFrame, model: Model, text: str = "content", out: str = "content_score") -> DataFrame:
    """``df`` with the score of ``text`` between 0 and 1; NULL has none, empty text has 0.

    A column called ``out`` is replaced; other columns and repeated rows stay as they are; texts are scored whole.
    """
    require(df, text)
    share = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.listed))

    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*share.value)
        for s in it:
            yield pd.Series([None if t is None else round(own.score(t), 6) for t in s], dtype="float64")

    return df.withColumn(out, score(F.col(text).cast("string")))


def rates(scored: DataFrame, source: str, score: str = "content_score", threshold: float = THRESHOLD) -> DataFrame:
    """``source, n_scored, n_flagged, rate`` per source; rows without source or score don't count."""
    require(scored, source, score)
    return (
        scored.filter(F.col(source).isNotNull() & F.col(score).isNotNull())
        .groupBy(source)
        .agg(F.count("*").alias("n_scored"), F.count_if(F.col(score) >= threshold).alias("n_flagged"))
        .withColumn("rate", F.col("n_flagged") / F.col("n_scored"))
    )
