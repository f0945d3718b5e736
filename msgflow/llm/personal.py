"""Personal information in free text: found and replaced by typed placeholders.

A skip-chain conditional random field labels the tokens of a document.  Its chain
has potentials over the classes of a token and its neighbours and over adjacent
labels; skip edges join similar tokens (names, numbers) anywhere in the
document, with learned potentials over their two labels.  Marginals come from loopy message passing:
forward-backward along the chains, then messages along the skip edges, in turn.

The weights are trained here, piecewise, on lines made from ``TEMPLATES``.  Whether
a capitalised word is a name of a person, a common word or a recurring name is seen
from how the whole corpus writes it.
"""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgflow.llm.lookalike import IGNORABLE, looks
from msgflow.session import materialize, require

LABELS = ("O", "email", "phone", "id_number", "address", "person")
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3)
MIDDLING = 6e-6  # share of all words from which a capitalised word is a recurring name
LISTED = 2e-6  # share of all words from which a word of the corpus has an entry (at most half a million)
LOWER = 0.05  # share of small-letter writings that makes a word a common one
TURNS = 8  # most rounds of messages along the skip edges
SETTLED = 0.01  # change of the messages at which the rounds end
NEAR = 40  # characters within which the word for a street stands by a number
BLOCK = 512  # documents passed together at most
BLOCK_TOKENS = 60_000  # tokens, with padding, of the documents passed together (one document may have more)
PART_CHARS = 2_000_000  # characters of the texts tokenized together (one text may have more)

_AT = r"(?:@| @ |\s?\(at\)\s?|\s?\[at\]\s?)"
_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?)"
TOKEN = re.compile(
    r"(?P<initial>(?<![^\W_])[A-ZÀ-ÞŠŽŁŚ]\.(?= ?[A-ZÀ-ÞŠŽŁŚ]))"
    r"|(?P<street>(?<![^\W_])C/(?= ?[^\W\d_]))"
    r"|(?P<word>(?>[^\W\d_]+(?:['’\-][^\W\d_]+)*)(?![\w@(\[.+\-])(?!\s[(\[](?:at|AT)[)\]])(?! @ ))"
    rf"|(?P<email>[^\W_][\w.+\-]*{_AT}[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[^\W\d_]{{2,}})"
    r"|(?P<handle>@[\w.\-]+)"
    r"|(?P<num>(?<![^\W_])(?:[A-Z]{1,2}[ \-]?)?(?:\+\d{1,3}[ .\-/]?)?(?:\(\d{1,4}\)[ ]?)?\d[\dA-Z]*(?:[ .\-/]\d[\dA-Z]*)*(?:[ \-]?[A-Z](?![^\W_]))?[a-z]?(?![^\W\d_]))"
    r"|(?P<code>(?<![^\W_])[A-Z]\d[A-Z0-9]{4,})"
    r"|(?P<word2>(?>[^\W\d_]+(?:['’\-][^\W\d_]+)*)(?![\d_]))"
    r"|(?P<mix>[^\W_]+)"
    r"|(?P<other>\S)"
)

# Words that stand by personal data, in the languages of the corpus.
WORDS = {
    "call": "call text mobile phone tel telephone téléphone tél handy telefon móvil teléfono appelez llámame joignable rückruf erreichbar fax cell whatsapp desk extension switchboard hotline reception durchwahl zentrale standard centralita",
    "card": "passport insurance ssn nino pasaporte passeport reisepass steuer ausweis kartennummer dni nie nif identité assuré sozialversicherungsnummer titular holder documento sécurité personalausweis identity",
    "street": "street st road rd lane avenue ave close weg straße strasse str allee gasse platz ring ufer hof calle avenida av avda plaza paseo camino ronda rue impasse chemin allée boulevard bd",
    "title": "mr mrs ms miss dr prof herr frau mme mlle monsieur madame sr sra srta",
    "house": "flat apt apartment bis ter wohnung piso puerta appartement bât",
    "count": "ticket order invoice article build port batch sha node job lot ref version items rows pages files messages bytes ns costs retry line seats room office photo page unit units box",
    "home": "moved lives address domicile vive wohnt adresse dirección pick ship deliver lieferung abholung recoger retirer envoyez office registered",
    "by": "by ask signed taken think cc demandez rédigé protokoll redactado pregunta contact von bei para pour a à",
    "of": "de la le les des du del el los las der die das den von of the l d",
}
_WORD_CLASS = {w: k for k, ws in WORDS.items() for w in ws.split()}
_CAPITAL_ONLY = frozenset("street st road rd lane ave close weg straße strasse str platz ring ufer hof gasse allee camino paseo ronda".split())
_STREET_END = re.compile(r"(?:straße|strasse|str|weg|gasse|allee|platz|ufer|damm|hof)$")
CLASSES = (
    ["pad", "email", "handle", "code", "low", "common", "middling", "rare", "initial", "shout", "mix", "house_number", "postal"]
    + list(WORDS)
    + ["comma", "dot", "colon", "hash", "slash", "dash", "other"]
    + [f"num{n}" for n in range(1, 18)]
    + ["tel9", "tel10", "id8", "id9", "short_tel", "triple"]
)
CLASS = {c: i for i, c in enumerate(CLASSES)}
_PUNCT = {",": "comma", ".": "dot", ":": "colon", "#": "hash", "/": "slash", "-": "dash"}


def number_class(t: str) -> str:
    """As ``_number_shape``, with few classes of telephone and identity numbers, so that each is met often in training."""
    c = _number_shape(t)
    if c.startswith("tel"):
        return "tel9" if int(c[3:]) <= 9 else "tel10"
    if c.startswith("id"):
        return "id8" if int(c[2:]) <= 8 else "id9"
    return c


def _number_shape(t: str) -> str:
    """Shape of a number: how many digits, and whether it is grouped as telephone or identity numbers are."""
    n = min(sum(c.isdigit() for c in t), 17)
    letters = sum(c.isalpha() for c in t)
    if t[0] in "+(" and n >= 6:
        return f"tel{n}"
    if letters:
        if t[-1].islower() and n <= 4:
            return "house_number"
        return f"id{n}" if n >= 5 else "mix"
    groups = re.findall(r"\d+", t)
    shape = "-".join(str(len(g)) for g in groups)
    if len(groups) == 1:
        return "house_number" if n <= 3 else "postal" if n == 5 else f"num{n}"
    if shape == "3-2-4" or shape.startswith("1-2-2-2-3") or shape == "2-3-3-3":
        return f"id{n}"
    if shape == "3-4" and "-" in t:
        return "short_tel"
    if shape == "3-3-3" and " " in t and t[0] not in "67":
        return "triple"
    if len(set(map(len, groups))) == 1 and len(groups) >= 4 and "." not in t[1:3] or shape in ("5-3-3", "3-5-3", "3-3-4", "3-4-4", "4-3-4", "5-6", "4-7", "4-6", "3-2-2-2", "3-3-3", "4-3-3-3", "2-2-2-2-2", "3-8"):
        return f"tel{n}"
    return f"num{n}"


class Lexicon:
    """How the corpus writes its words: ``common``, ``middling`` (recurring name) or ``rare``."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds = kinds

    def word(self, w: str) -> str:
        if "'" in w or "’" in w:
            w = re.split("['’]", w)[-1] or w
        low = w.lower()
        known = _WORD_CLASS.get(low)
        if known == "street" and low in _CAPITAL_ONLY and w[0].islower():
            return "low"
        if known and (known not in ("of", "by") or w[0].islower()):
            return known
        if not w[0].isupper():
            return "low"
        parts = low.split("-")
        if any(_WORD_CLASS.get(p) == "card" for p in parts):
            return "card"
        kinds = [self.kinds.get(p, "rare") for p in parts]
        if len(w) == 1 or "common" in kinds:
            return "common"
        if w.isupper():
            return "shout"
        if _STREET_END.search(low) and len(low) > 6:
            return "street"
        return "rare" if kinds == ["rare"] else "middling"


def lexicon(counts: dict[str, tuple[int, int]], total: int) -> Lexicon:
    kinds = {}
    for w, (low, cap) in counts.items():
        if low > LOWER * cap:
            kinds[w] = "common"
        elif cap >= MIDDLING * total:
            kinds[w] = "middling"
    return Lexicon(kinds)


#: Words for the lexicon: not those inside e-mail addresses, file names and codes.
_LETTERS = re.compile(r"(?<![\w.@+\-])(?>[^\W\d_]+)(?!\w|\+| ?@|[.\-]\w| ?[\[(]at[\])])")


def word_counts(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """``w, low, cap`` over all texts: how often each word begins small and large; summed per task before the shuffle.

    The row ``''`` holds the number of all words.  Texts in capitals only say nothing.
    """
    schema = pa.schema([("w", pa.string()), ("low", pa.int64()), ("cap", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            low: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for w, n in total.items():
                low[w.lower()][w[0].isupper()] += n
            rows = [*low.items(), ("", [sum(total.values()), 0])]
            total.clear()
            return pa.RecordBatch.from_pydict({"w": [r[0] for r in rows], "low": [r[1][0] for r in rows], "cap": [r[1][1] for r in rows]}, schema=schema)

        for b in batches:
            for t in b.column(0).to_pylist():
                if t and not t.isupper():
                    total.update(_LETTERS.findall(t))
            if len(total) > 300_000:
                yield out()
        yield out()

    parts = [df.select(F.col(c).cast("string")).mapInArrow(count, "w string, low long, cap long") for df, c in frames]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return united.groupBy("w").agg(F.sum("low").alias("low"), F.sum("cap").alias("cap"))


def learn_lexicon(frames: list[tuple[DataFrame, str]]) -> Lexicon:
    """Lexicon of the whole corpus; only words that make up at least ``LISTED`` of it reach the driver."""
    counts = materialize(word_counts(frames))
    total = counts.filter("w = ''").agg(F.sum("low")).first()[0] or 0
    held = counts.filter(((F.col("low") + F.col("cap")) >= F.lit(LISTED * total)) & (F.col("w") != "")).collect()
    return lexicon({r["w"]: (r["low"], r["cap"]) for r in held}, total)


# --- training -------------------------------------------------------------------------

# Lines of classes: {x} is a slot; everything else is given by its class.
_PERSON = ["middling rare", "middling rare", "initial rare", "initial rare", "title rare", "title dot rare", "rare comma middling", "title dot initial rare", "middling middling rare", "title middling rare", "middling initial rare"]
_ADDRESS = [
    "house_number rare street", "house_number middling street", "house_number common street", "house_number middling common street", "house_number common middling street", "house_number house street of common middling",
    "house_number comma street of middling", "house_number street of middling", "house_number street of rare", "house_number street of common middling", "house_number house street of middling", "street of middling comma house_number", "street middling house_number", "street of common middling comma house_number comma house_number low",
    "middling street house_number", "rare street house_number", "common middling street house_number", "street house_number", "common street house_number", "house house_number comma house_number middling street", "house house_number comma house_number common street", "house_number middling street street", "house_number street street", "street common house_number", "street of common house_number", "rare street dot house_number", "middling street dot house_number", "common street dot house_number", "street of of common comma house_number", "street of middling comma house_number", "house_number comma street of common middling",
]
_PHONE = ["tel10", "tel10", "tel10", "tel9", "tel9", "short_tel", "short_tel", "short_tel", "num9", "num10", "num11", "triple"]
_CARD = ["id9", "id9", "id9", "id8", "id8", "code", "code", "num8", "num15", "num9"]
_SLOTS = {"PERSON": _PERSON, "ADDRESS": _ADDRESS, "PHONE": _PHONE, "CARD": _CARD, "EMAIL": ["email"]}
_TAGS = {"PERSON": "person", "ADDRESS": "address", "PHONE": "phone", "CARD": "id_number", "EMAIL": "email"}
_AFTER = ["", "", "dot", "comma low low", "dot common low low low", "low low low", "low of low", "dash PERSON low low", "dot PERSON low", "slash low low", "comma middling dot", "comma postal middling", "comma rare", "comma rare low low", "comma middling low low", "comma postal rare"]
TEMPLATES = [
    "low low by PERSON", "common low by PERSON", "PERSON by low of low", "by PERSON low of low", "low low PERSON low of low low", "PERSON low low", "PERSON low low", "PERSON comma by", "by colon PERSON", "PERSON low of low low colon EMAIL", "by a PERSON by of low", "low PERSON low low low", "common low low PERSON", "PERSON home low ADDRESS",
    "by PERSON by EMAIL", "low low EMAIL low of low low", "by EMAIL low of low", "home low EMAIL", "common low low EMAIL", "by colon EMAIL", "EMAIL low low of low", "low EMAIL comma low home low ADDRESS", "low of common EMAIL low",
    "call low low PHONE low low", "call dot PHONE", "call PHONE", "call PHONE low low", "of low call PHONE low low comma low low", "common call PHONE", "call low PHONE", "low call PHONE", "call of PHONE", "call colon PHONE", "low low call low PHONE", "call dot colon PHONE", "common low call PHONE",
    "card house dot CARD", "card CARD", "card low low PHONE_NOT", "low low low of card comma low low CARD", "card low card CARD low low low", "card dash CARD low low low", "common of card low CARD", "low card low CARD", "card colon CARD", "low of card low common", "card dash CARD low low", "of card of card CARD", "card CARD low by low low", "low card CARD semi PERSON", "low card low low CARD", "low low low low CARD",
    "low low home low ADDRESS", "home low low low ADDRESS", "low home low ADDRESS low low", "home low colon ADDRESS", "home colon ADDRESS", "home low ADDRESS", "low low ADDRESS", "home by ADDRESS", "low low low low ADDRESS comma postal middling", "home of ADDRESS comma postal middling",
    "PHONE low of call count", "PHONE low of call count", "PHONE low of call low", "PHONE low low call count", "low low comma PHONE low of call count", "low low dot PHONE low of call count", "common low low semi PHONE low of call count", "PERSON dash PHONE low of call count", "PHONE low of call",
]
HARMLESS = [
    "count hash num8 low low low of hash num8", "count low triple count low count num5", "count num12 count num5 low count", "count num12 low count", "low low num9 low low", "count num7 count", "low low low num10 low low low", "of low num3 of low", "count dot num9 low low low of slash low slash low", "count house dot num10 low low",
    "count num12 num6 low num7 count", "low count mix low low low count num6", "common low low low count house_number comma low", "of low middling slash house_number", "low middling slash house_number low low low", "middling slash house_number", "common common middling low low", "common low of middling middling count low num4 count",
    "low low low of middling middling low num4 low", "of common middling low low low", "common low low common low low low", "common low low of common", "of common common low of common low low low house_number", "low of common low of common num4 low", "of common common of common house_number low of common common num4 common", "middling low low low low", "low low low middling low low middling",
    "common middling low low low low", "low middling low of common", "house_number street low low house_number low low low low low of low low", "low low low street low low low low", "common low low low street low", "common common house_number", "low house_number common low low", "common num3", "low street low low", "of common common low of street low common", "count num4 low low low", "low num13 low", "handle low low low low", "low low handle", "common low comma low low low low dot",
    "num4 dash num2 dash num2 low", "low low count num7 count", "low at num4 count", "low count num4", "common low num4 count low common low", "low low low house_number count", "low card low low num4 low", "low low low call low low", "low low count num4 count comma call low low low", "common rare low low low low", "low rare slash house_number", "slash low slash low slash mix dot low dash common low low",
    "num8 num8 num8", "low low num8 low low", "low num9 low", "low tel10 low", "count short_tel low low", "count num10 count", "low low num11 low", "middling middling low low", "of common middling count", "common middling", "middling house_number", "common house_number dot common house_number", "low triple low", "triple low count num5",
]


def _made_lines(seed: int = 7, rounds: int = 20) -> list[list[tuple[str, int]]]:
    """Labelled lines of classes."""
    rng = random.Random(seed)
    out = []

    def word(c: str) -> list[tuple[str, int]]:
        c = {"semi": "other", "at": "low", "PHONE_NOT": "num4"}.get(c, c)
        if c == "a":
            c = "low"
        if c in CLASS:
            swap = {"low": ["low"] * 8 + ["of", "common"], "common": ["common"] * 5 + ["low"]}.get(c)
            return [(rng.choice(swap) if swap else c, 0)]
        return [(w, LABELS.index(_TAGS[c])) for w in rng.choice(_SLOTS[c]).split()]

    def line(t: str) -> list[tuple[str, int]]:
        return [x for c in t.split() for x in word(c)]

    for _ in range(rounds):
        for t in TEMPLATES:
            out.append(line(" ".join([rng.choice(["", "", "common low low low dot", "low low low low"]), t, rng.choice(_AFTER)])))
        for t in HARMLESS:
            out.append(line(" ".join([rng.choice(["", "", "common low of common low dot"]), t, rng.choice(["", "dot", "low low low", "dot common low of common"])])))
            out.append(line(t))
    return out


class Field:
    """Weights: ``window[offset][class]`` per label, ``chain`` between adjacent labels, ``skip`` between labels of similar tokens."""

    def __init__(self, window: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.window, self.chain, self.skip = window, chain, skip
        # a document all of whose tokens lean to O by more than adjacent labels can turn round is O throughout
        gain = float(np.max(chain) - np.min(chain[0, 0]))
        self.margin = 2 * max(gain, 0.0)


def _skip_weights(lines: list[list[tuple[str, int]]], seed: int = 7, documents: int = 4000) -> np.ndarray:
    """Log potentials of the labels at both ends of a skip edge, by counting, as for the chain.

    Documents are made of several lines; a name or number of a kind of entity that occurs again in a document is the same one
    more often than not, and a token outside entities now and then has the form of one.
    """
    rng = random.Random(seed)
    linked = {"rare", "middling", "code"} | {c for c in CLASSES if c.startswith(("num", "tel", "id"))}
    pairs = np.ones((len(LABELS), len(LABELS)))
    single = np.ones(len(LABELS))
    for _ in range(documents):
        forms: dict[tuple, list[int]] = defaultdict(list)
        for line in rng.sample(lines, 5):
            for c, y in line:
                if c in linked:
                    single[y] += 1
                    label = 0 if y and rng.random() < 0.05 else y  # a name that also is a place or a product
                    forms[c, y, rng.randrange(3 if y else 30)].append(label)
        for labels in forms.values():
            for a, b in zip(labels, labels[1:]):
                pairs[a, b] += 1
                pairs[b, a] += 1
    share = single / single.sum()
    return np.log(pairs / pairs.sum() / (share[:, None] * share[None, :])).clip(-4.0, 4.0)


def train_field(steps: int = 160) -> Field:
    """Piecewise training: softmax over the window of classes, counted chain of labels and skip edges."""
    lines = _made_lines()
    reach = max(abs(o) for o in OFFSETS)
    ids, labels = [], []
    chain = np.ones((len(LABELS), len(LABELS)))
    for line in lines:
        ids += [0] * reach + [CLASS[c] for c, _ in line]
        labels += [-1] * reach + [y for _, y in line]
        for (_, a), (_, b) in zip(line, line[1:]):
            chain[a, b] += 1
    ids = np.array(ids + [0] * reach)
    labels = np.array(labels + [-1] * reach)
    at = np.flatnonzero(labels >= 0)
    y = np.eye(len(LABELS))[labels[at]]
    cols = [ids[at + o] for o in OFFSETS]
    w = np.zeros((len(OFFSETS), len(CLASSES), len(LABELS)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = sum(w[k][c] for k, c in enumerate(cols))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p = (p / p.sum(axis=1, keepdims=True) - y) / len(at)
        g = np.stack([np.stack([np.bincount(c, p[:, l], len(CLASSES)) for l in range(len(LABELS))], axis=1) for c in cols]) + 2e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    share = chain / chain.sum(axis=1, keepdims=True)
    prior = chain.sum(axis=0) / chain.sum()
    return Field(w, 0.5 * np.log(share / prior[None, :]), _skip_weights(lines))


# --- inference -------------------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, length: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Log marginals by forward-backward over padded chains ``(documents, tokens, labels)``."""
    b, t, k = unary.shape
    fwd, bwd = np.empty_like(unary), np.zeros_like(unary)
    fwd[:, 0] = unary[:, 0]
    for i in range(1, t):
        fwd[:, i] = unary[:, i] + _lse(fwd[:, i - 1, :, None] + chain[None], 1)
    for i in range(t - 2, -1, -1):
        step = _lse((unary[:, i + 1] + bwd[:, i + 1])[:, None, :] + chain[None], 2)
        bwd[:, i] = np.where((i + 1 < length)[:, None], step, 0.0)
    out = fwd + bwd
    return out - _lse(out, 2)[:, :, None]


def similar(token: str) -> str:
    """Key under which skip edges join tokens: case, accents, an ending of possession and the separators of numbers don't matter."""
    t = token.lower()
    if t.isascii() and t.isalpha():
        return t
    t = re.sub(r"['’]s$", "", t)
    return "".join(c for c in unicodedata.normalize("NFKD", t) if c.isalnum())


_NUMBER_BEFORE = re.compile(r"\d[a-z]?,? ?$")
_NUMBER_AFTER = re.compile(r",? ?(?:n[.º°o]{0,2} ?)?\d")
_CUT_OFF = re.compile(r"[-\u00ac\u00ad\u2010\u2011]\s*\n")
_TELLING = frozenset(CLASS[c] for c in ("rare", "initial", "title", "shout"))
_NAMES = frozenset(CLASS[c] for c in ("rare", "middling", "initial", "title", "shout", "common", "street", "by", "of"))


def _name_like(m: re.Match, c: int) -> bool:
    """A word that begins with a capital, an initial or a title."""
    return c in _NAMES and (m.group()[0].isupper() or c == CLASS["title"])


class Tagger:
    def __init__(self, field: Field, lex: Lexicon):
        self.field, self.lex = field, lex
        self.known: dict[str, int] = {}

    def _class(self, m: re.Match) -> int:
        kind = m.lastgroup
        if kind == "word" or kind == "word2":
            w = m.group()
            got = self.known.get(w)
            if got is None:
                if len(self.known) > 300_000:
                    self.known.clear()
                got = self.known[w] = CLASS[self.lex.word(w)]
            return got
        if kind == "num":
            c = number_class(m.group())
            return CLASS[c] if c in CLASS else CLASS["mix"]
        if kind == "other":
            return CLASS[_PUNCT.get(m.group(), "other")]
        return CLASS[kind]

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans ``(start, end, kind)`` of personal data in each text."""
        tokens = [list(TOKEN.finditer(t)) for t in texts]
        reach = max(abs(o) for o in OFFSETS)
        flat, first = [0] * reach, []
        for ms in tokens:
            first.append(len(flat))
            flat += map(self._class, ms)
            flat += [0] * reach
        ids = np.array(flat + [0] * reach)
        w = self.field.window
        at = np.arange(reach, len(ids) - reach)
        unary = np.zeros((len(ids), len(LABELS)))
        unary[at] = sum(w[k][ids[at + o]] for k, o in enumerate(OFFSETS))
        lean = unary[:, 1:].max(axis=1) - unary[:, 0]
        lean[ids == 0] = -np.inf
        sizes = [len(ms) for ms in tokens]
        live = [d for d in range(len(texts)) if sizes[d] and lean[first[d] : first[d] + sizes[d]].max() > -self.field.margin]
        live.sort(key=lambda d: sizes[d])
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        a = 0
        while a < len(live):
            b = a + 1
            while b < len(live) and b - a < BLOCK and sizes[live[b]] <= 1.3 * sizes[live[a]] + 4 and (b - a + 1) * sizes[live[b]] <= BLOCK_TOKENS:
                b += 1
            block = live[a:b]
            a = b
            t = max(sizes[d] for d in block)
            u = np.zeros((len(block), t, len(LABELS)))
            for r, d in enumerate(block):
                u[r, : sizes[d]] = unary[first[d] : first[d] + sizes[d]]
            length = np.array([sizes[d] for d in block])
            best = self._pass(u, length, [tokens[d] for d in block], [ids[first[d] : first[d] + sizes[d]] for d in block])
            for r, d in enumerate(block):
                out[d] = self._checked(self._spans(texts[d], tokens[d], best[r, : sizes[d]]), tokens[d], ids[first[d] : first[d] + sizes[d]])
        return out

    def _pass(self, u: np.ndarray, length: np.ndarray, tokens: list, classes: list) -> np.ndarray:
        """Loopy message passing: chains, then skip edges, until the messages settle (``TURNS`` rounds at most)."""
        chain = self.field.chain
        log = marginals(u, length, chain)
        rows, cols, group = [], [], []
        linked = {CLASS[c] for c in ("rare", "middling")}
        for r, (ms, cs) in enumerate(zip(tokens, classes)):
            forms: dict[str, list[int]] = defaultdict(list)
            for i, (m, c) in enumerate(zip(ms, cs.tolist())):
                if c in linked or m.lastgroup in ("num", "code") and m.end() - m.start() > 5:
                    forms[similar(m.group())].append(i)
            for f, where in forms.items():
                if len(where) > 1:
                    g = len(group) and group[-1] + 1
                    rows += [r] * len(where)
                    cols += where
                    group += [g] * len(where)
        if not rows:
            return log.argmax(axis=2)
        rows, cols, group = np.array(rows), np.array(cols), np.array(group)
        sent = np.zeros((len(rows), len(LABELS)))
        skip = np.exp(self.field.skip)
        for _ in range(TURNS):
            belief = log[rows, cols] - sent  # without what came along the skip edges
            p = np.exp(belief - _lse(belief, 1)[:, None])
            whole = np.stack([np.bincount(group, p[:, k]) for k in range(len(LABELS))], axis=1)
            n = np.bincount(group)
            others = (whole[group] - p) / np.maximum(n[group] - 1, 1)[:, None]
            before, sent = sent, np.log(others @ skip)
            if np.abs(sent - before).max() < SETTLED:
                break
            v = u.copy()
            np.add.at(v, (rows, cols), sent)
            log = marginals(v, length, chain)
        return log.argmax(axis=2)

    @staticmethod
    def _checked(spans: list[tuple[int, int, str]], ms: list[re.Match], classes: np.ndarray) -> list[tuple[int, int, str]]:
        """Exact check of what the field found.

        An address has a number in it or beside it and, close by, the word for a street.  A person is a family name with a
        given name, an initial or a title: two names, of which not all recur over the corpus as those of places and products do.
        """
        if not any(s[2] in ("address", "person") for s in spans):
            return spans
        text = ms[0].string
        street = [ms[i] for i in np.flatnonzero(classes == CLASS["street"]).tolist()]
        at = {m.start(): i for i, m in enumerate(ms)}

        def numbered(a: int, b: int) -> bool:
            return any(c.isalnum() for c in text[a:b]) and text[b : b + 1] != "/" and (any(c.isdigit() for c in text[a:b]) or bool(_NUMBER_BEFORE.search(text, max(0, a - 8), a) or _NUMBER_AFTER.match(text, b)))

        def joins(k: int) -> bool:
            """Whether token ``k`` goes on with the name before it: a word like a name, a comma, or the dot of a title."""
            near = k > 0 and ms[k].start() <= ms[k - 1].end() + 2 and "\n\n" not in text[ms[k - 1].end() : ms[k].start()]
            mark = ms[k].group()
            return near and (mark == "," or mark == "." and classes[k - 1] == CLASS["title"] or _name_like(ms[k], classes[k]))

        def named(a: int, b: int) -> bool:
            first = last = at[a]
            while last + 1 < len(ms) and (ms[last + 1].start() < b or joins(last + 1)):
                last += 1
            while first and joins(first) and (_name_like(ms[first - 1], classes[first - 1]) or ms[first - 1].group() in ",."):
                first -= 1
            run = [k for k in range(first, last + 1) if _name_like(ms[k], classes[k])]
            # a word cut at the end of a line tells nothing
            return len(run) >= 2 and any(classes[k] in _TELLING and not _CUT_OFF.match(text, ms[k].end()) for k in run)

        kept = []
        for s in spans:
            if s[2] == "address" and not (numbered(s[0], s[1]) and any(m.start() < s[1] + NEAR and m.end() > s[0] - NEAR for m in street)):
                continue
            if s[2] == "person" and not named(s[0], s[1]):
                continue
            kept.append(s)
        return kept

    @staticmethod
    def _spans(text: str, ms: list[re.Match], labels: np.ndarray) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        hot = np.flatnonzero(labels)
        last = -2
        for i in hot.tolist():
            kind = LABELS[labels[i]]
            if out and i == last + 1 and out[-1][2] == kind:
                out[-1] = (out[-1][0], ms[i].end(), kind)
            else:
                out.append((ms[i].start(), ms[i].end(), kind))
            last = i
        return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for a, b, kind in spans:
        parts += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*parts, text[last:]])


_HIDDEN = dict.fromkeys(map(ord, IGNORABLE))


_OTHER_SCRIPT = re.compile("[\u0370-\u052f\uff01-\uff5e]")
_OWN_SHAPE = re.compile("[\u0370-\u052f]")


def visible(text: str) -> str:
    """Composed form without ignorable characters, which would cut words; letters of other scripts that only stand in for Latin ones become Latin."""
    text = unicodedata.normalize("NFC", text.translate(_HIDDEN))
    if _OTHER_SCRIPT.search(text):
        plain = looks(text)
        if not _OWN_SHAPE.search(plain):
            return plain
    return text


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """``(first row, rows)`` of the parts of a batch with at most 2,000 texts and, but for a single text, ``PART_CHARS`` bytes."""
    sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    lo = total = 0
    for k, n in enumerate(sizes):
        if k > lo and (total + n > PART_CHARS or k - lo >= 2000):
            yield lo, k - lo
            lo, total = k, 0
        total += n
    if len(sizes) > lo:
        yield lo, len(sizes) - lo


def find_personal(df: DataFrame, key: str, text: str, lex: Lexicon, field: Field | None = None, out: str = "redacted") -> DataFrame:
    """``key, kinds array<string>, redacted`` of every row with a text.

    ``redacted`` is in composed form (NFC) and has no ignorable characters.  NULL texts give NULL and no kinds, empty ones stay empty; long texts are labelled whole; repeated
    rows are kept; other columns are ignored, whatever their names.
    """
    require(df, key, text)
    field = field or train_field()
    share = df.sparkSession.sparkContext.broadcast((field.window, field.chain, field.skip, lex.kinds))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, chain, skip, kinds = share.value
        own = Tagger(Field(window, chain, skip), Lexicon(kinds))
        for b in batches:
            for lo, n in parts(b.column(1)):
                part = b.slice(lo, n)
                coded = part.column(1).dictionary_encode()  # a text that recurs in the batch is labelled once
                texts = [t if t.isascii() else visible(t) for t in coded.dictionary.to_pylist()]
                spans = own.tag(texts)
                found = pa.array([sorted({s[2] for s in x}) for x in spans] + [[]], pa.list_(pa.string()))
                new = pa.array([redact(t, x) if x else t for t, x in zip(texts, spans)] + [None], pa.string())
                at = coded.indices.fill_null(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), found.take(at), new.take(at)], names=[key, "kinds", out])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, kinds array<string>, `{out}` string")
