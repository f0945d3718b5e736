"""Text from scanned pages: misread characters, cut words, running headers and page numbers.

Misread words are found by anagram hashes: the hash of a word is the sum of the
fifth powers (modulo a prime) of its characters, so a confusion (``rn`` for ``m``) changes
it by a fixed amount wherever it happens.  Rare words are joined in SQL, by hash plus
difference, with frequent words of the corpus; those that one confusion turns into
the other are ranked by frequency.  Words cut at line ends are joined where the
corpus has the whole word rather than the hyphenated one; lines at the edges of
pages that recur over the file, and page numbers, are taken out.

Words are counted per task before the shuffle, and the words of a record meet the
table of corrections in place; only edge lines and what was found are shuffled.
"""

import hashlib
import re
from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgflow.operators.skew import split_join
from msgflow.session import materialize, require

# What was printed, and what recognition makes of it.
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("a", "o"), ("o", "0"), ("l", "1"), ("u", "ii"), ("d", "cl"), ("g", "9"), ("h", "li"), ("m", "rn"),
    ("in", "m"), ("ri", "n"), ("w", "vv"), ("li", "h"), ("s", "5"), ("nn", "rm"), ("b", "8"), ("rn", "m"), ("i", "1"), ("b", "6"), ("z", "2"), ("cl", "d"), ("vv", "w"), ("ii", "u"),
)
RARE = 1e-4  # largest share of all words that a misread form may have
OFTEN = 30  # so many times as frequent must the right form be
LEAST = 3  # letters of a word that is looked at
RECURS = 0.4  # least share of the pages of a file on which a running header stands (there may be one for even and one for odd pages)
EDGE = 2  # lines at the top and at the bottom of a page
MARKS = "-\u00ac\u00ad\u2010\u2011"  # characters that end a cut line

PRIME = 2_147_483_629  # modulus of the fifth powers: every product stays below 2**63
MOST_BROADCAST = 1_000_000  # rows of a table of corrections or cut forms that every task may hold; a larger one is joined by shuffle

WORD = re.compile(r"[^\W_]+")
_MARK_END = re.compile(rf"[{MARKS}][ \t]*(?:\n\s*|\Z)")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-(?=[^\W\d_])")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT_LIKE = str.maketrans("lIiOoSs", "1110055")
_NUMBER_LINE = re.compile(
    r"^[\s\-–—\[(|<~*.=]*(?:(?:page|pagc|pago|poge|pg|p|pag|pág|página|seite|scite|s|strona|folio|fol|f|blatt|hoja)\b[.:\s]*)?(\d{1,4}|[lIO]\d{0,3}|\d[lIO\d]{0,3}|[ivxl]{1,6})"
    r"(?:\s*(?:/|of|af|0f|von|de|sur|z|out of)\s*[\dlIO]{1,4})?[\s\-–—\])|>~*.=]*$",
    re.IGNORECASE,
)
_SKELETON = re.compile("cl|rn|nn|rm|in|ri|li|ii|vv")
_SHAPE = {"cl": "d", "rn": "m", "nn": "m", "rm": "m", "in": "m", "ri": "n", "li": "h", "ii": "u", "vv": "w", "c": "e", "f": "t", "o": "a", "0": "a", "1": "l", "i": "l", "9": "g", "5": "s", "8": "b", "6": "b", "2": "z"}
_SINGLE = str.maketrans({k: v for k, v in _SHAPE.items() if len(k) == 1})

READ = "record_table string, record_key string, entity string, number int, line int, shape long, bare long, num int, lone boolean, kind string, form string, n long"
FLUSH = 300_000  # forms that a task counts before it hands them on


def shape(line: str) -> str:
    """Form of a line that misread characters don't change."""
    return _SKELETON.sub(lambda m: _SHAPE[m.group()], " ".join(line.lower().split())).translate(_SINGLE)


def _bare(line: str) -> tuple[str, int | None]:
    """Shape of a line without the number at its beginning or end, and that number."""
    m = re.match(r"^(?:page |p\. ?|seite )?(\d{1,4})\b[\s|.:\-–—]*(?=\D)|[\s|,.:\-–—]*(?:\b(?:page|p\.|seite) ?)?\b(\d{1,4})$", line.strip(), re.IGNORECASE)
    if not m:
        if not line.rstrip("])-–— ")[-1:].isdigit():  # as the pattern asks
            return "", None
        m = re.search(r"[\s|,.:\-–—\[(]*(?:\b(?:page|p\.|seite) ?)?\b(\d{1,4})(?: ?(?:of|/) ?\d{1,4})?[\])\-–— ]*$", line.strip(), re.IGNORECASE)
        if not m:
            return "", None
        n, rest = m.group(1), line.strip()[: m.start()]
    else:
        n = m.group(1) or m.group(2)
        rest = line.strip()[m.end() :] if m.start() == 0 and m.group(1) else line.strip()[: m.start()]
    return shape(rest), int(n)


def _digest(form: str) -> int | None:
    """64 bits that stand for the form of a line; NULL for one too short to tell anything."""
    return int.from_bytes(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if len(form) >= 4 else None


def _edge(line: str) -> dict:
    """An edge line: form of its words, whether a page number stands in it by itself, and else its form without a number at its end."""
    m = _NUMBER_LINE.match(line)
    if m:
        digits = m.group(1).translate(_DIGIT_LIKE)
        return {"shape": "", "bare": "", "num": int(digits) if digits.isdigit() else None, "lone": True}
    parts = re.split(r"\s{3,}|\t", line) if "\t" in line or "  " in line or "\xa0" in line else ()
    if len(parts) == 2 and len({bool(_NUMBER_LINE.match(p)) for p in parts}) == 2:
        words = next(p for p in parts if not _NUMBER_LINE.match(p))
        return {"shape": shape(words), "bare": "", "num": None, "lone": True}
    bare, num = _bare(line)
    return {"shape": shape(line), "bare": bare, "num": num, "lone": False}


def _lines(text: str) -> list[str]:
    return text.replace("\f", "\n").split("\n")


def edge_lines(text: str, transcript: bool) -> list[dict]:
    """Lines at the edges of a page; a transcript's pages run on, so all its lines are edges."""
    lines = [l.strip() for l in _lines(text)]
    full = [k for k, l in enumerate(lines) if l]
    at = full if transcript else sorted({*full[:EDGE], *full[-EDGE:]})
    edges = [{"line": k} | _edge(lines[k]) for k in at]
    return [e | {"shape": _digest(e["shape"]), "bare": _digest(e["bare"])} for e in edges]


def cut_words(text: str) -> list[tuple[int, int, int, str]]:
    """``(start of the word, end of its first half, start of the second, form)`` of words cut at line ends.

    The form is the lower-case word with its mark and a line end inside; a cut before something that is no word has no second half.
    """
    out = []
    for m in _MARK_END.finditer(text):
        i = end = m.start()
        while i and text[i - 1].isalnum():
            i -= 1
        if i == end or not text[end - 1].isalpha():
            continue
        b = WORD.match(text, m.end())
        if b and not b.group()[0].islower():
            continue
        out.append((i, end, m.end(), f"{text[i:end]}{text[end]}\n{b.group() if b else ''}".lower()))
    return out


def words_of(text: str, cuts: list[tuple[int, int, int, str]]) -> list[str]:
    """Lower-case words, cut ones whole; a first half without a second is no word."""
    if cuts:
        parts, last = [], 0
        for i, end, after, form in cuts:
            whole = form[-1] != "\n"
            parts += [text[last : max(last, end if whole else i)], "" if whole else " "]
            last = after
        text = "".join([*parts, text[last:]])
    return WORD.findall(text.lower())


def compounds_of(text: str) -> list[str]:
    """Lower-case pairs of words with a hyphen between them."""
    out = []
    for m in _HYPHEN.finditer(text):
        i = m.start()
        while i and text[i - 1].isalpha():
            i -= 1
        out.append(text[i : _LETTERS.match(text, m.end()).end()].lower())
    return out


def _read(records: DataFrame) -> DataFrame:
    """One pass over the texts: a row for every edge line, and counts ``kind, form, n`` of words, cut words and compounds per task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {kind: Counter() for kind in ("word", "cut", "compound")}

        def counted() -> pa.RecordBatch:
            rows = [(kind, form, n) for kind, total in totals.items() for form, n in total.items()]
            for total in totals.values():
                total.clear()
            none = [pa.nulls(len(rows), f.type) for f in list(schema)[:9]]
            return pa.RecordBatch.from_arrays([*none, *(pa.array([r[c] for r in rows], schema.field(9 + c).type) for c in range(3))], schema=schema)

        for b in batches:
            at: list[int] = []
            found: list[dict] = []
            number = b.column(3).to_pylist()
            for n, t in enumerate(b.column(4).to_pylist()):
                if not t:
                    continue
                t = t.replace("\f", "\n")
                here = edge_lines(t, number[n] is None)
                at += [n] * len(here)
                found += here
                cuts = cut_words(t)
                totals["word"].update(words_of(t, cuts))
                totals["cut"].update(c[3] for c in cuts)
                totals["compound"].update(compounds_of(t))
            held = pa.array(at, pa.int32())
            rest = [pa.array([f[c] for f in found], schema.field(c).type) for c in ("line", "shape", "bare", "num", "lone")]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(held) for c in range(4)), *rest, *(pa.nulls(len(at), f.type) for f in list(schema)[9:])], schema=schema)
            if len(totals["word"]) > FLUSH:
                yield counted()
        yield counted()

    return records.select("record_table", "record_key", "entity", F.col("number").cast("int").alias("number"), "text").mapInArrow(run, READ)


def _meet(records: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per kind (``word``, ``cut``): ``record_table, record_key`` and the columns of its table whose ``form`` is a word, or cut word, of the record.

    Tables of at most ``MOST_BROADCAST`` rows are held by every task; for a larger one the distinct forms of the records are shuffled.
    """
    sc = records.sparkSession.sparkContext
    small = {kind: t.count() <= MOST_BROADCAST for kind, t in tables.items()}
    wanted = sc.broadcast({kind: frozenset(r[0] for r in t.select("form").collect()) if small[kind] else None for kind, t in tables.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted.value
        for b in batches:
            at, forms, kinds = [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                t = t.replace("\f", "\n")
                cuts = cut_words(t)
                for kind, known in held.items():
                    here = {c[3] for c in cuts} if kind == "cut" else set(words_of(t, cuts))
                    here = sorted(here if known is None else here & known)
                    at += [k] * len(here)
                    forms += here
                    kinds += [kind] * len(here)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(kinds, pa.string()), pa.array(forms, pa.string())], names=["record_table", "record_key", "kind", "form"])

    found = materialize(records.select("record_table", "record_key", "text").mapInArrow(run, "record_table string, record_key string, kind string, form string"))
    parts = {kind: found.filter(F.col("kind") == kind).drop("kind") for kind in tables}
    return {kind: part.join(F.broadcast(tables[kind]), "form") if small[kind] else split_join(part, tables[kind], ["form"]) for kind, part in parts.items()}


def anagram_hash(word: str) -> Column:
    """Sum of the fifth powers of the characters modulo ``PRIME``, in SQL; it can't overflow."""
    power = f"(((c * c) % {PRIME}L) * ((c * c) % {PRIME}L)) % {PRIME}L * c % {PRIME}L"
    return F.expr(f"aggregate(transform(sequence(1, length({word})), i -> cast(ascii(substr({word}, i, 1)) as bigint)), 0L, (h, c) -> h + {power})")


def _hash(s: str) -> int:
    return sum(pow(ord(c), 5, PRIME) for c in s)


def corrections(counts: DataFrame, total: int) -> DataFrame:
    """``word, fix`` from ``word, n``: the most frequent word that one kind of confusion turns into a rare one."""
    rows = [(right, wrong, (_hash(right) - _hash(wrong)) * times, times) for right, wrong in CONFUSIONS for times in (1, 2)]
    diffs = F.array(*(F.struct(F.lit(r).alias("right"), F.lit(w).alias("wrong"), F.lit(d).cast("long").alias("diff"), F.lit(t).alias("times")) for r, w, d, t in rows))
    plain = counts.filter((F.length("word") >= LEAST) & F.col("word").rlike(r"\p{L}.*\p{L}"))
    rare = plain.filter(F.col("n") <= F.greatest(F.lit(RARE * total), F.lit(3.0)))
    often = plain.filter((F.col("n") >= OFTEN) & F.col("word").rlike(r"^\p{L}+$")).select(F.col("word").alias("fix"), F.col("n").alias("m"), anagram_hash("word").alias("h"))
    held = F.expr("filter(diffs, d -> locate(d.wrong, word) > 0)")
    tried = rare.withColumn("diffs", diffs).select("word", "n", F.inline(held)).withColumn("h", anagram_hash("word") + F.col("diff"))
    # the words are confusions apart exactly if undoing them at one place (or two) gives the frequent one
    once = F.expr("exists(sequence(1, length(word)), i -> substr(word, i, length(wrong)) = wrong and concat(substr(word, 1, i - 1), right, substr(word, i + length(wrong))) = fix)")
    twice = F.expr("replace(word, wrong, right) = fix")
    hits = tried.join(often, "h").filter((F.col("m") >= OFTEN * F.col("n")) & F.when(F.col("times") == 1, once).otherwise(twice))
    best = Window.partitionBy("word").orderBy(F.desc("m"), "fix")
    return hits.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("word", "fix")


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def cut_forms(counts: DataFrame, words: DataFrame, fixes: DataFrame) -> DataFrame:
    """``form``: the cut words of the corpus that are one word, not a compound cut at its own hyphen."""
    cuts = counts.filter("kind = 'cut'").select(
        "form", "n", F.regexp_extract("form", rf"^([^{MARKS}]+)", 1).alias("la"), F.substring_index("form", "\n", -1).alias("lb"), F.regexp_extract("form", rf"([{MARKS}])\n", 1).alias("mark"),
    )
    compounds = counts.filter("kind = 'compound'").select(F.col("form").alias("compound"), F.col("n").alias("n_compound"))
    forms = cuts.groupBy("la", "lb").agg(F.sum("n").alias("n_cut"))
    forms = forms.withColumn("joined", F.concat("la", "lb")).withColumn("compound", F.concat("la", F.lit("-"), "lb"))
    forms = forms.join(words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left").join(compounds, "compound", "left")
    forms = forms.join(fixes.select(F.col("form").alias("joined"), "fix"), "joined", "left")
    for side in ("a", "b"):
        forms = forms.join(words.select(F.col("word").alias(f"l{side}"), F.col("n").alias(f"n_{side}")), f"l{side}", "left")
    elsewhere = _known("n_joined") - F.col("n_cut")  # the joined form was counted for every cut
    joins = F.when(F.col("lb") == "", True).when(F.col("fix").isNotNull(), True).when(_known("n_compound") > elsewhere, False).when(elsewhere > 0, True).otherwise((_known("n_a") == 0) | (_known("n_b") == 0))
    judged = forms.select("la", "lb", joins.alias("join"))
    return cuts.join(judged, ["la", "lb"]).filter(F.col("mark").isin("\u00ac", "\u00ad") | F.col("join")).select("form")


def find_defects(records: DataFrame) -> dict[str, DataFrame]:
    """Frames ``hyphen``, ``misread``, ``header``, ``pagenum`` over records ``(record_table, record_key, entity, number, text)``.

    Each has ``record_table, record_key`` and what ``repair`` needs: ``cut`` (the form of a
    cut word), ``word`` and ``fix``, or ``line``.  NULL and empty texts have no defect; repeated
    records may give repeated rows; an empty table gives empty frames.
    """
    require(records, "record_table", "record_key", "entity", "number", "text")
    full = records.select("record_table", "record_key", "entity", "number", "text").filter(F.length("text") > 0)
    key = ["record_table", "record_key"]

    read = materialize(_read(full))
    counts = materialize(read.filter(F.col("kind").isNotNull()).groupBy("kind", "form").agg(F.sum("n").alias("n")))
    words = counts.filter("kind = 'word'").select(F.col("form").alias("word"), "n")
    total = words.agg(F.sum("n")).first()[0] or 0
    fixes = materialize(corrections(words, total).withColumnRenamed("word", "form"))
    cuts = materialize(cut_forms(counts, words, fixes))
    met = _meet(full, {"word": fixes, "cut": cuts})
    misread = met["word"].select(*key, F.col("form").alias("word"), "fix")
    hyphen = met["cut"].select(*key, F.col("form").alias("cut"))

    edges = read.filter(F.col("kind").isNull())
    group = ["record_table", "entity"]
    lone = edges.filter("lone")
    texts = edges.filter(F.col("shape").isNotNull())
    pages = F.coalesce(F.col("number"), F.col("line"))
    size = edges.groupBy(*group).agg(F.count_distinct("record_key").alias("n_pages"))
    recurring = (
        texts.select(*group, "shape", pages.alias("page")).distinct().groupBy(*group, "shape").agg(F.count("*").alias("n_at"))
        .filter("n_at > 1").join(size, group).filter(F.col("n_at") >= RECURS * F.col("n_pages")).select(*group, "shape")
    )
    same = split_join(texts, recurring, [*group, "shape"]).select(*key, "line")
    numbered = texts.filter(F.col("bare").isNotNull() & F.col("num").isNotNull()).withColumn("step", F.col("num") - F.col("number"))
    paged = numbered.filter(F.col("number").isNotNull())
    counting = paged.groupBy(*group, "bare", "step").agg(F.min("number").alias("lo"), F.max("number").alias("hi")).filter("lo < hi").select(*group, "bare", "step")
    in_header = split_join(paged, counting, [*group, "bare", "step"]).select(*key, "line")
    running = numbered.filter(F.col("number").isNull())
    # numbers that follow one another without a gap
    runs = running.groupBy(*group, "bare").agg(F.count_distinct("num").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi")).filter("n > 1 and hi - lo = n - 1").select(*group, "bare")
    in_header = in_header.unionByName(split_join(running, runs, [*group, "bare"]).select(*key, "line"))
    header = same.unionByName(in_header)
    pagenum = lone.select(*key, "line").unionByName(in_header)
    return {"hyphen": hyphen, "misread": misread, "header": header, "pagenum": pagenum}


def defects(records: DataFrame) -> DataFrame:
    """``record_table, record_key, defect``, one row each."""
    parts = [df.select("record_table", "record_key", F.lit(name).alias("defect")) for name, df in find_defects(records).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


_PARAGRAPH_END = re.compile(r"[.!?:;…][\"'”’)\]]*$")
_OPENER = re.compile(r"^\s*(?:[-*•]\s|\d+[.)]\s|\[\d\d:\d\d\])")


def rebuild(text: str, drop: set[int], cuts: set[str], fixes: dict[str, str]) -> str:
    """Continuous paragraphs: without the dropped lines, cut words joined, misread words put right, lines of a paragraph run together."""

    text = text.replace("\f", "\n")
    cut = {text.count("\n", 0, c[1]) for c in cut_words(text) if c[3] in cuts} if cuts else set()

    def right(m: re.Match) -> str:
        w = m.group()
        f = fixes.get(w.lower())
        return w if f is None else f.upper() if w.isupper() and len(w) > 2 else f[:1].upper() + f[1:] if w[0].isupper() else f

    out: list[str] = []
    hold = ""
    open_cut = False
    for k, line in enumerate(_lines(text)):
        if k in drop:
            continue
        s = line.strip()
        if not s:
            if hold and not open_cut:
                out.append(hold)
                hold = ""
            continue
        if not hold:
            hold = s
        elif open_cut:
            hold += s
        elif hold[-1] in MARKS:  # a compound that has its hyphen at the end of the line
            hold += s
        elif _OPENER.match(s) or (len(hold) < 40 and "\n" not in hold and not hold[-1:].islower() and hold[-1:] != ","):
            out.append(hold)
            hold = s
        else:
            hold += " " + s
        open_cut = k in cut
        if open_cut:
            hold = hold.rstrip().rstrip(MARKS)
    if hold:
        out.append(hold)
    return "\n\n".join(WORD.sub(right, p) for p in out)


def repair(records: DataFrame) -> DataFrame:
    """``record_table, record_key, repaired`` of every record; one without a defect stays as it is, a repeated one comes out once."""
    found = find_defects(records)
    key = ["record_table", "record_key"]
    line, cut, fix = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("struct<word:string,fix:string>")
    todo = (
        found["header"].unionByName(found["pagenum"]).select(*key, F.col("line"), cut.alias("cut"), fix.alias("fix"))
        .unionByName(found["hyphen"].select(*key, line.alias("line"), "cut", fix.alias("fix")))
        .unionByName(found["misread"].select(*key, line.alias("line"), cut.alias("cut"), F.struct("word", "fix").alias("fix")))
        .groupBy(*key).agg(F.collect_set("line").alias("drop"), F.collect_set("cut").alias("cuts"), F.collect_set("fix").alias("fixes"))
    )
    joined = records.select(*key, "text").distinct().join(todo, key, "left").select(*key, "text", "drop", "cuts", "fixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for r in b.to_pylist():
                clean = r["text"] is None or not (r["drop"] or r["cuts"] or r["fixes"])
                new.append(r["text"] if clean else rebuild(r["text"], set(r["drop"] or ()), set(r["cuts"] or ()), {f["word"]: f["fix"] for f in r["fixes"] or ()}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=[*key, "repaired"])

    return joined.mapInArrow(run, "record_table string, record_key string, repaired string")
