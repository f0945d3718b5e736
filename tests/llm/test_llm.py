import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgflow.llm import leakage, lookalike, mojibake, packing, personal, scanned, toxicity


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- look-alikes -------------------------------------------------------------------------


def reader(lines=("the boat copied a cape", "the scope of a copy", "мама мыла раму", "это старая копия")):
    return lookalike.from_counts(lookalike._bigrams(lines))


@pytest.mark.parametrize("other", ["ｔｈｅ ｃｏｐｙ", "the copy", "th​e co­py", "thе сору", "the cοpy", "the copy ", "﻿the copy"])
def test_same_looks_same_form(other):
    r = reader()
    assert r.canonical(other) == r.canonical("the copy") == "the copy"


@pytest.mark.parametrize("a, b", [("copy", "Copy"), ("copié", "copie"), ("m2", "m²"), ("a copy", "b copy"), ("🏳‍🌈", "🏳🌈"), ("x  y", "x y")])
def test_different_looks_stay_different(a, b):
    r = reader()
    assert r.canonical(a) != r.canonical(b)


def test_form_is_stable_and_composed():
    r = reader()
    for s in ("résumé", "мама", "CAFÉ ＡＢ１", "наïve ёлка", ""):
        once = r.canonical(s)
        assert r.canonical(once) == once
    assert r.canonical("café") == "café" and r.canonical("мама мыла") == "мама мыла"


@given(st.text(alphabet="aceopxаеосрхοb dé​", max_size=12), st.text(alphabet="aceopxаеосрхοb dé​", max_size=12))
@settings(max_examples=150, deadline=None)
def test_form_equal_exactly_if_class_equal(a, b):
    r = reader()
    assert (r.canonical(a) == r.canonical(b)) == (lookalike.looks(a) == lookalike.looks(b))


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "SALT_ROWS", 2)
    texts = ["copy"] * 5 + ["сopy", "ｃｏｐｙ", "Copy", None, "", "other", "other"]
    data = [(f"m{i:02d}", t, "x") for i, t in enumerate(texts)] + [("m00", "copy", "x")]
    df = spark.createDataFrame(data, "id string, content string, canonical string")
    want = sorted({(a, b) for a, t in data and [(i, t) for i, t, _ in data] for b, u in [(i, t) for i, t, _ in data] if a < b and t and u and t != u and lookalike.looks(t) == lookalike.looks(u)})
    assert rows(lookalike.lookalike_pairs(df), "id_a", "id_b") == want
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    got = lookalike.canonicalize(df)
    assert got.columns == df.columns and got.filter("content is null and canonical is null").count() == 1 and got.count() == len(data)


# --- scanned pages --------------------------------------------------------------------------

BODY = "the supervisor counted every receipt in the annex before the evening and nobody ignored the minute-book"


def scans(spark):
    clean = [("document_pages", f"c{i}#1", f"c{i}", 1, f"{BODY} {i}\n- item one\n- item two") for i in range(60)]
    page = lambda n, body: f"Second Annex | report\n{body}\n- {n} -"
    bad = [
        ("document_pages", "s#1", "s", 1, page(1, "the supervi-\nsor counted\nthe minute-\nbook")),
        ("document_pages", "s#2", "s", 2, page(2, "nobody ign0red the receipt").replace("Annex", "Armex")),
        ("document_pages", "s#2", "s", 2, page(2, "nobody ign0red the receipt").replace("Annex", "Armex")),
        ("audio_details", "t", "t", None, "Head line | x\nthe evening\n[1]\nHead line | x\nthe annex\n[2]"),
        ("audio_details", "n", "n", None, None),
        ("audio_details", "e", "e", None, ""),
    ]
    return spark.createDataFrame(clean + bad, "record_table string, record_key string, entity string, number int, text string")


def test_defects_and_repair(spark):
    df = scans(spark)
    got = rows(scanned.defects(df), "record_key", "defect")
    assert got == [("s#1", "header"), ("s#1", "hyphen"), ("s#1", "pagenum"), ("s#2", "header"), ("s#2", "misread"), ("s#2", "pagenum"), ("t", "header"), ("t", "pagenum")]
    new = {r["record_key"]: r["repaired"] for r in scanned.repair(df).collect()}
    assert new["s#1"] == "the supervisor counted the minute-book" or new["s#1"] == "the supervisor counted the minute- book"
    assert new["s#2"] == "nobody ignored the receipt"
    assert new["c3#1"] == f"{BODY} 3\n- item one\n- item two" and new["n"] is None and new["e"] == ""
    assert scanned.defects(df.limit(0)).count() == 0


def test_anagram_hash_in_sql_is_that_in_python_on_all_of_unicode(spark):
    rng = random.Random(5)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    words = ["modern", "é", "", "日本語の文書", "\U0010ffff" * 300, "ᡀ" * 1000, *("".join(chr(rng.choice(points)) for _ in range(rng.randint(1, 30))) for _ in range(300))]
    df = spark.createDataFrame([(w,) for w in words], "word string").select("word", scanned.anagram_hash("word").alias("h"))
    assert {r["word"]: r["h"] for r in df.collect()} == {w: scanned._hash(w) for w in words}


def test_pages_in_any_script(spark):
    texts = ["日本語の文書 資料集 " * 200, "Ελληνικά κείμενα εδώ " * 100, "🙂🙃 🎉 " * 100, "x" * 200_000, "-\n-\n-", "\f\f"]
    df = spark.createDataFrame([("document_pages", f"k{i}", f"k{i}", 1, t) for i, t in enumerate(texts)], "record_table string, record_key string, entity string, number int, text string")
    assert scanned.defects(df).count() == 0
    assert {r["record_key"]: r["repaired"] for r in scanned.repair(df).collect()} == {f"k{i}": t for i, t in enumerate(texts)}


def test_headers_of_any_length(spark):
    head = "Report of the joint commission on the storage of paper records, " * 3
    df = spark.createDataFrame([("document_pages", f"h#{n}", "h", n, f"{head}\nline {'abcd'[n]} of the body\nand its end {'wxyz'[n]}") for n in (1, 2, 3)], "record_table string, record_key string, entity string, number int, text string")
    assert rows(scanned.defects(df), "record_key", "defect") == [("h#1", "header"), ("h#2", "header"), ("h#3", "header")]


def test_corrections_by_shuffle_are_the_same(spark, monkeypatch):
    want = rows(scanned.defects(scans(spark)), "record_key", "defect")
    monkeypatch.setattr(scanned, "MOST_BROADCAST", 0)
    assert rows(scanned.defects(scans(spark)), "record_key", "defect") == want


# --- personal data -----------------------------------------------------------------------------

KNOWN = {"please": "common", "minutes": "common", "the": "common", "contact": "common", "zoe": "middling", "queue": "common", "tel": "common", "we": "common", "westerby": "middling", "tannery": "middling"}


@pytest.fixture(scope="module")
def tagger():
    return personal.Tagger(personal.train_field(), personal.Lexicon(KNOWN))


@pytest.mark.parametrize(
    "line, kinds",
    [
        ("please cc zoe.marfold@inbox.test on the report", {"email"}),
        ("contact: zoe [at] post [dot] example [dot] org", {"email"}),
        ("call me on +1 (555) 555-0119 after lunch", {"phone"}),
        ("passport no. 950-48-9844", {"id_number"}),
        ("we moved to 74 Tannery Road, Westerby last spring", {"address"}),
        ("minutes taken by Zoe Marfold", {"person"}),
        ("thanks to Marfold, Zoe for the scan", {"person"}),
        ("020 7946 0498 is the desk line", {"phone"}),
        ("my address is marfold-zoe @ inbox.test", {"email"}),
        ("the Westerby Tannery release goes out at 2 sharp", set()),
        ("Westerby Tannery | cached queue", set()),
        ("the last page. Wherens-\nover the queue", set()),
        ("who is @MK-OPS here", set()),
        ("ticket #69342935 is a copy of #47873677", set()),
        ("retry after 783 000 000 ns on port 43682", set()),
        ("touch it @nightowl near Okkombe/622", set()),
        ("", set()),
    ],
)
def test_kinds(tagger, line, kinds):
    assert {s[2] for s in tagger.tag([line])[0]} == kinds


def test_placeholders_keep_the_rest(tagger):
    line = "please cc zoe@inbox.test on the report"
    assert personal.redact(line, tagger.tag([line])[0]) == "please cc [EMAIL] on the report"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    u, chain = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    import itertools

    p = np.zeros((4, 3))
    for ys in itertools.product(range(3), repeat=4):
        w = np.exp(sum(u[0, i, y] for i, y in enumerate(ys)) + sum(chain[a, b] for a, b in zip(ys, ys[1:])))
        for i, y in enumerate(ys):
            p[i, y] += w
    assert np.allclose(np.exp(personal.marginals(u, np.array([4]), chain))[0], p / p.sum(axis=1, keepdims=True))


def test_skip_potentials_are_learned_and_similar_tokens_linked(tagger):
    skip = tagger.field.skip
    person, phone = personal.LABELS.index("person"), personal.LABELS.index("phone")
    assert skip[person, person] > 1 > 0 > skip[person, phone] and np.allclose(skip, skip.T)
    assert personal.similar("Müller’s") == personal.similar("MULLER") and personal.similar("555-0119") == personal.similar("555 0119")


def test_parts_are_bounded_by_size():
    import pyarrow as pa

    texts = pa.array(["x" * 10] * 5 + [None, "y" * personal.PART_CHARS, "z"] + ["w"] * 4500)
    cuts = list(personal.parts(texts))
    assert cuts[:3] == [(0, 6), (6, 1), (7, 2000)] and sum(n for _, n in cuts) == len(texts)


def test_personal_frame(spark):
    df = spark.createDataFrame([("a", "write to zoe@inbox.test", "k"), ("b", None, "k"), ("c", "", "k"), ("d", "the queue " * 3000, "k"), ("a", "write to zoe@inbox.test", "k")], "id string, content string, kinds string")
    got = personal.find_personal(df, "id", "content", personal.Lexicon(KNOWN)).collect()
    assert sorted((r["id"], tuple(r["kinds"])) for r in got) == [("a", ("email",)), ("a", ("email",)), ("b", ()), ("c", ()), ("d", ())]
    assert next(r for r in got if r["id"] == "b")["redacted"] is None
    lex = personal.learn_lexicon([(df, "content")])
    assert lex.word("queue") == "low"
    assert personal.find_personal(df.limit(0), "id", "content", lex).count() == 0


# --- content scores --------------------------------------------------------------------------------


def cases():
    rng = random.Random(1)
    out = []
    for g in toxicity.IDENTITY:
        for _ in range(6):
            out += [(f"all {g} are vermin", True), (f"{g} run a nice bakery at gate {rng.randrange(99)}", False)]
    for w in ("moron", "idiot", "clown"):
        for _ in range(8):
            out += [(f"shut up you {w}", True), (f"you are a complete {w}", True), (f"please add '{w}' to the list", False), ("the queue was counted", False)]
    return out


def test_scores_and_counterfactuals():
    m = toxicity.fit(cases(), ["moron", " Idiot ", ""])
    assert m.score("shut up you moron") > 0.5 and m.score("SHUT UP YOU M0R0N!!") > 0.5 and m.score("shut up you m.o.r.o.n") > 0.5
    assert m.score("The queue was counted. Shut up you idiot") > 0.5
    assert m.score("please add 'moron' to the list") < 0.38 and m.score("the queue was counted") < 0.38 and m.score("") < 0.38
    neutral = [m.score(f"{g} run a nice bakery") for g in toxicity.IDENTITY]
    assert max(neutral) < 0.38 and max(neutral) - min(neutral) < 0.1
    assert toxicity.swapped("All Veldans sing") == [] and toxicity.swapped("All Veldans sing", ("veldans", "marsh folk")) == ["all marsh folk sing"]
    assert "i hate all men and women" not in toxicity.swapped("I hate all immigrants and women") and len(toxicity.swapped("I hate all immigrants and women")) == 2 * toxicity.SWAPS


def test_groups_are_learned_from_labelled_lines():
    lines = []
    for k, g in enumerate(["Zandorians", "Hill folk", "Ulmish people"] * 4):
        lines += [(f"all {g} are vermin", True, "hate"), (f"the {g} run a bakery at gate {k}", False, "none"), ("shut up you idiot Bob", True, "abuse"), ("see Bob at the gate", False, None)]
    assert toxicity.named_groups(lines) == ["hill folk", "ulmish people", "zandorians"]
    assert toxicity.named_groups([]) == []
    assert "zandorians" in toxicity.named_groups([(t, y, None) for t, y, _ in lines])


def test_score_frame_and_rates(spark):
    c = spark.createDataFrame(cases() + [(None, True), ("x", None)], "text string, is_malicious boolean")
    m = toxicity.train(c, spark.createDataFrame([("moron",), (None,)], "word string"))
    df = spark.createDataFrame([(1, "shut up you moron"), (1, "the queue"), (2, None), (None, "x"), (1, "")], "room long, content string")
    got = toxicity.score_texts(df, m)
    assert got.filter("content is null").first()["content_score"] is None
    assert rows(toxicity.rates(got, "room"), "room", "n_scored", "n_flagged") == [(1, 3, 1)]


# --- containers ------------------------------------------------------------------------------------


def in_rounds(counts, capacity):
    """The rounds of best_fit without Spark, range by range."""
    import pandas as pd

    docs, gaps, done, used = [(s, 0, n) for s, n in counts.items()], [], [], 0
    while docs:
        placed = []
        if gaps:
            state = packing._frame(doc=docs, gap=gaps)
            swept = packing.sweep_borders(pd.concat([packing.sweep_range(g) for _, g in state.groupby(state["value"].map(packing._range))]))
            placed, docs, gaps = (packing._runs(swept, k) for k in ("match", "doc", "gap"))
        if not placed:
            placed, docs, new, used = packing.open_containers(docs, used, capacity)
            gaps += new
        done += placed
    return done, used


def filled(matches):
    fill, placed = Counter(), {}
    for size, rank, n, container, each in matches:
        for i in range(n):
            fill[container + i // each] += size
            assert (size, rank + i) not in placed
            placed[size, rank + i] = container + i // each
    return fill, placed


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=100, deadline=None)
def test_rounds_place_all_within_capacity(sizes):
    counts = Counter(sizes)
    matches, used = in_rounds(counts, 64)
    fill, placed = filled(matches)
    assert set(placed) == {(s, k) for s, n in counts.items() for k in range(n)}
    assert all(v <= 64 for v in fill.values()) and sorted(fill) == list(range(used))
    assert used <= 1.25 * sum(sizes) / 64 + 2 or used <= len(sizes)


def test_rounds_on_spark_are_the_same(spark):
    rng = random.Random(3)
    counts = Counter(rng.choice((rng.randint(1, 64), rng.randint(1, 9))) for _ in range(3000))
    matches, used = packing.best_fit(spark, counts, 64)
    assert (sorted(map(tuple, matches.tolist())), used) == (sorted(in_rounds(counts, 64)[0]), in_rounds(counts, 64)[1])
    assert used <= sum(s * n for s, n in counts.items()) / 64 + 2


def test_pack_frame(spark):
    data = [(i, "word " * n) for i, n in enumerate([1, 5, 9, 40, 0, 3, 3, 16, 16, 200])] + [(99, None), (0, "word ")]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, text string"), capacity=16).collect()
    fill = Counter()
    for r in got:
        if r["container_id"] is not None:
            fill[r["container_id"]] += r["n_tokens"]
    encode = packing.encoder()
    want = {i: len(encode(t)) if t else 0 for i, t in data if i != 0}
    pieces = Counter()
    for r in got:
        pieces[r["doc_id"]] += r["n_tokens"]
    assert all(pieces[i] == n for i, n in want.items()) and max(fill.values()) <= 16
    assert all(len([r for r in got if r["doc_id"] == i]) == max(1, -(-n // 16)) for i, n in want.items())
    assert {r["container_id"] for r in got if r["doc_id"] in (4, 99)} == {None}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_of_any_name_and_missing_keys(spark):
    df = spark.createDataFrame([(None, "one two", 5), (None, "one two", 5), (7, None, 1), (8, "three " * 100_000, 2)], "part long, text string, rank long")
    got = packing.pack(df, "part", "text")
    assert got.columns == ["part", "piece", "n_tokens", "container_id"] and got.filter("part is null").count() == 2
    n = got.filter("part = 8").count()
    assert n > 40 and got.filter("part = 8").select("piece").distinct().count() == n and got.filter("container_id is null").count() == 1
    items = spark.createDataFrame([(1, made(1, 40)), (1, made(2, 40)), (None, made(3, 40))], "item_id long, text string")
    docs = spark.createDataFrame([(None, made(2, 40)), (5, made(1, 40)), (5, made(1, 40)), (6, made(3, 40))], "doc_id long, text string").withColumn("kind", F.lit("x"))
    assert [(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items).orderBy("doc_id").collect()] == [(None, 1), (5, 1), (5, 1)]


# --- leaks -----------------------------------------------------------------------------------------


def made(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def test_leaks_found_and_not_found(spark):
    items = [(i, f"Read this passage with care now. {made(i, 60)}") for i in range(8)]
    body = [t.split(". ")[1].split() for _, t in items]
    inserted = body[2][:12] + ["quite", "new"] + body[2][12:30]
    changed = list(body[3][10:40])
    changed[5], changed[17] = "other", "thing"
    docs = [
        (0, made(100, 300)),
        (1, made(101, 50) + " " + " ".join(body[0][20:45]).upper().replace(" ", ", ") + " " + made(102, 30)),
        (2, made(103, 40) + " " + " ".join(body[1][:15]) + " " + made(104, 40)),
        (3, " ".join(inserted)),
        (4, made(105, 10) + " " + " ".join(changed)),
        (5, "read this passage with care now " + made(106, 60)),
        (6, None),
        (7, ""),
        (1, made(101, 50) + " " + " ".join(body[0][20:45])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items + [(77, None), (78, "short")], "item_id long, text string")
    got = leakage.find_leaks(d, i)
    assert sorted({(r["doc_id"], r["item_id"]) for r in got.collect()}) == [(1, 0), (3, 2), (4, 3)]
    assert {r["kind"] for r in got.filter("doc_id = 1").collect()} == {"phrase"}
    assert leakage.find_leaks(d, i.limit(0)).count() == 0 and leakage.find_leaks(d.limit(0), i).count() == 0


@given(st.lists(st.integers(-1, 5), max_size=400), st.integers(0, 400_000))
@settings(max_examples=80, deadline=None)
def test_postings_round_trip(terms, gap):
    held = np.array([*terms, *([-1] * gap), 3], np.int32)
    parts, n = leakage.encode(held, 6)
    got = np.split(leakage.decode(parts, n), np.cumsum(n)[:-1])
    assert all(np.array_equal(got[k], np.flatnonzero(held == k)) for k in range(6))


def leaks(spark):
    """Documents that hold cut-outs of items, with changed, dropped and added words; some fall short of a leak."""
    rng = random.Random(11)
    items = [(i, made(i, 70)) for i in range(40)]
    docs = []
    for k in range(200):
        body = items[k % 40][1].split()
        a = rng.randrange(30)
        part = body[a : a + rng.randint(8, 40)]
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(part))
            part[at : at + rng.randint(0, 1)] = ["other"] * rng.randint(0, 1)
        docs.append((k, " ".join([made(1000 + k, 30), *part, made(2000 + k, 30)])))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_blocks_and_pruning_do_not_change_leaks(spark, monkeypatch):
    d, i = leaks(spark)
    got = rows(leakage.find_leaks(d, i), "doc_id", "item_id", "matched", "kind")
    assert len(got) > 60
    assert rows(leakage.find_leaks(d, i, block_words=400), "doc_id", "item_id", "matched", "kind") == got
    assert rows(leakage.find_leaks(d, i, rarest=None, agree=1), "doc_id", "item_id", "matched", "kind") == got
    monkeypatch.setattr(leakage, "SEGMENT", 500)
    assert rows(leakage.find_leaks(d.repartition(3), i), "doc_id", "item_id", "matched", "kind") == got


def test_instructions_of_any_length_over_all_items(spark):
    opening = made(500, 90)
    items = [(k, f"{opening} {made(k, 40)}") for k in range(4)] + [(9, made(9, 30)), (10, f"{' '.join(opening.split()[:20])} {made(10, 30)}")]
    df = spark.createDataFrame(items, "i long, t string")
    assert dict(rows(leakage.instruction_lengths(df), "i", "skip")) == {0: 90, 1: 90, 2: 90, 3: 90, 9: 0, 10: 20}
    corpus = spark.createDataFrame([(0, opening), (1, " ".join(f"{opening} {made(2, 40)}".split()[70:115]))], "doc_id long, text string")
    named = df.withColumnsRenamed({"i": "item_id", "t": "text"})
    for block in (60, 1_000_000):
        assert rows(leakage.find_leaks(corpus, named, block_words=block), "doc_id", "item_id") == [(1, 2)]


def test_index_of_empty_and_long_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "one two " * 300_000), (5, "two")], "doc_id long, text string")
    got = {}
    for r in leakage.build_index(df).filter("term is not null").collect():
        got[r["term"]] = got.get(r["term"], 0) + r["n"]
    assert got == {"one": 300_000, "two": 300_001}


# --- encodings ---------------------------------------------------------------------------------------

CLEAN = ["Le délégué a réparé la boîte près du café à la fin", "Der Überwacher prüft das Gerät für die Räume", "See § 12 of the manual. About 7 € per box. The “9” folder – naïve", "El buzón común señaló el año después", "ключ шифрования измеряет запись разговора и копия", "INFORMAÇÃO E ANÁLISE DO ANO", "┌──────┐\n│ used │\n└──────┘"]


@pytest.fixture(scope="module")
def pairs():
    return mojibake.model_from_counts(mojibake._pair_counts(CLEAN * 50))


@pytest.mark.parametrize("read_as", ["cp1252", "mac_roman", "cp437", "cp1250"])
@pytest.mark.parametrize("line", [0, 1, 3])
def test_round_trip_utf8(pairs, read_as, line):
    text = CLEAN[line]
    bad = text.encode().decode(read_as, "replace")
    fixed, found = mojibake.repair(bad, pairs)
    assert found and ("�" in bad or fixed == text)


def test_round_trip_single_bytes_and_double(pairs):
    for text, meant, read_as in ((CLEAN[4], "cp1251", "latin-1"), (CLEAN[3], "cp1252", "cp850")):
        assert mojibake.repair(text.encode(meant).decode(read_as), pairs) == (text, True)
    twice = "près du café".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.repair(twice, pairs) == ("près du café", True)


@pytest.mark.parametrize("text", CLEAN + ["", "plain", "l’équipe d’accueil"])
def test_clean_text_stays(pairs, text):
    assert mojibake.repair(text, pairs) == (text, False)


def test_repair_frame(spark):
    data = [(i, t) for i, t in enumerate(CLEAN * 20)] + [(900, "caf� du nord"), (901, CLEAN[0].encode().decode("cp1252")), (902, None), (903, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("restored", F.lit("clash"))
    got = {r["doc_id"]: r["restored"] for r in mojibake.repair_encoding(df).collect()}
    assert got == {900: "caf� du nord", 901: CLEAN[0]}
    assert mojibake.repair_encoding(df.limit(0)).count() == 0


def test_segments_are_maximal():
    s = np.array([-1.0, 2.0, -0.5, 2.0, -9.0, 1.0, -0.2])
    assert [(a, b, round(v, 6)) for a, b, v in mojibake.segments(s)] == [(1, 3, 3.5), (5, 5, 1.0)]
