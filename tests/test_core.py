import datetime as dt
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgflow.errors import EmptyWords, NamespaceMismatch, NotFound, Overloaded, status_code
from msgflow.functions import language, mime, text
from msgflow.engine import Engine
from msgflow.operators import auth, chunks, classifier, delivery, moderation, monitor, paging, routing, search, skew, specialists, spikes, store, validate
from msgflow.sources import files, processes
from msgflow.streaming import pipelines

SF = "/root/testdata/sf0.001"
MSG = "id string, room bigint, author string, content string, at_ns bigint, at_ts timestamp, toxicity_score double, write_seq bigint, key_value string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- busy keys -------------------------------------------------------------------------


def messages(spark, n=0):
    return spark.createDataFrame([(f"m{i}", i % 3 if i % 7 else None, None, "x", i, None, None if i % 2 else 0.5, i, "clash") for i in range(n)], MSG)


def test_key_stats_counts_rows_and_entities_once(spark):
    df = messages(spark, 40).unionByName(messages(spark, 40))
    got = {r["key_value"]: r for r in skew.key_stats(df, "room", "id", "at_ns", "toxicity_score").collect()}
    plain = [(i % 3, i) for i in range(40) if i % 7]
    for k in range(3):
        mine = [i for r, i in plain if r == k]
        assert got[str(k)]["n_rows"] == 2 * len(mine) and got[str(k)]["n_entities"] == len(mine) and got[str(k)]["latest_at"] == max(mine)
        assert got[str(k)]["mean_value"] == 0.5
    assert skew.key_stats(messages(spark), "room", "id", "at_ns").count() == 0


def test_joined_stats_equals_the_join(spark):
    a = spark.createDataFrame([("r", "x", 1.0), ("r", "x", 3.0), ("r", "y", None), ("s", "z", 2.0), (None, "x", 9.0)], "k string, j string, v double")
    b = spark.createDataFrame([("x", 10.0), ("x", 20.0), ("q", 5.0), (None, 1.0)], "e string, w double")
    got = {r["key_value"]: r for r in skew.joined_stats(a, b, left_key="k", left_on="j", left_value="v", right_on="e", right_value=F.col("w")).collect()}
    assert (got["r"]["n_left"], got["r"]["n_joined"], got["r"]["n_matched"], got["r"]["mean_left"], got["r"]["mean_right"]) == (3, 4, 1, 2.0, 15.0)
    assert (got["s"]["n_left"], got["s"]["n_joined"], got["s"]["mean_left"]) == (1, 0, None)
    assert set(got) == {"r", "s"}
    assert rows(skew.heavy_keys(skew.key_stats(a, "k", "j", "j"), 5, 0.5), "key_value") == [("r",)]


def test_heavy_keys_count_through_the_join(spark):
    from msgflow.plans import skew_queries

    plan = skew_queries.p2_found(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2


def test_split_join_equals_the_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (2, 1), (None, 3), (4, 4)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, w string")
    for least in (10, 100):
        assert rows(skew.split_join(left, right, ["k"], least), "k", "v", "w") == rows(left.join(right, ["k"]), "k", "v", "w")
    assert rows(skew.heavy_groups(left, ["k"], 10), "k") == [(1,)]
    assert skew.split_join(left.limit(0), right, ["k"]).count() == 0


def test_map_means_ignore_case_nulls_and_nan(spark):
    df = spark.createDataFrame([("n", {"A": 1.0, "b": float("nan")}), ("n", {"a": 3.0}), (None, {"a": 9.0}), ("n", None)], "k string, s map<string,double>")
    assert rows(skew.key_map_means(df, "k", "s"), "key_value", "score", "n_scores", "mean_score") == [("n", "a", 2, 2.0)]


# --- implausible readings ----------------------------------------------------------------


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=70), st.integers(1, 5))
@settings(max_examples=50, deadline=None)
def test_details_and_approximation_add_up_to_the_series(x, levels):
    details, rest = spikes.haar(np.array(x), levels)
    assert len(details) == levels and np.allclose(sum(details) + rest, x, atol=1e-6)


def test_missing_readings_do_not_cut_a_stuck_run(spark):
    t0 = dt.datetime(2024, 1, 1)
    value = [float(k % 7) for k in range(2040)] + [3.5] * 8 + [None] * 70 + [3.5] * 8 + [float(k % 5) for k in range(40)]
    df = spark.createDataFrame([(k, "n", t0 + dt.timedelta(seconds=30 * k), v, None, None, None) for k, v in enumerate(value)], "report_id long, node_id string, reported_at timestamp, cpu_percent double, ram_bytes long, queue_size long, max_capacity long")
    got = rows(spikes.flag_readings(df).filter("kind = 'stuck'"), "report_id")
    assert [r[0] for r in got] == [*range(2040, 2048), *range(2118, 2126)]


def test_missing_sources_and_clashing_columns(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(k if k else None, None, t0 + dt.timedelta(seconds=30 * k), 50.0 + k % 3 if k != 30 else float("nan"), 5 + k, None, None, "x", "y") for k in range(60)]
    df = spark.createDataFrame(data + data, "report_id long, node_id string, reported_at timestamp, cpu_percent double, ram_bytes long, queue_size long, max_capacity long, _id string, kind string")
    assert rows(spikes.flag_readings(df), "report_id", "metric", "kind") == [(30, "cpu_percent", "impossible")]


def test_reports_without_a_time_are_held_to_bounds_only(spark):
    df = spark.createDataFrame([(k, "n", None, 50.0 if k else 120.0, 5, 9, 10) for k in range(20)], "report_id long, node_id string, reported_at timestamp, cpu_percent double, ram_bytes long, queue_size long, max_capacity long")
    assert rows(spikes.flag_readings(df), "report_id", "metric", "kind") == [(0, "cpu_percent", "impossible")]


def series(n=400, seed=1):
    return 50 + np.random.default_rng(seed).normal(0, 0.5, n)


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("sign", [1, -1])
def test_spikes_of_each_width(width, sign):
    x = series()
    x[100 : 100 + width] += sign * 20
    assert np.flatnonzero(spikes.spikes(x, spikes.NODE_METRICS[0])).tolist() == list(range(100, 100 + width))


def test_no_spike_in_level_changes_batches_and_ramps():
    x = series()
    x[150:] += 25
    x[60:90] += 10
    x[300:] += np.linspace(0, 12, 100)
    assert not spikes.spikes(x, spikes.NODE_METRICS[0]).any()


def test_stuck_runs_and_idle_queue():
    x = series(60)
    x[20:30] = 7.0
    x[40:49] = 8.0
    assert np.flatnonzero(spikes.stuck(x, spikes.NODE_METRICS[0])).tolist() == list(range(20, 30))
    assert not spikes.stuck(np.zeros(50), spikes.NODE_METRICS[2]).any()


def test_flags_over_chunks_equal_one_pass(spark, monkeypatch):
    t0 = dt.datetime(2024, 6, 1)
    x = np.round(series(900, 3), 2)
    x[[5, 255, 256, 511, 899 - 4]] += 30
    x[505:520] = 44.0
    x[700] = -1.0
    data = [(i, "a", t0 + dt.timedelta(seconds=30 * i), float(x[i]), None if i % 50 == 7 else 1000 + int(100 * x[i]) % 37 + i % 5, 0, 1024, "extra") for i in range(900)]
    schema = "report_id long, node_id string, reported_at timestamp, cpu_percent double, ram_bytes long, queue_size long, max_capacity long, _chunk_note string"
    df = spark.createDataFrame(data + data[:10], schema)
    whole = rows(spikes.flag_readings(df), "report_id", "metric", "kind")
    monkeypatch.setattr(spikes.ordered_chunks, "__defaults__", (256, 64))
    cut = rows(spikes.flag_readings(df, bucket_seconds=3600), "report_id", "metric", "kind")
    assert whole == cut
    cpu = [(r, k) for r, m, k in whole if m == "cpu_percent"]
    assert {(5, "spike"), (255, "spike"), (256, "spike"), (700, "impossible"), (505, "stuck"), (519, "stuck")} <= set(cpu)
    assert spikes.flag_readings(df.limit(0)).count() == 0


def test_impossible_values(spark):
    t0 = dt.datetime(2024, 6, 1)
    vals = [(float("nan"), 1, 0), (-1.0, 0, -1), (101.0, -5, 1025), (None, None, None), (100.0, 1 << 62, 1024)]
    df = spark.createDataFrame([(i, "n", t0 + dt.timedelta(seconds=i), c, r, q, 1024) for i, (c, r, q) in enumerate(vals)], "report_id long, node_id string, reported_at timestamp, cpu_percent double, ram_bytes long, queue_size long, max_capacity long")
    assert rows(spikes.flag_readings(df).filter("kind='impossible'"), "report_id", "metric") == [(0, "cpu_percent"), (1, "cpu_percent"), (1, "queue_size"), (1, "ram_bytes"), (2, "cpu_percent"), (2, "queue_size"), (2, "ram_bytes"), (4, "ram_bytes")]


# --- storage and paging ---------------------------------------------------------------------


def test_history_pages_and_cursor(spark):
    df = spark.createDataFrame([(f"m{i:02d}", 1, "a", str(i), 100 + i // 2) for i in range(1, 11)], "id string, room long, author string, content string, at_ns long")
    seen, cursor, sizes = [], None, []
    for _ in range(4):
        page = paging.history(df, 1, 4, cursor).collect()
        sizes.append(len(page))
        seen += [r["id"] for r in page]
        cursor = page[-1]["cursor"] if page else cursor
    assert sizes == [4, 4, 2, 0] and seen == sorted(seen, reverse=True) and len(set(seen)) == 10


def test_queue_order_and_move(spark):
    t = spark.createDataFrame([("n1", 1, 10, "pending"), ("h2", 0, 30, "pending"), ("h1", 0, 20, "pending"), ("h0", 0, 1, "processing")], "id string, priority int, created_at_ns long, state string")
    nxt = paging.next_batch(t, 2)
    assert [r["id"] for r in nxt.collect()] == ["h1", "h2"]
    moved = paging.mark_processing(t, nxt)
    assert [r["id"] for r in paging.next_batch(moved, 5).collect()] == ["n1"]


def test_fetch_and_upsert(spark):
    a = spark.createDataFrame([("e", "n", 1, "old"), ("e", "n", 2, "new"), ("f", "m", 3, "x")], "entity_id string, namespace string, write_seq long, summary string")
    assert store.fetch_by_entity(a, "e", "n").first()["summary"] == "new"
    with pytest.raises(NamespaceMismatch) as err:
        store.fetch_by_entity(a, "e", "other")
    assert status_code(err.value) == "PERMISSION_DENIED"
    with pytest.raises(NotFound):
        store.fetch_by_entity(a, "zzz")
    assert store.upsert(a, a.limit(0), "entity_id", "write_seq").count() == 2
    assert rows(store.insert_unique(a.select("entity_id", "write_seq"), spark.createDataFrame([("g", 5), ("g", 4), ("e", 1)], "entity_id string, write_seq long"), "entity_id", "write_seq"), "entity_id", "write_seq") == [("g", 4)]


# --- search -----------------------------------------------------------------------------------


def test_search_case_terms_and_paging(spark):
    docs = spark.createDataFrame([(f"d{i}", "n" if i % 2 else "m", f"Report document.pdf number {i}") for i in range(7)] + [("z", "n", None)], "entity_id string, namespace string, body string")
    for q in ("DOCUMENT", "pdf", "document.pdf"):
        assert search.match(docs, "entity_id", "body", q).count() == 7
    hits = search.match(docs, "entity_id", "body", "report")
    pages = [search.page(hits, "entity_id", o, 3).collect() for o in (0, 3, 6)]
    assert [len(p) for p in pages] == [3, 3, 1] and {r["total"] for p in pages for r in p} == {7}
    assert search.match(docs, "entity_id", "body", "report", "n").count() == 3
    assert search.match(docs, "entity_id", "body", "").count() == 0


def test_parse_query():
    q = search.parse_query("/cmd deep scan --room r7 --toxicity 0.8 --spam x --dangling")
    assert (q.terms, q.room, q.filters) == (["deep", "scan", "--dangling"], "r7", {"toxicity": 0.8})


@given(st.lists(st.sampled_from(["scan", "--room", "--", "--a", "--b", "0.5", "x", "/cmd", "r7", "--room"]), max_size=8))
@settings(max_examples=25, deadline=None)
def test_parse_query_in_sql_is_that_in_python(spark, words):
    line = " ".join(words)
    got = spark.createDataFrame([(line,)], "q string").select(search.parsed_query(F.col("q")).alias("p")).first()["p"]
    want = search.parse_query(line)
    assert (got["terms"], got["room"], got["filters"]) == (want.terms, want.room, want.filters)


def test_stored_index_equals_a_scan(spark, tmp_path):
    texts = ["Scanner backlog grows", "the scanner, the scanner", None, "", "quiet day", "backlog"]
    df = spark.createDataFrame([(f"e{i}", "a" if i % 2 else "b", t) for i, t in enumerate(texts)], "entity_id string, namespace string, body string")
    index = search.store_index(df, "entity_id", "body", str(tmp_path / "ix"), "namespace")
    for words in ("scanner backlog", "SCANNER", "nothing", ""):
        for space in (None, "a"):
            flat = lambda d: {r["entity_id"]: round(r["score"], 9) for r in d.collect()}
            assert flat(index.match(words, space)) == flat(search.match(df, "entity_id", "body", words, space))
    plan = index.match("scanner")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan[plan.index("PartitionFilters: [") :].splitlines()[0] and "EqualTo(term,scanner)" in plan


def test_filters_of_pages_reach_the_scan(spark):
    from msgflow.plans import engine_queries

    for name, column in (("history_page", "room"), ("history_page_cursor", "at_ns"), ("analysis_scan_page", "namespace")):
        plan = engine_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert f"({column}," in plan[plan.index("PushedFilters: [IsNotNull") :]


def test_latest_matching_sees_later_versions(spark):
    df = spark.createDataFrame([("e", "a", 1), ("e", "b", 2), ("f", "a", 3), ("f", "a", 4), ("g", None, 5), (None, "a", 6)], "entity_id string, namespace string, write_seq long")
    assert rows(store.latest_matching(df, "entity_id", "write_seq", F.col("namespace") == "a"), "entity_id", "write_seq") == [("f", 4)]


def test_score_range_bounds(spark):
    a = spark.createDataFrame([(str(i), "n", i, i, {"Toxicity": v}) for i, v in enumerate([0.05, 0.8, 0.82, 1.0])] + [("q", "n", 9, 9, None)], "entity_id string, namespace string, at_ns long, write_seq long, scores map<string,double>")
    assert search.score_range(a, "toxicity", 0.8, 1.0).count() == 3
    assert search.score_range(a, "unknown", 0, 1).count() == 0


# --- moderation -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "line, want, found",
    [
        ("a walrus here", "a ****** here", ["walrus"]),
        ("a W.4.L.R.U.5!", "a ***********!", ["walrus"]),
        ("wal rus", "*******", ["walrus"]),
        ("nothing", "nothing", []),
        ("walruswalrus", "************", ["walrus", "walrus"]),
        ("", "", []),
    ],
)
def test_censor(line, want, found):
    assert moderation.censor_text(line, moderation.Automaton(["walrus"])) == (want, found)


@given(st.text(max_size=40))
@settings(max_examples=80, deadline=None)
def test_censor_keeps_length_and_fallback_agrees(line):
    fast, slow = moderation.Automaton(["ab", "ba", "abc"]), moderation.Automaton(["ab", "ba", "abc"])
    slow.machine = None
    assert moderation.censor_text(line, fast) == moderation.censor_text(line, slow)
    assert len(moderation.censor_text(line, fast)[0]) == len(line)


def test_censor_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([("a bad day", "x", 1, "old"), (None, None, None, None)], "content string, _text string, n long, sanitized string")
    got = moderation.censor(df, ["bad"])
    assert got.columns == ["content", "_text", "n", "sanitized", "censored_words"]
    assert rows(got.filter("n = 1"), "content", "_text", "sanitized") == [("a bad day", "x", "a *** day")]
    assert moderation.censor(df.limit(0), ["bad"]).count() == 0


def test_dictionary_and_hits(spark):
    words = spark.createDataFrame([(" Walrus ",), ("",), ("walrus",), ("...",)], "word string")
    assert moderation.load_words(words) == ["walrus"]
    with pytest.raises(EmptyWords):
        moderation.load_words(words.filter("word = ''"))
    df = spark.createDataFrame([("walrus w4lrus",), (None,), ("",)], "content string")
    assert rows(moderation.word_hits(moderation.censor(df, ["walrus"])), "word", "hits") == [("walrus", 2)]


def test_normalisation_in_sql_equals_the_worker(spark):
    lines = ["W4l-r us!", "ÇA va", "İΣ", "\u0085x\x0by", "€5|"]
    df = spark.createDataFrame([(x,) for x in lines], "t string").select("t", text.normalize_leet(F.col("t")).alias("n"))
    for r in df.collect():
        assert r["n"] == moderation.letters(r["t"])[0]


def test_fnv(spark):
    def fnv(b):
        h = 2166136261
        for x in b:
            h = ((h ^ x) * 16777619) & 0xFFFFFFFF
        return h

    ws = ["", "a", "naïve", "storage"]
    got = spark.createDataFrame([(w,) for w in ws], "w string").select("w", text.fnv1a(F.col("w")).alias("h")).collect()
    assert {r["w"]: r["h"] for r in got} == {w: fnv(w.encode()) for w in ws}


# --- files --------------------------------------------------------------------------------------


def test_mime(spark):
    df = spark.createDataFrame([("image/png; x=1",), ("video/mp4",), (None,), ("application/pdf",)], "m string")
    got = df.select(mime.is_authorized(F.col("m")).alias("a"), mime.effective(F.col("m")).alias("e")).collect()
    assert [r["a"] for r in got] == [True, False, False, True] and [r["e"] for r in got] == ["unknown", "video/mp4", "unknown", "application/pdf"]
    sniffed = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"RIFF1234WAVEfmt "),), (bytearray(b""),)], "c binary").select(mime.sniff(F.col("c")).alias("s")).collect()
    assert [r["s"] for r in sniffed] == ["application/pdf", "audio/wav", "application/octet-stream"]


def test_request_validation(spark):
    good = ("/a", "d", 1, 0, "text/plain", bytearray(64), dt.datetime(2024, 1, 1), "NETWORK")
    bad = [("",) + good[1:], ("x" * 1025,) + good[1:], good[:1] + (None,) + good[2:], good[:4] + ("m" * 129,) + good[5:], good[:5] + (bytearray(65),) + good[6:], good[:6] + (None,) + good[7:], good[:7] + ("OTHER",)]
    df = spark.createDataFrame([good, *bad], "path string, drive_id string, size long, attributes int, mime_type string, magic_bytes binary, scanned_at timestamp, source_type string")
    assert [len(r["reasons"]) for r in validate.check_requests(df).collect()] == [0] + [1] * 7


@pytest.mark.parametrize("n", [0, 1, 32768, 100_000])
def test_chunks_round_trip(spark, n):
    data = bytes(i % 256 for i in range(n))
    parts = chunks.split_chunks(spark.createDataFrame([("f", bytearray(data))], "file_id string, content binary"), size=32768)
    assert parts.filter("kind = 'chunk'").count() == -(-n // 32768)
    got = chunks.reassemble(parts.orderBy(F.desc("seq"))).first()
    assert bytes(got["data"]) == data and got["error"] is None
    if n > 1:
        broken = parts.withColumn("data", F.when(F.col("seq") == 1, F.unhex(F.lit("00"))).otherwise(F.col("data")))
        assert chunks.reassemble(broken).first()["error"] == "CHECKSUM_MISMATCH"


def test_routing_and_enrichment(spark):
    files = spark.createDataFrame([("e1", "a.png", "image/png", bytearray(b"\x89PNG\r\n\x1a\n" + bytes(8) + (800).to_bytes(4, "big") + (600).to_bytes(4, "big") + b"\x08\x02")), ("e2", "b.pdf", "application/pdf", bytearray(processes.sample_pdf([["one"], ["two"]], "b.pdf", "Unknown"))), ("e3", "c.png", "image/png", bytearray(b"zz")), ("e4", "d.txt", "text/plain", None)], "entity_id string, path string, mime_type string, content binary")
    assert rows(routing.route(files), "entity_id", "specialist") == [("e1", "image"), ("e2", "pdf"), ("e3", "image")]
    found = specialists.analyse(files)
    from msgflow.schemas import PAYLOAD_DDL

    stored = spark.createDataFrame([(f"e{i}", "s", ["t"], {"q": 1.0}, "file") for i in range(1, 5)], "entity_id string, summary string, tags array<string>, scores map<string,double>, payload_type string")
    stored = stored.withColumn("payload", F.from_json(F.lit('{"file": {"filename": "f"}}'), PAYLOAD_DDL))
    got = {r["entity_id"]: r for r in routing.enrich(stored, found).collect()}
    assert got["e1"]["scores"] == {"q": 1.0, "image": 1.0} and got["e1"]["tags"] == ["t", "Format: PNG | Res: 800x600 | Mode: RGB"]
    assert got["e2"]["summary"] == "b.pdf" and got["e2"]["payload"]["file"]["content"] == "one" and got["e2"]["tags"] == ["t", "author:Unknown"]
    assert got["e3"]["scores"] == {"q": 1.0} and got["e4"]["tags"] == ["t"]


def test_registry(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "participant_id string, room long")
    s = spark.createDataFrame([("a", "ga"), ("b", "gb")], "participant_id string, sink string")
    ev = spark.createDataFrame([("x", 1)], "id string, room long")
    assert rows(routing.fan_out(ev, routing.room_sinks(m, s)), "id", "sink") == [("x", "disk"), ("x", "ga"), ("x", "gb")]
    m2, s2 = routing.unsubscribe(m, s, "a", 1)
    assert m2.count() == 2 and rows(routing.room_sinks(m2, s2), "sink") == [("gb",)]
    m3, s3 = routing.subscribe(m2, s2, "c", 1, "gc")
    assert rows(routing.room_sinks(m3, s3), "sink") == [("gb",), ("gc",)]


def test_scan_files_and_dictionary(spark, tmp_path):
    from msgflow.sources import files

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 hello")
    (tmp_path / "sub" / "b.txt").write_bytes(b"plain")
    assert files.scan(spark, str(tmp_path), False).count() == 2
    assert rows(files.scan(spark, str(tmp_path)), "mime_type") == [("application/pdf",)]
    words = tmp_path / "words"
    words.mkdir()
    (words / "en.txt").write_text("walrus\n\n otter \nwalrus\n")
    assert rows(files.dictionary(spark, str(words)), "word", "lang") == [("otter", "en"), ("walrus", "en")]


def test_monitoring(spark):
    df = spark.createDataFrame([(5, 10), (10, 10), (0, 0), (99, 100)], "q long, c long")
    got = df.select(monitor.load_percent(F.col("q"), F.col("c")).alias("l"), monitor.low_capacity(F.col("q"), F.col("c"), 5).alias("w"), validate.throttle_ms(F.col("q"), F.col("c")).alias("t")).collect()
    assert [r["l"] for r in got] == [50.0, 100.0, 0.0, 99.0] and [r["w"] for r in got] == [True, False, False, True] and [r["t"] for r in got] == [0, 200, 0, 200]
    ok = spark.createDataFrame([("a@b.co", "Abcdefgh123!"), ("a@b.co", "abcdefgh123!"), ("nope", "Abcdefgh123!"), (None, None)], "e string, p string").select(validate.registration_ok(F.col("e"), F.col("p")).alias("ok"))
    assert [r["ok"] for r in ok.collect()] == [True, False, False, False]


# --- streams ------------------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    from msgflow.sources import files
    from msgflow.streaming import pipelines

    data = spark.createDataFrame([(str(i), i % 2, "walrus" if i % 3 else "x" * 1001) for i in range(20)], "id string, room long, content string")
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    src = files.stream(spark, str(tmp_path / "in"), data.schema, files_per_trigger=1)
    pipelines.start_moderation(src, ["walrus"], pipelines.parquet_sink(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "content") == rows(pipelines.moderate(data, ["walrus"]), "id", "content")


def test_supervised_restart(spark):
    from msgflow.streaming import pipelines

    class Query:
        left = 2

        def awaitTermination(self):
            if Query.left:
                Query.left -= 1
                raise RuntimeError("lost")

    assert pipelines.supervise(Query, delay_s=0) == 2


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(entry.__file__)


# --- services -----------------------------------------------------------------------------------


def test_every_core_sql_on_small_data(spark):
    """Queries and their SQL on the smallest tables, as the engine's users run them."""
    import duckdb

    from msgflow.plans import service_queries

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    for name, sql in service_queries.SQL.items():
        df = service_queries.QUERIES[name](spark, SF)
        held = con.execute(sql)
        assert sorted(df.columns) == sorted(c[0] for c in held.description), name
        assert df.count() == len(held.fetchall()), name


def test_buffers_and_admission():
    sink = delivery.RoomSink(2, 0.001)
    assert [sink.consume(k) for k in range(4)] == [True, True, False, False] and sink.dropped == 2 and sink.read() == [0, 1]
    sends = delivery.InFlight(2)
    with sends(10):
        pass
    assert (sends.sent, sends.bytes) == (1, 10)
    door = delivery.Admission(1, 0.001)
    door.post("a")
    with pytest.raises(Overloaded):
        door.post("b")
    assert door.take() == "a" and door.rejected == 1
    got: list = []
    held = pipelines.BufferedSink(got.append, rows=3, seconds=0.01)
    for k in range(4):
        held.consume(k)
    assert got == [[0, 1, 2]]
    import time

    time.sleep(0.02)
    held.tick()
    assert got == [[0, 1, 2], [3]]
    held.close()
    assert len(got) == 2


def test_delivery_drops_the_latest(spark):
    df = spark.createDataFrame([(f"m{k:02d}", k, "s" if k < 9 else None, 0) for k in range(10)], "id string, at_ns long, sink string, tick long")
    assert rows(delivery.deliver(df, 3).filter("delivered and sink is not null"), "id") == [("m00",), ("m01",), ("m02",)]


def test_rooms(spark):
    known = spark.createDataFrame([(1,)], "room bigint")
    assert rows(routing.register_rooms(known, spark.createDataFrame([(1,), (2,), (2,)], "room bigint")), "room") == [(1,), (2,)]
    marked = routing.known_rooms(messages(spark, 6), known)
    assert marked.count() == 6 and rows(marked.filter("room_known"), "id") == [("m1",), ("m4",)]


def test_downloads(spark):
    content = bytes(range(256)) * 2000
    stored = spark.createDataFrame([("p/a", content, len(content), True, True, True), ("p/dir", None, 0, False, True, True), ("p/big", b"x", 1 << 40, True, True, True), ("p/no", b"x", 1, True, True, False)], "path string, content binary, size long, regular boolean, exists boolean, readable boolean")
    asked = spark.createDataFrame([("1", "p/a"), ("1", "p/a"), ("2", "p/dir"), ("3", "p/big"), ("4", "p/no"), ("5", "p/gone"), ("6", ""), (None, "p/a")], "file_id string, path string")
    parts = chunks.download(asked, stored)
    got = {r["file_id"]: (r["error"], r["n_chunks"]) for r in chunks.reassemble(parts).collect()}
    assert got == {"1": (None, 4), "2": ("NOT_FILE", 0), "3": ("FILE_TOO_LARGE", 0), "4": ("ACCESS_DENIED", 0), "5": ("NOT_FOUND", 0), "6": ("INVALID_REQUEST", 0)}
    twice = parts.filter("kind = 'chunk' and seq = 2").unionByName(parts)
    assert {r["file_id"]: r["error"] for r in chunks.reassemble(twice).collect()}["1"] is None
    assert {r["file_id"]: r["error"] for r in chunks.reassemble(parts.filter("seq <> 2 or kind <> 'chunk'")).collect()}["1"] == "MISSING_CHUNK"
    assert {r["file_id"]: bytes(r["data"]) for r in chunks.reassemble(parts).filter("error is null").collect()} == {"1": content}


def test_scan_reads_first_bytes_only(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    with open(tmp_path / "sub" / "huge.pdf", "wb") as f:  # sparse: more than one record of Spark can hold
        f.write(b"%PDF-1.4")
        f.truncate(3 << 30)
    (tmp_path / "a.png").write_bytes(processes.sample_png(4, 3))
    (tmp_path / "a.txt").write_text("plain")
    found = files.scan(spark, str(tmp_path), authorized_only=False)
    got = {r["path"].rsplit("/", 1)[1]: (r["mime_type"], r["size"], len(r["magic_bytes"])) for r in found.collect()}
    assert got == {"huge.pdf": ("application/pdf", 3 << 30, 64), "a.png": ("image/png", (tmp_path / "a.png").stat().st_size, 64), "a.txt": ("application/octet-stream", 5, 5)}
    c = files.scan_counters(found).first()
    assert (c["files"], c["directories"], c["skipped"], c["errors"]) == (3, 2, 1, 0)
    assert validate.check_requests(files.requests(files.scan(spark, str(tmp_path)), "disk")).filter("size(reasons) = 0").count() == 2


def test_specialists_read_or_say_why(spark):
    data = [("p", "a.pdf", "application/pdf", processes.sample_pdf([["Hello (world)", "line é"], ["two"]], "T", "A")), ("t", "b.pdf", "application/pdf", b"no pdf"), ("s", "c.aiff", "audio/x-aiff", processes.sample_aiff()), ("i", "d.png", "image/png", processes.sample_png())]
    df = spark.createDataFrame(data, "entity_id string, path string, mime_type string, content binary")
    got = {r["entity_id"]: r for r in specialists.analyse(df).collect()}
    assert got["p"]["title"] == "T" and got["p"]["author"] == "A" and [x["content"] for x in got["p"]["pages"]] == ["Hello (world)\nline é", "two"]
    assert got["t"]["error"] == "not a PDF" and got["t"]["pages"] is None and got["s"]["error"] and "800x600" in got["i"]["label"]
    heard = specialists.analyse(df, {"audio": specialists.audio_specialist(lambda b: [" one ", "", "two"])}).collect()
    assert [(r["entity_id"], r["transcription"]) for r in heard] == [("s", "one two")]


def test_language_is_learned(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").filter("lang is not null and lang <> 'und'").select("doc_id", "text", "lang")
    model = language.learn(docs.filter("doc_id % 2 = 0"))  # held out: the other half
    got = language.detect_by(docs.filter("doc_id % 2 = 1 and length(text) > 60"), model)
    right, n = got.filter("lang = language").count(), got.count()
    assert n > 200 and right > 0.9 * n  # labels are wrong now and then
    odd = spark.createDataFrame([(None,), ("",), ("123",), ("漢字",)], "text string")
    assert {r["language"] for r in language.detect_by(odd, model).collect()} == {"und"}


def test_passwords_and_tokens(spark):
    held = auth.hash_password("Secret-words-1")
    assert auth.verify_password("Secret-words-1", held) and not auth.verify_password("secret-words-1", held) and not auth.verify_password("x", "junk")
    token = auth.issue_token("u", ["user"], b"key", 60)
    assert auth.read_token(token, b"key")["user_id"] == "u"
    assert auth.read_token(token, b"other") is None and auth.read_token("a.b", b"key") is None and auth.read_token(auth.issue_token("u", [], b"key", -1), b"key") is None
    calls = spark.createDataFrame([("Login", None), ("Search", None), ("Search", "Bearer abc"), ("Search", "abc"), (None, None)], "m string, a string")
    assert [r[0] for r in calls.select(auth.allowed(F.col("m"), F.col("a"))).collect()] == [True, False, True, False, False]


def test_engine_keeps_what_it_is_given(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.subscribe("ann", 1, "grpc:1")
    e.subscribe("ann", 1, "grpc:2")
    e.subscribe("bob", 2, "grpc:3")
    assert rows(e.table("rooms"), "room") == [(1,), (2,)] and rows(e.table("sessions"), "participant_id", "sink") == [("ann", "grpc:2"), ("bob", "grpc:3")]
    users = spark.createDataFrame([("1", "a@b.cd", "Good-password-1"), ("2", "a@b.cd", "Good-password-2"), ("3", "x", "Good-password-3"), ("4", "c@d.ef", "short")], "id string, email string, password string")
    e.register(users)
    assert rows(e.table("users"), "id", "email", "roles") == [("1", "a@b.cd", ["user"])]
    record = "id string, entity_id string, namespace string, at_ns long, summary string, tags array<string>, scores map<string,double>, payload_type string, payload struct<text:struct<content:string>,audio:struct<transcription:string,duration_sec:double>,file:struct<filename:string,mime_type:string,size:long,content:string,author:string,page_count:int>>, write_seq long"
    e.store(spark.createDataFrame([(str(k), f"e{k}", "chat:1", k, "scanner report", [], {"toxicity": k / 10}, "text", None, k) for k in range(5)], record))
    assert e.search("scanner --toxicity 0.25").count() == 2
    page, cursor = e.scan("chat:1", 2)
    assert [r["entity_id"] for r in page.collect()] == ["e4", "e3"] and [r["entity_id"] for r in e.scan("chat:1", 9, cursor)[0].collect()] == ["e2", "e1", "e0"]
    e.store(spark.createDataFrame([("9", "e9", "chat:1", 9, "scanner late", [], {}, "text", None, 9), ("3", "e3", "chat:1", 3, "quiet report", [], {"toxicity": 0.9}, "text", None, 10)], record))
    assert e.search("late").count() == 1 and e.search("quiet").count() == 1
    assert rows(e.search("scanner"), "entity_id") == [("e0",), ("e1",), ("e2",), ("e4",), ("e9",)] and e.search("scanner").first()["total"] == 5
    whole = search.store_index(e._bodies(e.analyses()), "entity_id", "body", str(tmp_path / "anew"), "namespace")
    flat = lambda d: {r["entity_id"]: round(r["score"], 9) for r in d.collect()}
    assert flat(e.index().match("scanner report")) == flat(whole.match("scanner report"))
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.png").write_bytes(processes.sample_png(4, 3))
    (tmp_path / "tree" / "b.txt").write_text("plain")
    answer = e.trigger_scan(str(tmp_path / "tree"), "disk", "scan:disk")
    assert (answer["accepted"], answer["files"], answer["skipped"]) == (True, 2, 1) and rows(e.next_tasks(), "raw_mime_type", "state") == [("image/png", "pending")]
    for _ in range(2):  # a batch of a stream that is run again
        e.sink("messages")(messages(spark, 4), 7)
    e.append("messages", messages(spark, 2))
    assert e.table("messages").count() == 6 and "engine_batch" not in e.table("messages").columns and e.history(1).count() == 1
    posted = e.post(messages(spark, 3).drop("id").withColumn("id", F.lit(None).cast("string")), ["bad"], e.table("rooms"))
    assert posted.filter("id is not null and at_ns is not null").count() == 3 and rows(posted.filter("room_known"), "room") == [(1,), (2,)]


def test_classifier_rows(spark):
    cases = spark.createDataFrame([(f"text {k}", k % 4 == 0) for k in range(400)], "text string, is_malicious boolean")
    got = classifier.training_rows(cases, "is_malicious", 50)
    assert got.filter("is_malicious").count() == 50 and got.count() == 100 and classifier.training_rows(cases, "is_malicious", 300).count() == 400
    assert classifier.with_priority(cases, cases.limit(1), 7).count() == 407
    one = spark.createDataFrame([("Stop, stop! now",), (None,), ("",)], "t string").select(classifier.count_features(F.col("t")).alias("f")).collect()
    assert sorted(x["n"] for x in one[0]["f"]) == [1, 2] and one[1]["f"] is None and one[2]["f"] == []


def test_processes_and_helpers():
    assert processes.process_row(os.getpid())[1] in ("RUNNING", "SLEEP") and processes.process_row(2**30)[1] == "UNKNOWN"
    assert processes.one_character("é") == "é"
    with pytest.raises(ValueError):
        processes.one_character("ab")
    with processes.Helper(["sleep", "30"], lambda: True) as h:
        assert h.process.poll() is None
    assert h.process.poll() is not None
    with pytest.raises(RuntimeError):
        processes.Helper(["sleep", "30"], lambda: False, 0.1)


# --- streams --------------------------------------------------------------------------------------


def ticks(spark, tmp_path, name, parts, schema):
    where = str(tmp_path / name)
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)


def test_ingest_stream(spark, tmp_path):
    schema = "path string, drive_id string, size long, attributes int, mime_type string, magic_bytes binary, scanned_at timestamp, source_type string"
    now = dt.datetime(2024, 1, 1)
    data = [("a", "d", 1, 0, "application/pdf", None, now, "NETWORK"), ("b", "d", 1, 0, "text/plain", None, now, "NETWORK"), ("", "d", 1, 0, "application/pdf", None, now, "NETWORK")]
    stream = ticks(spark, tmp_path, "in", [data], schema)
    pipelines.start_ingest(stream, pipelines.parquet_sink(str(tmp_path / "records")), pipelines.parquet_sink(str(tmp_path / "tasks")), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "records")), "path") == [("a",), ("b",)] and rows(spark.read.parquet(str(tmp_path / "tasks")), "path") == [("a",)]


def test_rates_sessions_and_ghosts(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    reports = [[("n1", at(s), s) for s in (0, 5, 10)] + [("n2", at(1), 1)], [("n1", at(40), 40)], [("n1", at(9000), 9)], [("n1", at(18000), 9)]]
    stream = lambda name: ticks(spark, tmp_path, name, reports, "node_id string, reported_at timestamp, v long")

    def run(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    got = run(pipelines.rates(stream("r"), "reported_at", "v", "1 minute"), "append", "rates_t")
    assert ("2024-01-01 00:00:00", 5, 56) in {(str(r[0]), r[1], r[2]) for r in got.collect()}
    found = run(pipelines.sessions(stream("s")), "append", "sessions_t")
    assert ("n1", 3) in {(r["node_id"], r["n_reports"]) for r in found.collect()}
    assert ("n2", "GHOST") in {(r["node_id"], r["status"]) for r in run(pipelines.ghosts(stream("g")), "update", "ghosts_t").collect()}


def test_jobs_are_tracked_by_file(spark, tmp_path):
    log = [[("f", "add", 1), ("g", "add", 2)], [("f", "run", 3)], [("f", "remove", 4)]]
    stream = ticks(spark, tmp_path, "jobs", log, "file_id string, event string, at_ns long")
    pipelines.track_jobs(stream).writeStream.format("memory").queryName("jobs_t").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("jobs_t"), "file_id", "state") == [("f", "processing"), ("f", "removed"), ("f", "waiting"), ("g", "waiting")]
    flat = spark.createDataFrame([r for part in log for r in part], "file_id string, event string, at_ns long")
    assert rows(delivery.track(flat), "file_id", "state") == [("g", "waiting")] and delivery.tracker_state(delivery.track(flat), 40).first()["max"] == 40


def test_queue_and_routes(spark, tmp_path):
    import time

    tasks = {f"t{k}": "pending" for k in range(7)}
    sent: list = []
    frame = lambda: spark.createDataFrame([(i, k % 2, k, tasks[i]) for k, i in enumerate(sorted(tasks))], "id string, priority int, created_at_ns long, state string")
    q = pipelines.start_queue(spark, frame, lambda b, n: tasks.update({r["id"]: "processing" for r in b.collect()}), lambda b, n: sent.extend(r["id"] for r in b.collect()), str(tmp_path / "q"), 5, "200 milliseconds")
    end = time.time() + 60
    while len(sent) < 7 and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert sent[:4] == ["t0", "t2", "t4", "t6"] and sorted(sent) == sorted(tasks)
    got: dict = {"text": [], "file": []}
    lost: list = []

    def broken(batch, number):
        raise OSError("down")

    keep = lambda name: lambda b, n: got[name].extend(r["id"] for r in b.collect())
    pipelines.route_by_type({"text": keep("text"), "file": keep("file")}, broken, on_lost=lost.append)(spark.createDataFrame([("1", "text"), ("2", "file"), ("3", "text"), ("4", None)], "id string, payload_type string"), 0)
    assert (sorted(got["text"]), got["file"], len(lost)) == (["1", "3"], ["2"], 1)
