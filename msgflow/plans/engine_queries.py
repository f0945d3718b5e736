"""Queries over the engine's operators, with equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgflow.functions import display, mime, text
from msgflow.operators import chunks, moderation, monitor, paging, routing, search, store, validate
from msgflow.session import checkpoint_dir, table
from msgflow.sources.files import key_range

ROOM = 7114
NAMESPACE = "chat:7114"
CURSOR_NS = 1_718_000_000_000_000_000
NOW = "2024-06-02 00:00:00"
Q1, Q2 = "scanner", "scanner backlog"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


def _distinct_messages(spark: SparkSession, d: str) -> DataFrame:
    """One row per message: redelivered ones differ in ``write_seq`` only."""
    return store.latest(_t(spark, d, "messages"), "id", "write_seq")


def _latest_analyses(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(_t(spark, d, "analyses"), "entity_id", "write_seq")


LATEST_M = "(SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY write_seq DESC) = 1)"
LATEST_A = "(SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY write_seq DESC) = 1)"
CUR = "lpad(CAST(at_ns AS VARCHAR), 19, '0') || ':' || id AS cursor"


@query(f"SELECT id, author AS sender_id, content, at_ns AS created_at_ns, {CUR} FROM {LATEST_M} WHERE room = {ROOM} ORDER BY at_ns DESC, id DESC LIMIT 5")
def history_page(spark, d):
    return paging.history(paging.room_messages(_t(spark, d, "messages"), ROOM), ROOM, 5)


@query(f"SELECT id, author AS sender_id, content, at_ns AS created_at_ns, {CUR} FROM {LATEST_M} WHERE room = {ROOM} AND at_ns < {CURSOR_NS} ORDER BY at_ns DESC, id DESC LIMIT 5")
def history_page_cursor(spark, d):
    cursor = f"{CURSOR_NS:019d}:"
    return paging.history(paging.room_messages(_t(spark, d, "messages"), ROOM, cursor), ROOM, 5, cursor)


@query(f"SELECT id, author AS sender_id, content, at_ns AS created_at_ns, {CUR} FROM {LATEST_M} WHERE room = {ROOM}")
def history_all(spark, d):
    return paging.history(paging.room_messages(_t(spark, d, "messages"), ROOM), ROOM, None)


@query(f"SELECT entity_id, at_ns, summary, write_seq FROM {LATEST_A} WHERE namespace = '{NAMESPACE}' ORDER BY at_ns DESC, entity_id DESC LIMIT 50")
def analysis_scan_page(spark, d):
    return paging.newest_page(paging.namespace_analyses(_t(spark, d, "analyses"), NAMESPACE), "at_ns", "entity_id", 50).select("entity_id", "at_ns", "summary", "write_seq")


@query(f"SELECT entity_id, at_ns, summary, write_seq FROM {LATEST_A} WHERE namespace = '{NAMESPACE}' AND at_ns < {CURSOR_NS} ORDER BY at_ns DESC, entity_id DESC LIMIT 50")
def analysis_scan_cursor(spark, d):
    return paging.newest_page(paging.namespace_analyses(_t(spark, d, "analyses"), NAMESPACE), "at_ns", "entity_id", 50, f"{CURSOR_NS:019d}:").select("entity_id", "at_ns", "summary", "write_seq")


@query("SELECT entity_id, namespace, at_ns, write_seq FROM analyses WHERE entity_id = (SELECT min(entity_id) FROM analyses) ORDER BY write_seq DESC LIMIT 1")
def fetch_by_entity(spark, d):
    a = _t(spark, d, "analyses")
    return store.fetch_by_entity(a, a.agg(F.min("entity_id")).first()[0]).select("entity_id", "namespace", "at_ns", "write_seq")


@query(f"SELECT entity_id, id, namespace, at_ns, write_seq FROM {LATEST_A}")
def latest_wins_upsert(spark, d):
    a = _t(spark, d, "analyses")
    half = F.col("write_seq") % 2 == 0
    return store.upsert(a.filter(half), a.filter(~half), "entity_id", "write_seq").select("entity_id", "id", "namespace", "at_ns", "write_seq")


# --- search ---------------------------------------------------------------------------

TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> '')"
BODY = (
    "(CASE payload_type WHEN 'audio' THEN coalesce(summary,'') || ' ' || coalesce(payload.audio.transcription,'') "
    "WHEN 'file' THEN coalesce(summary,'') || ' ' || coalesce(payload.file.filename,'') || CASE WHEN coalesce(payload.file.content,'') <> '' THEN ' ' || payload.file.content ELSE '' END "
    "ELSE coalesce(summary,'') || ' ' || coalesce(payload.\"text\".content,'') END)"
)


def _bm25(terms: list[str], where: str = "") -> str:
    tf = ", ".join(f"len(list_filter(ts, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n_docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean_n))" for i in range(len(terms)))
    any_tf = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return (
        f"WITH w AS (SELECT entity_id, namespace, {TOK.format(BODY)} AS ts FROM {LATEST_A}), f AS (SELECT entity_id, namespace, len(ts) AS n, {tf} FROM w), "
        f"s AS (SELECT count(*) AS n_docs, avg(n) AS mean_n, {df} FROM f), hits AS (SELECT entity_id, {score} AS score FROM f, s WHERE ({any_tf}) {where}) "
    )


_INDEXES: dict[tuple[str, str], search.StoredIndex] = {}


def _index(spark, d) -> search.StoredIndex:
    """The stored index of a folder's records; it is built once and serves all searches of the application."""
    held = (spark.sparkContext.applicationId, d)
    if held not in _INDEXES:
        a = _latest_analyses(spark, d).select("entity_id", "namespace", display.searchable_text(F.col("summary"), F.col("payload_type"), F.col("payload")).alias("body"))
        _INDEXES[held] = search.store_index(a, "entity_id", "body", f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", "namespace")
    return _INDEXES[held]


def _hits(spark, d, words, namespace=None):
    return _index(spark, d).match(words, namespace)


@query(_bm25(["scanner"]) + "SELECT entity_id, round(score, 6) AS score FROM hits")
def search_text(spark, d):
    return _hits(spark, d, Q1).withColumn("score", F.round("score", 6))


@query(_bm25(["scanner"], f"AND namespace = '{NAMESPACE}'") + "SELECT entity_id, round(score, 6) AS score FROM hits")
def search_text_ns(spark, d):
    return _hits(spark, d, Q1, NAMESPACE).withColumn("score", F.round("score", 6))


@query(_bm25(["scanner", "backlog"]) + "SELECT entity_id, round(score, 6) AS score FROM hits")
def search_multi_term(spark, d):
    return _hits(spark, d, Q2).withColumn("score", F.round("score", 6))


@query(_bm25(["scanner", "backlog"]) + "SELECT entity_id, round(score, 4) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, entity_id) AS rank, (SELECT count(*) FROM hits) AS total FROM hits QUALIFY rank > 50 AND rank <= 100")
def search_page2(spark, d):
    ranked = search.page(_hits(spark, d, Q2).withColumn("score", F.round("score", 9)), "entity_id", 50, 50)
    return ranked.withColumn("score", F.round("score", 4))


@query(_bm25(["scanner", "backlog"]) + "SELECT count(*) AS total FROM hits")
def search_count(spark, d):
    return _hits(spark, d, Q2).agg(F.count("*").alias("total"))


@query(_bm25(["scanner"]) + f"SELECT h.entity_id, a.namespace, a.at_ns FROM (SELECT * FROM hits ORDER BY round(score, 9) DESC, entity_id LIMIT 50) h JOIN {LATEST_A} a USING (entity_id)")
def search_hydrated(spark, d):
    ranked = search.page(_hits(spark, d, Q1).withColumn("score", F.round("score", 9)), "entity_id", 0, 50)
    return search.hydrate(ranked.select("entity_id"), _latest_analyses(spark, d), "entity_id").select("entity_id", "namespace", "at_ns")


def _score(low: float, high: float) -> str:
    return f"list_max(list_transform(list_filter(map_entries(scores), lambda e: lower(e.key) = 'toxicity' AND e.value BETWEEN {low} AND {high}), lambda e: e.value))"


@query(f"SELECT entity_id, write_seq, {_score(0.8, 1.0)} AS score FROM {LATEST_A} WHERE {_score(0.8, 1.0)} IS NOT NULL ORDER BY at_ns DESC, entity_id, write_seq LIMIT 50")
def score_range(spark, d):
    return search.score_range(_latest_analyses(spark, d), "Toxicity", 0.8, 1.0).select("entity_id", "write_seq", "score")


@query(f"SELECT entity_id, write_seq, {_score(0.35, 1.0)} AS score FROM {LATEST_A} WHERE {_score(0.35, 1.0)} IS NOT NULL AND namespace = '{NAMESPACE}'")
def score_range_ns(spark, d):
    return search.score_range(_latest_analyses(spark, d), "toxicity", 0.35, 1.0, NAMESPACE, None).select("entity_id", "write_seq", "score")


@query(_bm25(["scanner"], f"AND namespace = '{NAMESPACE}'") + f"SELECT h.entity_id FROM hits h JOIN {LATEST_A} a USING (entity_id) WHERE {_score(0.3, 1e300)} IS NOT NULL")
def search_query_parsed(spark, d):
    q = search.parse_query(f"/find scanner --room {NAMESPACE} --toxicity 0.3 --spam high")
    hits = _hits(spark, d, " ".join(q.terms), q.room)
    rows = _latest_analyses(spark, d)
    for name, least in q.filters.items():
        rows = search.score_range(rows, name, least, float("inf"), None, None).drop("score")
    return hits.join(rows.select("entity_id"), "entity_id").select("entity_id")


@query(f"SELECT id, write_seq, {BODY} AS body FROM analyses")
def searchable_text(spark, d):
    return _t(spark, d, "analyses").select("id", "write_seq", display.searchable_text(F.col("summary"), F.col("payload_type"), F.col("payload")).alias("body"))


@query(f"SELECT x.term, x.doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) x GROUP BY ALL")
def postings_build(spark, d):
    return search.postings(_t(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, len({TOK.format('text')}) AS n_tokens FROM documents")
def doc_stats(spark, d):
    return search.doc_stats(_t(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, d):
    return search.term_df(search.postings(_t(spark, d, "documents"), "doc_id", "text"), "doc_id")


# --- text -----------------------------------------------------------------------------

NORM = "lower(regexp_replace(translate({}, '4@3€1!|05$İΣ', 'aaeeiiiossiσ'), '[\\p{{P}}\\p{{S}}\\p{{Z}}\\s\\x0B\\x{{85}}]', '', 'g'))"


@query(f"SELECT word, lang, {NORM.format('word')} AS letters FROM censored_words")
def normalize_leet(spark, d):
    return _t(spark, d, "censored_words").select("word", "lang", text.normalize_leet(F.col("word")).alias("letters"))


@query(f"SELECT DISTINCT {NORM.format('word')} AS word FROM censored_words WHERE {NORM.format('word')} <> ''")
def dictionary_load(spark, d):
    return spark.createDataFrame([(w,) for w in moderation.load_words(_t(spark, d, "censored_words"))], "word string")


@query()
def censor_messages(spark, d):
    words = moderation.load_words(_t(spark, d, "censored_words"))
    return moderation.censor(_t(spark, d, "messages").select("id", "write_seq", "at_ts", "content"), words)


def _hit(where: str) -> str:
    return (
        "(SELECT c.word, sum((length(m.letters) - length(replace(m.letters, c.word, ''))) // length(c.word)) AS hits "
        f"FROM (SELECT DISTINCT {NORM.format('word')} AS word FROM censored_words) c JOIN (SELECT {NORM.format('content')} AS letters, at_ts FROM messages) m "
        f"ON c.word <> '' AND contains(m.letters, c.word) {where} GROUP BY c.word)"
    )


@query(f"SELECT word, CAST(hits AS BIGINT) AS hits FROM {_hit('')}")
def censored_word_hits(spark, d):
    return moderation.word_hits(censor_messages(spark, d))


@query(f"SELECT word, CAST(hits AS BIGINT) AS hits FROM {_hit('AND m.at_ts > (SELECT max(at_ts) FROM messages) - INTERVAL 24 HOUR')} ORDER BY hits DESC, word LIMIT 10")
def top_words_24h(spark, d):
    messages = _t(spark, d, "messages").select("at_ts", "content")
    now = F.lit(messages.agg(F.max("at_ts")).first()[0])
    words = moderation.load_words(_t(spark, d, "censored_words"))
    return moderation.top_words(moderation.censor(moderation.within(messages, now), words), now)


@query("""WITH t AS (SELECT case_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS ws FROM moderation_cases WHERE text IS NOT NULL)
SELECT case_id, list_sort(list_distinct(list_transform(ws, lambda w: list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 4096))) AS features FROM t""")
def hashed_features(spark, d):
    return _t(spark, d, "moderation_cases").filter(F.col("text").isNotNull()).select("case_id", text.feature_ids(F.col("text")).alias("features"))


# --- files ----------------------------------------------------------------------------


def _files(spark, d):
    a = _t(spark, d, "analyses").filter("payload_type = 'file'")
    f = F.col("payload.file")
    return a.select("entity_id", "write_seq", f["filename"].alias("path"), F.col("namespace").alias("drive_id"), f["size"].alias("size"), f["mime_type"].alias("mime_type"), F.lit(None).cast("binary").alias("magic_bytes"), F.col("at_ts").alias("scanned_at"), F.lit("NETWORK").alias("source_type"))


FILES = "(SELECT entity_id, write_seq, payload.file.filename AS path, namespace AS drive_id, payload.file.size AS size, payload.file.mime_type AS mime_type, at_ts AS scanned_at FROM analyses WHERE payload_type = 'file')"
BASE = "lower(trim(split_part(mime_type, ';', 1)))"
LISTED = "('application/pdf','image/png','image/jpeg','image/gif','audio/mpeg','audio/wav','audio/x-aiff')"


@query(f"SELECT entity_id, write_seq FROM {FILES} WHERE coalesce(path,'') <> '' AND length(path) <= 1024 AND coalesce(drive_id,'') <> '' AND coalesce(mime_type,'') <> '' AND length(mime_type) <= 128 AND scanned_at IS NOT NULL")
def validate_files(spark, d):
    return validate.check_requests(_files(spark, d)).filter(F.size("reasons") == 0).select("entity_id", "write_seq")


@query(f"""SELECT reason, count(*) AS n_rows FROM (SELECT unnest(list_filter([CASE WHEN coalesce(path,'') = '' OR length(path) > 1024 THEN 'path' END, CASE WHEN coalesce(drive_id,'') = '' THEN 'drive_id' END,
CASE WHEN coalesce(mime_type,'') = '' OR length(mime_type) > 128 THEN 'mime_type' END, CASE WHEN scanned_at IS NULL THEN 'scanned_at' END], lambda x: x IS NOT NULL)) AS reason FROM {FILES}) GROUP BY reason""")
def reject_reasons(spark, d):
    return validate.check_requests(_files(spark, d)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))


@query(f"SELECT entity_id, write_seq, mime_type FROM {FILES} WHERE {BASE} IN {LISTED}")
def authorized_files(spark, d):
    return _files(spark, d).filter(mime.is_authorized(F.col("mime_type"))).select("entity_id", "write_seq", "mime_type")


@query(f"SELECT entity_id, write_seq, CASE WHEN mime_type IN {LISTED} OR mime_type = 'video/mp4' THEN mime_type ELSE 'unknown' END AS effective FROM {FILES}")
def mime_effective(spark, d):
    return _files(spark, d).select("entity_id", "write_seq", mime.effective(F.col("mime_type")).alias("effective"))


@query(f"SELECT count(*) AS files_received, coalesce(sum(size), 0) AS bytes_processed FROM {FILES}")
def ingest_summary(spark, d):
    return monitor.ingest_summary(_files(spark, d), "size")


@query(f"SELECT entity_id, write_seq, specialist FROM (SELECT entity_id, write_seq, CASE WHEN {BASE} = 'application/pdf' THEN 'pdf' WHEN {BASE} LIKE 'audio/%' AND {BASE} IN {LISTED} THEN 'audio' WHEN {BASE} IN {LISTED} THEN 'image' END AS specialist FROM {FILES}) WHERE specialist IS NOT NULL")
def specialist_routing(spark, d):
    return routing.route(_files(spark, d)).select("entity_id", "write_seq", "specialist")


@query("SELECT doc_id AS file_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes, true AS ok FROM documents WHERE text IS NOT NULL")
def chunk_reassemble_sha(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("content"))
    parts = chunks.split_chunks(docs, size=4096)
    return chunks.reassemble(parts, with_data=False).select("file_id", "sha256", "n_bytes", F.col("error").isNull().alias("ok"))


@query("SELECT doc_id AS file_id, CAST(ceil(octet_length(encode(text)) / 4096.0) AS BIGINT) AS n_chunks FROM documents WHERE text IS NOT NULL")
def chunk_counts(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("content"))
    return chunks.split_chunks(docs, size=4096).groupBy("file_id").agg(F.count_if(F.col("kind") == "chunk").alias("n_chunks"))


@query(
    "WITH au AS (SELECT entity_id, max(transcription) AS transcription, max(duration_sec) AS score, coalesce(max(lang), '') AS label FROM audio_details GROUP BY entity_id), "
    "pg AS (SELECT entity_id, arg_min(content, number) AS first_page, max(number) AS n_pages, coalesce(max(lang), '') AS label FROM document_pages WHERE content IS NOT NULL GROUP BY entity_id), "
    "m AS (SELECT a.*, au.entity_id IS NOT NULL AND coalesce(au.transcription, '') <> '' AS heard, pg.entity_id IS NOT NULL AS paged, au.transcription, au.score AS au_score, au.label AS au_label, pg.first_page, pg.n_pages, pg.label AS pg_label "
    f"FROM {LATEST_A} a LEFT JOIN au USING (entity_id) LEFT JOIN pg USING (entity_id) WHERE au.entity_id IS NOT NULL OR pg.entity_id IS NOT NULL) "
    "SELECT entity_id, payload_type, "
    "CASE payload_type WHEN 'file' THEN coalesce(CASE WHEN heard THEN transcription END, nullif(payload.file.content, ''), CASE WHEN paged THEN first_page END, payload.file.content) WHEN 'audio' THEN coalesce(CASE WHEN heard THEN transcription END, payload.audio.transcription) END AS content, "
    "CASE WHEN paged THEN 'Scan of ' || n_pages || ' pages' ELSE summary END AS summary, "
    "CASE WHEN heard THEN au_score END AS audio_score, CASE WHEN paged THEN CAST(n_pages AS DOUBLE) END AS pdf_score, "
    "coalesce(array_to_string(tags, '|'), '') || CASE WHEN heard AND au_label <> '' THEN '#' || au_label ELSE '' END || CASE WHEN paged AND pg_label <> '' THEN '#' || pg_label ELSE '' END || CASE WHEN paged THEN '#author:scanner' ELSE '' END AS tags FROM m"
)
def enrichment_merge(spark, d):
    """Results of recordings (score: duration, label: language, an error where nothing was heard) and of scanned files (all pages, title, author, label) merged into the records."""
    none, pages_type = F.lit(None), "array<struct<number:int,content:string>>"
    tapes = _t(spark, d, "audio_details").groupBy("entity_id").agg(F.max("transcription").alias("transcription"), F.max("duration_sec").alias("score"), F.coalesce(F.max("lang"), F.lit("")).alias("label"))
    silent = F.when(F.coalesce("transcription", F.lit("")) == "", F.lit("nothing was heard"))
    tapes = tapes.select("entity_id", F.lit("audio").alias("metric_id"), silent.alias("error"), "score", "label", "transcription", none.cast("string").alias("title"), none.cast("string").alias("author"), none.cast(pages_type).alias("pages"))
    page = F.struct(F.col("number").cast("int").alias("number"), "content")
    pages = _t(spark, d, "document_pages").filter("content IS NOT NULL").groupBy("entity_id").agg(F.array_sort(F.collect_set(page)).alias("pages"), F.max("number").alias("n"), F.coalesce(F.max("lang"), F.lit("")).alias("label"))  # the pages of one file
    docs = pages.select(
        "entity_id", F.lit("pdf").alias("metric_id"), none.cast("string").alias("error"), F.col("n").cast("double").alias("score"), "label", none.cast("string").alias("transcription"),
        F.format_string("Scan of %d pages", "n").alias("title"), F.lit("scanner").alias("author"), F.col("pages").cast(pages_type).alias("pages"),
    )
    results = tapes.unionByName(docs)
    log = _t(spark, d, "analyses").withColumn("n_tags", F.size("tags"))
    merged = routing.enrich(store.latest(log, "entity_id", "write_seq"), results).join(results.select("entity_id").distinct(), "entity_id", "left_semi")
    body = F.when(F.col("payload_type") == "file", F.col("payload.file.content")).when(F.col("payload_type") == "audio", F.col("payload.audio.transcription"))
    kept = F.coalesce(F.greatest("n_tags", F.lit(0)), F.lit(0))  # tags of the record come first, those that were added are marked
    added = F.transform(F.slice("tags", kept + 1, F.greatest(F.size("tags") - kept, F.lit(0))), lambda t: F.concat(F.lit("#"), t))
    tags = F.concat(F.array_join(F.slice("tags", F.lit(1), kept), "|"), F.array_join(added, ""))
    return merged.select("entity_id", "payload_type", body.alias("content"), "summary", F.col("scores")["audio"].alias("audio_score"), F.col("scores")["pdf"].alias("pdf_score"), F.coalesce(tags, F.lit("")).alias("tags"))


# --- queue, rooms, users ----------------------------------------------------------------


def _tasks(spark, d):
    o = _t(spark, d, "orders")
    return o.select(F.format_string("%010d", "o_orderkey").alias("id"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0).otherwise(1).alias("priority"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at_ns"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("processing").alias("state"))


TASKS = "(SELECT format('{:010d}', o_orderkey) AS id, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 0 ELSE 1 END AS priority, epoch_us(o_orderdate) AS created_at_ns, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'processing' END AS state FROM orders)"


@query(f"SELECT id, priority, created_at_ns FROM {TASKS} WHERE state = 'pending' ORDER BY priority, created_at_ns, id LIMIT 5")
def queue_next_batch(spark, d):
    return paging.next_batch(_tasks(spark, d), 5).select("id", "priority", "created_at_ns")


@query(f"WITH t AS {TASKS}, n AS (SELECT id FROM t WHERE state = 'pending' ORDER BY priority, created_at_ns, id LIMIT 100) SELECT CASE WHEN n.id IS NOT NULL THEN 'processing' ELSE state END AS state, count(*) AS n_tasks FROM t LEFT JOIN n USING (id) GROUP BY 1")
def queue_mark_processing(spark, d):
    t = _tasks(spark, d)
    return paging.mark_processing(t, paging.next_batch(t, 100)).groupBy("state").agg(F.count("*").alias("n_tasks"))


@query(
    f"WITH t AS {TASKS}, run AS (SELECT id FROM t WHERE created_at_ns <= (SELECT created_at_ns FROM t ORDER BY created_at_ns LIMIT 1 OFFSET 24)) "
    "SELECT id AS file_id, created_at_ns FROM t WHERE id NOT IN (SELECT id FROM run) ORDER BY created_at_ns, id LIMIT (SELECT greatest(0, 40 - count(*)) FROM run)"
)
def job_admission(spark, d):
    """The oldest jobs run already (those up to the time of the 25th); all others wait for the places left of 40."""
    t = _tasks(spark, d).withColumnRenamed("id", "file_id")
    until = t.orderBy("created_at_ns").limit(25).agg(F.max("created_at_ns")).first()[0]
    return paging.admit(t, t.filter(F.col("created_at_ns") <= until), 40)


def _members(spark, d):
    m = _t(spark, d, "messages").filter("author IS NOT NULL AND room IS NOT NULL").select(F.col("author").alias("participant_id"), "room").distinct()
    s = m.select("participant_id", F.concat(F.lit("grpc:"), "participant_id").alias("sink")).distinct().filter(F.length("participant_id") % 2 == 0)
    return m, s


MEMBERS = "(SELECT DISTINCT author AS participant_id, room FROM messages WHERE author IS NOT NULL AND room IS NOT NULL)"


@query(f"SELECT sink, count(*) AS n_events FROM (SELECT 'grpc:' || p.participant_id AS sink FROM messages m JOIN {MEMBERS} p USING (room) WHERE length(p.participant_id) % 2 = 0 UNION ALL SELECT 'disk' FROM messages) GROUP BY sink")
def room_fanout(spark, d):
    events = _t(spark, d, "messages").groupBy("room").agg(F.count("*").alias("n"))
    sinks = routing.room_sinks(*_members(spark, d))
    per = events.join(sinks, "room").groupBy("sink").agg(F.sum("n").alias("n_events"))  # counted per room first: no event is copied
    return per.unionByName(events.agg(F.sum("n").alias("n_events")).select(F.lit("disk").alias("sink"), "n_events"))


@query(f"SELECT p.room, 'grpc:' || p.participant_id AS sink FROM {MEMBERS} p WHERE length(p.participant_id) % 2 = 0 AND p.participant_id <> (SELECT min(author) FROM messages WHERE length(author) % 2 = 0)")
def registry_unsubscribe(spark, d):
    m, s = _members(spark, d)
    who = s.agg(F.min("participant_id")).first()[0]
    m2, s2 = routing.unsubscribe(m, s, who, m.filter(F.col("participant_id") == who).agg(F.min("room")).first()[0])
    return routing.room_sinks(m2, s2).select("room", "sink")


@query("SELECT c_name AS email, min(c_custkey) AS c_custkey FROM customer WHERE c_custkey % 3 <> 0 GROUP BY c_name")
def unique_email_insert(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_name").alias("email"), "c_custkey")
    return store.insert_unique(c.filter("c_custkey % 3 = 0"), c, "email", "c_custkey")


# --- monitoring -------------------------------------------------------------------------

LATEST_N = "(SELECT * FROM node_status QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY reported_at DESC, report_id DESC) = 1)"


@query(f"SELECT node_id, report_id, node_type, CASE WHEN epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(reported_at) > 15000000 THEN 'GHOST' ELSE 'ALIVE' END AS status, CASE upper(node_type) WHEN 'MASTER' THEN 0 WHEN 'SCANNER' THEN 1 ELSE 2 END AS rank FROM {LATEST_N}")
def node_snapshot(spark, d):
    nodes = monitor.node_state(monitor.latest_nodes(_t(spark, d, "node_status")), F.lit(NOW).cast("timestamp"))
    return nodes.orderBy("rank", "node_id").select("node_id", "report_id", "node_type", "status", "rank")


@query(f"SELECT node_id FROM {LATEST_N} WHERE epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(reported_at) > 15000000")
def ghost_nodes(spark, d):
    return monitor.node_state(monitor.latest_nodes(_t(spark, d, "node_status")), F.lit(NOW).cast("timestamp")).filter("status = 'GHOST'").select("node_id")


@query("SELECT report_id, round(avg(least(100, queue_size / greatest(max_capacity, 1) * 100)) + 1e-9, 4) AS load FROM node_status GROUP BY report_id")
def load_percent(spark, d):
    return _t(spark, d, "node_status").groupBy("report_id").agg(F.round(F.avg(monitor.load_percent(F.col("queue_size"), F.col("max_capacity"))) + 1e-9, 4).alias("load"))


@query("SELECT CASE WHEN pid_status IN ('R','RUNNING') THEN 'RUNNING' WHEN pid_status IN ('S','SLEEP','SLEEPING') THEN 'SLEEP' WHEN pid_status IN ('T','STOP','STOPPED') THEN 'STOP' WHEN pid_status IN ('I','IDLE') THEN 'IDLE' WHEN pid_status IN ('Z','ZOMBIE') THEN 'ZOMBIE' WHEN pid_status = 'W' THEN 'WAIT' WHEN pid_status = 'L' THEN 'LOCK' ELSE 'UNKNOWN' END AS status, count(*) AS n_reports FROM node_status GROUP BY 1")
def pid_status_map(spark, d):
    return _t(spark, d, "node_status").groupBy(display.pid_status(F.col("pid_status")).alias("status")).agg(F.count("*").alias("n_reports"))


@query("SELECT event_type, count(*) AS n_events FROM events GROUP BY event_type")
def event_counts(spark, d):
    return monitor.event_counts(_t(spark, d, "events"), "event_type")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, sum(event_id) AS bytes, round(sum(event_id) / 1048576.0 / 3600, 9) AS mb_per_s FROM events GROUP BY 1")
def throughput_per_window(spark, d):
    e = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.throughput(e, "ts", "event_id", 3600).select(F.unix_micros("window_start").alias("window_us"), "bytes", F.round("mb_per_s", 9).alias("mb_per_s"))


@query("SELECT a.id AS message_id, max(b.at_ns - a.at_ns) AS delay_ns FROM " + LATEST_M + " a JOIN analyses b ON b.entity_id = a.id WHERE epoch_us(b.at_ts) - epoch_us(a.at_ts) > 500000 GROUP BY a.id")
def latency_alerts(spark, d):
    m = _distinct_messages(spark, d).select("id", F.col("at_ns").alias("m_ns"), F.col("at_ts").alias("m_ts"))
    a = _t(spark, d, "analyses").select("entity_id", "at_ns", "at_ts")
    late = m.join(a, m["id"] == a["entity_id"]).filter(monitor.late(F.col("m_ts"), F.col("at_ts")))
    return late.groupBy(F.col("id").alias("message_id")).agg(F.max(F.col("at_ns") - F.col("m_ns")).alias("delay_ns"))


@query("SELECT DISTINCT report_id FROM node_status WHERE max_capacity > 0 AND max_capacity - queue_size > 0 AND max_capacity - queue_size <= 900")
def low_capacity(spark, d):
    return _t(spark, d, "node_status").filter(monitor.low_capacity(F.col("queue_size"), F.col("max_capacity"), 900)).select("report_id").distinct()


@query("SELECT CASE WHEN queue_size > floor(max_capacity * 90 / 100) THEN 200 WHEN queue_size > floor(max_capacity * 70 / 100) THEN 20 ELSE 0 END AS pause_ms, count(*) AS n_reports FROM node_status GROUP BY 1")
def throttle_bands(spark, d):
    return _t(spark, d, "node_status").groupBy(validate.throttle_ms(F.col("queue_size"), F.col("max_capacity")).alias("pause_ms")).agg(F.count("*").alias("n_reports"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 20")
def recent_20(spark, d):
    return monitor.recent(_t(spark, d, "events"), "ts", "event_id").select("event_id", "rank")


@query("""SELECT id, write_seq, split_part(coalesce(namespace, ''), ':', 1) AS kind, strftime(at_ts, '%H:%M:%S') AS time, left(entity_id, 8) AS short_id,
CASE payload_type WHEN 'text' THEN 'CHAT' WHEN 'file' THEN 'FILE' WHEN 'audio' THEN 'AUDIO' ELSE 'BASE' END AS label,
coalesce(CASE payload_type WHEN 'audio' THEN payload.audio.transcription WHEN 'file' THEN CASE WHEN coalesce(payload.file.content, '') <> '' THEN payload.file.content ELSE summary END ELSE payload."text".content END, '') AS detail,
coalesce(array_to_string(list_sort(list_transform(map_entries(scores), lambda e: e.key || ':' || printf('%.2f', e.value - 1e-9))), ' '), '') AS scores FROM analyses""")
def inspect_rows(spark, d):
    return display.inspect_rows(_t(spark, d, "analyses"))


@query("SELECT count(*) FILTER (WHERE octet_length(encode(content)) <= 1000) AS accepted, count(*) FILTER (WHERE content IS NULL OR octet_length(encode(content)) > 1000) AS rejected FROM messages")
def message_admission(spark, d):
    ok = validate.content_fits(F.col("content"))
    return monitor.counters(_t(spark, d, "messages"), accepted=ok, rejected=~ok)


@query(
    f"WITH c AS (SELECT DISTINCT {NORM.format('word')} AS word FROM censored_words), p AS (SELECT category, is_malicious, EXISTS (SELECT 1 FROM c WHERE word <> '' AND contains({NORM.format('text')}, word)) AS hit FROM moderation_cases) "
    "SELECT category, count(*) AS n_cases, round(avg(CASE WHEN is_malicious = coalesce(hit, false) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p WHERE is_malicious IS NOT NULL GROUP BY category"
)
def accuracy_by_category(spark, d):
    """Label against prediction, which is a hit of the moderators' list."""
    words = moderation.load_words(_t(spark, d, "censored_words"))
    predicted = moderation.censor(_t(spark, d, "moderation_cases").filter("is_malicious IS NOT NULL"), words, "text").withColumn("hit", moderation.has_hit())
    return monitor.accuracy(predicted, "category", F.col("hit") == F.col("is_malicious")).withColumn("accuracy", F.round("accuracy", 6))


@query()
def detected_language(spark, d):
    from msgflow.functions.language import detect

    return _t(spark, d, "documents").select("doc_id", detect(F.col("text")).alias("language"))


@query()
def check_messages(spark, d):
    from msgflow.operators import classifier

    model = classifier.fit(_t(spark, d, "moderation_cases"))
    return classifier.check(_t(spark, d, "messages").select("id", "write_seq", "content"), model, "content").select("id", "write_seq", F.round("toxicity", 6).alias("toxicity"), "is_toxic")


@query("SELECT entity_id, write_seq, CASE WHEN size >= 1073741824 THEN regexp_replace(CAST(round(size / 1073741824.0, 1) AS VARCHAR), '\\.0$', '') || ' GB' WHEN size >= 1048576 THEN regexp_replace(CAST(round(size / 1048576.0, 1) AS VARCHAR), '\\.0$', '') || ' MB' WHEN size >= 1024 THEN regexp_replace(CAST(round(size / 1024.0, 1) AS VARCHAR), '\\.0$', '') || ' KB' ELSE CAST(size AS VARCHAR) || ' B' END AS shown FROM " + FILES)
def human_sizes(spark, d):
    return _files(spark, d).select("entity_id", "write_seq", text.human_bytes(F.col("size")).alias("shown"))


@query("SELECT word, count(*) AS n_keys FROM censored_words WHERE word LIKE 'i%' GROUP BY word")
def prefix_scan(spark, d):
    """Keys of records and, under ``idx:``, of their index; a scan by the prefix ``i`` must leave the latter out."""
    words = _t(spark, d, "censored_words").select("word")
    keys = words.unionByName(words.select(F.concat(F.lit("idx:"), "word").alias("word")))
    return key_range(store.scan_prefix(keys, "word", "i"), "word", F.lit(True)).groupBy("word").agg(F.count("*").alias("n_keys"))
