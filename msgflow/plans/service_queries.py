"""Queries over delivery, rooms, downloads, jobs, telemetry and projections, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgflow.functions import display, language, mime
from msgflow.operators import chunks, classifier, delivery, monitor, routing, validate
from msgflow.plans.engine_queries import FILES, LATEST_A, LATEST_M, MEMBERS, NORM, TASKS, _distinct_messages, _files, _latest_analyses, _members, _t, _tasks
from msgflow.plans.engine_queries import BASE as BASE_TYPE

QUERIES: dict = {}
SQL: dict[str, str] = {}
BUFFER = 2  # events that a subscriber's buffer takes in a tick


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT id AS message_id, room, author AS sender_id, content, at_ns FROM {LATEST_M}")
def chat_events(spark, d):
    return delivery.chat_events(_distinct_messages(spark, d))


@query(f"SELECT id, '[' || strftime(at_ts, '%H:%M:%S') || '] ' || coalesce(author, '') || ': ' || coalesce(content, '') AS line FROM {LATEST_M}")
def chat_lines(spark, d):
    return _distinct_messages(spark, d).select("id", delivery.chat_line(F.col("at_ts"), F.col("author"), F.col("content")).alias("line"))


@query(
    f"WITH e AS (SELECT 'room:' || room AS sink, at_ns // 60000000000 AS tick, row_number() OVER (PARTITION BY room, at_ns // 60000000000 ORDER BY at_ns, id) AS k FROM {LATEST_M} WHERE room IS NOT NULL) "
    f"SELECT sink, count(*) FILTER (WHERE k <= {BUFFER}) AS delivered, count(*) FILTER (WHERE k > {BUFFER}) AS dropped FROM e GROUP BY sink"
)
def room_delivery(spark, d):
    events = _distinct_messages(spark, d).filter("room IS NOT NULL").select("id", "at_ns", F.concat(F.lit("room:"), F.col("room").cast("string")).alias("sink"), F.expr("at_ns div 60000000000").alias("tick"))
    sent = delivery.deliver(events, BUFFER)
    return sent.groupBy("sink").agg(F.count_if("delivered").alias("delivered"), F.count_if(~F.col("delivered")).alias("dropped"))


@query(f"SELECT p.participant_id, p.room, count(*) AS n_events FROM messages m JOIN {MEMBERS} p USING (room) WHERE p.participant_id IN (SELECT author FROM messages WHERE author IS NOT NULL GROUP BY author ORDER BY count(*) DESC, author LIMIT 3) GROUP BY ALL")
def fan_out_to_three(spark, d):
    """Every message to the three busiest participants who are in its room."""
    m = _t(spark, d, "messages")
    top = m.filter("author IS NOT NULL").groupBy(F.col("author").alias("participant_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "participant_id").limit(3).select("participant_id")
    members, _ = _members(spark, d)
    sinks = members.join(F.broadcast(top), "participant_id").select("room", F.to_json(F.struct("participant_id", "room")).alias("sink"))
    sent = routing.fan_out(m.select("id", "room"), sinks).filter("sink <> 'disk'").groupBy("sink").agg(F.count("*").alias("n_events"))
    return sent.select(F.get_json_object("sink", "$.participant_id").alias("participant_id"), F.get_json_object("sink", "$.room").cast("bigint").alias("room"), "n_events")


@query("SELECT room_known, count(*) AS n_messages FROM (SELECT room IN (SELECT DISTINCT CAST(substr(namespace, 6) AS BIGINT) FROM analyses WHERE namespace LIKE 'chat:%') AND room IS NOT NULL AS room_known FROM messages) GROUP BY 1")
def known_rooms(spark, d):
    rooms = _t(spark, d, "analyses").filter("namespace LIKE 'chat:%'").select(F.substring("namespace", 6, 100).cast("bigint").alias("room"))
    return routing.known_rooms(_t(spark, d, "messages"), rooms).groupBy("room_known").agg(F.count("*").alias("n_messages"))


@query("SELECT DISTINCT room FROM messages WHERE room IS NOT NULL")
def register_rooms(spark, d):
    rooms = _t(spark, d, "messages").filter("room IS NOT NULL").select("room").distinct()
    return routing.register_rooms(rooms.filter("room % 2 = 0"), _t(spark, d, "messages").filter("room IS NOT NULL").select("room"))


@query(f"SELECT id AS file_id, 'drive' AS drive_id, 'p/' || id AS path, 'done' AS answer FROM {TASKS} WHERE state = 'processing' AND priority = 0")
def job_lookup(spark, d):
    """Answers come for all urgent tasks; only those that run have a job."""
    t = _tasks(spark, d).select(F.col("id").alias("file_id"), "state", "priority", F.lit("drive").alias("drive_id"), F.concat(F.lit("p/"), "id").alias("path"))
    answers = t.filter("priority = 0").select("file_id", F.lit("done").alias("answer"))
    return delivery.find_jobs(answers, t.filter("state = 'processing'")).select("file_id", "drive_id", "path", "answer")


@query(f"SELECT count(*) FILTER (WHERE state = 'processing') AS processing, 40 AS max FROM {TASKS} WHERE id NOT LIKE '%0'")
def job_tracker(spark, d):
    t = _tasks(spark, d)
    log = t.select(F.col("id").alias("file_id"), F.lit("add").alias("event"), (F.col("created_at_ns") * 10).alias("at_ns"))
    log = log.unionByName(t.filter("state = 'processing'").select(F.col("id").alias("file_id"), F.lit("run").alias("event"), (F.col("created_at_ns") * 10 + 1).alias("at_ns")))
    log = log.unionByName(t.filter("id LIKE '%0'").select(F.col("id").alias("file_id"), F.lit("remove").alias("event"), (F.col("created_at_ns") * 10 + 2).alias("at_ns")))
    return delivery.tracker_state(delivery.track(log), 40)


@query(
    "SELECT file_id, CASE WHEN kind = 'bad' THEN 'INVALID_REQUEST' WHEN kind = 'none' THEN 'NOT_FOUND' WHEN n > 20000 THEN 'FILE_TOO_LARGE' END AS error_code, CASE WHEN kind = 'ok' AND n <= 20000 THEN n END AS size, CASE WHEN kind = 'ok' AND n <= 20000 THEN sha256(text) END AS sha256 "
    "FROM (SELECT doc_id AS file_id, text, octet_length(encode(text)) AS n, CASE doc_id % 10 WHEN 3 THEN 'bad' WHEN 7 THEN 'none' ELSE 'ok' END AS kind FROM documents WHERE text IS NOT NULL)"
)
def download_answers(spark, d):
    """Requests for every document; some name no path, some one that isn't there, and files of more than 20,000 bytes are too large."""
    docs = _t(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("content"))
    path = F.concat(F.lit("f/"), F.col("file_id").cast("string"))
    on = F.lit(True)
    # the engine's limit is in bytes: sizes are scaled so that it is met by these small files
    files = docs.select(path.alias("path"), "content", (F.octet_length("content").cast("long") * (validate.MAX_FILE_BYTES // 20_000)).alias("size"), on.alias("regular"), on.alias("exists"), on.alias("readable"))
    asked = docs.select("file_id", F.when(F.col("file_id") % 10 == 3, "").when(F.col("file_id") % 10 == 7, F.concat(F.lit("x/"), path)).otherwise(path).alias("path"))
    parts = chunks.download(asked, files)
    whole = chunks.reassemble(parts, with_data=False)
    sizes = chunks.decode_response(parts).groupBy("file_id").agg((F.max("size") / (validate.MAX_FILE_BYTES // 20_000)).cast("long").alias("size"))
    return whole.join(sizes, "file_id").select("file_id", F.col("error").alias("error_code"), "size", F.when(F.col("error").isNull(), F.col("sha256")).alias("sha256"))


@query(f"SELECT entity_id, write_seq, coalesce({BASE_TYPE} = 'application/pdf', false) AS pdf, coalesce({BASE_TYPE} IN ('image/png','image/jpeg','image/gif'), false) AS image, coalesce({BASE_TYPE} IN ('audio/mpeg','audio/wav','audio/x-aiff'), false) AS audio, coalesce(mime_type = 'video/mp4', false) AS video, coalesce({BASE_TYPE} = 'application/pdf', false) AS matches FROM {FILES}")
def media_kinds(spark, d):
    m = F.col("mime_type")
    return _files(spark, d).select("entity_id", "write_seq", mime.is_pdf(m).alias("pdf"), mime.is_image(m).alias("image"), mime.is_audio(m).alias("audio"), mime.is_video(m).alias("video"), mime.match_type(m, F.lit("application/pdf"))["ok"].alias("matches"))


@query("SELECT source, CASE upper(trim(source)) WHEN 'REMOVABLE' THEN 'REMOVABLE' WHEN 'NETWORK' THEN 'NETWORK' WHEN 'LOCAL_FIXED' THEN 'LOCAL_FIXED' ELSE 'UNSPECIFIED' END AS source_type, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS priority, n_orders FROM (SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN ' removable' WHEN '2-HIGH' THEN 'NETWORK' WHEN '3-MEDIUM' THEN 'local_fixed' ELSE 'cloud' END AS source, count(*) AS n_orders FROM orders GROUP BY 1, 2)")
def enum_names(spark, d):
    p = F.col("o_orderpriority")
    o = _t(spark, d, "orders").groupBy(p).agg(F.count("*").alias("n_orders"))
    source = F.when(p == "1-URGENT", " removable").when(p == "2-HIGH", "NETWORK").when(p == "3-MEDIUM", "local_fixed").otherwise("cloud")
    return o.select(source.alias("source"), validate.source_type(source).alias("source_type"), validate.priority(F.when(p == "1-URGENT", "high").otherwise(p)).alias("priority"), "n_orders")


@query(
    f"SELECT entity_id, coalesce(summary, '') AS summary, coalesce(namespace, '') AS namespace, coalesce(len(tags), 0) AS n_tags, coalesce(array_to_string(list_sort(list_transform(ks, lambda k: k || '=' || printf('%.6f', list_max(list_transform(list_filter(es, lambda e: lower(e.key) = k), lambda e: e.value))))), ' '), '') AS scores "
    f"FROM (SELECT *, map_entries(scores) AS es, list_distinct(list_transform(map_keys(scores), lambda k: lower(k))) AS ks FROM {LATEST_A})"
)
def wire_records(spark, d):
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.format_string("%s=%.6f", e["key"], e["value"]))), " ")
    return delivery.to_wire(_latest_analyses(spark, d)).select("entity_id", "summary", "namespace", F.size("tags").alias("n_tags"), shown.alias("scores"))


@query("SELECT type, count(*) AS n_events, count(DISTINCT name) AS n_names FROM (SELECT unnest(['process', 'capacity']) AS type, node_id AS name FROM node_status) GROUP BY type")
def health_events(spark, d):
    events = delivery.health_events(_t(spark, d, "node_status"))
    counted = delivery.handle(events, {kind: lambda e: e.groupBy("type").agg(F.count("*").alias("n_events"), F.count_distinct("name").alias("n_names")) for kind in ("process", "capacity")})
    return counted["process"].unionByName(counted["capacity"])


@query(f"SELECT '{{\"files_received\":' || count(*) || ',\"bytes_processed\":' || coalesce(sum(size), 0) || '}}' AS json FROM {FILES}")
def stats_json(spark, d):
    return delivery.stats_json(monitor.ingest_summary(_files(spark, d), "size"))


@query("SELECT arg_max(queue_size, (reported_at, report_id)) FILTER (WHERE queue_size IS NOT NULL) AS queue_size, arg_max(ram_bytes, (reported_at, report_id)) FILTER (WHERE ram_bytes IS NOT NULL) AS ram_bytes FROM node_status")
def last_known_stats(spark, d):
    return monitor.merge_stats(_t(spark, d, "node_status").select("queue_size", "ram_bytes", F.struct("reported_at", "report_id").alias("at")))


@query(
    "SELECT n.node_id, upper(node_type) || ' ' || pid || ' ' || pid_status || ' ' || printf('%.2f', round(cpu_percent, 2)) || '% ' || ram_bytes AS line, 'ram ' || ram_bytes || ' | disk - | net - | files ' || items_processed || ' | queue ' || queue_size AS report "
    "FROM (SELECT * FROM node_status QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY reported_at DESC, report_id DESC) = 1) n WHERE pid IS NOT NULL AND cpu_percent IS NOT NULL AND ram_bytes IS NOT NULL AND pid_status IS NOT NULL AND node_type IS NOT NULL AND items_processed IS NOT NULL AND queue_size IS NOT NULL"
)
def node_lines(spark, d):
    n = monitor.latest_nodes(_t(spark, d, "node_status")).dropna(subset=["pid", "cpu_percent", "ram_bytes", "pid_status", "node_type", "items_processed", "queue_size"])
    line = display.tracker_line(F.col("node_type"), F.col("pid"), F.col("pid_status"), F.round("cpu_percent", 2), F.col("ram_bytes"))
    return n.select("node_id", line.alias("line"), delivery.reporter_line(F.col("ram_bytes"), F.lit("-"), F.lit("-"), F.col("items_processed"), F.col("queue_size")).alias("report"))


@query(
    r"""WITH t AS (SELECT case_id, list_filter(regexp_split_to_array(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'), lambda x: x <> '') AS ws FROM moderation_cases WHERE text IS NOT NULL),
h AS (SELECT case_id, unnest(list_transform(ws, lambda w: list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 1024)) AS id FROM t)
SELECT case_id, id, count(*) AS n FROM h GROUP BY case_id, id"""
)
def word_count_features(spark, d):
    return _t(spark, d, "moderation_cases").filter("text IS NOT NULL").select("case_id", F.inline(classifier.count_features(F.col("text"))))


@query(
    f"WITH w AS (SELECT DISTINCT {NORM.format('word')} AS word FROM censored_words) SELECT hit, count(*) AS n_messages FROM (SELECT EXISTS (SELECT 1 FROM w WHERE word <> '' AND contains({NORM.format('content')}, word)) AS hit FROM messages WHERE content IS NOT NULL) GROUP BY hit"
)
def messages_with_hits(spark, d):
    from msgflow.operators import moderation

    words = moderation.load_words(_t(spark, d, "censored_words"))
    censored = moderation.censor(_t(spark, d, "messages").filter("content IS NOT NULL").select("content"), words)
    return censored.groupBy(moderation.has_hit().alias("hit")).agg(F.count("*").alias("n_messages"))


_LETTER = NORM.format("substr(content, i, 1)")


@query(
    f"WITH w AS (SELECT DISTINCT {NORM.format('word')} AS word FROM censored_words WHERE {NORM.format('word')} <> ''), "
    f"m AS (SELECT write_seq, content, {NORM.format('content')} AS letters FROM messages WHERE content IS NOT NULL), "
    "near AS (SELECT DISTINCT m.* FROM m JOIN w ON contains(m.letters, w.word)), "
    f"spot AS (SELECT *, list_filter(range(1, length(content) + 1), lambda i: {_LETTER} <> '') AS pos FROM near), "
    "hit AS (SELECT a.write_seq, w.word, unnest(range(1, length(a.letters) - length(w.word) + 2)) AS k FROM spot a JOIN w ON contains(a.letters, w.word)), "
    "span AS (SELECT a.write_seq, list(struct_pack(lo := a.pos[h.k], hi := a.pos[h.k + length(h.word) - 1])) AS spans FROM hit h JOIN spot a USING (write_seq) WHERE substr(a.letters, h.k, length(h.word)) = h.word GROUP BY a.write_seq) "
    "SELECT write_seq, list_aggregate(list_transform(range(1, length(content) + 1), lambda i: CASE WHEN len(list_filter(spans, lambda s: i >= s.lo AND i <= s.hi)) > 0 THEN '*' ELSE substr(content, i, 1) END), 'string_agg', '') AS sanitized, len(spans) AS n_hits FROM spot JOIN span USING (write_seq)"
)
def masked_messages(spark, d):
    """Text of every message in which listed words were found, masked, and how many were found."""
    from msgflow.operators import moderation

    words = moderation.load_words(_t(spark, d, "censored_words"))
    done = moderation.censor(_t(spark, d, "messages").select("write_seq", "content"), words)
    return done.filter(moderation.has_hit()).select("write_seq", "sanitized", F.size("censored_words").alias("n_hits"))


@query()
def learned_language(spark, d):
    """Language of every document by trigrams of the labelled ones."""
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang")
    return language.detect_by(docs, language.learn(docs)).select("doc_id", "lang", "language")
