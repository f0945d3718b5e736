"""The engine's API over tables in a folder: post, history, search, scores, files, queue, nodes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgflow.functions.display import searchable_text
from msgflow.functions.mime import effective, is_authorized
from msgflow.operators import auth, chunks, monitor, paging, routing, search, specialists, store, validate
from msgflow.operators.moderation import censor
from msgflow.operators.routing import enrich
from msgflow.operators.validate import check_requests, content_fits
from msgflow.schemas import PAYLOAD_DDL, USER
from msgflow.sources import files as file_sources


BATCH = "engine_batch"  # partition column of the engine's tables


class Engine:
    """Tables are append logs in Parquet; readers see the last write of every key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._index: search.StoredIndex | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet").drop(BATCH)

    def append(self, name: str, rows: DataFrame, batch: int | None = None) -> None:
        """Adds rows as a batch of their own; a numbered batch that is written again replaces itself, so a stream may repeat one."""
        number = batch if batch is not None else -time.time_ns()  # below all numbers of a stream
        numbered = rows.withColumn(BATCH, F.lit(number).cast("long"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(f"{self.root}/{name}.parquet")

    def sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """A streaming sink into a table of the engine."""
        return lambda rows, batch: self.append(name, rows, batch)

    def post(self, messages: DataFrame, patterns: list[str], known: DataFrame | None = None) -> DataFrame:
        """Messages that fit, with id and time where they have none, censored; ready to append.

        Rooms that aren't ``known`` are marked, not dropped.
        """
        now = F.unix_micros(F.current_timestamp()) * 1000
        ok = messages.filter(content_fits(F.col("content"))).withColumn("id", F.coalesce("id", F.expr("uuid()")))
        ok = ok.withColumn("at_ns", F.coalesce("at_ns", now)) if "at_ns" in ok.columns else ok.withColumn("at_ns", now)
        out = censor(ok, patterns).withColumn("content", F.col("sanitized")).drop("sanitized")
        return routing.known_rooms(out, known) if known is not None else out

    def store(self, analyses: DataFrame) -> None:
        """Adds records, one or many, and brings the search index, once there is one, up to date for the entities they touch."""
        self.append("analyses", analyses)
        if self._index is not None:
            touched = self.table("analyses").join(analyses.select("entity_id").distinct(), "entity_id", "left_semi")
            self._index = self._index.upsert(self._bodies(store.latest(touched, "entity_id", "write_seq")))

    @staticmethod
    def _bodies(rows: DataFrame) -> DataFrame:
        return rows.select("entity_id", "namespace", searchable_text(F.col("summary"), F.col("payload_type"), F.col("payload")).alias("body"))

    def enqueue(self, tasks: DataFrame) -> None:
        """Adds tasks as pending ones, under their priority."""
        self.append("tasks", tasks.withColumn("priority", validate.priority(F.col("priority"))).withColumn("state", F.lit("pending")))

    def download(self, requests: DataFrame, files: DataFrame) -> DataFrame:
        return chunks.download(requests, files)

    def subscribe(self, participant: str, room: int, sink: str) -> None:
        """Registers room, membership and session, each once."""
        of = lambda name, schema: self.table(name) if self._has(name) else self.spark.createDataFrame([], schema)
        rooms, members, sessions = routing.join_room(of("rooms", "room bigint"), of("members", "participant_id string, room bigint"), of("sessions", "participant_id string, sink string"), participant, room, sink)
        for name, df in (("rooms", rooms), ("members", members), ("sessions", sessions)):
            held = df.collect()  # read before the table is written anew
            self.spark.createDataFrame(held, df.schema).write.mode("overwrite").parquet(f"{self.root}/{name}.parquet")

    def _has(self, name: str) -> bool:
        try:
            self.table(name)
            return True
        except AnalysisException:
            return False

    def report_status(self, reports: DataFrame) -> None:
        self.append("node_status", reports)

    def register(self, users: DataFrame) -> DataFrame:
        """Users with a valid e-mail address and password and a new address: stored with the hash, the first of each address."""
        good = users.filter(validate.registration_ok(F.col("email"), F.col("password")))
        stored = self.table("users") if self._has("users") else self.spark.createDataFrame([], USER)
        hashed = auth.with_hash(good).withColumn("roles", F.array(F.lit("user"))).withColumn("created_at", F.unix_micros(F.current_timestamp()) * 1000)
        new = store.insert_unique(stored, hashed.select("id", "email", "password_hash", "roles", "created_at"), "email", "id")
        self.append("users", new)
        return new

    def history(self, room: int, limit: int | None = 5, cursor: str | None = None) -> DataFrame:
        return paging.history(paging.room_messages(self.table("messages"), room, cursor), room, limit, cursor)

    def analyses(self) -> DataFrame:
        return store.latest(self.table("analyses"), "entity_id", "write_seq")

    def index(self) -> search.StoredIndex:
        """Stored postings of the records; built when first asked for."""
        if self._index is None:
            self._index = search.store_index(self._bodies(self.analyses()), "entity_id", "body", f"{self.root}/analyses.index", "namespace")
        return self._index

    def scan(self, namespace: str, limit: int = 50, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """A page of a namespace and the cursor of the next (None on the last)."""
        page = paging.newest_page(paging.namespace_analyses(self.table("analyses"), namespace), "at_ns", "entity_id", limit + 1, cursor)
        rows = page.collect()  # the page, read once; its size is the caller's
        return self.spark.createDataFrame(rows[:limit], page.schema), paging.next_cursor(rows, limit)

    def fetch(self, entity_id: str, namespace: str | None = None) -> DataFrame:
        return store.fetch_by_entity(self.table("analyses"), entity_id, namespace)

    def search(self, text: str, namespace: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """Flags in ``text`` become filters: ``--room`` the namespace, others least scores."""
        q = search.parse_query(text)
        space = namespace or q.room
        rows = self.analyses()
        hits = self.index().match(" ".join(q.terms), space)
        for name, least in q.filters.items():
            hits = hits.join(search.score_range(rows, name, least, float("inf"), space, None).select("entity_id"), "entity_id", "left_semi")
        return search.hydrate(search.page(hits, "entity_id", offset, limit), rows, "entity_id").orderBy("rank")

    def scores(self, name: str, low: float, high: float, namespace: str | None = None, limit: int = 50) -> DataFrame:
        return search.score_range(self.analyses(), name, low, high, namespace, limit)

    def trigger_scan(self, path: str, drive_id: str, namespace: str) -> dict:
        """Scans a tree and takes its files in: records, tasks, and the answer ``accepted`` with the counters of the scan."""
        scanned = file_sources.scan(self.spark, path, authorized_only=False)
        counters = file_sources.scan_counters(scanned).first().asDict()
        records, tasks = self.ingest_files(file_sources.requests(scanned, drive_id), namespace)
        self.store(records.withColumn("write_seq", F.col("at_ns")))
        self.enqueue(tasks)
        return {"accepted": True} | counters

    def scan_files(self, path: str) -> DataFrame:
        return file_sources.scan(self.spark, path)

    def ingest_files(self, requests: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
        """Records and tasks of the valid requests."""
        ok = check_requests(requests).filter(F.size("reasons") == 0).withColumn("entity_id", F.sha2(F.concat_ws(":", "drive_id", "path"), 256))
        kind = effective(F.col("mime_type"))
        name = F.element_at(F.split("path", "/"), -1)
        payload = F.struct(
            F.lit(None).cast("struct<content:string>").alias("text"),
            F.lit(None).cast("struct<transcription:string,duration_sec:double>").alias("audio"),
            F.struct(name.alias("filename"), kind.alias("mime_type"), F.col("size").alias("size"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("int").alias("page_count")).alias("file"),
        )
        at_ns = F.unix_micros("scanned_at") * 1000
        records = ok.select(
            F.col("entity_id").alias("id"), "entity_id", F.lit(namespace).alias("namespace"), at_ns.alias("at_ns"), F.col("scanned_at").alias("at_ts"), F.col("path").alias("summary"),
            F.array("mime_type", "source_type").alias("tags"), F.create_map().cast("map<string,double>").alias("scores"), F.lit("file").alias("payload_type"), payload.cast(PAYLOAD_DDL).alias("payload"), F.expr("uuid()").alias("version"),
        )
        tasks = ok.filter(is_authorized(F.col("mime_type"))).select(
            F.col("entity_id").alias("id"), "drive_id", "path", F.col("mime_type").alias("raw_mime_type"), kind.alias("effective_mime_type"), "size", F.lit(1).alias("priority"), at_ns.alias("created_at_ns"), F.lit(0).alias("retry_count"), F.lit("pending").alias("state")
        )
        return records, tasks

    def analyse_files(self, files: DataFrame) -> DataFrame:
        """Stored records with what the specialists found merged in."""
        return enrich(self.analyses(), specialists.analyse(files))

    def next_tasks(self, n: int = 5) -> DataFrame:
        return paging.next_batch(self.table("tasks"), n)

    def nodes(self, now) -> DataFrame:
        return monitor.node_state(monitor.latest_nodes(self.table("node_status")), F.lit(now).cast("timestamp")).orderBy("rank", "node_id")
