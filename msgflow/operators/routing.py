"""Who gets what: room members and their sinks, files and the specialists for them, and results merged back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgflow.functions.mime import AUDIO, IMAGE, PDF, base_type
from msgflow.operators.skew import split_join

# Which specialist takes which media types.
CAPABILITIES = {"pdf": PDF, "audio": AUDIO, "image": IMAGE}


def room_sinks(members: DataFrame, sessions: DataFrame) -> DataFrame:
    """``room, participant_id, sink``; members without a session have none."""
    return members.join(sessions, "participant_id")


def fan_out(events: DataFrame, sinks: DataFrame, room: str = "room", key: str = "id") -> DataFrame:
    """``key, sink``: every event to all sinks of its room, and to the disk.  The events of a busy room stay where they are; the sinks of such rooms are sent to them."""
    to_rooms = split_join(events.select(key, room), sinks.select(F.col("room").alias(room), "sink"), [room]).select(key, "sink")
    return to_rooms.unionByName(events.select(key, F.lit("disk").alias("sink")))


def subscribe(members: DataFrame, sessions: DataFrame, participant: str, room: int, sink: str) -> tuple[DataFrame, DataFrame]:
    spark = members.sparkSession
    m = members.unionByName(spark.createDataFrame([(participant, room)], "participant_id string, room bigint")).distinct()
    s = sessions.filter(F.col("participant_id") != participant).unionByName(spark.createDataFrame([(participant, sink)], "participant_id string, sink string"))
    return m, s


def unsubscribe(members: DataFrame, sessions: DataFrame, participant: str, room: int) -> tuple[DataFrame, DataFrame]:
    """Leaving one room ends the participant's session, as the engine's clients expect."""
    m = members.filter(~((F.col("participant_id") == participant) & (F.col("room") == room)))
    return m, sessions.filter(F.col("participant_id") != participant)


def register_rooms(rooms: DataFrame, new: DataFrame) -> DataFrame:
    """``rooms`` with those of ``new`` that aren't there yet; registering one twice changes nothing."""
    return rooms.unionByName(new.select(*rooms.columns).dropDuplicates(["room"]).join(rooms.select("room"), "room", "left_anti").select(*rooms.columns))


def known_rooms(messages: DataFrame, rooms: DataFrame) -> DataFrame:
    """``messages`` with ``room_known``; none is dropped."""
    known = rooms.select(F.col("room").alias("_room")).distinct().withColumn("_known", F.lit(True))
    return messages.join(known, F.col("room") == F.col("_room"), "left").withColumn("room_known", F.coalesce("_known", F.lit(False))).drop("_room", "_known")


def join_room(rooms: DataFrame, members: DataFrame, sessions: DataFrame, participant: str, room: int, sink: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registers the room and subscribes the participant."""
    new = rooms.sparkSession.createDataFrame([(room,)], "room bigint")
    return register_rooms(rooms.select("room"), new), *subscribe(members, sessions, participant, room, sink)


def capable(mime: str) -> F.Column:
    """Specialists for a media type: a lookup in a fixed table, so no join is needed."""
    kind = base_type(F.col(mime))
    return F.array_compact(F.array(*(F.when(kind.isin(*types), F.lit(name)) for name, types in CAPABILITIES.items())))


def route(files: DataFrame, mime: str = "mime_type", outer: bool = False) -> DataFrame:
    """``files`` with ``specialist``, one row each; files without one are kept with NULL if ``outer``."""
    split = F.explode_outer if outer else F.explode
    return files.withColumn("specialist", split(capable(mime)))


RESULT = "entity_id string, metric_id string, error string, score double, label string, transcription string, title string, author string, pages array<struct<number:int,content:string>>"


def enrich(analyses: DataFrame, results: DataFrame, key: str = "entity_id", order: str = "metric_id") -> DataFrame:
    """Merges results into the stored records: equi-join and update.

    Results with an error are left out.  Scores are added under the metric's id, later ones win; a label is appended
    to the tags; a transcription becomes the file's content (or the recording's text), as does the first page where that is empty;
    a title becomes the summary; an author becomes a tag.
    """
    good = results.filter(F.coalesce(F.col("error"), F.lit("")) == "")
    per = good.groupBy(F.col(key).alias("_e")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "metric_id", "score", "label", "transcription", "title", "author", "pages"))).alias("_r"))
    some = lambda name: F.filter(F.transform("_r", lambda r: r[name]), lambda v: F.coalesce(v, F.lit("")) != "")
    last = lambda arr: F.try_element_at(arr, F.lit(-1))
    scored = F.filter("_r", lambda r: r["score"].isNotNull() & (F.coalesce(r["metric_id"], F.lit("")) != ""))
    new_scores = F.map_from_entries(F.transform(scored, lambda r: F.struct(r["metric_id"], r["score"])))
    keep = F.map_filter("scores", lambda k, _: ~F.array_contains(F.map_keys(new_scores), k))
    first_page = F.try_element_at(F.flatten(F.transform("_r", lambda r: F.coalesce(r["pages"], F.array().cast("array<struct<number:int,content:string>>")))), F.lit(1))["content"]
    body = F.coalesce(last(some("transcription")), F.when(F.coalesce(F.col("payload.file.content"), F.lit("")) == "", first_page), F.col("payload.file.content"))
    joined = analyses.join(per, F.col(key) == F.col("_e"), "left")
    hit = F.col("_e").isNotNull()
    empty_tags = F.array().cast("array<string>")
    return (
        joined.withColumn("scores", F.when(hit, F.map_concat(keep, new_scores)).otherwise(F.col("scores")))
        .withColumn("tags", F.when(hit, F.concat(F.coalesce("tags", empty_tags), some("label"), F.transform(some("author"), lambda a: F.concat(F.lit("author:"), a)))).otherwise(F.col("tags")))
        .withColumn("summary", F.when(hit, F.coalesce(last(some("title")), F.col("summary"))).otherwise(F.col("summary")))
        .withColumn(
            "payload",
            F.when(hit & F.col("payload.file").isNotNull(), F.col("payload").withField("file.content", body))
            .when(hit & F.col("payload.audio").isNotNull(), F.col("payload").withField("audio.transcription", F.coalesce(last(some("transcription")), F.col("payload.audio.transcription"))))
            .otherwise(F.col("payload")),
        )
        .drop("_e", "_r")
    )
