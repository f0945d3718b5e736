"""Registered queries over text, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgflow.llm import leakage, lookalike, mojibake, packing, personal, scanned, toxicity
from msgflow.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "messages"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, sf_dir, "messages"))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonicalize(table(spark, sf_dir, "messages").select("id", "write_seq", "content"))


def page_key() -> Column:
    return F.concat("entity_id", F.lit("#"), F.col("number").cast("string"))


def scanned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "document_pages").select(
        F.lit("document_pages").alias("record_table"), page_key().alias("record_key"), F.col("entity_id").alias("entity"), F.col("number").cast("int").alias("number"), F.col("content").alias("text")
    )
    tapes = table(spark, sf_dir, "audio_details").select(
        F.lit("audio_details").alias("record_table"), F.col("entity_id").alias("record_key"), F.col("entity_id").alias("entity"), F.lit(None).cast("int").alias("number"), F.col("transcription").alias("text")
    )
    return pages.unionByName(tapes)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.defects(scanned_records(spark, sf_dir))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repair(scanned_records(spark, sf_dir))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages").select(F.col("id").alias("record_key"), "content")
    pages = table(spark, sf_dir, "document_pages").select(page_key().alias("record_key"), "content")
    lex = personal.learn_lexicon([(messages, "content"), (pages, "content")])
    field = personal.train_field()
    parts = [
        personal.find_personal(df, "record_key", "content", lex, field).withColumn("record_table", F.lit(name))
        for name, df in (("messages", messages), ("document_pages", pages))
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("record_table", "record_key", F.explode("kinds").alias("kind")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("record_table", "record_key", "redacted")


def _scored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.train(table(spark, sf_dir, "moderation_cases"), table(spark, sf_dir, "censored_words"))
    return toxicity.score_texts(table(spark, sf_dir, "messages").select("id", "room", "content"), model)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_messages(spark, sf_dir).filter(F.col("content_score") >= toxicity.THRESHOLD).select("id").distinct()


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_messages(spark, sf_dir).select("id", "room", "content_score")


def p6_room_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(_scored_messages(spark, sf_dir), "room")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: every document placed, none over the capacity, none cut that fits, and few containers."""
    placed = p7_containers(spark, sf_dir)
    tokens = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    fill = tokens.filter(F.col("container_id").isNotNull()).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("n_over"), (F.count("*") - F.ceil(F.sum("n") / packing.CAPACITY) > 0.01 * F.count("*") + 1).alias("wasteful"))
    whole = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.count("container_id").alias("placed"))
    docs = whole.agg(F.count("*").alias("n_documents"), F.count_if((F.col("n") > 0) & (F.col("placed") < F.col("pieces"))).alias("n_unplaced"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("n_cut"))
    return docs.withColumn("one", F.lit(1)).join(fill.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_restored(spark, sf_dir).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair_encoding(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_canonical, p3_found, p3_repaired, p5_found, p5_redacted, p6_found, p6_scores, p6_room_rates, p7_containers, p7_check, p8_found, p8_passages, p9_found, p9_restored)}

SQL: dict[str, str] = {
    # invariants: SQL can't count the tokens, but it knows what must come out
    "p7_check": "SELECT count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_unplaced, CAST(0 AS BIGINT) AS n_cut, CAST(0 AS BIGINT) AS n_over, false AS wasteful FROM documents",
}
