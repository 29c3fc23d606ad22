"""The live side: reads in, kept events out, by Structured Streaming.

Everything runs on event time. A read may come ``lateness`` late; rows wait
for the watermark and are handled in order, so a stream gives what a batch
over the same rows gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.lines import parse_lines
from feedloom.functions.text import TextRules
from feedloom.operators.dedup import DedupRules, stream_dedup
from feedloom.sources.sinks import upsert

READ_SCHEMA = "id LONG, streamer STRING, ts TIMESTAMP, text STRING, read_count LONG"


def read_stream(spark: SparkSession, folder: str, schema: str = READ_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def parsed_reads(reads: DataFrame, rules: TextRules) -> DataFrame:
    """Reads parsed to the columns that the suppression needs."""
    rows = parse_lines(reads, "text", rules)
    return rows.select(
        F.lower(F.trim("streamer")).alias("key"), "id", F.unix_micros("ts").alias("us"), "event_type", "attacker", "victim",
        F.coalesce("read_count", F.lit(1)).alias("reads"), "ts",
    ).where("key <> '' and us is not null")


def kept_events(reads: DataFrame, rules: TextRules, dedup: DedupRules = DedupRules(), lateness: str = "30 seconds") -> DataFrame:
    return stream_dedup(parsed_reads(reads, rules).withWatermark("ts", lateness), dedup)


def live_sessions(events: DataFrame, gap: str = "90 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of each streamer, closed once the watermark has passed them."""
    rows = events.withWatermark("ts", lateness).withColumn("key", F.lower(F.trim("streamer"))).where("key <> ''")
    grouped = rows.groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("events"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return grouped.select("key", "start_time", "end_time", "events")


def coverage(anchors: DataFrame, hits: DataFrame, before: str = "10 seconds", after: str = "9 seconds", lateness: str = "1 minute") -> DataFrame:
    """Pairs of anchors and hits of a streamer from ``before`` to ``after`` around the anchor, by a stream-stream join.

    Its keys are streamers and slots of time as wide as the window: an anchor has one, a hit those of the anchors it can
    belong to (two at most), so a row meets the rows of its slot only and not all that the state holds of its streamer.
    """
    spark = anchors.sparkSession
    width = spark.sql(f"select unix_micros(timestamp_seconds(0) + interval {before} + interval {after})").first()[0]
    slot = lambda at: F.floor(F.unix_micros(F.expr(at)) / F.lit(max(width, 1))).cast("long")
    a = anchors.select(F.col("key"), F.col("ts").alias("at"), F.col("id").alias("anchor")).withWatermark("at", lateness).withColumn("slot", slot("at"))
    h = hits.select(F.col("key").alias("hit_key"), F.col("ts").alias("hit_at"), F.col("id").alias("hit")).withWatermark("hit_at", lateness)
    h = h.withColumn("hit_slot", F.explode(F.sequence(slot(f"hit_at - interval {after}"), slot(f"hit_at + interval {before}"))))
    near = F.expr(f"key = hit_key and slot = hit_slot and hit_at >= at - interval {before} and hit_at <= at + interval {after}")
    return a.join(h, near).select("key", "anchor", "hit", "at", "hit_at")


def fold_into(path: str):
    """A ``foreachBatch`` function that adds the reads of suppressed rows to the kept rows of a table published at ``path``."""
    from feedloom.sources.sinks import publish, published

    def fold(batch: DataFrame, batch_id: int) -> None:
        kept = batch.where("id = kept_id").select("id", "key", "event_type", "attacker", "victim")
        reads = batch.groupBy(F.col("kept_id").alias("id")).agg(F.sum("reads").alias("reads"))
        new = kept.join(reads, "id", "full")
        if batch_id == 0:
            publish(new, path)
            return
        old = published(batch.sparkSession, path)
        more = reads.join(old.select("id", F.col("reads").alias("had")), "id").select("id", (F.col("reads") + F.col("had")).alias("reads"))
        grown = old.drop("reads").join(more, "id", "left_semi").join(more, "id").select(*old.columns)
        fresh = new.join(old.select("id"), "id", "left_anti").select(*old.columns)
        publish(upsert(old, grown.unionByName(fresh), ["id"]), path)

    return fold


def rebuild_on(make, every: int = 6):
    """A ``foreachBatch`` function: ``make(batch, clean)``, clean on every so-many-th batch."""

    def rebuild(batch: DataFrame, batch_id: int) -> None:
        make(batch, batch_id % every == 0)

    return rebuild
