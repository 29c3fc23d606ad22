"""Queries over player names: variant spellings (p4) and repeated events (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.runs import canonical_values, collapse_runs
from feedloom.llm.spellings import attribute, feed_spellings, variant_pairs
from feedloom.operators.sessions import GAP_US, from_micros, micros
from feedloom.session import table


def _attributed(spark: SparkSession, folder: str) -> DataFrame:
    return attribute(feed_spellings(table(spark, folder, "feed_events"), table(spark, folder, "player_ratings")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(_attributed(spark, folder))


def p4_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with the canonical form that it is attached to."""
    return _attributed(spark, folder)


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    names = _attributed(spark, folder).where("name <> canonical")
    events = table(spark, folder, "feed_events").select(
        F.lower(F.trim("streamer")).alias("key"), micros("timestamp").alias("us"), "id", "attacker", "victim"
    )
    return collapse_runs(canonical_values(events.where("key <> '' and us is not null"), names, "attacker", "victim"), GAP_US)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).where("events >= 2").select("min_id", "max_id")


def p6_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run, single events included."""
    return _runs(spark, folder).select(
        F.col("key").alias("streamer"),
        F.split("value", "\n")[0].alias("attacker"),
        F.split("value", "\n")[1].alias("victim"),
        from_micros("start_us").alias("start_time"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"),
        F.col("events").alias("reads"),
        "min_id",
        "max_id",
    )


QUERIES = {"p4_found": p4_found, "p4_canonical": p4_canonical, "p6_found": p6_found, "p6_collapsed": p6_collapsed}
ORACLE: dict[str, str] = {}
