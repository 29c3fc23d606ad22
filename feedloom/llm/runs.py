"""Runs of equal consecutive events, collapsed into one event with count and duration.

Within time buckets of an entity, an event's row number less its row number
among the events of its own value is constant along a run; (value, difference,
session) identifies it. Runs that touch a bucket's edge are then joined to
their continuation. Of an entity at most two runs a bucket take part in that,
so no task ever holds all events of a hot entity. The local runs are written once,
as both parts read them.

Defined cases: rows without entity or time are left out; rows of equal
(entity, time, id) count once; a null value ends the run before it and is in
none; silence longer than the gap ends a run; ties in time are ordered by id;
an empty table has no runs; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import materialize

BUCKET_US = 3_600_000_000


def collapse_runs(events: DataFrame, gap_us: int, bucket_us: int = BUCKET_US) -> DataFrame:
    """``events``: (key, us, id, value). Every run: (key, value, start_us, end_us, min_id, max_id, events)."""
    bucket = Window.partitionBy("key", "bucket")
    in_time = bucket.orderBy("us", "id")
    rows = (
        events.where("key is not null and us is not null")
        .withColumn("bucket", F.floor(F.col("us") / F.lit(bucket_us)).cast("long"))
        .repartition("key", "bucket")
        .groupBy("key", "bucket", "us", "id")
        .agg(F.max("value").alias("value"))
        .withColumn("opens", F.when(F.col("us") - F.lag("us").over(in_time) > gap_us, 1).otherwise(0))
        .withColumn("place", F.row_number().over(in_time))
        .withColumn("session", F.sum("opens").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    )
    of_value = Window.partitionBy("key", "bucket", "value").orderBy("us", "id")
    local = materialize(
        rows.withColumn("shift", F.col("place") - F.row_number().over(of_value))
        .groupBy("key", "bucket", "session", "value", "shift")
        .agg(
            F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("id").alias("min_id"), F.max("id").alias("max_id"),
            F.count(F.lit(1)).alias("events"), F.min("place").alias("first"), F.max("place").alias("last"),
        )
        .withColumn("head", F.col("first") == 1)
        .withColumn("tail", F.col("last") == F.max("last").over(bucket)),
        "local-runs",
    )
    out = ["key", "value", "start_us", "end_us", "min_id", "max_id", "events"]
    inner = local.where("not head and not tail and value is not null").select(*out)
    edges = Window.partitionBy("key").orderBy("bucket", "first")
    before = edges.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = (
        F.col("head")
        & F.lag("tail").over(edges)
        & (F.col("start_us") - F.lag("end_us").over(edges) <= gap_us)
        & (F.col("value") == F.lag("value").over(edges))
    )
    joined = (
        local.where("head or tail")
        .withColumn("starts", F.when(goes_on, 0).otherwise(1))
        .withColumn("n", F.sum("starts").over(before))
        .where("value is not null")
        .groupBy("key", "n", "value")
        .agg(
            F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min("min_id").alias("min_id"),
            F.max("max_id").alias("max_id"), F.sum("events").alias("events"),
        )
        .select(*out)
    )
    return inner.unionByName(joined)


def canonical_values(events: DataFrame, names: DataFrame, left: str, right: str) -> DataFrame:
    """``events`` (key, us, id and the two name columns) with ``value``: both names in canonical form, null if one is missing.

    ``names`` (name, canonical) holds the spellings that differ from their
    canonical form. Rows without both names keep out of the joins.
    """
    clean = events.select("key", "us", "id", F.trim(left).alias("a"), F.trim(right).alias("b"))
    usable = F.coalesce((F.col("a") != "") & (F.col("b") != ""), F.lit(False))
    whole = (
        clean.where(usable)
        .join(names.select(F.col("name").alias("a"), F.col("canonical").alias("ca")), "a", "left")
        .join(names.select(F.col("name").alias("b"), F.col("canonical").alias("cb")), "b", "left")
        .select("key", "us", "id", F.concat(F.coalesce("ca", "a"), F.lit("\n"), F.coalesce("cb", "b")).alias("value"))
    )
    return whole.unionByName(clean.where(~usable).select("key", "us", "id", F.lit(None).cast("string").alias("value")))
