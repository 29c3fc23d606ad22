"""References to records that do not exist, from signed counts per key.

Every change of a child row is a reference delta (+1 insert, -1 delete) of the
key it names, every change of a parent row an existence delta. Their sums per
key are the state; keys with positive references and no existence are the
current orphans. Sums commute, so parents may arrive before or after their
children, and a change batch is folded into the state without reading either
table again. Partial aggregation keeps a hot key from gathering rows.

Defined cases: null or blank references are missing and no orphans; keys are
compared without surrounding blanks; repeated rows add to a count and change
no orphan; empty tables and extra columns are fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import forget, materialize
from feedloom.sources.versioned import VersionedTable

STATE = T.StructType(
    [T.StructField("parent", T.StringType()), T.StructField("key", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("refs", "exists", "bucket"))]
)


def clean_key(col: str | Column) -> Column:
    """Key as trimmed text, null if blank."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.trim(c.cast("string"))
    return F.when(text != "", text)


def existence_deltas(rows: DataFrame, parent: str, key: str, sign: int = 1) -> DataFrame:
    return rows.select(
        F.lit(parent).alias("parent"), clean_key(key).alias("key"),
        F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("exists"),
    ).where("key is not null")


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """``refs`` has (parent, key)."""
    return refs.select("parent", "key", F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists")).where(
        "key is not null"
    )


def fold(*changes: DataFrame) -> DataFrame:
    """State (parent, key, refs, exists) of states and deltas."""
    return (
        reduce(DataFrame.unionByName, changes)
        .groupBy("parent", "key")
        .agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))
        .where("refs <> 0 or exists <> 0")
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    return state.where("refs > 0 and exists <= 0").select("parent", "key")


class ReferenceState:
    """The counts per key as a kept table in ``buckets`` by hash, brought up to date change batch by change batch.

    A batch of deltas, insertions and deletions of either side, is summed first; only the buckets it touches are read and
    replaced, by one atomic commit. Neither table of rows is read again. ``buckets`` should keep a bucket within a task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.store = VersionedTable(spark, path, STATE, "bucket")

    def apply(self, *changes: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("parent", "key"), F.lit(self.buckets))
        batch = materialize(fold(*changes).withColumn("bucket", bucket), "deltas")
        touched = {r.bucket for r in batch.select("bucket").distinct().collect()}  # at most ``buckets``
        if touched:
            stored = self.store.read(only=touched)
            both = batch.unionByName(stored) if self.store.manifest().buckets else batch
            self.store.commit(fold(both.drop("bucket")).withColumn("bucket", bucket), touched)
        forget(batch)

    def read(self) -> DataFrame:
        return self.store.read().drop("bucket")


def references(kills: DataFrame, placements: DataFrame) -> DataFrame:
    """One row per reference: (child_table, ref_field, row_key, day, parent, key).

    The day of a placement, which has no time of its own, is that of the epoch
    seconds at the end of the match id it names, if there are any.
    """
    day = F.col("timestamp").cast("date")
    of_kills = kills.select(
        F.explode(
            F.array(
                F.struct(F.lit("source_event_id").alias("ref_field"), F.lit("feed_events").alias("parent"), clean_key("source_event_id").alias("key")),
                F.struct(F.lit("crop_filename").alias("ref_field"), F.lit("crop_labels").alias("parent"), clean_key("crop_filename").alias("key")),
            )
        ).alias("r"),
        F.col("id").cast("string").alias("row_key"),
        day.alias("day"),
    ).select(F.lit("match_kills").alias("child_table"), "r.ref_field", "row_key", "day", "r.parent", "r.key")
    epoch = F.regexp_extract(F.trim("match_id"), r"_([0-9]{9,11})$", 1)
    of_placements = placements.select(
        F.lit("match_placements").alias("child_table"),
        F.lit("match_id").alias("ref_field"),
        F.concat(F.trim("match_id"), F.lit("|"), F.coalesce(F.trim("player"), F.lit(""))).alias("row_key"),
        F.when(epoch != "", F.timestamp_seconds(epoch.cast("long")).cast("date")).alias("day"),
        F.lit("matches").alias("parent"),
        clean_key("match_id").alias("key"),
    )
    return of_kills.unionByName(of_placements).where("key is not null")


def orphan_references(refs: DataFrame, state: DataFrame) -> DataFrame:
    """The references whose key has no existence by ``state``, each row once."""
    return refs.join(orphan_keys(state), ["parent", "key"], "left_semi").dropDuplicates(["child_table", "ref_field", "row_key"])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of dangling references per table, field and day."""
    return orphans.groupBy("child_table", "ref_field", "day").agg(F.count(F.lit(1)).alias("orphans"))
