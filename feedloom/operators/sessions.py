"""Sessions: stretches of activity of one key, parted by silence.

The plan never sorts raw events of one key in one task. Events are first put
into cells as long as the gap: two events of one cell can't be further apart
than the gap, so a cell lies within one session and is one aggregated row. Of
a key there are at most (time span / gap) cells, however many events it has,
and only these are ordered by a window.

Defined cases: rows whose key or time is null, or whose key is blank, belong
to no session; equal (key, time, id) rows count once; exactly ``gap`` apart is
together; an empty table has no sessions; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import forget, fresh_path, materialize
from feedloom.sources.versioned import VersionedTable

GAP_US = 90_000_000
DAY_US = 86_400_000_000

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("start_us", T.LongType()),
        T.StructField("end_us", T.LongType()),
        T.StructField("min_id", T.LongType()),
        T.StructField("max_id", T.LongType()),
        T.StructField("events", T.LongType()),
        T.StructField("day", T.LongType()),
    ]
)


ROW_SCHEMA = T.StructType([T.StructField("key", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("us", "id", "day"))])


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ column (UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def from_micros(us: str) -> Column:
    return F.timestamp_micros(F.col(us)).cast("timestamp_ntz")


def usable_events(events: DataFrame, key: str = "streamer", ts: str = "timestamp", id_: str = "id") -> DataFrame:
    """(key, us, id): keys trimmed and lower-cased, rows without key or time left out."""
    return events.select(
        F.lower(F.trim(F.col(key))).alias("key"), micros(ts).alias("us"), F.col(id_).cast("long").alias("id")
    ).where("key is not null and key <> '' and us is not null")


def local_sessions(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Sessions of the rows (key, us, id) of one batch."""
    cells = (
        events.withColumn("cell", F.floor(F.col("us") / F.lit(gap_us)).cast("long"))
        .repartition("key", "cell")
        .groupBy("key", "cell", "us", "id")
        .agg(F.lit(1).alias("one"))
        .groupBy("key", "cell")
        .agg(
            F.min("us").alias("start_us"),
            F.max("us").alias("end_us"),
            F.min("id").alias("min_id"),
            F.max("id").alias("max_id"),
            F.count(F.lit(1)).alias("events"),
        )
    )
    return merge_bridged(cells, gap_us)


def merge_bridged(parts: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Unite intervals of a key that overlap or lie at most ``gap_us`` apart.

    ``parts`` has (key, start_us, end_us, min_id, max_id, events) and at most a
    few rows per gap-long cell of time and key.
    """
    order = Window.partitionBy("key").orderBy("start_us", "end_us")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_us").over(before)
    return (
        parts.withColumn("opens", F.when(F.col("start_us") - reach <= gap_us, 0).otherwise(1))
        .withColumn("n", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "n")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.min("min_id").alias("min_id"),
            F.max("max_id").alias("max_id"),
            F.sum("events").cast("long").alias("events"),
        )
        .select(
            "key", "start_us", "end_us", "min_id", "max_id", "events",
            F.floor(F.col("start_us") / F.lit(DAY_US)).cast("long").alias("day"),
        )
    )


class SessionTable:
    """Stored sessions, kept up to date batch by batch.

    A batch may hold any times: late events extend, bridge or precede stored
    sessions. Only the days are rewritten in which a stored session lies within
    reach of one of the batch. With ``seen`` the table also keeps the (key, us,
    id) of all rows by day of time, and rows that come again, in the same batch
    or a later one, count once; without it a batch must bring whole sets of
    repeated rows.
    """

    def __init__(self, spark: SparkSession, path: str, gap_us: int = GAP_US, seen: bool = False):
        self.spark, self.gap_us = spark, gap_us
        self.store = VersionedTable(spark, path, SESSION_SCHEMA, "day")
        self.rows = VersionedTable(spark, f"{path.rstrip('/')}-rows", ROW_SCHEMA, "day") if seen else None

    def _new_rows(self, batch: DataFrame) -> DataFrame:
        rows = batch.select("key", "us", "id").distinct().withColumn("day", F.floor(F.col("us") / F.lit(DAY_US)).cast("long"))
        rows = materialize(rows, "rows")
        days = {r.day for r in rows.select("day").distinct().collect()}  # bounded by the span of the batch
        stored = self.rows.read(only=days)
        fresh = rows.join(stored, ["key", "us", "id", "day"], "left_anti").select(*ROW_SCHEMA.fieldNames())
        fresh = materialize(fresh, "new-rows")
        self.rows.commit(stored.unionByName(fresh), days)
        return fresh.drop("day")

    def apply(self, batch: DataFrame) -> None:
        """``batch``: (key, us, id). One pass: local sessions, stored ones within reach, merge, replace."""
        local = materialize(local_sessions(self._new_rows(batch) if self.rows else batch, self.gap_us), "local-sessions")
        # Days that a session of the batch or its reach touches, one row each.
        day = lambda us: F.floor(us / F.lit(DAY_US)).cast("long")
        reach = F.sequence(day(F.col("start_us") - self.gap_us), day(F.col("end_us") + self.gap_us))
        touched = {r.d for r in local.select(F.explode(reach).alias("d")).distinct().collect()}
        if not touched:
            return
        # A stored session lies on the day of its start and may reach into a touched one from as far as that day's longest session goes.
        longest = self.store.manifest().facts.get("largest", {})
        near = {int(d) for d, most in longest.items() if any(int(d) + k in touched for k in range(int(most // DAY_US) + 2))}
        merged = merge_bridged(local.unionByName(self.store.read(only=near)).drop("day"), self.gap_us)
        self.store.commit(merged, near, F.col("end_us") - F.col("start_us"))
        forget(local)

    def read(self) -> DataFrame:
        return self.store.read()


def sessionize_in_batches(events: DataFrame, arrival: str = "created_at", batches: int = 3, gap_us: int = GAP_US) -> DataFrame:
    """The session table of ``events``, filled in ``batches`` steps by time of arrival.

    Copies of a row have one arrival and come in one batch. Rows without an
    arrival come first.
    """
    spark = events.sparkSession
    store = SessionTable(spark, fresh_path(spark, "session-table"), gap_us)
    first, last = events.agg(F.min(arrival), F.max(arrival)).first()
    if first is None:
        store.apply(usable_events(events))
        return store.read()
    step = max(1, -(-(last - first + 1) // batches))
    for k in range(batches):
        low, high = first + k * step, first + (k + 1) * step
        inside = (F.col(arrival) >= low) & (F.col(arrival) < high)
        store.apply(usable_events(events.where(inside | F.col(arrival).isNull() if k == 0 else inside)))
    return store.read()
