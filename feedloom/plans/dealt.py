"""Queries of the general problems: sessions (p1) and dangling references (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.references import ReferenceState, existence_deltas, orphan_references, orphan_report, reference_deltas, references
from feedloom.operators.sessions import from_micros, micros, sessionize_in_batches
from feedloom.session import fresh_path, table


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessionize_in_batches(table(spark, folder, "feed_events"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sessions(spark, folder).select(F.col("key").alias("streamer"), "min_id", "max_id")


def p1_sessions_with_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every session next to the match spans of its streamer that it touches.

    Spans and sessions meet in hours of time, so that no streamer's sessions
    are compared with all of its matches. A span whose end is missing or too
    early counts as its start alone.
    """
    hour = 3_600_000_000
    sessions = _sessions(spark, folder)
    spans = table(spark, folder, "matches").select(
        "match_id",
        F.lower(F.trim("streamer")).alias("key"),
        micros("start_time").alias("m_start"),
        F.greatest(micros("start_time"), F.coalesce(micros("end_time"), micros("start_time"))).alias("m_end"),
    )

    def hours(low: str, high: str):
        return F.explode(F.sequence(F.floor(F.col(low) / hour), F.floor(F.col(high) / hour)))

    touched = (
        sessions.select("key", "start_us", "end_us", hours("start_us", "end_us").alias("h"))
        .join(spans.where("m_start is not null").withColumn("h", hours("m_start", "m_end")), ["key", "h"])
        .where("m_start <= end_us and start_us <= m_end")
        .groupBy("key", "start_us")
        .agg(F.count_distinct("match_id").alias("matches"), F.min("m_start").alias("first_start"), F.max("m_end").alias("last_end"))
    )
    return sessions.join(touched, ["key", "start_us"], "left").select(
        F.col("key").alias("streamer"),
        from_micros("start_us").alias("start_time"),
        from_micros("end_us").alias("end_time"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"),
        F.col("events").alias("event_count"),
        F.coalesce("matches", F.lit(0)).cast("long").alias("matches_touched"),
        from_micros("first_start").alias("first_match_start"),
        from_micros("last_end").alias("last_match_end"),
    )


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans by a kept state, in three change batches: what came first, what came late, and the deletion of rows that came twice."""
    t = lambda name: table(spark, folder, name)
    refs = references(t("match_kills"), t("match_placements"))
    events = t("feed_events").select("id", "created_at")
    low, high = events.agg(F.min("created_at"), F.max("created_at")).first()
    late = F.coalesce(F.col("created_at") > F.lit((low + high) // 2 if low is not None else 0), F.lit(False))
    state = ReferenceState(spark, fresh_path(spark, "reference-state"), buckets=max(16, t("match_kills").count() // 500_000))
    state.apply(reference_deltas(refs), existence_deltas(events.where(~late), "feed_events", "id"), existence_deltas(t("matches"), "matches", "match_id"))
    state.apply(existence_deltas(events.where(late), "feed_events", "id"), existence_deltas(t("crop_labels"), "crop_labels", "filename"))
    copies = refs.groupBy("child_table", "ref_field", "row_key", "parent", "key").agg((F.count(F.lit(1)) - 1).alias("copies")).where("copies > 0")
    gone = copies.select("parent", "key", (-F.col("copies")).alias("refs"), F.lit(0).cast("long").alias("exists"))
    state.apply(gone)
    return orphan_references(refs, state.read())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("child_table", "ref_field", "row_key")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder))


QUERIES = {
    "p1_found": p1_found,
    "p1_sessions_with_matches": p1_sessions_with_matches,
    "p2_found": p2_found,
    "p2_report": p2_report,
}

_SESSIONS = """
with e as (
  select distinct id, lower(trim(streamer)) as streamer, timestamp as ts from feed_events
  where trim(streamer) <> '' and timestamp is not null),
f as (select *, case when ts - lag(ts) over w <= interval 90 second then 0 else 1 end as opens
      from e window w as (partition by streamer order by ts, id)),
g as (select *, sum(opens) over (partition by streamer order by ts, id rows unbounded preceding) as n from f),
s as (select streamer, n, min(ts) as start_time, max(ts) as end_time, min(id) as min_id, max(id) as max_id, count(*) as event_count
      from g group by streamer, n)
"""

_ORPHANS = """
with r as (
  select 'match_kills' as child_table, 'source_event_id' as ref_field, cast(id as varchar) as row_key,
         cast(timestamp as date) as day, cast(source_event_id as varchar) as k
  from match_kills k where source_event_id is not null
    and not exists (select 1 from feed_events e where e.id = k.source_event_id)
  union
  select 'match_kills', 'crop_filename', cast(id as varchar), cast(timestamp as date), trim(crop_filename)
  from match_kills k where trim(crop_filename) <> ''
    and not exists (select 1 from crop_labels l where trim(l.filename) = trim(k.crop_filename))
  union
  select 'match_placements', 'match_id', trim(match_id) || '|' || coalesce(trim(player), ''),
         cast(epoch_ms(1000 * try_cast(nullif(regexp_extract(trim(match_id), '_([0-9]{9,11})$', 1), '') as bigint)) as date), trim(match_id)
  from match_placements p where trim(match_id) <> ''
    and not exists (select 1 from matches m where trim(m.match_id) = trim(p.match_id)))
"""

ORACLE = {
    "p1_found": _SESSIONS + "select streamer, min_id, max_id from s",
    "p1_sessions_with_matches": _SESSIONS
    + """, m as (select match_id, lower(trim(streamer)) as streamer, start_time as m_start,
             greatest(start_time, coalesce(end_time, start_time)) as m_end from matches where start_time is not null)
    select s.streamer, s.start_time, s.end_time, (epoch_us(s.end_time) - epoch_us(s.start_time)) / 1e6 as duration_s, s.event_count,
           count(distinct match_id) as matches_touched, min(m_start) as first_match_start, max(m_end) as last_match_end
    from s left join m on m.streamer = s.streamer and m_start <= s.end_time and s.start_time <= m_end
    group by all""",
    "p2_found": _ORPHANS + "select distinct child_table, ref_field, row_key from r",
    "p2_report": _ORPHANS
    + "select child_table, ref_field, day, count(distinct row_key) as orphans from r group by all",
}
