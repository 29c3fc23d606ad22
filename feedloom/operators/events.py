"""Scans and predicates over event rows. All filters reach the Parquet scan where they can."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATING_SOURCES = ("trocr", "easyocr")
FINGERPRINT_TYPES = ("Knock", "KillUnverified")


def present(col: str) -> Column:
    """Not null and not blank."""
    return F.length(F.trim(F.coalesce(F.col(col), F.lit("")))) > 0


def name_or_null(col: str) -> Column:
    return F.when(present(col), F.trim(col))


def confidence(col: str) -> Column:
    """Stored confidences of 0 or null count as one half."""
    return F.when(F.col(col).isNull() | (F.col(col) == 0), 0.5).otherwise(F.col(col))


def query_events(
    events: DataFrame,
    streamer: str | None = None,
    event_type: str | None = None,
    attacker: str | None = None,
    victim: str | None = None,
    from_ts: dt.datetime | None = None,
    to_ts: dt.datetime | None = None,
    source: str | None = None,
    corrected_only: bool = False,
    limit: int | None = None,
    offset: int = 0,
    newest_first: bool = False,
) -> DataFrame:
    """Filtered page of events by id. Types and streamers compare without case, names by substring, times inclusively."""
    out = events
    if streamer is not None:
        out = out.where(F.lower("streamer") == streamer.lower())
    if event_type is not None:
        out = out.where(F.lower("event_type") == event_type.lower())
    for col, part in (("attacker", attacker), ("victim", victim)):
        if part is not None:
            out = out.where(F.lower(col).like(f"%{part.lower()}%"))
    if from_ts is not None:
        out = out.where(F.col("timestamp") >= F.lit(from_ts).cast("timestamp_ntz"))
    if to_ts is not None:
        out = out.where(F.col("timestamp") <= F.lit(to_ts).cast("timestamp_ntz"))
    if source is not None:
        out = out.where(F.col("source") == source)
    if corrected_only:
        out = out.where(F.col("gemini_corrected") == 1)
    if limit is not None:
        out = out.orderBy(F.col("id").desc() if newest_first else F.col("id").asc()).offset(offset).limit(limit)
    return out


def rating_input(events: DataFrame) -> DataFrame:
    """Rows that ratings are made of: kills with a victim, bleed-outs with both names, from the trusted readers."""
    kill = (F.col("event_type") == "Kill") & present("victim")
    bleed = (F.col("event_type") == "BleedOut") & present("attacker") & present("victim")
    return events.where((kill | bleed) & F.col("source").isin(*RATING_SOURCES))


def fingerprints(events: DataFrame) -> DataFrame:
    """Rows that tell matches apart without counting for ratings."""
    return events.where(F.col("event_type").isin(*FINGERPRINT_TYPES) & present("attacker") & present("victim") & F.col("source").isin(*RATING_SOURCES))


def suspicion(name: str) -> tuple[Column, Column]:
    """Score of one side's name and its reasons: 2 for a blank inside or four letters at most, 1 for short with digits or odd characters."""
    n = F.trim(F.coalesce(F.col(name), F.lit("")))
    there = n != ""
    tests = [
        (there & n.contains(" "), 2, "space"),
        (there & (F.length(n) <= 4), 2, "short"),
        (there & (F.length(n) <= 6) & n.rlike("[0-9]"), 1, "short with digits"),
        (there & n.rlike("[^A-Za-z0-9_. \\-]"), 1, "special characters"),
    ]
    score = F.lit(0)
    for test, points, _ in tests:
        score = score + F.when(test, points).otherwise(0)
    reasons = F.concat_ws(" | ", *(F.when(test, F.lit(f"{name}: {why}")) for test, _, why in tests))
    return score, reasons
