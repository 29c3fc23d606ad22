"""One text out of several noisy reads of a line, and clusters of reads in time."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.similarity import ratio_at_least
from feedloom.functions.text import gap_marker
from feedloom.operators.dedup import _stretches, fold_sorted

LEAST_VOTE = 0.4


def vote(reads: list[str]) -> str | None:
    """Letter by letter over reads aligned to the one with most letters and digits; rare positions are left out."""
    reads = [r for r in reads if r]
    if not reads:
        return None
    base = max(reads, key=lambda r: (sum(ch.isalnum() for ch in r), -reads.index(r)))
    seats: list[Counter] = [Counter() for _ in base]
    for read in reads:
        for kind, a, b, c, d in SequenceMatcher(None, base, read).get_opcodes():
            if kind == "equal" or (kind == "replace" and b - a == d - c):
                for k in range(b - a):
                    seats[a + k][read[c + k]] += 1
    return "".join(ch for ch, n in (s.most_common(1)[0] for s in seats if s) if n >= LEAST_VOTE * len(reads))


def best_variant(reads: list[str]) -> str | None:
    """Fewer than three reads: the most frequent, the longer of equals. Else the vote."""
    reads = [" ".join(r.split()) for r in reads if r and r.strip()]
    if len(reads) >= 3:
        return vote(reads)
    return max(reads, key=lambda r: (reads.count(r), len(r), r), default=None)


def best_text(tracks: DataFrame) -> DataFrame:
    """(key, track, text, reads): one text of every track, whose reads are few by its window."""

    @F.pandas_udf(T.StringType())
    def of_reads(lists: pd.Series) -> pd.Series:
        return pd.Series([best_variant(list(x)) for x in lists], dtype="object")

    texts = F.transform(F.sort_array(F.collect_list(F.struct("us", "id", "text"))), lambda r: r["text"])
    return tracks.groupBy("key", "track").agg(texts.alias("texts")).select("key", "track", of_reads("texts").alias("text"), F.size("texts").alias("reads"))


TRACKS = "key string, id long, us long, text string, track long"
_MARK = re.compile(r"<(kill|gun)_icon>", re.IGNORECASE)


def _marker_of(text: str) -> str:
    """'kill' before 'gun' before none, as ``text.gap_marker``."""
    return min((m.lower() for m in _MARK.findall(text)), key=["kill", "gun"].index, default="")


def track_reads(reads: DataFrame, window_us: int = 6_000_000, similarity: float = 0.75, markers: str = "any") -> DataFrame:
    """``reads`` (key, id, us, text) with the track of each: the most similar open track of the key seen in the last seconds.

    A track is compared by its first text. ``markers``: 'same' lets only reads of one marker (kill, gun, none) meet, 'voted'
    compares texts without regard to it, as a vote decides later. Silence of a key longer than the window parts stretches
    that stream by on their own; a task holds the open tracks only.
    """

    def step(open_: list[list], row: dict) -> tuple:
        us, text = row["us"], row["text"] if isinstance(row["text"], str) else ""
        kind = _marker_of(text) if markers == "same" else ""
        plain = _MARK.sub("<ICON>", text) if markers == "voted" else text
        open_[:] = [t for t in open_ if us - t[0] <= window_us]
        near = [(SequenceMatcher(None, plain, t[1]).ratio(), -k) for k, t in enumerate(open_) if t[3] == kind and ratio_at_least(plain, t[1], similarity)]
        if near:
            track = open_[-max(near)[1]]
            track[0] = us
        else:
            track = [us, plain, row["id"], kind]
            open_.append(track)
        return row["key"], row["id"], us, row["text"], track[2]

    placed = _stretches(reads.select("key", "id", "us", "text"), ["key"], window_us)
    return fold_sorted(placed, ["key", "stretch"], ["us", "id"], list, step, TRACKS)


def flushed_tracks(tracks: DataFrame, least_run: int = 3, least_share: float = 0.5) -> DataFrame:
    """(key, track, last_us, text, reads, icon_vote) of every track, as a timer that finds it silent puts it out.

    The marker is 'kill' if kill reads are ``least_run`` in a row and ``least_share`` of the marked ones, else 'gun'; without a marked read it is null.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("us", "id", gap_marker("text").alias("m")))), lambda r: r["m"])
    rows = tracks.groupBy("key", "track").agg(F.max("us").alias("last_us"), ordered.alias("marks"))
    marked = rows.withColumn("marks", F.filter("marks", lambda m: m.isNotNull()))
    longest = F.aggregate(
        "marks", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, m: F.struct(F.when(m == "kill", s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(m == "kill", s["now"] + 1).otherwise(0)).alias("most")),
    )["most"]
    kills = F.size(F.filter("marks", lambda m: m == "kill"))
    decision = F.when(F.size("marks") == 0, F.lit(None).cast("string")).when((longest >= least_run) & (kills >= least_share * F.size("marks")), "kill").otherwise("gun")
    return best_text(tracks).join(marked.select("key", "track", "last_us", decision.alias("icon_vote")), ["key", "track"]).select("key", "track", "last_us", "text", "reads", "icon_vote")


def cluster_in_time(rows: DataFrame, window_us: int = 120_000_000, similarity: float = 0.82) -> DataFrame:
    """Victims of one game clustered by similar name in a sliding window: as ``track_reads``, on names."""
    return track_reads(rows, window_us, similarity)
