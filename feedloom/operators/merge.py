"""The same match seen by several streams, merged into one.

Only views that share a line (similar names, close in time) can ever be merged,
directly or after others, so lines are compared in spans of time, and the graph
of the views whose lines are alike falls into the groups that show one match;
overlap alone would tie all views of a busy hour together. Groups stream by,
sorted, and each is merged on its own; its size is that of the views of one match.

Inside a group the order matters: of all pairs that can be united the first in
the order of the streams' first kill and of time is, then all again. What once
could not be united is not tried again before one of the two has changed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations, groupby
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.similarity import likely_pairs, ratio_at_least, ratio_if_at_least
from feedloom.operators.graph import components
from feedloom.session import materialize

# Clocks of two streams are so far apart at most, spans may be, lines are so similar, and so many are shared.
SKEW_US, SLOP_US, SIMILARITY, LEAST_SHARED = 60_000_000, 120_000_000, 0.75, 3
#: Merging shifts clocks, so ends and lines may move; candidates take in that much more.
MARGIN_US = 300_000_000


@dataclass
class Seen:
    """One event of a match."""

    us: int
    id: int
    attacker: str | None
    victim: str | None
    attacker_conf: float = 1.0
    victim_conf: float = 1.0

    @property
    def line(self) -> str | None:
        return f"{self.attacker}|{self.victim}".lower() if self.attacker and self.victim else None


@dataclass
class View:
    match_id: str
    streamer: str
    kills: list[Seen]
    marks: list[Seen] = field(default_factory=list)
    merged: list[str] = field(default_factory=list)

    @property
    def span(self) -> tuple[int, int]:
        return self.kills[0].us, self.kills[-1].us

    @property
    def events(self) -> list[Seen]:
        return self.kills + self.marks


class Lines:
    """Named events of a view by time, to be taken once each."""

    def __init__(self, events: list[Seen]):
        self.events = events
        self.lines = [e.line for e in events]
        self.by_time = sorted((e.us, k) for k, e in enumerate(events) if self.lines[k])
        self.times = [us for us, _ in self.by_time]
        self.taken: set[int] = set()

    def near(self, us: int, window_us: int) -> list[int]:
        """Places of the free events at most ``window_us`` away, in the order of the view."""
        found = self.by_time[bisect_left(self.times, us - window_us) : bisect_right(self.times, us + window_us)]
        return sorted(k for _, k in found if k not in self.taken)

    def take_like(self, line: str, us: int) -> Seen | None:
        """The most similar free event, the first of equals."""
        best, at = 0.0, None
        for k in self.near(us, SKEW_US):
            r = ratio_if_at_least(line, self.lines[k], max(SIMILARITY, best))
            if r is not None and r > best:
                best, at = r, k
        if at is None:
            return None
        self.taken.add(at)
        return self.events[at]


def shared_events(left: list[Seen], right: list[Seen]) -> list[tuple[Seen, Seen]]:
    """One to one: every left event in turn with the most similar event of the right side."""
    lines = Lines(right)
    found = [(e, lines.take_like(e.line, e.us)) for e in left if e.line]
    return [(a, b) for a, b in found if b is not None]


def unite(first: View, second: View) -> View | None:
    """``second`` put on the clock of ``first`` by the median offset of what they share, if that is enough. Shared kills keep the better confidences."""
    offsets = [b.us - a.us for a, b in shared_events(first.events, second.events)]
    if len(offsets) < LEAST_SHARED:
        return None
    offset = median(offsets)
    twins = {id(a): b for a, b in shared_events(first.kills, second.kills)}
    here = {id(b) for b in twins.values()}

    def surer(e: Seen) -> Seen:
        twin = twins.get(id(e), e)
        return replace(e, attacker_conf=max(e.attacker_conf, twin.attacker_conf), victim_conf=max(e.victim_conf, twin.victim_conf))

    def moved(events: list[Seen]) -> list[Seen]:
        return [replace(e, us=round(e.us - offset)) for e in events if id(e) not in here]

    kills = sorted([surer(e) for e in first.kills] + moved(second.kills), key=lambda e: e.us)
    return View(first.match_id, first.streamer, kills, first.marks + moved(second.marks), [*first.merged, *second.merged, second.match_id])


def merge_views(views: list[View]) -> list[View]:
    """Merge until nothing fits any more; ``views`` in their order of trial. The view with more kills leads, the earlier of equals."""
    views, refused = list(views), set()

    def united(a: View, b: View) -> View | None:
        if (id(a), id(b)) in refused or a.streamer == b.streamer:
            return None
        (s, e), (t, f) = a.span, b.span
        if s - SLOP_US <= f and t - SLOP_US <= e:
            first, second = sorted((a, b), key=lambda v: (-len(v.kills), v.span[0]))
            if (new := unite(first, second)) is not None:
                return new
        refused.add((id(a), id(b)))
        return None

    keep = list(views)  # ids of views must stay theirs
    while True:
        found = next(((i, j, new) for i, j in combinations(range(len(views)), 2) if (new := united(views[i], views[j]))), None)
        if found is None:
            return views
        i, j, new = found
        keep.append(new)
        views[i] = new
        del views[j]


MERGED = "match_id string, streamer string, id long, us long, attacker string, victim string, kill_order int, attacker_conf double, victim_conf double, merged_from string"


def mergeable_pairs(events: DataFrame) -> DataFrame:
    """(a, b), a < b: views of two streams that share a line: a merge could find one, whatever clocks are shifted by. ``events`` have match_id.

    Lines meet in spans of time as wide as the window, each with those of its own span and of the one before, where
    letters and common subsequences leave few to compare (``likely_pairs``).
    """
    reach = SKEW_US + MARGIN_US
    line = F.concat_ws("|", "attacker", "victim")
    lines = events.where("attacker is not null and victim is not null").select("match_id", "key", "us", line.alias("line"))
    span = F.floor(F.col("us") / reach).cast("long")
    met = lines.withColumn("own", span).withColumn("span", F.explode(F.array(F.col("own"), F.col("own") + 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["match_id", "us", "line"], kind="stable")
        lines = [t.lower() for t in pdf["line"]]
        own = np.flatnonzero(pdf["own"].to_numpy() == pdf["span"].to_numpy())
        p, q = likely_pairs([lines[k] for k in own], lines, SIMILARITY)
        p = own[p]
        us, (views, _), (keys, _) = pdf["us"].to_numpy(), pd.factorize(pdf["match_id"], sort=True), pd.factorize(pdf["key"])
        near = (np.abs(us[p] - us[q]) <= reach) & (keys[p] != keys[q])
        p, q = p[near], q[near]
        first = views[p] < views[q]
        p, q = np.where(first, p, q), np.where(first, q, p)
        ids, found = pdf["match_id"].tolist(), set()
        for i, j in zip(p.tolist(), q.tolist()):
            pair = (ids[i], ids[j])
            if pair not in found and (ratio_at_least(lines[i], lines[j], SIMILARITY) or ratio_at_least(lines[j], lines[i], SIMILARITY)):
                found.add(pair)
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype=object)

    return met.groupBy("span").applyInPandas(run, "a string, b string").distinct()


def merge_matches(events: DataFrame, least_kills: int = 3) -> DataFrame:
    """Kills of the merged matches, from the chunked events of ``matches.match_events``; short matches are dropped after merging."""
    events = materialize(events, "match-events")
    kills = events.where("is_kill")
    match = ["key", "session", "chunk"]
    spans = kills.groupBy(*match).agg(F.min("us").alias("s"))
    spans = spans.withColumn("match_id", F.concat_ws("_", "key", F.floor(F.col("s") / 1_000_000).cast("long"), "chunk"))
    placed = events.join(spans, match)
    groups = components(mergeable_pairs(placed))
    first = kills.groupBy("key").agg(F.min("us").alias("opened"))
    placed = placed.join(groups.withColumnRenamed("member", "match_id"), "match_id", "left").withColumn("group", F.coalesce("group", "match_id"))
    order = ["group", "opened", "key", "s", "match_id", "us", "id"]
    columns = [*order, "is_kill", "attacker", "victim", "attacker_conf", "victim_conf"]
    name = lambda x: x if isinstance(x, str) else None

    def merged(rows: Iterator[tuple]) -> list[tuple]:
        views = []
        for (_, _, key, _, match_id), part in groupby(rows, key=lambda r: r[:5]):
            seen = [(r[7], Seen(r[5], r[6], name(r[8]), name(r[9]), r[10], r[11])) for r in part]
            views.append(View(match_id, key, [e for k, e in seen if k], [e for k, e in seen if not k]))
        out = []
        for v in merge_views(views):
            if len(v.kills) >= least_kills:
                title = f"{v.streamer}_{v.span[0] // 1_000_000}"
                out += [(title, v.streamer, e.id, e.us, e.attacker, e.victim, n, e.attacker_conf, e.victim_conf, ",".join(v.merged)) for n, e in enumerate(v.kills, 1)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups lie sorted in a partition and stream by, one in memory at a time."""
        rows = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
        waiting: list[tuple] = []
        for _, part in groupby(rows, key=lambda r: r[0]):
            waiting += merged(part)
            if len(waiting) >= ROWS_AT_ONCE:
                yield pd.DataFrame(waiting, columns=[c.split()[0] for c in MERGED.split(", ")], dtype=object)
                waiting = []
        yield pd.DataFrame(waiting, columns=[c.split()[0] for c in MERGED.split(", ")], dtype=object)

    return placed.join(first, "key").select(*columns).repartition("group").sortWithinPartitions(*order).mapInPandas(run, MERGED)


ROWS_AT_ONCE = 10_000
