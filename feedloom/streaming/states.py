"""Small state machines over ordered rows of one key, for batch and stream alike.

Each is a pure function (state, row) -> (state, output), so tests need no
stream and both ways of running share the code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Squads:
    """Smoothed number of squads, which never rises within a match.

    Lower reads in a row that don't rise among themselves confirm a drop: two for one of up to four, three up to seven, else four.
    A read as shown forgets them. A jump up of five or more, read twice alike, is a new match; smaller rises change nothing.
    """

    shown: int | None = None
    candidate: int | None = None
    seen: int = 0
    match: int = 0


def squads_step(s: Squads, read: int | None) -> tuple[Squads, int | None]:
    if read is None:
        return s, s.shown
    if s.shown is None or read == s.shown:
        return Squads(read, None, 0, s.match), read
    if read < s.shown:
        seen = s.seen + 1 if s.candidate is not None and read <= s.candidate else 1
        drop = s.shown - read
        if seen >= (2 if drop <= 4 else 3 if drop <= 7 else 4):
            return Squads(read, None, 0, s.match), read
        return Squads(s.shown, read, seen, s.match), s.shown
    if read - s.shown < 5:
        return s, s.shown
    if read == s.candidate:
        return Squads(read, None, 0, s.match + 1), read
    return Squads(s.shown, read, 1, s.match), s.shown


@dataclass
class Streak:
    """Run of rows that meet a condition."""

    length: int = 0


def streak_step(s: Streak, hit: bool, least: int = 5) -> tuple[Streak, bool]:
    s = Streak(s.length + 1 if hit else 0)
    return s, s.length >= least


@dataclass
class Hashes:
    """Saved perceptual hashes of the last seconds."""

    saved: list[tuple[int, int]] = field(default_factory=list)


def hash_step(s: Hashes, us: int, value: int, window_us: int = 30_000_000, most_bits: int = 8) -> tuple[Hashes, bool]:
    """Whether to save: no saved hash of the window is within ``most_bits``."""
    live = [(t, h) for t, h in s.saved if us - t <= window_us]
    new = all(((value ^ h) & (2**64 - 1)).bit_count() > most_bits for _, h in live)
    return Hashes(live + [(us, value)] if new else live), new


@dataclass
class Proposal:
    """Zones (left end, width): two agreeing proposals in a row confirm; ten attempts at most."""

    last: tuple[float, float] | None = None
    attempts: int = 0
    confirmed: tuple[float, float] | None = None


def zones_agree(a: tuple[float, float], b: tuple[float, float]) -> bool:
    """As ``text.zones_overlap``: half of the narrower one shared, left ends at most 0.1 apart."""
    shared = min(a[0] + a[1], b[0] + b[1]) - max(a[0], b[0])
    return shared >= 0.5 * min(a[1], b[1]) and abs(a[0] - b[0]) <= 0.1


def proposal_step(s: Proposal, zone: tuple[float, float] | None, most: int = 10) -> tuple[Proposal, list[float] | None]:
    shown = lambda z: None if z is None else list(z)
    if zone is None or s.confirmed is not None or s.attempts >= most:
        return s, shown(s.confirmed)
    zone = (float(zone[0]), float(zone[1]))
    agreed = s.last is not None and zones_agree(s.last, zone)
    s = Proposal(zone, s.attempts + 1, zone if agreed else None)
    return s, shown(s.confirmed)


@dataclass
class RecentNames:
    """Names of the last seconds, for a looser match: canonical -> [(us, variant)]."""

    seen: list[tuple[int, str, str]] = field(default_factory=list)


def recent_step(s: RecentNames, us: int, name: str, window_us: int = 10_000_000, similarity: float = 0.70, most: int = 20) -> tuple[RecentNames, str]:
    """Canonical form by the most similar recent name (the first of equals), else the name itself."""
    from feedloom.functions.similarity import ratio_of

    live = [x for x in s.seen if us - x[0] <= window_us][-most:]
    scores = [(ratio_of(name.lower(), v.lower()), -k) for k, (_, _, v) in enumerate(live)]
    best, at = max(scores, default=(0.0, 0))
    canonical = live[-at][1] if best >= similarity else name
    return RecentNames((live + [(us, canonical, name)])[-most:]), canonical


def run_ordered(rows: DataFrame, key: str, order: list[str], value: str, start, step, out: str, kind: str) -> DataFrame:
    """``rows`` with a column ``out`` from ``step(state, value)`` along the order of each key.

    For keys of bounded size (a game, a stream's day): one task per key.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {out} {kind}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state, results = start(), []
        for v in pdf[value]:
            state, r = step(state, None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v)
            results.append(r)
        pdf[out] = pd.Series(results, index=pdf.index, dtype="object")
        return pdf

    return rows.groupBy(F.col(key)).applyInPandas(run, schema)
