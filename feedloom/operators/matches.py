"""From event rows to matches: sessions, order of elimination, confidence, stitching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.events import confidence, fingerprints, name_or_null, rating_input
from feedloom.operators.sessions import GAP_US, micros

MOST_PLAYERS = 62
LONGEST_S = 1500
STAT_WINDOW_US = 120_000_000
SESSIONS_A_TASK = 64


def _norm(col: str):
    return F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), "[^a-z0-9]", "")


def session_ordinals(events: DataFrame, gap_us: int = GAP_US, id_: str = "id") -> DataFrame:
    """(id, key, us, session): the ordinal of each event's session among those of its key.

    Rows of one gap-long cell share a session, so only cells are ordered, and
    rows get the ordinal of their cell.
    """
    rows = events.select(F.col(id_).alias("id"), F.lower(F.trim("streamer")).alias("key"), micros("timestamp").alias("us"))
    rows = rows.where("key <> '' and us is not null").distinct().withColumn("cell", F.floor(F.col("us") / gap_us))
    order = Window.partitionBy("key").orderBy("cell")
    cells = rows.groupBy("key", "cell").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    cells = cells.withColumn("opens", F.when(F.col("first") - F.lag("last").over(order) <= gap_us, 0).otherwise(1))
    numbered = cells.select("key", "cell", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))
    return rows.join(numbered, ["key", "cell"]).select("id", "key", "us", "session")


def oversized_sessions(events: DataFrame, gap_us: int, least_events: int) -> DataFrame:
    """Sessions of so many events with their largest inner gap and the five largest ones."""
    rows = session_ordinals(events, gap_us)
    size = Window.partitionBy("key", "session")
    big = rows.withColumn("events", F.count(F.lit(1)).over(size)).where(F.col("events") >= least_events)
    gap = F.col("us") - F.lag("us").over(size.orderBy("us", "id"))
    return (
        big.withColumn("gap", gap)
        .groupBy("key", "session")
        .agg(
            F.timestamp_micros(F.min("us")).cast("timestamp_ntz").alias("start_time"),
            F.count(F.lit(1)).alias("events"),
            F.max("gap").alias("largest_gap"),
            F.array_join(F.slice(F.sort_array(F.collect_list("gap"), asc=False), 1, 5).cast("array<string>"), ",").alias("top_gaps"),
        )
        .drop("session")
    )


def last_orders(kills: DataFrame) -> DataFrame:
    """(match_id, player, last_kill, last_death): highest kill_order on either side."""
    side = lambda n, k, d: F.struct(F.trim(n).alias("player"), k.alias("k"), d.alias("d"))
    none, order = F.lit(None).cast("int"), F.col("kill_order")
    rows = kills.select("match_id", F.inline(F.array(side("attacker", order, none), side("victim", none, order))))
    return rows.where("player <> ''").groupBy("match_id", "player").agg(F.max("k").alias("last_kill"), F.max("d").alias("last_death"))


def survival(kills: DataFrame) -> DataFrame:
    """(match_id, player, eliminated, order_out): dead unless a later kill shows a respawn; survivors get the match's last order."""
    orders = last_orders(kills)
    eliminated = F.col("last_death").isNotNull() & ~F.coalesce(F.col("last_kill") > F.col("last_death"), F.lit(False))
    floor = F.max(F.greatest("last_kill", "last_death")).over(Window.partitionBy("match_id"))
    return orders.select("match_id", "player", eliminated.alias("eliminated"), F.when(eliminated, F.col("last_death")).otherwise(floor).alias("order_out"))


def stat_dedup(kills: DataFrame, window_us: int = STAT_WINDOW_US) -> DataFrame:
    """Kills without re-reads: the same normalized pair at most ``window_us`` after the row before it. The window slides with every row."""
    order = Window.partitionBy("match_id", _norm("attacker"), _norm("victim")).orderBy("timestamp", "id")
    since = micros("timestamp") - F.lag(micros("timestamp")).over(order)
    return kills.withColumn("_since", since).where(F.col("_since").isNull() | (F.col("_since") > window_us)).drop("_since")


def most_confident(kills: DataFrame, most: int) -> DataFrame:
    """The ``most`` players of a match by best confidence; ties by first appearance, attackers before victims."""
    side = lambda n, slot: F.struct(F.trim(n).alias("player"), confidence(f"{n}_conf").alias("c"), (F.col("kill_order") * 2 + slot).alias("at"))
    rows = kills.select("match_id", F.inline(F.array(side("attacker", 0), side("victim", 1)))).where("player <> ''")
    best = rows.groupBy("match_id", "player").agg(F.max("c").alias("c"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("c"), "first", "player"))
    return best.withColumn("_rank", rank).where(F.col("_rank") <= most).select("match_id", "player")


def icon_decision(votes: DataFrame, key: str, order: list[str], vote: str, least_run: int = 3, least_share: float = 0.5, cell: int = 3_600) -> DataFrame:
    """Per key the longest run of 'kill' votes, their share and the decision. The first column of ``order`` is a time or a number.

    Runs are found inside cells of time or of so many numbers; of a cell only
    its counts, its longest run and the runs at its edges go on to the order of
    the key's cells, where runs that touch are put together.
    """
    at = F.col(order[0])
    number = F.unix_seconds(at.cast("timestamp")) if dict(votes.dtypes)[order[0]].startswith("timestamp") else at
    rows = votes.withColumn("_cell", F.floor(number / cell)).withColumn("_k", F.col(vote) == "kill")
    inside = Window.partitionBy(key, "_cell").orderBy(*order)
    place = F.row_number().over(inside)
    shift = place - F.row_number().over(Window.partitionBy(key, "_cell", "_k").orderBy(*order))
    runs = (
        rows.withColumns({"_p": place, "_g": shift})
        .groupBy(key, "_cell", "_k", "_g")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_p").alias("first"), F.max("_p").alias("last"))
    )
    size = F.sum("n").over(Window.partitionBy(key, "_cell"))
    kills = F.when(F.col("_k"), F.col("n"))
    cells = (
        runs.withColumn("size", size)
        .groupBy(key, "_cell")
        .agg(
            F.max("size").alias("size"), F.coalesce(F.sum(kills), F.lit(0)).alias("kills"), F.coalesce(F.max(kills), F.lit(0)).alias("longest"),
            F.coalesce(F.max(F.when(F.col("first") == 1, kills)), F.lit(0)).alias("head"),
            F.coalesce(F.max(F.when(F.col("last") == F.col("size"), kills)), F.lit(0)).alias("tail"),
        )
    )
    # A cell of kill votes only goes on with the run, any other one ends it at its head and opens another with its tail.
    whole = F.col("head") == F.col("size")
    along = Window.partitionBy(key).orderBy("_cell")
    group = F.sum(F.when(whole, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = cells.withColumn("_run", F.coalesce(group, F.lit(0)))
    middle = parts.groupBy(key, "_run").agg(F.sum("head").alias("heads"))
    opened = cells.withColumn("_run", F.sum(F.when(whole, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    tails = opened.where(~whole).select(key, "_run", "tail")
    joined = middle.join(tails, [key, "_run"], "full").groupBy(key).agg(F.max(F.coalesce("heads", F.lit(0)) + F.coalesce("tail", F.lit(0))).alias("across"))
    totals = cells.groupBy(key).agg(F.max("longest").alias("longest"), (F.sum("kills") / F.sum("size")).alias("share"))
    both = totals.join(joined, key).withColumn("longest", F.greatest("longest", "across").cast("long"))
    decision = F.when((F.col("longest") >= least_run) & (F.col("share") >= least_share), "kill").otherwise("gun")
    return both.select(key, "longest", F.round("share", 6).alias("fraction"), decision.alias("decision"))


EVENT = "key string, session long, id long, us long, attacker string, victim string, attacker_conf double, victim_conf double, is_kill boolean"
CHUNKED = EVENT + ", chunk long"


def _too_big(times: list[int], names: list[tuple], low: int, high: int, most: int, longest_us: int) -> bool:
    seen = {n for pair in names[low:high] for n in pair if n}
    return len(seen) >= most or times[high - 1] - times[low] >= longest_us


def split_points(times: list[int], names: list[tuple], most: int = MOST_PLAYERS, longest_us: int = LONGEST_S * 1_000_000) -> list[int]:
    """Starts of the chunks of a session: cut at the (first) largest gap while a part has too many players or lasts too long."""
    starts, todo = [], [(0, len(times))]
    while todo:
        low, high = todo.pop()
        if high - low < 2 or not _too_big(times, names, low, high, most, longest_us):
            starts.append(low)
            continue
        cut = max(range(low + 1, high), key=lambda k: (times[k] - times[k - 1], -k))
        todo += [(low, cut), (cut, high)]
    return sorted(starts)


def _chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chunk numbers of whole sessions."""
    pdf = pdf.sort_values(["session", "us", "is_kill", "id"], ascending=[True, True, False, True], kind="stable").reset_index(drop=True)
    us, sessions = pdf["us"].tolist(), pdf["session"].tolist()
    names = [tuple(n if isinstance(n, str) else None for n in p) for p in zip(pdf["attacker"], pdf["victim"])]
    chunks: list[int] = []
    low = 0
    for high in range(1, len(us) + 1):
        if high == len(us) or sessions[high] != sessions[low]:
            starts = set(split_points(us[low:high], names[low:high]))
            chunk = 0
            for k in range(high - low):
                chunk += k in starts
                chunks.append(chunk)
            low = high
    pdf["chunk"] = chunks
    return pdf


def match_events(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Rating input and fingerprints with session and chunk. Sessions are short, so some whole ones may be split in one task."""
    cols = ["id", "streamer", "timestamp", name_or_null("attacker").alias("attacker"), name_or_null("victim").alias("victim")]
    cols += [confidence("attacker_conf").alias("attacker_conf"), confidence("victim_conf").alias("victim_conf")]
    kills = rating_input(events).select(*cols, F.lit(True).alias("is_kill"))
    marks = fingerprints(events).select(*cols, F.lit(False).alias("is_kill"))
    rows = kills.unionByName(marks).dropDuplicates(["id"])
    placed = rows.join(session_ordinals(rows, gap_us).select("id", "key", "us", "session"), "id").drop("streamer", "timestamp")
    return placed.groupBy("key", F.floor(F.col("session") / SESSIONS_A_TASK)).applyInPandas(_chunk, CHUNKED)


def build_matches(events: DataFrame, gap_us: int = GAP_US, least_kills: int = 3) -> DataFrame:
    """(match_id, streamer, start_time, end_time, kill_count, players_observed) before merging streams; chunks without a kill are dropped."""
    rows = match_events(events, gap_us)
    kills = rows.where("is_kill")
    names = F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array("attacker", "victim")))))
    start = F.min("us")
    return (
        kills.groupBy("key", "session", "chunk")
        .agg(start.alias("s"), F.max("us").alias("e"), F.count(F.lit(1)).alias("kill_count"), F.size(names).alias("players_observed"))
        .where(F.col("kill_count") >= least_kills)
        .select(
            F.concat_ws("_", "key", F.floor(F.col("s") / 1_000_000).cast("long")).alias("match_id"), F.col("key").alias("streamer"),
            F.timestamp_micros("s").cast("timestamp_ntz").alias("start_time"), F.timestamp_micros("e").cast("timestamp_ntz").alias("end_time"),
            "kill_count", "players_observed",
        )
    )


def sessions_of_rows(rows: DataFrame, gap_us: int = GAP_US, least_kills: int = 3) -> DataFrame:
    """Sessions of kills without ids (key, ts, a, v), as legacy files hold them: (streamer, start_time, end_time, kills, session), so many kills at least."""
    numbered = _row_sessions(rows, gap_us)
    spans = numbered.groupBy("key", "session").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("kills"))
    time = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spans.where(F.col("kills") >= least_kills).select(F.col("key").alias("streamer"), time("start_time"), time("end_time"), "kills", "session")


def _row_sessions(rows: DataFrame, gap_us: int) -> DataFrame:
    celled = rows.withColumn("us", micros("ts")).withColumn("cell", F.floor(F.col("us") / gap_us))
    order = Window.partitionBy("key").orderBy("cell")
    cells = celled.groupBy("key", "cell").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    cells = cells.withColumn("opens", F.when(F.col("first") - F.lag("last").over(order) <= gap_us, 0).otherwise(1))
    return celled.join(cells.select("key", "cell", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("session")), ["key", "cell"])


def matches_of_rows(rows: DataFrame, gap_us: int = GAP_US, least_kills: int = 3) -> DataFrame:
    """Matches of kills without ids: sessions with enough kills, split where they are too long or have too many players, parts with enough kills. No marks, no merging."""
    numbered = _row_sessions(rows, gap_us)
    size = F.count(F.lit(1)).over(Window.partitionBy("key", "session"))
    large = numbered.withColumn("_n", size).where(F.col("_n") >= least_kills).select("key", "session", "us", "a", "v")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "a", "v"]).reset_index(drop=True)
        names = [tuple(n or None for n in pair) for pair in zip(pdf["a"], pdf["v"])]
        starts = [*split_points(pdf["us"].tolist(), names), len(pdf)]
        out = []
        for low, high in zip(starts, starts[1:]):
            if high - low >= least_kills:
                players = {n for pair in names[low:high] for n in pair if n}
                out.append((pdf["key"].iloc[0], int(pdf["us"].iloc[low]), int(pdf["us"].iloc[high - 1]), high - low, len(players)))
        return pd.DataFrame(out, columns=["streamer", "start_us", "end_us", "kill_count", "players_observed"])

    schema = "streamer string, start_us long, end_us long, kill_count int, players_observed int"
    return large.groupBy("key", "session").applyInPandas(split, schema)
