"""The serving interface: every endpoint as a function that returns a DataFrame.

Totals are true totals under the same filters as the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.events import query_events

PROVISIONAL_MATCHES = 5


def health(events: DataFrame) -> DataFrame:
    return events.agg(F.lit("ok").alias("status"), F.count(F.lit(1)).alias("events"))


def events_page(events: DataFrame, limit: int = 100, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, total)."""
    return query_events(events, limit=limit, offset=offset, **filters), query_events(events, **filters).agg(F.count(F.lit(1)).alias("total"))


def latest_events(events: DataFrame, n: int = 50) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(n).orderBy("id")


def kills_page(events: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    return query_events(events, event_type="Kill", limit=limit, offset=offset, **filters)


def streamer_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("streamer").agg(F.count(F.lit(1)).alias("events")).orderBy("streamer")


def player_stats(events: DataFrame, streamer: str | None = None) -> DataFrame:
    """(player, kills, deaths) over kill rows, each row once."""
    rows = query_events(events, streamer=streamer).where("event_type = 'Kill'").select("id", "attacker", "victim").distinct()
    side = lambda n, k, d: F.struct(F.trim(n).alias("player"), F.lit(k).alias("k"), F.lit(d).alias("d"))
    both = rows.select(F.inline(F.array(side("attacker", 1, 0), side("victim", 0, 1)))).where("player <> ''")
    return both.groupBy("player").agg(F.sum("k").alias("kills"), F.sum("d").alias("deaths"))


def victim_stats(events: DataFrame) -> DataFrame:
    return player_stats(events).where("deaths > 0").select("player", "deaths").orderBy(F.desc("deaths"), "player")


def validation_stats(events: DataFrame) -> DataFrame:
    rows = events.where("source = 'gemini'")
    agreed = F.count_if(F.col("gemini_corrected") == 0)
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("validated"), agreed.alias("agreed"), F.count_if(F.col("gemini_corrected") == 1).alias("corrections"),
        F.when(total > 0, F.round(agreed / total, 4)).alias("agree_rate"),
    )


def rankings(ratings: DataFrame, min_matches: int = PROVISIONAL_MATCHES, limit: int = 100, offset: int = 0) -> DataFrame:
    score = F.col("elo") - 2 * F.col("rd")
    rows = ratings.where((F.col("matches_played") >= min_matches) & F.col("elo").isNotNull())
    return rows.withColumn("score", score).orderBy(F.desc("score"), "player").offset(offset).limit(limit)


def player_page(ratings: DataFrame, search: str | None = None, limit: int = 100) -> DataFrame:
    """The default board hides provisional players; a search shows them."""
    rows = ratings.withColumn("provisional", F.col("matches_played") < PROVISIONAL_MATCHES).withColumn("score", F.col("elo") - 2 * F.col("rd"))
    rows = rows.where(~F.col("provisional")) if search is None else rows.where(F.contains(F.lower("player"), F.lit(search.lower())))
    return rows.orderBy(F.desc_nulls_last("score"), "player").limit(limit)


def player_history(placements: DataFrame, matches: DataFrame, player: str, limit: int = 50) -> DataFrame:
    own = placements.where(F.col("player") == player).distinct()
    return own.join(matches.select("match_id", "streamer", "start_time"), "match_id").orderBy(F.desc("start_time"), "match_id").limit(limit)


def match_list(matches: DataFrame, streamer: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = matches if streamer is None else matches.where(F.lower("streamer") == streamer.lower())
    return rows.orderBy(F.desc("start_time"), "match_id").offset(offset).limit(limit)


def match_detail(matches: DataFrame, kills: DataFrame, placements: DataFrame, match_id: str) -> DataFrame:
    """One row with the match's kills and placements as arrays of structs."""
    one = lambda df: df.where(F.col("match_id") == match_id)
    k = one(kills).groupBy("match_id").agg(F.sort_array(F.collect_set(F.struct("kill_order", "id", "attacker", "victim"))).alias("kills"))
    p = one(placements).groupBy("match_id").agg(F.sort_array(F.collect_set(F.struct("survived", "kill_order_out", "player")), asc=False).alias("placements"))
    return one(matches).join(k, "match_id", "left").join(p, "match_id", "left")


def match_scoreboard(kills: DataFrame, placements: DataFrame) -> DataFrame:
    """(match_id, player, kills, deaths, place)."""
    side = lambda n, k, d: F.struct(F.trim(n).alias("player"), F.lit(k).alias("k"), F.lit(d).alias("d"))
    rows = kills.select("id", "match_id", "attacker", "victim").distinct()
    stats = (
        rows.select("match_id", F.inline(F.array(side("attacker", 1, 0), side("victim", 0, 1))))
        .where("player <> ''")
        .groupBy("match_id", "player")
        .agg(F.sum("k").alias("kills"), F.sum("d").alias("deaths"))
    )
    placed = placements.groupBy("match_id", "player").agg(F.max("kill_order_out").alias("place"))
    return stats.join(placed, ["match_id", "player"], "full").select(
        "match_id", "player", F.coalesce("kills", F.lit(0)).alias("kills"), F.coalesce("deaths", F.lit(0)).alias("deaths"), "place"
    )


def audit_player(placements: DataFrame, matches: DataFrame, kills: DataFrame, events: DataFrame, player: str) -> DataFrame:
    """Every rated match of a player with the kills and source texts behind it, in one join instead of a query a match."""
    name = F.lit(player)
    own = placements.where(F.col("player") == name).select("match_id", "kill_order_out", "elo_before", "elo_after").distinct()
    texts = events.select(F.col("id").alias("source_event_id"), "raw_text").dropDuplicates(["source_event_id"])
    involved = kills.where((F.col("attacker") == name) | (F.col("victim") == name)).join(texts, "source_event_id", "left")
    evidence = involved.groupBy("match_id").agg(F.sort_array(F.collect_set(F.struct("kill_order", "attacker", "victim", "raw_text"))).alias("evidence"))
    return own.join(matches.select("match_id", "start_time"), "match_id").join(evidence, "match_id", "left").orderBy(F.desc("start_time"), "match_id")


def audit_event(kills: DataFrame, matches: DataFrame, event_id: int) -> DataFrame:
    """Matches that an event went into."""
    return kills.where(F.col("source_event_id") == event_id).join(matches.select("match_id", "streamer", "start_time"), "match_id")


def crop_files(crops: DataFrame, path: str) -> DataFrame:
    """The crop (filename, streamer, filepath) that a path from outside asks for; an unsafe path finds nothing."""
    from feedloom.functions.text import safe_path

    asked = F.lit(path)
    return crops.where(safe_path(asked) & (F.col("filepath") == asked)).select("filename", "streamer", "filepath")
