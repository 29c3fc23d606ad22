"""Stateful, iterative and graph queries (R, ST, Q7, Q9 of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import dedup as D
from feedloom.operators import identity as I
from feedloom.operators import matches as M
from feedloom.operators import merge as MG
from feedloom.operators import ratings as RT
from feedloom.operators import votes as V
from feedloom.operators.events import name_or_null
from feedloom.operators.sessions import micros
from feedloom.plans.functions import LABELS
from feedloom.plans.registry import Registry, Tables

R = Registry()


@R.add("ref_r1_r2_matches")
def r2(t: Tables) -> DataFrame:
    """Matches of each stream: sessions, split where stitched, at least three kills."""
    return M.build_matches(t.feed_events)


@R.add("ref_r3_merged_matches")
def r3(t: Tables) -> DataFrame:
    """Matches with the views of other streams merged in."""
    rows = MG.merge_matches(M.match_events(t.feed_events))
    return rows.groupBy("match_id", "streamer", "merged_from").agg(F.count("*").alias("kills"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


_ORDERS = """
with s as (select match_id, p, max(k) as lk, max(d) as ld from (select match_id, trim(attacker) as p, kill_order as k, null as d from match_kills union all select match_id, trim(victim), null, kill_order from match_kills) where p <> '' group by 1, 2),
e as (select *, ld is not null and not coalesce(lk > ld, false) as eliminated, max(greatest(coalesce(lk, 0), coalesce(ld, 0))) over (partition by match_id) as floor from s)
"""


@R.add("ref_r4_elimination_order", _ORDERS + "select match_id, p as player, ld as order_out from e where eliminated")
def r4(t: Tables) -> DataFrame:
    return M.survival(t.match_kills).where("eliminated").select("match_id", "player", "order_out")


@R.add("ref_r5_survivor_floor", _ORDERS + "select match_id, p as player, case when eliminated then ld else floor end as order_out from e")
def r5(t: Tables) -> DataFrame:
    return M.survival(t.match_kills).select("match_id", "player", "order_out")


def _placements(t: Tables) -> DataFrame:
    valid = RT.valid_player("player", LABELS, [])
    return RT.rate_all(RT.match_rows(t.match_kills.dropDuplicates(["id"]), valid))


@R.add("ref_r6_r7_placements")
def r7(t: Tables) -> DataFrame:
    """Rated placements of all matches in order of time."""
    return _placements(t).select("match_id", "player", "kill_order_out", "survived", F.round("elo_before", 6).alias("elo_before"), F.round("elo_after", 6).alias("elo_after"))


@R.add("ref_r7_final_ratings")
def r7b(t: Tables) -> DataFrame:
    return RT.final_ratings(_placements(t), t.match_kills.dropDuplicates(["id"]))


@R.add("ref_r8_period_update")
def r8(t: Tables) -> DataFrame:
    """One rating period over all kills, every player at once."""
    start = t.player_ratings.select("player", F.coalesce("elo", F.lit(1000.0)).alias("elo"), "rd", "vol")
    pairs = t.match_kills.where("trim(attacker) <> '' and trim(victim) <> '' and attacker <> victim").select("id", "attacker", "victim").distinct()
    won = pairs.select(F.col("attacker").alias("player"), F.col("victim").alias("opponent"), F.lit(1.0).alias("score"))
    lost = pairs.select(F.col("victim").alias("player"), F.col("attacker").alias("opponent"), F.lit(0.0).alias("score"))
    return RT.period_update(start, won.unionByName(lost))


_WHO = "(" + ", ".join(f"'{c.lower()}'" for c in LABELS) + ")"
_NAMED = "^(" + "|".join(c.lower() for c in LABELS) + ")[ ]*[0-9]+$"


@R.add("ref_p11_valid_player", f"""
select n as player from (select distinct trim(victim) as n from match_kills where trim(victim) <> '')
where not (lower(n) in {_WHO} or trim(regexp_replace(lower(n), '[\\[\\]()]', '', 'g')) in {_WHO} or regexp_matches(lower(n), '{_NAMED}') or length(n) < 4 or lower(n) in ('ring', 'squad')
or (length(regexp_replace(n, '[^\\p{{L}}]', '', 'g')) >= 4 and len(list_distinct(string_split(regexp_replace(n, '[^\\p{{L}}]', '', 'g'), ''))) <= 2)
or regexp_matches(lower(n), '^[0-9]+[a-z]{{1,4}}$') or length(regexp_replace(n, '[^0-9]', '', 'g')) > 0.4 * length(n) or starts_with(lower(n), 'twitch.') or regexp_matches(lower(n), '^ping[_.]')
or contains(lower(n), '[bleed') or contains(lower(n), 'bleed]') or regexp_full_match(n, '\\[[^\\]]*\\]'))""")
def p11(t: Tables) -> DataFrame:
    """Victims that may be rated; labels that are misread are left to ``ref_p11_hidden_players``."""
    from feedloom.functions.names import default_label

    names = t.match_kills.select(F.trim("victim").alias("player")).where("player <> ''").distinct()
    misread = default_label("player", LABELS)["number"].isNotNull() & ~F.lower("player").rlike(_NAMED)
    return names.where(RT.valid_player("player", LABELS, ["ring", "squad"]) | (misread & _apart_from_labels())).select("player")


def _apart_from_labels():
    """The other tests of a player, for names that only a misread label refuses."""
    return RT.valid_player("player", [], ["ring", "squad"])


@R.add("ref_p11_hidden_players")
def p11b(t: Tables) -> DataFrame:
    """Names on either side of match_kills that are nobody in particular: default labels, misread ones too."""
    names = t.match_kills.select(F.explode(F.array(F.trim("attacker"), F.trim("victim"))).alias("player")).where("player <> ''").distinct()
    return names.where(RT.hidden_player("player", LABELS))


@R.add("ref_r9_name_clusters")
def r9(t: Tables) -> DataFrame:
    return I.cluster_names(t.player_ratings, LABELS)


@R.add("ref_j15_similar_names")
def j15(t: Tables) -> DataFrame:
    return I.similar_names(t.player_ratings)


@R.add("ref_j16_key_edges")
def j16(t: Tables) -> DataFrame:
    return I.key_edges(t.player_ratings.select("player"), LABELS)


@R.add("ref_r10_reapplied_clusters", """
with a as (select trim(dup) as player, min(trim(canonical)) as canonical from account_merges where trim(dup) <> '' and trim(canonical) <> '' group by 1)
select k.id, coalesce(a.canonical, k.attacker) as attacker from match_kills k left join a on a.player = k.attacker""")
def r10(t: Tables) -> DataFrame:
    alias = t.account_merges.select(F.trim("dup").alias("player"), F.trim("canonical").alias("canonical")).where("player <> '' and canonical <> ''").groupBy("player").agg(F.min("canonical").alias("canonical"))
    return I.apply_alias(t.match_kills.select("id", "attacker"), alias, "attacker")


@R.add("ref_k7_merged_placements", """
with a as (select trim(dup) as player, min(trim(canonical)) as canonical from account_merges where trim(dup) <> '' and trim(canonical) <> '' group by 1),
p as (select distinct match_id, player, kill_order_out from match_placements where player is not null),
n as (select p.match_id, coalesce(a.canonical, p.player) as to_, p.kill_order_out, row_number() over (partition by p.match_id, coalesce(a.canonical, p.player) order by case when a.canonical is null then 0 else 1 end, p.player, p.kill_order_out) as rn from p left join a on a.player = p.player)
select match_id, to_ as player, kill_order_out from n where rn = 1""")
def k7(t: Tables) -> DataFrame:
    alias = t.account_merges.select(F.trim("dup").alias("player"), F.trim("canonical").alias("canonical")).where("player <> '' and canonical <> ''").groupBy("player").agg(F.min("canonical").alias("canonical"))
    rows = t.match_placements.where("player is not null").groupBy("match_id", "player").agg(F.min("kill_order_out").alias("kill_order_out"))
    return I.merge_placements(rows, alias).select("match_id", "player", "kill_order_out")


def reads(t: Tables) -> DataFrame:
    return t.feed_events.where("timestamp is not null and trim(streamer) <> ''").select(
        F.lower(F.trim("streamer")).alias("key"), "id", micros("timestamp").alias("us"), "event_type", name_or_null("attacker").alias("attacker"),
        name_or_null("victim").alias("victim"), F.col("read_count").cast("long").alias("reads"),
    ).dropDuplicates(["id"])


@R.add("ref_st4_st5_dedup")
def st5(t: Tables) -> DataFrame:
    """Kept rows with the number of reads that count for them."""
    return D.fold_reads(D.dedup_events(reads(t))).select("id", "key", "event_type", "attacker", "victim", "read_count", "rows")


@R.add("ref_q9_lever_sizes")
def q9(t: Tables) -> DataFrame:
    """Rows that survive under several rules, all gone through in one pass."""
    rules = {f"{cap} {'merged' if merge else 'by type'}": D.DedupRules(rated_cap=cap, merge_types=merge) for cap in (1, 2, 4) for merge in (False, True)}
    kept = D.dedup_variants(reads(t), rules)
    return kept.groupBy("variant").agg(F.count_if(F.col("id") == F.col("kept_id")).alias("kept"), F.count("*").alias("all"))


@R.add("ref_st2_st3_tracks")
def st3(t: Tables) -> DataFrame:
    """Tracks of similar reads within six seconds, with one text voted out of each."""
    rows = t.feed_events.where("timestamp is not null and trim(streamer) <> '' and raw_text is not null").select(
        F.lower(F.trim("streamer")).alias("key"), "id", micros("timestamp").alias("us"), F.col("raw_text").alias("text")).dropDuplicates(["id"])
    return V.best_text(V.track_reads(rows)).select("key", "track", "text")


@R.add("ref_st3_flushed_tracks")
def st3b(t: Tables) -> DataFrame:
    """Tracks with markers of the reader, compared without regard to them, with the vote on the marker."""
    marked = F.replace(F.replace("raw_text", F.lit("<skull>"), F.lit("<KILL_ICON>")), F.lit("[R-44]"), F.lit("<GUN_ICON>"))
    rows = t.feed_events.where("timestamp is not null and trim(streamer) <> '' and raw_text is not null").select(
        F.lower(F.trim("streamer")).alias("key"), "id", micros("timestamp").alias("us"), marked.alias("text")).dropDuplicates(["id"])
    return V.flushed_tracks(V.track_reads(rows, markers="voted"))


@R.add("ref_r14_victim_clusters")
def r14(t: Tables) -> DataFrame:
    rows = t.match_kills.where("timestamp is not null and trim(victim) <> ''").select(F.col("match_id").alias("key"), "id", micros("timestamp").alias("us"), F.lower(F.trim("victim")).alias("text")).dropDuplicates(["id"])
    return V.cluster_in_time(rows).groupBy("key", "track").agg(F.count("*").alias("reads"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@R.add("ref_st13_daily_latest", """
select lower(trim(streamer)) as streamer, cast(timestamp as date) as day, max_by(event_type, id) as event_type from feed_events where timestamp is not null and trim(streamer) <> '' group by 1, 2""")
def st13(t: Tables) -> DataFrame:
    rows = t.feed_events.where("timestamp is not null and trim(streamer) <> ''")
    return rows.groupBy(F.lower(F.trim("streamer")).alias("streamer"), F.col("timestamp").cast("date").alias("day")).agg(F.max_by("event_type", "id").alias("event_type"))


@R.add("ref_st1_throttle", """
select key, slot, min(id) as id from (select id, lower(trim(streamer)) as key, epoch_us(timestamp) // 500000 as slot from feed_events where timestamp is not null and trim(streamer) <> '') group by 1, 2""")
def st1(t: Tables) -> DataFrame:
    """The first row of every half second of a stream."""
    rows = t.feed_events.where("timestamp is not null and trim(streamer) <> ''").select("id", F.lower(F.trim("streamer")).alias("key"), F.floor(micros("timestamp") / 500_000).cast("long").alias("slot"))
    return rows.groupBy("key", "slot").agg(F.min("id").alias("id"))


@R.add("ref_st10_coverage", """
with e as (select distinct id, lower(trim(streamer)) as key, epoch_us(timestamp) as us, event_type from feed_events where timestamp is not null and trim(streamer) <> '')
select a.id as anchor, count(b.id) as seen from e a left join e b on b.key = a.key and b.event_type = 'Kill' and b.us between a.us - 10000000 and a.us + 9000000 where a.event_type = 'Knock' group by a.id""")
def st10(t: Tables) -> DataFrame:
    """Kills from 10 s before to 9 s after each knock."""
    from feedloom.operators.joins import within

    e = t.feed_events.where("timestamp is not null and trim(streamer) <> ''").select("id", F.lower(F.trim("streamer")).alias("key"), micros("timestamp").alias("us"), "event_type").distinct()
    a = e.where("event_type = 'Knock'").select(F.col("id").alias("anchor"), "key", F.col("us").alias("at"))
    b = e.where("event_type = 'Kill'").select("id", "key", "us")
    hits = within(a, b, ["key"], "at", "us", 10_000_000).where(F.col("us") <= F.col("at") + 9_000_000).groupBy("anchor").agg(F.count("*").alias("seen"))
    return a.select("anchor").join(hits, "anchor", "left").select("anchor", F.coalesce("seen", F.lit(0)).cast("long").alias("seen"))


_LIVE = """
with e as (select lower(trim(streamer)) as key, timestamp as ts, id from feed_events where timestamp is not null and trim(streamer) <> ''),
f as (select *, case when ts - lag(ts) over (partition by key order by ts, id) <= interval 90 second then 0 else 1 end as opens from e),
g as (select *, sum(opens) over (partition by key order by ts, id rows unbounded preceding) as n from f)
select key, min(ts) as start_time, max(ts) as end_time, count(*) as events from g group by key, n"""


@R.add("ref_st17_session_window", _LIVE)
def st17(t: Tables) -> DataFrame:
    """Sessions by the built-in session window: 90 seconds apart is together, as in the reference form."""
    rows = t.feed_events.select(F.lower(F.trim("streamer")).alias("key"), F.col("timestamp").cast("timestamp").alias("ts")).where("ts is not null and key <> ''")
    out = rows.groupBy("key", F.session_window("ts", "90 seconds")).agg(F.min("ts").alias("s"), F.max("ts").alias("e"), F.count("*").alias("events"))
    return out.select("key", F.col("s").cast("timestamp_ntz").alias("start_time"), F.col("e").cast("timestamp_ntz").alias("end_time"), "events")


@R.add("ref_st17_live_sessions", _LIVE)
def st17b(t: Tables) -> DataFrame:
    """The same as a stream over the files of the table, run until it has seen them all."""
    from feedloom.session import fresh_path
    from feedloom.streaming.live import live_sessions

    out, state = fresh_path(t.spark, "live-sessions"), fresh_path(t.spark, "live-state")
    source = t.spark.readStream.schema(t.feed_events.schema).option("maxFilesPerTrigger", 16).parquet(f"{t.folder}/feed_events.parquet*")
    events = source.select("streamer", F.col("timestamp").cast("timestamp").alias("ts")).where("ts is not null")
    query = (
        live_sessions(events)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out))
        .start()
    )
    query.awaitTermination()
    rows = t.spark.read.parquet(out)
    return rows.select("key", F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"), "events")


QUERIES, ORACLE = R.queries, R.oracle
