"""The serving interface over the tables (section 2.15 of the inventory), chain audits and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import serving as V
from feedloom.functions import text as X
from feedloom.operators import dedup as D
from feedloom.operators import retro as RE
from feedloom.plans.registry import Registry, Tables
from feedloom.plans.stateful import reads

R = Registry()


@R.add("api_health", "select 'ok' as status, count(*) as events from feed_events")
def health(t: Tables) -> DataFrame:
    return V.health(t.feed_events)


@R.add("api_events_total", "select count(*) as total from feed_events where lower(event_type) = 'kill' and lower(attacker) like '%ra%'")
def events_total(t: Tables) -> DataFrame:
    return V.events_page(t.feed_events, event_type="Kill", attacker="ra")[1]


@R.add("api_kills_page", "select id, attacker, victim from (select distinct id, attacker, victim, event_type from feed_events) where lower(event_type) = 'kill' order by id limit 40 offset 20")
def kills_page(t: Tables) -> DataFrame:
    return V.kills_page(t.feed_events.select("id", "attacker", "victim", "event_type").distinct(), 40, 20).select("id", "attacker", "victim")


@R.add("api_latest", "select id from (select distinct id from feed_events order by id desc limit 50) order by id")
def latest(t: Tables) -> DataFrame:
    return V.latest_events(t.feed_events.select("id").distinct())


@R.add("api_streamers", "select streamer, count(*) as events from feed_events group by 1")
def streamers(t: Tables) -> DataFrame:
    return V.streamer_stats(t.feed_events)


@R.add("api_victims", """
with e as (select distinct id, attacker, victim from feed_events where event_type = 'Kill') select trim(victim) as player, count(*) as deaths from e where trim(victim) <> '' group by 1""")
def victims(t: Tables) -> DataFrame:
    return V.victim_stats(t.feed_events)


@R.add("api_rankings", """
select player, elo, rd, round(elo - 2 * rd, 4) as score from player_ratings where matches_played >= 5 and elo is not null order by elo - 2 * rd desc, player limit 50 offset 10""")
def rankings(t: Tables) -> DataFrame:
    return V.rankings(t.player_ratings, limit=50, offset=10).select("player", "elo", "rd", F.round("score", 4).alias("score"))


@R.add("api_players", "select player, matches_played < 5 as provisional from player_ratings where contains(lower(player), 'an') order by elo - 2 * rd desc nulls last, player limit 30")
def players(t: Tables) -> DataFrame:
    return V.player_page(t.player_ratings, "AN", 30).select("player", "provisional")


@R.add("api_matches", "select match_id, streamer, start_time from matches order by start_time desc, match_id limit 50 offset 5")
def match_list(t: Tables) -> DataFrame:
    return V.match_list(t.matches, limit=50, offset=5).select("match_id", "streamer", "start_time")


@R.add("api_player_history", """
select p.match_id, p.kill_order_out, m.streamer from (select distinct * from match_placements where player = 'PaceBot_Meridian') p join matches m on m.match_id = p.match_id order by m.start_time desc, p.match_id limit 20""")
def history(t: Tables) -> DataFrame:
    return V.player_history(t.match_placements, t.matches, "PaceBot_Meridian", 20).select("match_id", "kill_order_out", "streamer")


@R.add("api_audit_player", """
with own as (select distinct match_id, kill_order_out, elo_before, elo_after from match_placements where player = 'PaceBot_Meridian'),
ev as (select k.match_id, count(distinct (k.kill_order, k.attacker, k.victim, e.raw_text)) as n from match_kills k left join (select id, min(raw_text) as raw_text from feed_events group by 1) e on e.id = k.source_event_id
  where k.attacker = 'PaceBot_Meridian' or k.victim = 'PaceBot_Meridian' group by 1)
select own.match_id, own.kill_order_out, coalesce(ev.n, 0) as evidence from own join matches m on m.match_id = own.match_id left join ev on ev.match_id = own.match_id""")
def audit_player(t: Tables) -> DataFrame:
    rows = V.audit_player(t.match_placements, t.matches, t.match_kills, t.feed_events, "PaceBot_Meridian")
    return rows.select("match_id", "kill_order_out", F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("evidence"))


@R.add("api_match_detail", """
with m as (select * from matches order by start_time desc nulls last, match_id limit 1)
select m.match_id, m.streamer, m.start_time, (select count(*) from (select distinct id from match_kills k where k.match_id = m.match_id)) as kills,
(select count(*) from (select distinct player from match_placements p where trim(p.match_id) = m.match_id and player is not null)) as players from m""")
def match_detail(t: Tables) -> DataFrame:
    """The latest match with its numbers of kills and players; the match is found inside the plan."""
    last = t.matches.orderBy(F.desc_nulls_last("start_time"), "match_id").limit(1).select("match_id", "streamer", "start_time")
    of = F.broadcast(last.select("match_id"))  # one row
    kills = t.match_kills.join(of, "match_id").groupBy("match_id").agg(F.count_distinct("id").alias("kills"))
    players = t.match_placements.withColumn("match_id", F.trim("match_id")).join(of, "match_id").groupBy("match_id").agg(F.count_distinct("player").alias("players"))
    zero = F.lit(0).cast("long")
    out = last.join(kills, "match_id", "left").join(players, "match_id", "left")
    return out.select("match_id", "streamer", "start_time", F.coalesce("kills", zero).alias("kills"), F.coalesce("players", zero).alias("players"))


@R.add("api_match_detail_rows")
def match_detail_rows(t: Tables) -> DataFrame:
    """The detail view of a match of the tables."""
    return V.match_detail(t.matches, t.match_kills, t.match_placements, "odenplus_1514795580")


def _kept(t: Tables) -> DataFrame:
    return D.dedup_events(reads(t))


@R.add("ref_a34_chain_statistics")
def a34(t: Tables) -> DataFrame:
    """Length, span and least likeness of the chains of repeated reads."""
    return RE.chain_statistics(_kept(t))


@R.add("ref_a38_chain_audit")
def a38(t: Tables) -> DataFrame:
    """Suppressed rows by how safe that was: same letters, very similar, or to be looked at."""
    return RE.deletion_audit(_kept(t))


@R.add("ref_a38_chains_to_look_at")
def a38b(t: Tables) -> DataFrame:
    """The three longest chains and the four least alike."""
    return RE.chains_to_look_at(_kept(t))


@R.add("ref_q6_snapshot", """
select 'players' as what, count(*) as n from player_ratings union all select 'matches', count(*) from matches
union all select 'credited_kills', count(*) from (select distinct id, attacker, victim from match_kills where trim(attacker) <> '')""")
def q6(t: Tables) -> DataFrame:
    """Counts of the state, for comparison with a later one by ``snapshot_diff``."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    credited = t.match_kills.where("trim(attacker) <> ''").select("id", "attacker", "victim").distinct()
    return one(t.player_ratings, "players").unionByName(one(t.matches, "matches")).unionByName(one(credited, "credited_kills"))


@R.add("ref_q6_snapshot_diff", """
with o as (select distinct trim(dup) as dup, min(trim(canonical)) as canonical from account_merges where trim(dup) <> '' and trim(canonical) <> '' group by 1),
b as (select player, round(elo, 3) as elo from player_ratings), n as (select coalesce(o.canonical, b.player) as player, max(elo) as elo from b left join o on o.dup = b.player group by 1)
select coalesce(b.player, n.player) as player, case when b.player is null then 'added' when n.player is null then 'removed' else 'changed' end as what, b.elo as old_elo, n.elo as new_elo
from b full join n on b.player = n.player where b.player is null or n.player is null or b.elo is distinct from n.elo""")
def q6b(t: Tables) -> DataFrame:
    """The board before and after the merges of accounts: what was added, removed or changed."""
    from feedloom.operators.quality import snapshot_diff

    merges = t.account_merges.select(F.trim("dup").alias("player"), F.trim("canonical").alias("canonical")).where("player <> '' and canonical <> ''").groupBy("player").agg(F.min("canonical").alias("canonical"))
    board = t.player_ratings.select("player", F.round("elo", 3).alias("elo"))
    after = board.join(merges, "player", "left").groupBy(F.coalesce("canonical", "player").alias("player")).agg(F.max("elo").alias("elo"))
    diff = snapshot_diff(board, after, "player", ["elo"])
    return diff.select("player", "what", F.col("old_values.elo").alias("old_elo"), F.col("new_values.elo").alias("new_elo"))


@R.add("ref_f39_f44_plain_names", "select distinct regexp_replace(regexp_replace(trim(streamer), '^(https?://)?(www\\.)?[a-z0-9-]+\\.tv/', '', 'i'), '/+$', '') as channel from feed_events where trim(streamer) <> ''")
def f39(t: Tables) -> DataFrame:
    return t.feed_events.where("trim(streamer) <> ''").select(X.plain_characters(X.channel_name("streamer")).alias("channel")).distinct()


@R.add("ref_f48_zone_overlap", """
with m as (select match_id, kill_count / 40.0 as x0, players_observed / 80.0 as w0, players_observed / 40.0 as x1, kill_count / 80.0 as w1 from matches)
select match_id, least(x0 + w0, x1 + w1) - greatest(x0, x1) >= 0.5 * least(w0, w1) and abs(x0 - x1) <= 0.1 as same from m""")
def f48(t: Tables) -> DataFrame:
    k, p = F.col("kill_count"), F.col("players_observed")
    return t.matches.select("match_id", X.zones_overlap(k / 40.0, p / 80.0, p / 40.0, k / 80.0).alias("same"))


QUERIES, ORACLE = R.queries, R.oracle
