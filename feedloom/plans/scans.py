"""Scans, predicates, projections, sorts and set operations (S, P, O, U of the inventory)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import events as E
from feedloom.plans.registry import Registry, Tables

R = Registry()

_SUSP = """(case when {n} <> '' and contains({n}, ' ') then 2 else 0 end + case when {n} <> '' and length({n}) <= 4 then 2 else 0 end
 + case when {n} <> '' and length({n}) <= 6 and regexp_matches({n}, '[0-9]') then 1 else 0 end
 + case when {n} <> '' and regexp_matches({n}, '[^A-Za-z0-9_. -]') then 1 else 0 end)"""
_BOTH = "length(trim(coalesce(attacker, ''))) > 0 and length(trim(coalesce(victim, ''))) > 0"


@R.add("ref_s1_query_events", """
select id, streamer, timestamp, event_type, attacker, victim from feed_events
where lower(event_type) = 'kill' and lower(attacker) like '%an%' and timestamp >= timestamp '2018-01-05' and timestamp <= timestamp '2018-01-20'
order by id desc limit 50 offset 10""")
def s1(t: Tables) -> DataFrame:
    return E.query_events(
        t.feed_events.select("id", "streamer", "timestamp", "event_type", "attacker", "victim"),
        event_type="kill", attacker="an", from_ts=dt.datetime(2018, 1, 5), to_ts=dt.datetime(2018, 1, 20), limit=50, offset=10, newest_first=True,
    )


@R.add("ref_s2_rating_input", f"""
select id, timestamp, event_type, attacker, victim from feed_events
where ((event_type = 'Kill' and length(trim(coalesce(victim, ''))) > 0) or (event_type = 'BleedOut' and {_BOTH})) and source in ('trocr', 'easyocr')""")
def s2(t: Tables) -> DataFrame:
    return E.rating_input(t.feed_events).select("id", "timestamp", "event_type", "attacker", "victim")


@R.add("ref_s3_fingerprints", f"""
select id, timestamp, attacker, victim from feed_events where event_type in ('Knock', 'KillUnverified') and {_BOTH} and source in ('trocr', 'easyocr')""")
def s3(t: Tables) -> DataFrame:
    return E.fingerprints(t.feed_events).select("id", "timestamp", "attacker", "victim")


@R.add("ref_s9_seed_dimension", """
select s.name, 0 as total_seen, true as protected from (values ('Ember'), ('Rook'), ('Vesper'), ('Kestrel')) s(name)
where not exists (select 1 from player_ratings p where p.player = s.name)
union all select player, matches_played, false from player_ratings""")
def s9(t: Tables) -> DataFrame:
    seed = t.spark.createDataFrame([("Ember",), ("Rook",), ("Vesper",), ("Kestrel",)], "name string")
    have = t.player_ratings.select(F.col("player").alias("name"), F.col("matches_played").alias("total_seen"), F.lit(False).alias("protected"))
    new = seed.join(have, "name", "left_anti").select("name", F.lit(0).alias("total_seen"), F.lit(True).alias("protected"))
    return new.unionByName(have)


@R.add("ref_s10_cross_store_join", """
select m.streamer, count(*) as linked from match_kills k join matches m on m.match_id = k.match_id join feed_events e on e.id = k.source_event_id group by m.streamer""")
def s10(t: Tables) -> DataFrame:
    k = t.match_kills.select("match_id", F.col("source_event_id").alias("id"))
    return k.join(t.matches.select("match_id", "streamer"), "match_id").join(t.feed_events.select("id"), "id").groupBy("streamer").agg(F.count(F.lit(1)).alias("linked"))


@R.add("ref_s15_liveness_lookup", """
select s.streamer, coalesce(l.live, false) as live from (select distinct lower(trim(streamer)) as streamer from matches where trim(streamer) <> '') s
left join (select distinct lower(trim(streamer)) as streamer, true as live from feed_events where timestamp >= timestamp '2018-01-28') l on l.streamer = s.streamer""")
def s15(t: Tables) -> DataFrame:
    key = F.lower(F.trim("streamer")).alias("streamer")
    all_ = t.matches.select(key).where("streamer <> ''").distinct()
    live = t.feed_events.where(F.col("timestamp") >= F.lit("2018-01-28").cast("timestamp_ntz")).select(key).distinct().withColumn("live", F.lit(True))
    return all_.join(live, "streamer", "left").select("streamer", F.coalesce("live", F.lit(False)).alias("live"))


@R.add("ref_p1_ci_equals", "select id, streamer from feed_events where lower(streamer) = 'solarena'")
def p1(t: Tables) -> DataFrame:
    return E.query_events(t.feed_events, streamer="SolArena").select("id", "streamer")


@R.add("ref_p2_ci_substring", "select id, attacker from feed_events where lower(attacker) like '%bot%'")
def p2(t: Tables) -> DataFrame:
    return E.query_events(t.feed_events, attacker="BOT").select("id", "attacker")


@R.add("ref_p2_literal_substring", "select id, attacker from feed_events where contains(lower(attacker), '_m')")
def p2b(t: Tables) -> DataFrame:
    return t.feed_events.where(F.contains(F.lower("attacker"), F.lit("_m"))).select("id", "attacker")


@R.add("ref_p3_time_range", "select id from feed_events where timestamp between timestamp '2018-01-10 00:00:00' and timestamp '2018-01-12 12:00:00'")
def p3(t: Tables) -> DataFrame:
    return E.query_events(t.feed_events, from_ts=dt.datetime(2018, 1, 10), to_ts=dt.datetime(2018, 1, 12, 12)).select("id")


@R.add("ref_p4_source_and_flag", "select id from feed_events where source = 'gemini' and gemini_corrected = 1")
def p4(t: Tables) -> DataFrame:
    return E.query_events(t.feed_events, source="gemini", corrected_only=True).select("id")


@R.add("ref_p5_present", f"select id from feed_events where {_BOTH}")
def p5(t: Tables) -> DataFrame:
    return t.feed_events.where(E.present("attacker") & E.present("victim")).select("id")


@R.add("ref_p6_in_list", "select id, event_type from feed_events where event_type in ('Kill', 'BleedOut', 'Knock')")
def p6(t: Tables) -> DataFrame:
    return t.feed_events.where(F.col("event_type").isin("Kill", "BleedOut", "Knock")).select("id", "event_type")


@R.add("ref_p7_either_side", """
select id, case when attacker = 'PaceBot_Meridian' then 'attacker' else 'victim' end as role from match_kills where attacker = 'PaceBot_Meridian' or victim = 'PaceBot_Meridian'""")
def p7(t: Tables) -> DataFrame:
    me = F.lit("PaceBot_Meridian")
    return t.match_kills.where((F.col("attacker") == me) | (F.col("victim") == me)).select("id", F.when(F.col("attacker") == me, "attacker").otherwise("victim").alias("role"))


@R.add("ref_p8_as_of", "select id from feed_events where timestamp >= timestamp '2018-01-29 00:00:00' - interval 1 day")
def p8(t: Tables) -> DataFrame:
    return t.feed_events.where("timestamp >= timestamp_ntz '2018-01-29 00:00:00' - interval 1 day").select("id")


@R.add("ref_p9_outliers", "select player, elo from player_ratings where elo > 1150 or elo < 850")
def p9(t: Tables) -> DataFrame:
    return t.player_ratings.where((F.col("elo") > 1150) | (F.col("elo") < 850)).select("player", "elo")


@R.add("ref_p10_domain", """
select id, icon_vote, read_count from feed_events where icon_vote not in ('', 'kill') or read_count < 1 or attacker_conf <= 0 or attacker_conf > 1""")
def p10(t: Tables) -> DataFrame:
    bad = ~F.col("icon_vote").isin("", "kill") | (F.col("read_count") < 1) | (F.col("attacker_conf") <= 0) | (F.col("attacker_conf") > 1)
    return t.feed_events.where(bad).select("id", "icon_vote", "read_count")


@R.add("ref_p12_usable_rows", """
select id from feed_events where not (event_type in ('Kill', 'BleedOut') and length(trim(coalesce(attacker, ''))) = 0 and length(trim(coalesce(victim, ''))) = 0)""")
def p12(t: Tables) -> DataFrame:
    bad = F.col("event_type").isin("Kill", "BleedOut") & ~E.present("attacker") & ~E.present("victim")
    return t.feed_events.where(~bad).select("id")


@R.add("ref_p13_suspicion", f"""
with e as (select distinct id, trim(coalesce(attacker, '')) as a, trim(coalesce(victim, '')) as v from feed_events)
select id, {_SUSP.format(n='a')} + {_SUSP.format(n='v')} as score from e where {_SUSP.format(n='a')} + {_SUSP.format(n='v')} >= 4""")
def p13(t: Tables) -> DataFrame:
    (sa, ra), (sv, rv) = E.suspicion("attacker"), E.suspicion("victim")
    return t.feed_events.select("id", "attacker", "victim").distinct().select("id", (sa + sv).alias("score")).where("score >= 4").distinct()


@R.add("ref_p14_garbled", "select distinct raw_text as text from feed_events where regexp_matches(regexp_replace(lower(raw_text), '[^a-z]', '', 'g'), '[bcdfghjklmnpqrstvwxz]{8,}')")
def p14(t: Tables) -> DataFrame:
    """Texts with eight consonants in a row."""
    letters = F.regexp_replace(F.lower("raw_text"), "[^a-z]", "")
    return t.feed_events.where(letters.rlike("[bcdfghjklmnpqrstvwxz]{8,}")).select(F.col("raw_text").alias("text")).distinct()


@R.add("ref_p15_blocklist", "select match_id, streamer from matches where streamer is not null and streamer not in ('solarena', 'odenplus')")
def p15(t: Tables) -> DataFrame:
    block = t.spark.createDataFrame([("solarena",), ("odenplus",)], "streamer string")
    return t.matches.where("streamer is not null").join(F.broadcast(block), "streamer", "left_anti").select("match_id", "streamer")


@R.add("ref_p16_provisional", "select player, matches_played < 5 as provisional from player_ratings")
def p16(t: Tables) -> DataFrame:
    return t.player_ratings.select("player", (F.col("matches_played") < 5).alias("provisional"))


@R.add("ref_p17_conservative", "select player, round(elo - 2 * rd, 4) as score from player_ratings where elo is not null")
def p17(t: Tables) -> DataFrame:
    return t.player_ratings.where("elo is not null").select("player", F.round(F.col("elo") - 2 * F.col("rd"), 4).alias("score"))


@R.add("ref_p18_kill_death_ratio", "select player, round(case when total_deaths = 0 then total_kills else total_kills / total_deaths end, 6) as kd from player_ratings")
def p18(t: Tables) -> DataFrame:
    kd = F.when(F.col("total_deaths") == 0, F.col("total_kills").cast("double")).otherwise(F.col("total_kills") / F.col("total_deaths"))
    return t.player_ratings.select("player", F.round(kd, 6).alias("kd"))


@R.add("ref_p19_tiers", """
select player, case when elo >= 1400 then 'S' when elo >= 1200 then 'A' when elo >= 1050 then 'B' else 'C' end as tier from player_ratings where elo is not null""")
def p19(t: Tables) -> DataFrame:
    elo = F.col("elo")
    return t.player_ratings.where("elo is not null").select("player", F.when(elo >= 1400, "S").when(elo >= 1200, "A").when(elo >= 1050, "B").otherwise("C").alias("tier"))


@R.add("ref_p20_confidence_histogram", """
with e as (select least(coalesce(attacker_conf, 1), coalesce(victim_conf, 1)) as c from feed_events)
select case when c < 0.5 then 'lt50' when c < 0.7 then 'lt70' when c < 0.85 then 'lt85' when c < 0.95 then 'lt95' else 'rest' end as band, count(*) as n from e group by 1""")
def p20(t: Tables) -> DataFrame:
    c = F.least(F.coalesce("attacker_conf", F.lit(1.0)), F.coalesce("victim_conf", F.lit(1.0)))
    band = F.when(c < 0.5, "lt50").when(c < 0.7, "lt70").when(c < 0.85, "lt85").when(c < 0.95, "lt95").otherwise("rest")
    return t.feed_events.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@R.add("ref_p22_player_lookup", "select player, elo from player_ratings where lower(player) = 'pacebot_meridian'")
def p22(t: Tables) -> DataFrame:
    return t.player_ratings.where(F.lower("player") == "pacebot_meridian").select("player", "elo")


@R.add("ref_p23_mismatch", "select id, coalesce(raw_text <> canonical, false) as differs from feed_events")
def p23(t: Tables) -> DataFrame:
    return t.feed_events.select("id", F.coalesce(F.col("raw_text") != F.col("canonical"), F.lit(False)).alias("differs"))


@R.add("ref_o1_page", "select id, event_type from (select distinct id, event_type from feed_events) order by id limit 25 offset 50")
def o1(t: Tables) -> DataFrame:
    return t.feed_events.select("id", "event_type").distinct().orderBy("id").offset(50).limit(25)


@R.add("ref_o2_leaderboard", """
select player, elo, rd, round(elo - 2 * rd, 4) as score from player_ratings where matches_played >= 5 and elo is not null order by elo - 2 * rd desc, player limit 100""")
def o2(t: Tables) -> DataFrame:
    score = F.col("elo") - 2 * F.col("rd")
    rows = t.player_ratings.where("matches_played >= 5 and elo is not null")
    return rows.orderBy(score.desc(), "player").limit(100).select("player", "elo", "rd", F.round(score, 4).alias("score"))


@R.add("ref_o3_match_list", "select match_id, streamer, start_time from matches where lower(streamer) = 'solarena' order by start_time desc, match_id limit 20")
def o3(t: Tables) -> DataFrame:
    return t.matches.where(F.lower("streamer") == "solarena").orderBy(F.desc("start_time"), "match_id").limit(20).select("match_id", "streamer", "start_time")


@R.add("ref_o4_placement_order", """
select match_id, player, row_number() over (partition by match_id order by survived desc, kill_order_out desc, player) as place
from (select distinct trim(match_id) as match_id, player, survived, kill_order_out from match_placements)""")
def o4(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.match_placements.select(F.trim("match_id").alias("match_id"), "player", "survived", "kill_order_out").distinct()
    w = Window.partitionBy("match_id").orderBy(F.desc("survived"), F.desc("kill_order_out"), "player")
    return rows.select("match_id", "player", F.row_number().over(w).alias("place"))


@R.add("ref_o5_farthest", "select player, elo from player_ratings where elo is not null order by abs(elo - 1000) desc, player limit 10")
def o5(t: Tables) -> DataFrame:
    return t.player_ratings.where("elo is not null").orderBy(F.abs(F.col("elo") - 1000).desc(), "player").limit(10).select("player", "elo")


@R.add("ref_o6_top20", "select player, elo, matches_played from player_ratings where matches_played >= 3 and elo is not null order by elo desc, player limit 20")
def o6(t: Tables) -> DataFrame:
    return t.player_ratings.where("matches_played >= 3 and elo is not null").orderBy(F.desc("elo"), "player").limit(20).select("player", "elo", "matches_played")


@R.add("ref_o7_mixed_sort", f"""
with e as (select distinct id, timestamp, trim(coalesce(attacker, '')) as a, trim(coalesce(victim, '')) as v from feed_events where timestamp is not null)
select id, {_SUSP.format(n='a')} + {_SUSP.format(n='v')} as score from e order by score desc, timestamp, id limit 200""")
def o7(t: Tables) -> DataFrame:
    (sa, _), (sv, _) = E.suspicion("attacker"), E.suspicion("victim")
    rows = t.feed_events.where("timestamp is not null").select("id", "timestamp", F.trim(F.coalesce("attacker", F.lit(""))).alias("attacker"), F.trim(F.coalesce("victim", F.lit(""))).alias("victim")).distinct()
    return rows.select("id", "timestamp", (sa + sv).alias("score")).orderBy(F.desc("score"), "timestamp", "id").limit(200).select("id", "score")


@R.add("ref_o8_relevance", """
select player, matches_played from player_ratings where contains(lower(player), 'an')
order by case when lower(player) = 'an' then 0 else 1 end, matches_played desc, player limit 10""")
def o8(t: Tables) -> DataFrame:
    rows = t.player_ratings.where(F.contains(F.lower("player"), F.lit("an")))
    return rows.orderBy(F.lower("player") != "an", F.desc("matches_played"), "player").limit(10).select("player", "matches_played")


@R.add("ref_o9_total", "select count(*) as total from player_ratings where matches_played >= 5")
def o9(t: Tables) -> DataFrame:
    return t.player_ratings.where("matches_played >= 5").agg(F.count(F.lit(1)).alias("total"))


@R.add("ref_o11_by_change", """
select match_id, player, row_number() over (partition by match_id order by elo_change desc nulls last, player) as place
from (select trim(match_id) as match_id, player, max(elo_change) as elo_change from match_placements group by 1, 2)""")
def o11(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.match_placements.groupBy(F.trim("match_id").alias("match_id"), "player").agg(F.max("elo_change").alias("elo_change"))
    w = Window.partitionBy("match_id").orderBy(F.desc_nulls_last("elo_change"), "player")
    return rows.select("match_id", "player", F.row_number().over(w).alias("place"))


@R.add("ref_o10_seeded_sample", "select filename, label from crop_labels where label is not null order by md5(filename || '|7'), filename limit 100")
def o10(t: Tables) -> DataFrame:
    """The same 100 crops on every run, whatever the partitions."""
    return t.crop_labels.where("label is not null").orderBy(F.md5(F.concat("filename", F.lit("|7"))), "filename").limit(100).select("filename", "label")


@R.add("ref_u1_names", """
select distinct name from (select trim(attacker) as name from feed_events union all select trim(victim) from feed_events) where name <> ''""")
def u1(t: Tables) -> DataFrame:
    names = t.feed_events.select(F.explode(F.array(F.trim("attacker"), F.trim("victim"))).alias("name"))
    return names.where("name <> ''").distinct()


@R.add("ref_u2_common_matches", """
select match_id from match_kills where attacker = 'PaceBot_Meridian' intersect select match_id from match_kills where victim = 'PaceBot_Meridian'""")
def u2(t: Tables) -> DataFrame:
    me = F.lit("PaceBot_Meridian")
    return t.match_kills.where(F.col("attacker") == me).select("match_id").intersect(t.match_kills.where(F.col("victim") == me).select("match_id"))


@R.add("ref_u3_snapshot_diff", """
select coalesce(a.player, b.player) as player, case when a.player is null then 'added' when b.player is null then 'removed' else 'changed' end as what
from (select player, matches_played from player_ratings where matches_played >= 3) a
full join (select player, matches_played + case when total_kills > 40 then 1 else 0 end as matches_played from player_ratings where matches_played >= 3 or total_kills > 1) b
on a.player = b.player where a.player is null or b.player is null or a.matches_played <> b.matches_played""")
def u3(t: Tables) -> DataFrame:
    from feedloom.operators.quality import snapshot_diff

    old = t.player_ratings.where("matches_played >= 3").select("player", "matches_played")
    grown = F.col("matches_played") + F.when(F.col("total_kills") > 40, 1).otherwise(0)
    new = t.player_ratings.where("matches_played >= 3 or total_kills > 1").select("player", grown.alias("matches_played"))
    return snapshot_diff(old, new, "player", ["matches_played"]).select("player", "what")


@R.add("ref_u4_concat", f"""
select id, 'kill' as kind from feed_events where event_type = 'Kill' and {_BOTH} union all select id, 'fingerprint' from feed_events where event_type = 'Knock' and {_BOTH}""")
def u4(t: Tables) -> DataFrame:
    both = E.present("attacker") & E.present("victim")
    part = lambda kind, name: t.feed_events.where((F.col("event_type") == kind) & both).select("id", F.lit(name).alias("kind"))
    return part("Kill", "kill").unionAll(part("Knock", "fingerprint"))


@R.add("ref_u5_subset_reapply", """
select trim(m.canonical) as canonical, trim(m.dup) as dup from account_merges m
where exists (select 1 from player_ratings p where p.player = trim(m.canonical)) and exists (select 1 from player_ratings p where p.player = trim(m.dup))""")
def u5(t: Tables) -> DataFrame:
    links = t.account_merges.select(F.trim("canonical").alias("canonical"), F.trim("dup").alias("dup"))
    have = t.player_ratings.select("player")
    return links.join(have, links.canonical == have.player, "left_semi").join(have, links.dup == have.player, "left_semi")


QUERIES, ORACLE = R.queries, R.oracle
