"""Joins, aggregates and windows (J, A, W of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators import events as E
from feedloom.operators import joins as J
from feedloom.operators.sessions import micros
from feedloom.plans.registry import Registry, Tables

R = Registry()
_MATCHES = "(select match_id, streamer, start_time, greatest(start_time, coalesce(end_time, start_time)) as end_time from matches)"


def _distinct_events(t: Tables, *cols: str) -> DataFrame:
    return t.feed_events.select("id", *cols).distinct()


def _key(col: str = "streamer"):
    return F.lower(F.trim(col)).alias("key")


@R.add("ref_j1_player_history", """
select p.match_id, p.kill_order_out, p.elo_after, m.start_time from (select distinct match_id, player, kill_order_out, elo_after from match_placements) p
join matches m on m.match_id = p.match_id where p.player = 'PaceBot_Meridian' order by m.start_time desc, p.match_id limit 50""")
def j1(t: Tables) -> DataFrame:
    p = t.match_placements.where("player = 'PaceBot_Meridian'").select("match_id", "kill_order_out", "elo_after").distinct()
    return p.join(t.matches.select("match_id", "start_time"), "match_id").orderBy(F.desc("start_time"), "match_id").limit(50)


@R.add("ref_j2_kill_audit", """
select k.id, k.match_id, e.raw_text, e.event_type from match_kills k left join (select distinct id, raw_text, event_type from feed_events) e on e.id = k.source_event_id""")
def j2(t: Tables) -> DataFrame:
    e = _distinct_events(t, "raw_text", "event_type").withColumnRenamed("id", "source_event_id")
    return t.match_kills.select("id", "match_id", "source_event_id").join(e, "source_event_id", "left").select("id", "match_id", "raw_text", "event_type")


@R.add("ref_j3_event_trace", """
select k.id, k.source_event_id, m.match_id, m.streamer, m.start_time from match_kills k join matches m on m.match_id = k.match_id where k.source_event_id is not null""")
def j3(t: Tables) -> DataFrame:
    k = t.match_kills.where("source_event_id is not null").select("id", "source_event_id", "match_id")
    return k.join(t.matches.select("match_id", "streamer", "start_time"), "match_id")


@R.add("ref_j4_orphan_events", """
select k.id from match_kills k where k.source_event_id is not null and not exists (select 1 from feed_events e where e.id = k.source_event_id)""")
def j4(t: Tables) -> DataFrame:
    k = t.match_kills.where("source_event_id is not null").select("id", "source_event_id")
    return k.join(t.feed_events.select(F.col("id").alias("source_event_id")), "source_event_id", "left_anti").select("id")


@R.add("ref_j5_placement_without_kill", """
select distinct p.match_id, p.player from match_placements p where p.survived = 0 and p.kill_order_out > 0
and not exists (select 1 from match_kills k where k.match_id = p.match_id and k.victim = p.player)""")
def j5(t: Tables) -> DataFrame:
    p = t.match_placements.where("survived = 0 and kill_order_out > 0").select("match_id", "player").distinct()
    return p.join(t.match_kills.select("match_id", F.col("victim").alias("player")), ["match_id", "player"], "left_anti")


@R.add("ref_j6_duplicate_reads", """
with e as (select distinct id, streamer, attacker, victim, timestamp from feed_events where event_type = 'Kill' and attacker is not null and victim is not null and streamer is not null and timestamp is not null)
select a.id as id_a, b.id as id_b from e a join e b on a.streamer = b.streamer and a.attacker = b.attacker and a.victim = b.victim and b.id > a.id
and abs(epoch_us(b.timestamp) - epoch_us(a.timestamp)) <= 5000000""")
def j6(t: Tables) -> DataFrame:
    e = t.feed_events.where("event_type = 'Kill' and attacker is not null and victim is not null and streamer is not null").select(
        "id", "streamer", "attacker", "victim", micros("timestamp").alias("us")).where("us is not null").distinct()
    b = e.withColumnsRenamed({"id": "id_b", "us": "us_b"})
    return J.within(e.withColumnsRenamed({"id": "id_a"}), b, ["streamer", "attacker", "victim"], "us", "us_b", 5_000_000).where("id_b > id_a").select("id_a", "id_b")


_CROPS = """(select filename, lower(streamer) as key, epoch_us(try_strptime(regexp_extract(filename, '^([0-9]{8}_[0-9]{6})_line', 1), '%Y%m%d_%H%M%S')) as cus from crop_labels)"""
_EV = "(select distinct id, lower(trim(streamer)) as key, epoch_us(timestamp) as us from feed_events where timestamp is not null and trim(streamer) <> '')"


def crops(t: Tables) -> DataFrame:
    """Crops with the time in their names: (filename, key, cus)."""
    stamp = F.regexp_extract("filename", "^([0-9]{8}_[0-9]{6})_line", 1)
    return t.crop_labels.select("filename", F.lower("streamer").alias("key"), F.unix_micros(F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))).alias("cus"))


def timed(t: Tables) -> DataFrame:
    return t.feed_events.select("id", _key(), micros("timestamp").alias("us")).where("us is not null and key <> ''").distinct()


@R.add("ref_j7_nearest_crop", f"""
select id, filename, distance_us from (select e.id, c.filename, abs(e.us - c.cus) as distance_us, row_number() over (partition by e.id order by abs(e.us - c.cus), c.filename) as rn
from {_EV} e join {_CROPS} c on c.key = e.key and abs(e.us - c.cus) <= 12000000) where rn = 1""")
def j7(t: Tables) -> DataFrame:
    return J.nearest_within(timed(t), crops(t), ["key"], "id", "us", "cus", "filename", 12_000_000)


@R.add("ref_j8_nearest_graded", f"""
with d as (select e.id, min(abs(e.us - c.cus)) as distance_us from {_EV} e join {_CROPS} c on c.key = e.key group by e.id)
select id, distance_us, case when distance_us <= 15000000 then 'near' when distance_us <= 60000000 then 'close' else 'far' end as grade from d""")
def j8(t: Tables) -> DataFrame:
    best = J.nearest(timed(t), crops(t).where("cus is not null"), ["key"], "id", "us", "cus", "filename")
    grade = F.when(F.col("distance_us") <= 15_000_000, "near").when(F.col("distance_us") <= 60_000_000, "close").otherwise("far")
    return best.select("id", "distance_us", grade.alias("grade"))


@R.add("ref_j9_crops_with_event", f"select c.filename from {_CROPS} c where exists (select 1 from {_EV} e where e.key = c.key and abs(e.us - c.cus) <= 12000000)")
def j9(t: Tables) -> DataFrame:
    return J.within(crops(t), timed(t).select("key", "us").distinct(), ["key"], "cus", "us", 12_000_000).select("filename").distinct()


@R.add("ref_j10_crops_around_event", f"""
select e.id, c.filename, cast(floor(abs(e.us - c.cus) / 1000000) as bigint) as offset_s from {_EV} e join {_CROPS} c on c.key = e.key and abs(e.us - c.cus) <= 30000000""")
def j10(t: Tables) -> DataFrame:
    return J.within(timed(t), crops(t), ["key"], "us", "cus", 30_000_000).select("id", "filename", F.floor(F.abs(F.col("us") - F.col("cus")) / 1_000_000).cast("long").alias("offset_s"))


@R.add("ref_j11_linked_or_near_crop", f"""
with n as (select e.id, min(c.filename) as near from {_EV} e join {_CROPS} c on c.key = e.key and abs(e.us - c.cus) <= 30000000 group by e.id),
k as (select distinct id, source_event_id, nullif(trim(crop_filename), '') as crop from match_kills)
select k.id, coalesce(l.filename, n.near) as filename from k left join crop_labels l on l.filename = k.crop left join n on n.id = k.source_event_id""")
def j11(t: Tables) -> DataFrame:
    near = J.within(timed(t), crops(t), ["key"], "us", "cus", 30_000_000).groupBy(F.col("id").alias("source_event_id")).agg(F.min("filename").alias("near"))
    k = t.match_kills.select("id", "source_event_id", F.when(F.trim("crop_filename") != "", F.trim("crop_filename")).alias("crop")).distinct()
    linked = t.crop_labels.select(F.col("filename").alias("crop"), "filename")
    return k.join(linked, "crop", "left").join(near, "source_event_id", "left").select("id", F.coalesce("filename", "near").alias("filename"))


@R.add("ref_j12_events_around_kills", f"""
with k as (select distinct k.id, lower(m.streamer) as key, epoch_us(k.timestamp) as kus from match_kills k join matches m on m.match_id = k.match_id where k.timestamp is not null)
select k.id as kill_id, count(*) as nearby from k join {_EV} e on e.key = k.key and abs(e.us - k.kus) <= 5000000 group by k.id""")
def j12(t: Tables) -> DataFrame:
    k = t.match_kills.join(t.matches.select("match_id", "streamer"), "match_id").select(F.col("id").alias("kill_id"), F.lower("streamer").alias("key"), micros("timestamp").alias("kus")).where("kus is not null").distinct()
    return J.within(k, timed(t), ["key"], "kus", "us", 5_000_000).groupBy("kill_id").agg(F.count("*").alias("nearby"))


@R.add("ref_j14_overlapping_matches", f"""
select a.match_id as match_a, b.match_id as match_b from {_MATCHES} a join {_MATCHES} b on a.match_id < b.match_id and a.streamer <> b.streamer
and a.start_time - interval 120 second <= b.end_time and b.start_time - interval 120 second <= a.end_time""")
def j14(t: Tables) -> DataFrame:
    m = t.matches.select("match_id", "streamer", micros("start_time").alias("s"), F.greatest(micros("start_time"), F.coalesce(micros("end_time"), micros("start_time"))).alias("e")).where("s is not null")
    pairs = J.overlapping(m, "s", "e", "match_id", 120_000_000, 1_800_000_000)
    # A slop on both sides counts once.
    apart = F.greatest(F.col("s_a") - F.col("e_b"), F.col("s_b") - F.col("e_a"))
    return pairs.where((apart <= 120_000_000) & (F.col("streamer_a") != F.col("streamer_b"))).select(F.col("match_id_a").alias("match_a"), F.col("match_id_b").alias("match_b"))


@R.add("ref_j17_base_token", """
with n as (select distinct trim(attacker) as player from feed_events where trim(attacker) <> ''),
p as (select player from n union select regexp_extract(player, '^([A-Za-z]+)_', 1) from n where regexp_extract(player, '^([A-Za-z]+)_', 1) <> ''),
s as (select lower(player) as k, max(player) as single from p where not contains(player, ' ') group by 1)
select p.player, s.single from p join s on s.k = lower(split_part(p.player, ' ', 1)) where contains(p.player, ' ') and length(split_part(p.player, ' ', 1)) >= 4""")
def j17(t: Tables) -> DataFrame:
    """Names of several words beside the single words that others are written with."""
    from feedloom.operators.identity import base_token_edges

    n = t.feed_events.select(F.trim("attacker").alias("player")).where("player <> ''").distinct()
    heads = n.select(F.regexp_extract("player", "^([A-Za-z]+)_", 1).alias("player")).where("player <> ''")
    return base_token_edges(n.unionByName(heads).distinct()).select(F.col("a").alias("player"), F.col("b").alias("single"))


@R.add("ref_j24_kills_and_deaths", """
with e as (select distinct id, nullif(trim(attacker), '') as a, nullif(trim(victim), '') as v from feed_events where event_type = 'Kill'),
k as (select a as player, count(*) as kills from e where a is not null group by 1), d as (select v as player, count(*) as deaths from e where v is not null group by 1)
select coalesce(k.player, d.player) as player, coalesce(kills, 0) as kills, coalesce(deaths, 0) as deaths from k full join d on k.player = d.player""")
def j24(t: Tables) -> DataFrame:
    from feedloom.serving import player_stats

    return player_stats(t.feed_events)


@R.add("ref_j25_alias_lookup", """
with a as (select distinct id, trim(attacker) as n from feed_events where trim(attacker) <> ''), m as (select trim(dup) as n, min(trim(canonical)) as c from account_merges where trim(dup) <> '' and trim(canonical) <> '' group by 1)
select a.id, coalesce(m.c, a.n) as canonical from a left join m on m.n = a.n""")
def j25(t: Tables) -> DataFrame:
    alias = t.account_merges.select(F.trim("dup").alias("n"), F.trim("canonical").alias("c")).where("n <> '' and c <> ''").groupBy("n").agg(F.min("c").alias("c"))
    rows = t.feed_events.select("id", F.trim("attacker").alias("n")).where("n <> ''").distinct()
    return rows.join(alias, "n", "left").select("id", F.coalesce("c", "n").alias("canonical"))


@R.add("ref_j26_variant_search", """
with v(variant) as (values ('pacebot'), ('kestrel'), ('kestrel1')), e as (select distinct id, raw_text, attacker, victim from feed_events)
select e.id, max_by(variant, length(variant)) as variant from e join v on contains(lower(e.raw_text), variant)
where not (coalesce(lower(e.attacker), '') in (select variant from v) or coalesce(lower(e.victim), '') in (select variant from v)) group by e.id""")
def j26(t: Tables) -> DataFrame:
    """The variants asked for are a fixed short list: they become predicates, not a join."""
    variants = ["pacebot", "kestrel", "kestrel1"]
    text = F.lower("raw_text")
    longest = F.coalesce(*(F.when(F.contains(text, F.lit(v)), F.lit(v)) for v in sorted(variants, key=len, reverse=True)))
    direct = F.coalesce(F.lower("attacker"), F.lit("")).isin(variants) | F.coalesce(F.lower("victim"), F.lit("")).isin(variants)
    return _distinct_events(t, "raw_text", "attacker", "victim").where(~direct).select("id", longest.alias("variant")).where("variant is not null")


@R.add("ref_j27_match_pairs", """
with p as (select trim(match_id) as m, player, max(kill_order_out) as o from match_placements where player is not null group by 1, 2)
select a.m as match_id, count(*) as pairs, sum(b.o - a.o) as spread from p a join p b on a.m = b.m and a.o < b.o group by a.m""")
def j27(t: Tables) -> DataFrame:
    """Count and spread of the ordered pairs of a match, from running sums instead of pairs."""
    p = t.match_placements.where("player is not null").groupBy(F.trim("match_id").alias("match_id"), "player").agg(F.max("kill_order_out").alias("o"))
    steps = p.groupBy("match_id", "o").agg(F.count("*").alias("n"))
    before = Window.partitionBy("match_id").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.select("match_id", "o", "n", F.sum("n").over(before).alias("below"), F.sum(F.col("n") * F.col("o")).over(before).alias("weight"))
    return sums.where("below > 0").groupBy("match_id").agg(F.sum(F.col("n") * F.col("below")).alias("pairs"), F.sum(F.col("n") * (F.col("o") * F.col("below") - F.col("weight"))).cast("decimal(38,0)").cast("long").alias("spread"))


@R.add("ref_j29_crop_prefix_labels", """
with e as (select distinct id, lower(trim(streamer)) as key, strftime(timestamp, '%Y%m%d_%H%M%S') as p from feed_events where timestamp is not null),
c as (select lower(streamer) as key, regexp_extract(filename, '^([0-9]{8}_[0-9]{6})_line', 1) as p, label from crop_labels)
select e.id, max(c.label) as label, count(*) as crops from e join c on c.key = e.key and c.p = e.p group by e.id""")
def j29(t: Tables) -> DataFrame:
    e = t.feed_events.where("timestamp is not null").select("id", _key(), F.date_format("timestamp", "yyyyMMdd_HHmmss").alias("p")).distinct()
    c = t.crop_labels.select(F.lower("streamer").alias("key"), F.regexp_extract("filename", "^([0-9]{8}_[0-9]{6})_line", 1).alias("p"), "label")
    return e.join(c, ["key", "p"]).groupBy("id").agg(F.max("label").alias("label"), F.count("*").alias("crops"))


@R.add("ref_a1_count", "select count(*) as n from feed_events where event_type = 'Kill'")
def a1(t: Tables) -> DataFrame:
    return t.feed_events.where("event_type = 'Kill'").agg(F.count("*").alias("n"))


@R.add("ref_a2_by_streamer", "select lower(trim(streamer)) as streamer, count(*) as n from feed_events group by 1")
def a2(t: Tables) -> DataFrame:
    return t.feed_events.groupBy(F.lower(F.trim("streamer")).alias("streamer")).agg(F.count("*").alias("n"))


@R.add("ref_a4_deaths", "select victim, n from (select trim(victim) as victim, count(*) as n from feed_events where event_type = 'Kill' group by 1) where victim <> ''")
def a4(t: Tables) -> DataFrame:
    return t.feed_events.where("event_type = 'Kill'").groupBy(F.trim("victim").alias("victim")).agg(F.count("*").alias("n")).where("victim <> ''")


@R.add("ref_a5_by_type", "select event_type, count(*) as n from feed_events group by 1")
def a5(t: Tables) -> DataFrame:
    return t.feed_events.groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("ref_a6_distinct_streamers", "select count(distinct lower(trim(streamer))) as n from feed_events")
def a6(t: Tables) -> DataFrame:
    return t.feed_events.agg(F.count_distinct(F.lower(F.trim("streamer"))).alias("n"))


@R.add("ref_a7_quality_counts", """
select count(*) filter (where coalesce(trim(attacker), '') = '') as no_attacker, count(*) filter (where coalesce(trim(victim), '') = '') as no_victim,
count(*) filter (where attacker_conf < 0.5) as low_conf, count(*) filter (where gemini_corrected = 1) as corrected,
count(*) filter (where length(attacker) < 3) as short_names, count(*) filter (where length(attacker) > 20) as long_names from feed_events""")
def a7(t: Tables) -> DataFrame:
    return t.feed_events.agg(
        F.count_if(~E.present("attacker")).alias("no_attacker"), F.count_if(~E.present("victim")).alias("no_victim"),
        F.count_if(F.col("attacker_conf") < 0.5).alias("low_conf"), F.count_if(F.col("gemini_corrected") == 1).alias("corrected"),
        F.count_if(F.length("attacker") < 3).alias("short_names"), F.count_if(F.length("attacker") > 20).alias("long_names"),
    )


@R.add("ref_a8_a9_rating_spread", """
select count(elo) as n, round(avg(elo), 3) as mean, round(stddev_samp(elo), 3) as sd, min(elo) as least, max(elo) as most,
round(quantile_cont(elo, 0.25), 4) as p25, round(quantile_cont(elo, 0.5), 4) as p50, round(quantile_cont(elo, 0.75), 4) as p75 from player_ratings""")
def a8(t: Tables) -> DataFrame:
    p = lambda q: F.round(F.percentile("elo", F.lit(q)), 4)
    return t.player_ratings.agg(
        F.count("elo").alias("n"), F.round(F.avg("elo"), 3).alias("mean"), F.round(F.stddev_samp("elo"), 3).alias("sd"), F.min("elo").alias("least"),
        F.max("elo").alias("most"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"),
    )


@R.add("ref_a10_nearest_rank", """
with r as (select elo, row_number() over (order by elo, player) - 1 as k, count(*) over () as n from player_ratings where elo is not null)
select max(elo) filter (where k = n // 4) as q1, max(elo) filter (where k = n // 2) as q2, max(elo) filter (where k = 3 * n // 4) as q3 from r""")
def a10(t: Tables) -> DataFrame:
    """Values at places n//4, n//2 and 3n//4 of the sorted list: percentile_disc would round otherwise."""
    rows = t.player_ratings.where("elo is not null").select("elo")
    steps = rows.groupBy("elo").agg(F.count("*").alias("c"))
    w = Window.orderBy("elo").rowsBetween(Window.unboundedPreceding, 0)  # over the distinct values
    placed = steps.select("elo", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("elo")))
    return placed.agg(at(F.expr("n div 4")).alias("q1"), at(F.expr("n div 2")).alias("q2"), at(F.expr("3 * n div 4")).alias("q3"))


@R.add("ref_a11_median_delay", """
select lower(trim(streamer)) as streamer, median(cast(created_at - epoch(timestamp) as bigint)) as delay from (select distinct id, streamer, timestamp, created_at from feed_events where timestamp is not null) group by 1""")
def a11(t: Tables) -> DataFrame:
    rows = t.feed_events.where("timestamp is not null").select("id", "streamer", "timestamp", "created_at").distinct()
    delay = F.round(F.col("created_at") - micros("timestamp") / 1e6).cast("long")
    return rows.groupBy(F.lower(F.trim("streamer")).alias("streamer")).agg(F.median(delay).alias("delay"))


R.oracle["ref_a11_median_delay"] = R.oracle["ref_a11_median_delay"].replace("cast(created_at - epoch(timestamp) as bigint)", "cast(round(created_at - epoch_us(timestamp) / 1e6) as bigint)")


@R.add("ref_a12_top_confusions", "select trim(attacker) as word, count(*) as n from feed_events where trim(attacker) <> '' group by 1 order by n desc, word limit 5")
def a12(t: Tables) -> DataFrame:
    return t.feed_events.select(F.trim("attacker").alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(5)


@R.add("ref_a13_shares", "select source, count(*) as n, round(100.0 * count(*) / (select count(*) from feed_events), 2) as pct from feed_events group by 1")
def a13(t: Tables) -> DataFrame:
    counts = t.feed_events.groupBy("source").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row a source
    return counts.select("source", "n", F.when(total == 0, 0.0).otherwise(F.round(100.0 * F.col("n") / total, 2)).alias("pct"))


@R.add("ref_a14_span_and_rate", """
select min(timestamp) as first, max(timestamp) as last, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9, 4) as hours,
round(count(*) * 3.6e9 / (epoch_us(max(timestamp)) - epoch_us(min(timestamp))), 4) as per_hour from feed_events where timestamp is not null""")
def a14(t: Tables) -> DataFrame:
    span = F.max(micros("timestamp")) - F.min(micros("timestamp"))
    return t.feed_events.where("timestamp is not null").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.round(span / 3.6e9, 4).alias("hours"), F.round(F.count("*") * 3.6e9 / span, 4).alias("per_hour")
    )


@R.add("ref_a15_matches_per_streamer", "select streamer, count(*) as matches, sum(kill_count)::bigint as kills, sum(players_observed)::bigint as players from matches group by 1")
def a15(t: Tables) -> DataFrame:
    return t.matches.groupBy("streamer").agg(F.count("*").alias("matches"), F.sum("kill_count").alias("kills"), F.sum("players_observed").alias("players"))


@R.add("ref_a16_players_per_match", """
select match_id, count(distinct p) as players from (select match_id, trim(attacker) as p from match_kills union all select match_id, trim(victim) from match_kills) where p <> '' group by 1""")
def a16(t: Tables) -> DataFrame:
    names = t.match_kills.select("match_id", F.explode(F.array(F.trim("attacker"), F.trim("victim"))).alias("p"))
    return names.where("p <> ''").groupBy("match_id").agg(F.count_distinct("p").alias("players"))


@R.add("ref_a17_durations", """
with d as (select (epoch_us(end_time) - epoch_us(start_time)) / 6e7 as m, kill_count from matches where end_time >= start_time)
select round(min(m), 4) as least, round(max(m), 4) as most, round(avg(m), 3) as mean, count(*) filter (where kill_count >= 30) as mega from d""")
def a17(t: Tables) -> DataFrame:
    m = (micros("end_time") - micros("start_time")) / 6e7
    return t.matches.where("end_time >= start_time").agg(F.round(F.min(m), 4).alias("least"), F.round(F.max(m), 4).alias("most"), F.round(F.avg(m), 3).alias("mean"), F.count_if(F.col("kill_count") >= 30).alias("mega"))


@R.add("ref_a18_match_scoreboard", """
with k as (select distinct id, match_id, nullif(trim(attacker), '') as a, nullif(trim(victim), '') as v from match_kills),
s as (select match_id, player, sum(k)::bigint as kills, sum(d)::bigint as deaths from (select match_id, a as player, 1 as k, 0 as d from k union all select match_id, v, 0, 1 from k) where player is not null group by 1, 2),
p as (select match_id, player, max(kill_order_out) as place from match_placements group by 1, 2)
select coalesce(s.match_id, p.match_id) as match_id, coalesce(s.player, p.player) as player, coalesce(kills, 0) as kills, coalesce(deaths, 0) as deaths, place
from s full join p on s.match_id = p.match_id and s.player = p.player""")
def a18(t: Tables) -> DataFrame:
    from feedloom.serving import match_scoreboard

    return match_scoreboard(t.match_kills, t.match_placements)


@R.add("ref_a19_last_orders", """
with k as (select match_id, trim(attacker) as a, trim(victim) as v, kill_order as o from match_kills)
select coalesce(x.match_id, y.match_id) as match_id, coalesce(x.p, y.p) as player, last_kill, last_death from
(select match_id, a as p, max(o) as last_kill from k where a <> '' group by 1, 2) x full join
(select match_id, v as p, max(o) as last_death from k where v <> '' group by 1, 2) y on x.match_id = y.match_id and x.p = y.p""")
def a19(t: Tables) -> DataFrame:
    from feedloom.operators.matches import last_orders

    return last_orders(t.match_kills.select("match_id", "attacker", "victim", "kill_order"))


@R.add("ref_a20_best_confidence", """
with x as (select match_id, trim(attacker) as player, case when coalesce(attacker_conf, 0) = 0 then 0.5 else attacker_conf end as c from match_kills
union all select match_id, trim(victim), case when coalesce(victim_conf, 0) = 0 then 0.5 else victim_conf end from match_kills)
select match_id, player, max(c) as best from x where player <> '' group by 1, 2""")
def a20(t: Tables) -> DataFrame:
    side = lambda n: F.struct(F.trim(n).alias("player"), E.confidence(f"{n}_conf").alias("c"))
    rows = t.match_kills.select("match_id", F.inline(F.array(side("attacker"), side("victim"))))
    return rows.where("player <> ''").groupBy("match_id", "player").agg(F.max("c").alias("best"))


@R.add("ref_a22_cluster_rollup", """
with g as (select trim(dup) as player, min(trim(canonical)) as canonical from account_merges where trim(dup) <> '' and trim(canonical) <> '' group by 1)
select coalesce(g.canonical, p.player) as canonical, sum(total_kills)::bigint as kills, sum(total_deaths)::bigint as deaths, sum(matches_played)::bigint as matches, max(peak_elo) as peak
from player_ratings p left join g on g.player = p.player group by 1""")
def a22(t: Tables) -> DataFrame:
    from feedloom.operators.identity import roll_up

    alias = t.account_merges.select(F.trim("dup").alias("player"), F.trim("canonical").alias("canonical")).where("player <> '' and canonical <> ''").groupBy("player").agg(F.min("canonical").alias("canonical"))
    return roll_up(t.player_ratings, alias)


@R.add("ref_a23_arg_max", """
with g as (select lower(regexp_replace(player, '[^A-Za-z0-9]', '', 'g')) as k, player, matches_played, case when player <> lower(player) and player <> upper(player) then 1 else 0 end as mixed from player_ratings)
select k, player as canonical from (select *, row_number() over (partition by k order by mixed desc, matches_played desc, length(player) desc, player) as rn from g) where rn = 1""")
def a23(t: Tables) -> DataFrame:
    from feedloom.operators.identity import choose_canonical

    keyed = t.player_ratings.select(F.lower(F.regexp_replace("player", "[^A-Za-z0-9]", "")).alias("k"), "player", "matches_played")
    return choose_canonical(keyed, "k")


@R.add("ref_a24_majority_vote", """
with v as (select streamer, quality, count(*) as n from crop_labels where trim(quality) <> '' and streamer is not null group by 1, 2),
r as (select streamer, quality, n, row_number() over (partition by streamer order by n desc, quality) as rn, sum(n) over (partition by streamer) as votes from v)
select streamer, case when votes >= 3 then quality end as tier from r where rn = 1""")
def a24(t: Tables) -> DataFrame:
    votes = t.crop_labels.where("trim(quality) <> '' and streamer is not null").groupBy("streamer", "quality").agg(F.count("*").alias("n"))
    best = F.min_by("quality", F.struct(-F.col("n"), "quality"))
    return votes.groupBy("streamer").agg(F.when(F.sum("n") >= 3, best).alias("tier"))


_ISLANDS = """
with e as (select distinct id, lower(trim(streamer)) as key, timestamp as ts, icon_vote as v from feed_events where timestamp is not null and trim(streamer) <> '' and icon_vote <> ''),
r as (select *, row_number() over (partition by key order by ts, id) - row_number() over (partition by key, v order by ts, id) as g from e),
l as (select key, v, g, count(*) as n from r group by 1, 2, 3)
"""


@R.add("ref_a26_longest_kill_run", _ISLANDS + """
select key, coalesce(max(n) filter (where v = 'kill'), 0)::bigint as longest, round(sum(case when v = 'kill' then n else 0 end) / sum(n), 6) as fraction,
case when coalesce(max(n) filter (where v = 'kill'), 0) >= 3 and sum(case when v = 'kill' then n else 0 end) / sum(n) >= 0.5 then 'kill' else 'gun' end as decision from l group by key""")
def a26(t: Tables) -> DataFrame:
    from feedloom.operators.matches import icon_decision

    rows = t.feed_events.where("timestamp is not null and trim(streamer) <> '' and icon_vote <> ''").select("id", _key(), "timestamp", "icon_vote").distinct()
    return icon_decision(rows, "key", ["timestamp", "id"], "icon_vote")


@R.add("ref_a27_a28_character_errors", """
with d as (select distinct id, levenshtein(lower(raw_text), lower(canonical)) / length(canonical) as cer from feed_events where length(canonical) > 0 and raw_text is not null)
select case when cer = 0 then 'exact' when cer <= 0.15 then 'low' when cer <= 0.4 then 'middle' else 'high' end as band, count(*) as n from d group by 1""")
def a28(t: Tables) -> DataFrame:
    cer = F.levenshtein(F.lower("raw_text"), F.lower("canonical")) / F.length("canonical")
    rows = t.feed_events.where("length(canonical) > 0 and raw_text is not null").select("id", cer.alias("cer")).distinct()
    c = F.col("cer")
    return rows.groupBy(F.when(c == 0, "exact").when(c <= 0.15, "low").when(c <= 0.4, "middle").otherwise("high").alias("band")).agg(F.count("*").alias("n"))


@R.add("ref_a29_set_valued", """
select match_id, trim(victim) as victim, array_to_string(list_sort(list_distinct(list(trim(attacker)) filter (where trim(attacker) <> ''))), '|') as attackers, count(*) as n, min(timestamp) as first, max(timestamp) as last
from match_kills where trim(victim) <> '' group by 1, 2""")
def a29(t: Tables) -> DataFrame:
    names = F.array_sort(F.collect_set(F.when(F.trim("attacker") != "", F.trim("attacker"))))
    return t.match_kills.where("trim(victim) <> ''").groupBy("match_id", F.trim("victim").alias("victim")).agg(F.array_join(names, "|").alias("attackers"), F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


R.oracle["ref_a29_set_valued"] = R.oracle["ref_a29_set_valued"].replace("array_to_string(list_sort(list_distinct(list(trim(attacker)) filter (where trim(attacker) <> ''))), '|')", "coalesce(string_agg(distinct trim(attacker), '|' order by trim(attacker)) filter (where trim(attacker) <> ''), '')")


@R.add("ref_a30_agreement_stats", """
select count(*) as validated, count(*) filter (where gemini_corrected = 0) as agreed, count(*) filter (where gemini_corrected = 1) as corrections,
round(count(*) filter (where gemini_corrected = 0) / count(*), 4) as agree_rate from feed_events where source = 'gemini'""")
def a30(t: Tables) -> DataFrame:
    from feedloom.serving import validation_stats

    return validation_stats(t.feed_events)


@R.add("ref_a31_floor_percent", "select match_id, 100 * count(*) filter (where trim(attacker) <> '') // count(*) as named_pct from match_kills group by 1")
def a31(t: Tables) -> DataFrame:
    return t.match_kills.groupBy("match_id").agg(F.expr("(100 * count_if(trim(attacker) <> '')) div count(1)").alias("named_pct"))


@R.add("ref_a32_variant_shares", """
with n as (select lower(regexp_replace(trim(attacker), '[^A-Za-z0-9]', '', 'g')) as k, trim(attacker) as variant, count(*) as seen from feed_events where trim(attacker) <> '' group by 1, 2)
select k, variant, seen, count(*) over (partition by k) as variants, round(seen / sum(seen) over (partition by k), 6) as share from n""")
def a32(t: Tables) -> DataFrame:
    rows = t.feed_events.select(F.trim("attacker").alias("variant")).where("variant <> ''")
    n = rows.groupBy(F.lower(F.regexp_replace("variant", "[^A-Za-z0-9]", "")).alias("k"), "variant").agg(F.count("*").alias("seen"))
    w = Window.partitionBy("k")
    return n.select("k", "variant", "seen", F.count("*").over(w).alias("variants"), F.round(F.col("seen") / F.sum("seen").over(w), 6).alias("share"))


_GAPS = """
with e as (select distinct id, lower(trim(streamer)) as key, timestamp as ts from feed_events where timestamp is not null and trim(streamer) <> ''),
f as (select *, case when ts - lag(ts) over (partition by key order by ts, id) <= interval {gap} second then 0 else 1 end as opens from e),
g as (select *, sum(opens) over (partition by key order by ts, id rows unbounded preceding) as n from f)
"""


@R.add("ref_a33_segments", _GAPS.format(gap=1800) + "select key, min(ts) as start_time, max(ts) as end_time, count(*) as events from g group by key, n")
def a33(t: Tables) -> DataFrame:
    from feedloom.operators.sessions import from_micros, local_sessions, usable_events

    s = local_sessions(usable_events(t.feed_events), 1_800_000_000)
    return s.select("key", from_micros("start_us").alias("start_time"), from_micros("end_us").alias("end_time"), "events")


@R.add("ref_a36_text_counts", "select raw_text, count(*) as n from feed_events where trim(attacker) = 'PaceBot_Meridian' and timestamp >= timestamp '2018-01-10' group by 1")
def a36(t: Tables) -> DataFrame:
    rows = t.feed_events.where(F.trim("attacker") == "PaceBot_Meridian").where("timestamp >= timestamp_ntz '2018-01-10 00:00:00'")
    return rows.groupBy("raw_text").agg(F.count("*").alias("n"))


@R.add("ref_a37_oversized_sessions", _GAPS.format(gap=90).replace("then 0 else 1 end as opens", "then 0 else 1 end as opens, epoch_us(ts) - epoch_us(lag(ts) over (partition by key order by ts, id)) as gap") + """
select key, min(ts) as start_time, count(*) as events, max(case when opens = 0 then gap end) as largest_gap,
array_to_string(list_slice(list_sort(list(case when opens = 0 then gap end) filter (where opens = 0), 'DESC'), 1, 5), ',') as top_gaps from g group by key, n having count(*) >= 60""")
def a37(t: Tables) -> DataFrame:
    from feedloom.operators.matches import oversized_sessions

    return oversized_sessions(t.feed_events, 90_000_000, 60)


_KILLS = "(select distinct id, match_id, timestamp as ts, lower(regexp_replace(coalesce(attacker, ''), '[^A-Za-z0-9]', '', 'g')) as a, lower(regexp_replace(coalesce(victim, ''), '[^A-Za-z0-9]', '', 'g')) as v from match_kills)"


@R.add("ref_w1_session_ordinals", _GAPS.format(gap=90) + "select id, n::bigint as session from g")
def w1(t: Tables) -> DataFrame:
    from feedloom.operators.matches import session_ordinals

    return session_ordinals(t.feed_events, 90_000_000).select("id", "session")


@R.add("ref_w2_kill_order", "select id, row_number() over (partition by match_id order by timestamp, id) as kill_order from (select distinct id, match_id, timestamp from match_kills)")
def w2(t: Tables) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy("timestamp", "id")
    return t.match_kills.select("id", "match_id", "timestamp").distinct().select("id", F.row_number().over(w).alias("kill_order"))


@R.add("ref_w3_largest_gap", f"""
with g as (select match_id, id, epoch_us(ts) - epoch_us(lag(ts) over (partition by match_id order by ts, id)) as gap from {_KILLS} where ts is not null)
select match_id, gap, id from (select *, row_number() over (partition by match_id order by gap desc, id) as rn from g where gap is not null) where rn = 1""")
def w3(t: Tables) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy("us", "id")
    rows = t.match_kills.select("id", "match_id", micros("timestamp").alias("us")).where("us is not null").distinct()
    gaps = rows.select("match_id", "id", (F.col("us") - F.lag("us").over(w)).alias("gap")).where("gap is not null")
    return gaps.groupBy("match_id").agg(F.max("gap").alias("gap"), F.min_by("id", F.struct(-F.col("gap"), "id")).alias("id"))


@R.add("ref_w4_stat_dedup", f"""
with k as (select * from {_KILLS} where ts is not null), l as (select id, epoch_us(ts) - epoch_us(lag(ts) over (partition by match_id, a, v order by ts, id)) as d from k) select id from l where d is null or d > 120000000""")
def w4(t: Tables) -> DataFrame:
    from feedloom.operators.matches import stat_dedup

    return stat_dedup(t.match_kills.where("timestamp is not null").select("id", "match_id", "timestamp", "attacker", "victim").distinct()).select("id")


@R.add("ref_w6_rank_page", "select player, row_number() over (order by elo - 2 * rd desc, player) as rank from player_ratings where matches_played >= 5 and elo is not null order by rank limit 50 offset 20")
def w6(t: Tables) -> DataFrame:
    rows = t.player_ratings.where("matches_played >= 5 and elo is not null").orderBy((F.col("elo") - 2 * F.col("rd")).desc(), "player").limit(70).select("player", (F.col("elo") - 2 * F.col("rd")).alias("s"))
    w = Window.orderBy(F.desc("s"), "player")  # over the 70 rows of the page's reach
    return rows.select("player", F.row_number().over(w).alias("rank")).where("rank > 20")


@R.add("ref_w7_top_by_confidence", """
with x as (select match_id, trim(attacker) as player, kill_order as o, 0 as slot, case when coalesce(attacker_conf, 0) = 0 then 0.5 else attacker_conf end as c from match_kills
union all select match_id, trim(victim), kill_order, 1, case when coalesce(victim_conf, 0) = 0 then 0.5 else victim_conf end from match_kills),
b as (select match_id, player, max(c) as c, min(o * 2 + slot) as first from x where player <> '' group by 1, 2)
select match_id, player from (select *, row_number() over (partition by match_id order by c desc, first, player) as rn from b) where rn <= 10""")
def w7(t: Tables) -> DataFrame:
    from feedloom.operators.matches import most_confident

    return most_confident(t.match_kills, 10)


@R.add("ref_w7_most_rated", """
with x as (select match_id, trim(attacker) as player, kill_order as o, 0 as slot, case when coalesce(attacker_conf, 0) = 0 then 0.5 else attacker_conf end as c from match_kills
union all select match_id, trim(victim), kill_order, 1, case when coalesce(victim_conf, 0) = 0 then 0.5 else victim_conf end from match_kills),
b as (select match_id, player, max(c) as c, min(o * 2 + slot) as first from x where player <> '' group by 1, 2)
select match_id, player from (select *, row_number() over (partition by match_id order by c desc, first, player) as rn from b) where rn <= 60""")
def w7b(t: Tables) -> DataFrame:
    """As ref_w7_top_by_confidence with the limit that ratings use."""
    from feedloom.operators.matches import most_confident
    from feedloom.operators.ratings import MOST_RATED

    return most_confident(t.match_kills, MOST_RATED)


@R.add("ref_w8_first_occurrence", "select trim(attacker) as player, min(id) as first_id from feed_events where trim(attacker) <> '' group by 1")
def w8(t: Tables) -> DataFrame:
    return t.feed_events.select(F.trim("attacker").alias("player"), "id").where("player <> ''").groupBy("player").agg(F.min("id").alias("first_id"))


@R.add("ref_w9_death_ordinal", "select id, row_number() over (partition by match_id, v order by ts, id) as death from (select distinct id, match_id, timestamp as ts, trim(victim) as v from match_kills where trim(victim) <> '')")
def w9(t: Tables) -> DataFrame:
    rows = t.match_kills.select("id", "match_id", "timestamp", F.trim("victim").alias("v")).where("v <> ''").distinct()
    return rows.select("id", F.row_number().over(Window.partitionBy("match_id", "v").orderBy("timestamp", "id")).alias("death"))


@R.add("ref_w10_row_gaps", f"""
select id, gap, coalesce(gap > 90000000, false) as marked from (select id, epoch_us(ts) - epoch_us(lag(ts) over (partition by match_id order by ts, id)) as gap from {_KILLS} where ts is not null)""")
def w10(t: Tables) -> DataFrame:
    rows = t.match_kills.select("id", "match_id", micros("timestamp").alias("us")).where("us is not null").distinct()
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("match_id").orderBy("us", "id"))
    return rows.select("id", gap.alias("gap")).select("id", "gap", F.coalesce(F.col("gap") > 90_000_000, F.lit(False)).alias("marked"))


@R.add("ref_w12_last_n", """
select player, id from (select player, id, row_number() over (partition by player order by id desc) as rn from (select distinct id, trim(attacker) as player from feed_events where trim(attacker) <> '')) where rn <= 20""")
def w12(t: Tables) -> DataFrame:
    rows = t.feed_events.select("id", F.trim("attacker").alias("player")).where("player <> ''").distinct()
    w = Window.partitionBy("player").orderBy(F.desc("id"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("player", "id")


@R.add("ref_w13_range_frame", """
select id, count(*) over (partition by key order by s range between 6 preceding and 6 following) as around from
(select distinct id, lower(trim(streamer)) as key, cast(floor(epoch_us(timestamp) / 1000000) as bigint) as s from feed_events where timestamp is not null and trim(streamer) <> '')""")
def w13(t: Tables) -> DataFrame:
    rows = timed(t).select("id", "key", F.floor(F.col("us") / 1_000_000).cast("long").alias("s"))
    return J.around(rows, "key", "s", 6).select("id", "around")


@R.add("ref_w14_latest", "select id, event_type from (select distinct id, event_type from feed_events order by id desc limit 30) order by id")
def w14(t: Tables) -> DataFrame:
    return _distinct_events(t, "event_type").orderBy(F.desc("id")).limit(30).orderBy("id")


QUERIES, ORACLE = R.queries, R.oracle
