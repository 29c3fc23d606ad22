"""Sources, sinks, state machines and looks back at stored rows (S, K, ST, W5, J28, F49-F56, Q8 of the inventory).

Queries of sources and sinks write to the shared folder, read back, and give what a reader sees.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.functions import hashes as H
from feedloom.functions import similarity as S
from feedloom.functions import text as X
from feedloom.operators import dedup as D
from feedloom.operators import evaluation as E
from feedloom.operators import matches as M
from feedloom.operators import quality as Q
from feedloom.operators import retro as RE
from feedloom.operators.sessions import micros
from feedloom.plans.functions import RULES
from feedloom.plans.names_eval import _truth_and_reads
from feedloom.plans.registry import Registry, Tables
from feedloom.plans.stateful import reads
from feedloom.session import fresh_path
from feedloom.sources import files as SRC
from feedloom.sources import sinks as K
from feedloom.streaming import states as ST

R = Registry()


# -- sources -----------------------------------------------------------------

_CSV = """
select trim(streamer) as streamer, date_trunc('second', timestamp) as timestamp, raw_text, event_type, nullif(trim(attacker), '') as attacker, nullif(trim(victim), '') as victim,
coalesce(attacker_conf, 0.5) as attacker_conf, coalesce(victim_conf, 0.5) as victim_conf from feed_events where timestamp is not null and trim(streamer) <> '' and event_type is not null and raw_text is not null"""


def _as_csv(t: Tables) -> str:
    path = fresh_path(t.spark, "legacy-csv")
    rows = t.feed_events.where("trim(streamer) <> '' and event_type is not null and raw_text is not null")
    at = F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    rows.select("victim", "streamer", at, "raw_text", "event_type", "attacker", "attacker_conf", "victim_conf").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@R.add("ref_s4_legacy_csv", _CSV)
def s4(t: Tables) -> DataFrame:
    """Events written as CSV in another order of columns and read back."""
    columns = ["streamer", "timestamp", "raw_text", "event_type", "attacker", "victim", "attacker_conf", "victim_conf"]
    return SRC.read_event_csv(t.spark, _as_csv(t)).select(*columns)


@R.add("ref_s5_import_csv", _CSV.replace("select trim(streamer)", "select 0 as gemini_corrected, 1 as read_count, '' as icon_vote, trim(streamer)"))
def s5(t: Tables) -> DataFrame:
    """The same CSV appended to an event table with its defaults."""
    path = fresh_path(t.spark, "imported")
    SRC.import_event_csv(t.spark, _as_csv(t), path)
    columns = ["gemini_corrected", "read_count", "icon_vote", "streamer", "timestamp", "raw_text", "event_type", "attacker", "victim", "attacker_conf", "victim_conf"]
    return t.spark.read.parquet(path).select(*columns)


@R.add("ref_s7_json_lines", "select epoch_us(timestamp) / 1e6 as t, id % 7 as ri, [id % 100, 2, 3, 4] as box, crop_filename as crop, raw_text as text from feed_events where timestamp is not null".replace("id % 7 as ri", "cast(id % 7 as int) as ri").replace("[id % 100, 2, 3, 4]", "array_to_string([id % 100, 2, 3, 4], ',')"))
def s7(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "json-lines")
    box = F.array((F.col("id") % 100).cast("int"), F.lit(2), F.lit(3), F.lit(4))
    rows = t.feed_events.where("timestamp is not null")
    rows.select((micros("timestamp") / 1e6).alias("t"), (F.col("id") % 7).cast("int").alias("ri"), box.alias("box"), F.col("crop_filename").alias("crop"), F.col("raw_text").alias("text")).write.json(path)
    return SRC.read_json_lines(t.spark, path, schemas.READS_JSON).withColumn("box", F.array_join("box", ","))


@R.add("ref_s8_rules_file", "select distinct id, replace(lower(raw_text), 'skull', 'kill') as line from feed_events where raw_text is not null")
def s8(t: Tables) -> DataFrame:
    """A typo table from a JSON file, applied to every line."""
    path = fresh_path(t.spark, "rules") + ".json"
    K.write_small_file(t.spark, json.dumps({"typos": {"skull": "kill"}}), path)
    rules = X.TextRules(**json.loads(K.read_small_file(t.spark, path)))
    return t.feed_events.where("raw_text is not null").select("id", X.fix_typos("raw_text", rules).alias("line")).distinct()


@R.add("ref_s12_probe", """
select * from (values ('feed_events', true, 'nickname'), ('matches', true, 'nickname,raw_text'), ('no_such_table', false, 'nickname,raw_text')) as v("table", "exists", missing)""")
def s12(t: Tables) -> DataFrame:
    """Which tables and columns are there, without reading them."""
    found = [(n, p := SRC.probe(t.spark, f"{t.folder}/{n}.parquet", ["nickname", "raw_text"])) for n in ("feed_events", "matches", "no_such_table")]
    return t.spark.createDataFrame([(n, p["exists"], ",".join(p["missing"])) for n, p in found], "table string, exists boolean, missing string")


@R.add("ref_s16_scraped_board", "select cast(row_number() over (order by elo desc, player) as int) as rank, player as name, cast(round(elo * 10) as bigint) as points from player_ratings where elo is not null and not contains(player, '  ')")
def s16(t: Tables) -> DataFrame:
    """Pages of a board, made of the ratings by fifties, scraped back into rows."""
    ranked = _ranked(t)
    escaped = F.replace(F.replace("player", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.concat(F.lit("<tr><td>#"), F.col("rank").cast("string"), F.lit("</td><td><b>"), escaped, F.lit("</b></td><td>"), F.format_number("points", 0), F.lit("</td></tr>"))
    pages = ranked.groupBy(F.floor((F.col("rank") - 1) / 50).alias("page_id")).agg(
        F.concat(F.lit("<table>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("h")))), lambda x: x["h"]), ""), F.lit("</table>")).alias("html")
    )
    return SRC.scrape_board(pages)


def _ranked(t: Tables) -> DataFrame:
    """Ratings with their rank: one count a range of strength is ordered in one place."""
    from pyspark.sql import Window

    rows = t.player_ratings.where("elo is not null").where(~F.contains("player", F.lit("  ")))
    band = rows.withColumn("band", -F.floor(F.col("elo") / 10))
    sizes = band.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("band", (F.sum("n").over(Window.orderBy("band")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("elo"), "player"))
    ranked = band.withColumn("k", inside).join(F.broadcast(before), "band")
    return ranked.select((F.col("before") + F.col("k")).cast("int").alias("rank"), "player", F.round(F.col("elo") * 10).cast("long").alias("points"))


@R.add("ref_s17_fresh_board", "select * from (values (1, 'written'), (2, 'fresh'), (3, 'refused'), (4, 'written')) as v(step, outcome)")
def s17(t: Tables) -> DataFrame:
    """A board written, left alone while it is fresh, kept when the new one is too short, and written again."""
    import time

    path, now = fresh_path(t.spark, "board"), int(time.time() * 1000)
    board, day = lambda: t.player_ratings.select("player", "elo"), 24 * 3_600_000
    steps = [
        SRC.refresh_board(t.spark, path, board, now, "20180101", least_rows=20), SRC.refresh_board(t.spark, path, board, now, "20180102", least_rows=20),
        SRC.refresh_board(t.spark, path, board, now + 3 * day, "20180104", least_rows=10**9), SRC.refresh_board(t.spark, path, board, now + 3 * day, "20180104", least_rows=20),
    ]
    return t.spark.createDataFrame(list(enumerate(steps, 1)), "step int, outcome string")


# -- sinks -------------------------------------------------------------------


@R.add("ref_k1_k2_folded_reads", """
select count(distinct id) as rows, sum(r)::bigint as reads from (select id, max(read_count) as r from feed_events where timestamp is not null and trim(streamer) <> ''
and not (event_type in ('Kill', 'BleedOut') and coalesce(trim(attacker), '') = '' and coalesce(trim(victim), '') = '') group by id)""")
def k2(t: Tables) -> DataFrame:
    """Suppression loses no row and no read: what the kept rows count adds up."""
    folded = D.fold_reads(D.dedup_events(reads(t)))
    return folded.agg(F.sum("rows").alias("rows"), F.sum("read_count").alias("reads"))


@R.add("ref_k3_replaced_matches", """
select match_id, case when kill_count >= 20 then kill_count + 1 else kill_count end as kill_count from matches""")
def k3(t: Tables) -> DataFrame:
    """The rows of large matches replaced twice, which changes nothing the second time."""
    base = t.matches.select("match_id", "kill_count")
    new = base.where("kill_count >= 20").withColumn("kill_count", F.col("kill_count") + 1)
    return K.replace_matches(K.replace_matches(base, new), new).select("match_id", F.col("kill_count").cast("int").alias("kill_count"))


@R.add("ref_k5_upserted_ratings", """
select player, case when matches_played >= 10 then 1500.0 else elo end as elo, case when matches_played >= 10 then greatest(peak_elo, 1200.0) else peak_elo end as peak_elo from player_ratings""")
def k5(t: Tables) -> DataFrame:
    """Ratings of known players set anew; a peak never falls."""
    base = t.player_ratings.select("player", "elo", "peak_elo")
    new = t.player_ratings.where("matches_played >= 10").select("player", F.lit(1500.0).alias("elo"), F.lit(1200.0).alias("peak_elo"))
    return K.upsert(base, new, ["player"], keep_larger=("peak_elo",))


@R.add("ref_k4_k6_k8_k9_published", "select distinct match_id, player, kill_order_out from match_placements where player is not null")
def k9(t: Tables) -> DataFrame:
    """Placements published, dropped with all versions, recreated and published again: readers see the last version."""
    path = fresh_path(t.spark, "published")
    rows = t.match_placements.where("player is not null").select("match_id", "player", "kill_order_out").distinct()
    K.publish(rows.where("kill_order_out = 1"), path)
    K.drop_table(t.spark, path)
    K.publish(rows.limit(0), path)
    K.publish(rows, path)
    return K.published(t.spark, path)


@R.add("ref_k10_cache", "select * from (values ('a', '1'), ('b', '[2, 3]')) as v(key, value)")
def k10(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "cache") + ".json"
    for key, value in (("a", 0), ("b", [2, 3]), ("a", 1)):
        K.update_cache(t.spark, path, key, value)
    cache = json.loads(K.read_small_file(t.spark, path))
    return t.spark.createDataFrame([(k, json.dumps(v)) for k, v in cache.items()], "key string, value string")


@R.add("ref_k11_backup", "select 'now' as which, count(*) as rows from player_ratings union all select 'backup', count(*) from player_ratings where matches_played >= 5")
def k11(t: Tables) -> DataFrame:
    """A CSV written over an older one, which stays beside it under its day."""
    path = fresh_path(t.spark, "board-csv")
    K.write_csv_with_backup(t.player_ratings.where("matches_played >= 5").select("player", "elo"), path, "20180101")
    backup = K.write_csv_with_backup(t.player_ratings.select("player", "elo"), path, "20180102")
    rows = lambda p, n: t.spark.read.option("header", True).csv(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("which"), "rows")
    return rows(path, "now").unionByName(rows(backup, "backup"))


@R.add("ref_k12_report", """
select '| ' || coalesce(event_type, '') || ' | ' || count(*) || ' |' as line from feed_events group by event_type""")
def k12(t: Tables) -> DataFrame:
    """A Markdown report of the kinds of events; its rows."""
    text = K.markdown_report(t.feed_events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type"), "Events")
    return t.spark.createDataFrame([(x,) for x in text.splitlines()[4:]], "line string")


@R.add("ref_k13_reparsed")
def k13(t: Tables) -> DataFrame:
    """The event table with its parsed columns made anew from the texts."""
    from feedloom.functions.lines import parse_lines

    rows = t.feed_events.select("id", "raw_text", "canonical", "event_type", "attacker", "victim").distinct()
    return K.reparsed(rows, lambda r, c: parse_lines(r, c, RULES)).select("id", "event_type", "attacker", "victim")


@R.add("ref_k14_k15_maintained", """
select id, case event_type when 'Ping' then 'Mark' else event_type end as event_type from feed_events where read_count <= 3""")
def k14(t: Tables) -> DataFrame:
    """Rows read often deleted by id, and one kind renamed."""
    goes = t.feed_events.where("read_count > 3").select("id").distinct()
    kept = K.delete_ids(t.feed_events.select("id", "event_type", "read_count"), goes)
    return K.rename_values(kept, ["event_type"], {"Ping": "Mark"}).where("read_count <= 3").select("id", "event_type")


@R.add("ref_k16_deleted_entries", """
select player as name from player_ratings where not ((coalesce(matches_played < 3, false) or coalesce(total_kills < 2, false)) and not coalesce(elo > 1100, false)) and player <> 'PaceBot_Meridian'""")
def k16(t: Tables) -> DataFrame:
    """Dictionary entries seen too rarely or too long ago deleted, unless protected, and one by its name."""
    entries = t.player_ratings.select(
        F.col("player").alias("name"), F.col("matches_played").alias("total_seen"), F.col("total_kills").cast("double").alias("last_seen"), (F.col("elo") > 1100).alias("protected")
    )
    return K.delete_where(entries, least_seen=3, last_seen_before=2.0, names=["PaceBot_Meridian"]).select("name")


@R.add("ref_k17_merged_dictionaries", """
with a as (select trim(attacker) as name, count(*) as n from feed_events where trim(attacker) <> '' group by 1), v as (select trim(victim) as name, count(*) as n from feed_events where trim(victim) <> '' group by 1)
select coalesce(a.name, v.name) as name, cast(coalesce(a.n, 0) + coalesce(v.n, 0) as int) as total_seen, cast(coalesce(a.n, 0) + coalesce(v.n, 0) as int) as of_variant from a full join v on a.name = v.name""")
def k17(t: Tables) -> DataFrame:
    """The dictionaries of attackers and of victims as one."""

    def entries(c: str) -> DataFrame:
        n = t.feed_events.select(F.trim(c).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("total_seen"))
        return n.select("name", F.create_map("name", "total_seen").alias("variants"), "total_seen", F.lit(0.0).alias("last_seen"), F.lit(False).alias("protected"))

    both = SRC.player_dictionary_update(entries("attacker"), entries("victim"))
    return both.select("name", F.col("total_seen").cast("int").alias("total_seen"), F.col("variants")[F.col("name")].cast("int").alias("of_variant"))


# -- state machines ----------------------------------------------------------

_DAY = "with e as (select distinct id, lower(trim(streamer)) || '|' || cast(timestamp as date) as key, epoch_us(timestamp) as us, event_type, read_count from feed_events where timestamp is not null and trim(streamer) <> '')"


def _days(t: Tables) -> DataFrame:
    """Rows of a streamer's day."""
    rows = t.feed_events.where("timestamp is not null and trim(streamer) <> ''")
    key = F.concat_ws("|", F.lower(F.trim("streamer")), F.col("timestamp").cast("date").cast("string"))
    return rows.select("id", key.alias("key"), micros("timestamp").alias("us"), "event_type", "read_count").distinct()


@R.add("ref_st7_streaks", _DAY + """
, s as (select *, sum(case when event_type = 'Kill' then 0 else 1 end) over (partition by key order by us, id rows unbounded preceding) as n from e)
select id, event_type = 'Kill' and count(*) filter (where event_type = 'Kill') over (partition by key, n order by us, id rows unbounded preceding) >= 5 as streak from s""")
def st7(t: Tables) -> DataFrame:
    """Whether a row is at least the fifth kill in a row of a streamer's day."""
    rows = _days(t).withColumn("hit", F.coalesce(F.col("event_type") == "Kill", F.lit(False)))
    return ST.run_ordered(rows, "key", ["us", "id"], "hit", ST.Streak, ST.streak_step, "streak", "boolean").select("id", "streak")


@R.add("ref_st8_saved_hashes")
def st8(t: Tables) -> DataFrame:
    """Which rows would save a crop: no crop saved in the last 30 seconds has a hash within eight bits."""
    rows = _days(t).withColumn("seen", F.struct("us", F.xxhash64(F.col("read_count") % 3).alias("hash")))
    step = lambda s, v: ST.hash_step(s, v["us"], v["hash"])
    return ST.run_ordered(rows, "key", ["us", "id"], "seen", ST.Hashes, step, "saved", "boolean").select("id", "saved")


@R.add("ref_st9_recent_names")
def st9(t: Tables) -> DataFrame:
    """Attackers of a streamer's day by the most similar name of the last ten seconds."""
    names = t.feed_events.select("id", F.trim("attacker").alias("name")).where("name <> ''").distinct()
    rows = _days(t).join(names, "id").withColumn("seen", F.struct("us", "name"))
    step = lambda s, v: ST.recent_step(s, v["us"], v["name"])
    return ST.run_ordered(rows, "key", ["us", "id", "name"], "seen", ST.RecentNames, step, "canonical", "string").select("id", "name", "canonical")


def _of_matches(t: Tables) -> DataFrame:
    return t.matches.where("start_time is not null and trim(streamer) <> ''").select("match_id", F.lower(F.trim("streamer")).alias("key"), micros("start_time").alias("us"), "kill_count", "players_observed")


@R.add("ref_st14_zones")
def st14(t: Tables) -> DataFrame:
    """Zones proposed match by match, confirmed by two agreeing in a row."""
    rows = _of_matches(t).withColumn("zone", F.array(F.col("kill_count") / 100.0, F.col("players_observed") / 50.0))
    return ST.run_ordered(rows, "key", ["us", "match_id"], "zone", ST.Proposal, ST.proposal_step, "confirmed", "array<double>").select("match_id", F.array_join(F.col("confirmed").cast("array<string>"), ",").alias("confirmed"))


@R.add("ref_r18_squads")
def r18(t: Tables) -> DataFrame:
    """Smoothed numbers of squads, read match by match."""
    rows = _of_matches(t).withColumn("squads", (F.col("kill_count") % 21).cast("int"))
    return ST.run_ordered(rows, "key", ["us", "match_id"], "squads", ST.Squads, ST.squads_step, "shown", "int").select("match_id", "squads", "shown")


@R.add("ref_st6_seeded_dedup")
def st6(t: Tables) -> DataFrame:
    """Kept rows when new chains count the kept rows of the half hour before as their own."""
    return D.fold_reads(D.dedup_events(reads(t), D.DedupRules(seed_us=1_800 * D.S, guard_victims=True))).select("id", "key", "event_type", "attacker", "victim", "read_count", "rows")


# -- looks back --------------------------------------------------------------


@R.add("ref_w5_exact_chains")
def w5(t: Tables) -> DataFrame:
    """Stored rows of equal names in chains with their place and whether they stay."""
    return RE.exact_chains(reads(t)).select("id", "place", "kept")


@R.add("ref_st5b_retro_chains")
def st5b(t: Tables) -> DataFrame:
    """What three clean-ups of stored rows would delete."""
    rows = reads(t).where("attacker is not null and victim is not null")
    out = D.dedup_variants(rows, {"by type": RE.RETRO, "all types": RE.RETRO_MERGED, "drifting": RE.RETRO_DRIFTING})
    return out.groupBy("variant").agg(F.count("*").alias("rows"), F.count_if(F.col("id") != F.col("kept_id")).alias("deleted"))


@R.add("ref_j28_residual_jitter")
def j28(t: Tables) -> DataFrame:
    """Rows that survive the clean-up although one side is the same and the other a misreading, and what they tie together."""
    rated = reads(t).where("event_type in ('Kill', 'BleedOut') and attacker is not null and victim is not null")
    kept = D.dedup_events(rated, RE.RETRO).where("id = kept_id").select("key", "id", "us", "attacker", "victim")
    pairs, clusters = RE.residual_jitter(kept)
    n = lambda df, what, c: df.agg(F.coalesce(c, F.lit(0)).cast("long").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(pairs, "pairs", F.count(F.lit(1))).unionByName(n(clusters, "clusters", F.count(F.lit(1)))).unionByName(n(clusters, "excess_rows", F.sum(F.col("rows") - 1)))


@R.add("ref_q8_replay_scores")
def q8(t: Tables) -> DataFrame:
    """Suppression against the stored kills as truth."""
    truth, kills, _ = _truth_and_reads(t)
    as_reads = kills.select(F.col("game").alias("key"), "id", "us", F.lit("Kill").alias("event_type"), "attacker", "victim", F.lit(1).cast("long").alias("reads"))
    kept = D.dedup_events(as_reads).where("id = kept_id").select("id")
    return Q.replay_scores(truth, kills, kept)


@R.add("ref_r2b_matches_from_rows", """
with e as (select distinct lower(trim(streamer)) as key, date_trunc('second', timestamp) as ts, trim(attacker) as a, trim(victim) as v from feed_events
where timestamp is not null and trim(streamer) <> '' and event_type = 'Kill' and (trim(attacker) <> '' or trim(victim) <> '')),
f as (select *, case when ts - lag(ts) over (partition by key order by ts) <= interval 90 second then 0 else 1 end as opens from e),
g as (select *, sum(opens) over (partition by key order by ts rows unbounded preceding) as n from f)
select key as streamer, min(ts) as start_time, max(ts) as end_time, count(*) as kills from g group by key, n having count(*) >= 3""")
def r2b(t: Tables) -> DataFrame:
    """Sessions of kills that a legacy file holds, three kills at least, before they are split."""
    return M.sessions_of_rows(_legacy_kills(t)).select("streamer", "start_time", "end_time", "kills")


def _legacy_kills(t: Tables) -> DataFrame:
    rows = t.feed_events.where("timestamp is not null and trim(streamer) <> '' and event_type = 'Kill' and (trim(attacker) <> '' or trim(victim) <> '')")
    return rows.select(F.lower(F.trim("streamer")).alias("key"), F.date_trunc("second", "timestamp").alias("ts"), F.trim("attacker").alias("a"), F.trim("victim").alias("v")).distinct()


@R.add("ref_r2b_split_matches")
def r2c(t: Tables) -> DataFrame:
    """The same sessions split where they are too long or have too many players; parts of fewer than three kills go."""
    return M.matches_of_rows(_legacy_kills(t))


# -- functions ---------------------------------------------------------------


@R.add("ref_f14_guarded_victims")
def f14(t: Tables) -> DataFrame:
    """Neighbouring victims of a match: whether the guard takes them for two players."""
    from pyspark.sql import Window

    order = Window.partitionBy("match_id").orderBy("kill_order", "id")
    rows = t.match_kills.where("trim(victim) <> ''").select("match_id", "id", X.norm("victim").alias("v"), F.lag(X.norm("victim")).over(order).alias("before")).where("before is not null")
    pairs = rows.select("v", "before").distinct()

    @F.pandas_udf("boolean")
    def other(v, before):
        import pandas as pd

        return pd.Series([S.other_player_of_one_line(a, [b]) for a, b in zip(v, before)])

    return pairs.select("v", "before", other("v", "before").alias("other_player"))


_BOXES = "(select lower(trim(streamer)) as s, (kill_count % 40) / 100.0 as x0, (players_observed % 30) / 100.0 as y0, (kill_count % 40 + 30) / 100.0 as x1, (players_observed % 30 + 5) / 100.0 as y1 from matches where trim(streamer) <> '')"


@R.add("ref_f49_zones", f"""
with b as {_BOXES}, z as (select s, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b where y0 <= 0.26 group by s), c as (select s, x0, y0, x1, least(y1, y0 + 0.24) as y1 from z),
f as (select c.s, min(b.x0) as x0, min(b.y0) as y0, max(b.x1) as x1, max(b.y1) as y1 from c join b on b.s = c.s and b.x0 >= c.x0 and b.y0 >= c.y0 and b.x1 <= c.x1 and b.y1 <= c.y1 group by c.s),
n as (select c.s, coalesce(greatest(c.x0, f.x0 - 0.02), c.x0) as x0, coalesce(greatest(c.y0, f.y0 - 0.02), c.y0) as y0, coalesce(least(c.x1, f.x1 + 0.02), c.x1) as x1, coalesce(least(c.y1, f.y1 + 0.02), c.y1) as y1, c.y1 as old from c left join f on f.s = c.s)
select s, round(x0, 6)::double as x0, round(y0, 6)::double as y0, round(x1, 6)::double as x1, round(greatest(y1, least(old, y0 + 0.04)), 6)::double as y1 from n""")
def f49(t: Tables) -> DataFrame:
    """Zones of boxes made up from the matches, derived and drawn in."""
    k, p = F.col("kill_count"), F.col("players_observed")
    boxes = t.matches.where("trim(streamer) <> ''").select(
        F.lower(F.trim("streamer")).alias("s"), (k % 40 / 100).alias("x0"), (p % 30 / 100).alias("y0"), ((k % 40 + 30) / 100).alias("x1"), ((p % 30 + 5) / 100).alias("y1")
    )
    zone = E.tighten_zone(E.derive_zone(boxes, "s"), boxes, "s")
    return zone.select("s", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


_MARKS = "<[^>]*>|\\[[^\\]]*\\]"


@R.add("ref_d4_zipped_boxes", f"""
with l as (select filename, list_filter(list_transform(regexp_split_to_array(label, '{_MARKS}'), lambda w: regexp_replace(w, '^[ ]+|[ ]+$', '', 'g')), lambda w: w <> '') as words, range(1, 2 + length(filename || label) % 3) as boxes from crop_labels where label is not null),
e as (select filename, words, boxes from l where len(words) = len(boxes))
select filename, (p - 1)::int as place, words[p] as word, boxes[p]::int as box from (select filename, words, boxes, unnest(range(1, len(words) + 1)) as p from e)""")
def d4b(t: Tables) -> DataFrame:
    """Parts of labels around their markers with as many numbered boxes; labels with another number of boxes are left out."""
    boxes = F.sequence(F.lit(1), F.lit(1) + F.length(F.concat("filename", "label")) % 3)
    rows = t.crop_labels.where("label is not null").select("filename", F.explode(X.zip_words("label", boxes, _MARKS)).alias("x"))
    return rows.select("filename", F.col("x.place").cast("int").alias("place"), "x.word", F.col("x.box").cast("int").alias("box"))


@R.add("ref_q11_two_line_rate", f"""
select streamer, count(*) as crops, count(*) filter (where len(regexp_extract_all(label, '{_MARKS}')) >= 2) as two_lines,
case when 100.0 * count(*) filter (where len(regexp_extract_all(label, '{_MARKS}')) >= 2) / count(*) > 2.0 then 'warn' else 'ok' end as status from crop_labels where label is not null and label <> 'EMPTY' group by streamer""")
def q11(t: Tables) -> DataFrame:
    """Crops that show two lines in one, by their labels' markers, against a limit of two per cent."""
    two = X.marker_count("label", _MARKS) >= 2
    rows = t.crop_labels.where("label is not null and label <> 'EMPTY'").groupBy("streamer").agg(F.count(F.lit(1)).alias("crops"), F.count_if(two).alias("two_lines"))
    return rows.select("streamer", "crops", "two_lines", F.when(100.0 * F.col("two_lines") / F.col("crops") > 2.0, "warn").otherwise("ok").alias("status"))


@R.add("ref_j23_live_coverage", """
with e as (select distinct id, lower(trim(streamer)) as key, epoch_us(timestamp) as us, event_type from feed_events where timestamp is not null and trim(streamer) <> '')
select a.key, a.id as anchor, b.id as hit from e a join e b on b.key = a.key and b.event_type = 'BleedOut' and b.us between a.us - 10000000 and a.us + 9000000 where a.event_type = 'Knock'""")
def j23(t: Tables) -> DataFrame:
    """Bleed-outs around knocks by a stream-stream join, run until it has seen all of the table."""
    from feedloom.streaming.live import coverage

    source, out, state = (fresh_path(t.spark, x) for x in ("coverage-in", "coverage-out", "coverage-state"))
    rows = t.feed_events.where("timestamp is not null and trim(streamer) <> '' and event_type in ('Knock', 'BleedOut')")
    rows.select("id", F.lower(F.trim("streamer")).alias("key"), F.col("timestamp").cast("timestamp").alias("ts"), "event_type").distinct().write.parquet(source)
    events = t.spark.readStream.schema("id long, key string, ts timestamp, event_type string").parquet(source)
    pairs = coverage(events.where("event_type = 'Knock'"), events.where("event_type = 'BleedOut'"), lateness="60 days")
    pairs.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("key string, anchor long, hit long, at timestamp, hit_at timestamp").parquet(out).select("key", "anchor", "hit")


@R.add("ref_st15_folded_stream", """
select sum(r)::bigint as reads from (select id, max(read_count) as r from feed_events where timestamp is not null and trim(streamer) <> '' and event_type = 'Knock' group by id)""")
def st15(t: Tables) -> DataFrame:
    """Suppression as a stream whose batches are folded into a published table: no read is lost on the way."""
    from feedloom.sources.sinks import published
    from feedloom.streaming.live import fold_into

    source, table, state = (fresh_path(t.spark, x) for x in ("fold-in", "fold-table", "fold-state"))
    rows = reads(t).where("event_type = 'Knock'").withColumn("ts", F.timestamp_micros("us"))
    last = rows.agg(F.max("us").alias("us")).select(
        F.lit("end").alias("key"), F.lit(-1).cast("long").alias("id"), (F.col("us") + 10**13).alias("us"), F.lit("Knock").alias("event_type"),
        F.lit(None).cast("string").alias("attacker"), F.lit(None).cast("string").alias("victim"), F.lit(0).cast("long").alias("reads"),
    )  # a late row that moves the watermark past all others
    rows.coalesce(1).write.parquet(source)
    last.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(source)
    last.withColumn("id", F.lit(-2).cast("long")).withColumn("us", F.col("us") + 10**13).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "60 days")
    query = D.stream_dedup(stream).writeStream.foreachBatch(fold_into(table)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return published(t.spark, table).where("key <> 'end'").agg(F.sum("reads").alias("reads"))


@R.add("ref_f52_hashes")
def f52(t: Tables) -> DataFrame:
    """Perceptual hashes of the embeddings taken as images of eight by eight."""
    return t.embeddings.select("vec_id", H.average_hash("embedding").alias("average"), H.difference_hash("embedding").alias("difference"), H.frequency_hash("embedding").alias("frequency"))


@R.add("ref_f52_average_hash_bits", """
select vec_id, array_to_string(list_transform(embedding, lambda x: case when x > list_avg(embedding::double[]) then '1' else '0' end), '') as bits from embeddings""")
def f52b(t: Tables) -> DataFrame:
    """The average hash as bits."""
    bits = F.lpad(F.bin(H.average_hash("embedding")), 64, "0")
    return t.embeddings.select("vec_id", bits.alias("bits"))


@R.add("ref_f56_safe_paths", """
select distinct path, regexp_full_match(path, '[A-Za-z0-9_\\-][A-Za-z0-9_.\\-/]*') and not contains(path, '..') as safe from
(select filepath as path from crop_labels union all select '../' || filepath from crop_labels union all select '/' || filepath from crop_labels union all select filepath || '%00' from crop_labels) where path is not null""")
def f56(t: Tables) -> DataFrame:
    """Paths of crops, and made unsafe in three ways."""
    p = F.col("filepath")
    paths = t.crop_labels.select(F.explode(F.array(p, F.concat(F.lit("../"), p), F.concat(F.lit("/"), p), F.concat(p, F.lit("%00")))).alias("path"))
    return paths.where("path is not null").distinct().select("path", X.safe_path("path").alias("safe"))


@R.add("api_crop", "select filename, streamer, filepath from crop_labels where filepath = (select min(filepath) from crop_labels where regexp_full_match(filepath, '[A-Za-z0-9_\\-][A-Za-z0-9_.\\-/]*'))")
def crop(t: Tables) -> DataFrame:
    """The first crop by path, as the endpoint serves it."""
    from feedloom.serving import crop_files

    first = t.crop_labels.where(X.safe_path("filepath")).agg(F.min("filepath")).first()[0]
    return crop_files(t.crop_labels, first or "")


QUERIES, ORACLE = R.queries, R.oracle
