"""Identity of names and scoring (F11-F20, F41, F46, J13, J18-J22, R11-R13, Q7, D2 of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import names as N
from feedloom.functions import similarity as S
from feedloom.functions import text as X
from feedloom.operators import evaluation as E
from feedloom.operators.sessions import micros
from feedloom.plans.functions import LABELS
from feedloom.plans.registry import Registry, Tables

R = Registry()


def _players(t: Tables) -> DataFrame:
    return t.player_ratings.select("player", "matches_played")


@R.add("ref_f11_default_labels")
def f11(t: Tables) -> DataFrame:
    return t.match_kills.select(F.trim("attacker").alias("name")).where("name <> ''").distinct().select("name", N.default_label("name", LABELS).alias("x")).select("name", "x.character", "x.number")


@R.add("ref_f12_same_identity")
def f12(t: Tables) -> DataFrame:
    pairs = t.account_merges.select(F.trim("canonical").alias("a"), F.trim("dup").alias("b")).where("a <> '' and b <> ''").distinct()
    return pairs.select("a", "b", N.same_identity("a", "b", LABELS).alias("same"))


@R.add("ref_f18_character_number", """
select distinct trim(victim) as name from match_kills where regexp_matches(lower(trim(victim)), '^(kestrel|bramble|bulwark|cinder|corsair|drift|ember|halcyon|harrow|lumen|mantis|marrow|osprey|pylon|quarry|rook|sable|thicket|tundra|vesper)[0-9]{4}$')""")
def f18(t: Tables) -> DataFrame:
    rules = X.TextRules(characters=LABELS)
    return t.match_kills.select(F.trim("victim").alias("name")).where(X.character_with_number("name", rules)).distinct()


@R.add("ref_f19_characters")
def f19(t: Tables) -> DataFrame:
    """Beginnings of names that are a character's name, misread or not."""
    names = t.match_kills.select(F.explode(F.array(F.trim("attacker"), F.trim("victim"))).alias("name")).where("name <> ''").distinct()
    tokens = names.select(F.explode(F.split(F.regexp_replace("name", "[0-9]+", " "), "[ _.-]+")).alias("token")).where("token <> ''").distinct()
    return tokens.select("token", N.character_of("token", {}, LABELS).alias("who")).where("who is not null")


@R.add("ref_r13_learned_typos")
def r13(t: Tables) -> DataFrame:
    """Words of names, read with a v for every u, that are a character's name misread and in no list yet."""
    names = t.match_kills.select(F.explode(F.array(F.trim("attacker"), F.trim("victim"))).alias("name")).where("name <> ''").distinct()
    words = F.explode(F.split(F.regexp_replace("name", "[0-9]+", " "), "[ _.-]+"))
    tokens = names.select(words.alias("token")).where("token <> ''").select(F.translate("token", "uU", "vV").alias("token"))
    return N.learn_typos(tokens, {"harow": "Harrow"}, LABELS)


_TAGLESS = "regexp_replace(lower(regexp_replace({}, '\\[[^\\]]*\\]', '', 'g')), '[^a-z0-9]', '', 'g')"


@R.add("ref_f46_equal_without_likeness", f"""
with p as (select distinct attacker as a, victim as v, {_TAGLESS.format('attacker')} as x, {_TAGLESS.format('victim')} as y from match_kills where attacker is not null and victim is not null)
select a as attacker, v as victim from p where x <> '' and y <> '' and (x = y or (length(x) >= 4 and length(y) >= 4 and (starts_with(x, y) or starts_with(y, x) or left(x, 5) = left(y, 5)))
or (regexp_replace(x, '[0-9]+$', '') <> '' and regexp_replace(x, '[0-9]+$', '') = regexp_replace(y, '[0-9]+$', '')))""")
def f46b(t: Tables) -> DataFrame:
    """Names of both sides that are equal across sources without asking for their likeness."""
    pairs = t.match_kills.select("attacker", "victim").where("attacker is not null and victim is not null").distinct()
    x, y = X.norm_untagged("attacker"), X.norm_untagged("victim")
    begins = (F.length(x) >= 4) & (F.length(y) >= 4) & (F.startswith(x, y) | F.startswith(y, x) | (F.substring(x, 1, 5) == F.substring(y, 1, 5)))
    same = (x == y) | begins | ((X.stem("attacker") != "") & (X.stem("attacker") == X.stem("victim")))
    return pairs.where((x != "") & (y != "") & same & N.tolerant_equal("attacker", "victim", across=True))


@R.add("ref_f46_tolerant_equal")
def f46(t: Tables) -> DataFrame:
    """Pairs of names that are equal up to a misreading, within one source and across two."""
    pairs = t.match_kills.select("attacker", "victim").where("attacker is not null and victim is not null").distinct()
    both = pairs.select("attacker", "victim", N.tolerant_equal("attacker", "victim").alias("within_source"), N.tolerant_equal("attacker", "victim", across=True).alias("across"))
    return both.where("within_source or across")


def _dictionary(t: Tables) -> DataFrame:
    return t.player_ratings.select(F.col("player").alias("canonical"), F.col("player").alias("variant"), F.col("matches_played").alias("seen"), (F.col("matches_played") > 20).alias("protected"))


@R.add("ref_r11_r13_resolved_names")
def r11(t: Tables) -> DataFrame:
    """Names of events looked up in the dictionary that the ratings make."""
    names = t.feed_events.select(F.explode(F.array(F.trim("attacker"), F.trim("victim"))).alias("name")).where("name <> ''")
    return N.resolve(names, _dictionary(t), characters=LABELS).select("name", "canonical", F.round("score", 6).alias("score"))


@R.add("ref_r11_recent_names")
def r11b(t: Tables) -> DataFrame:
    """Attackers in order of time, with the names of the last ten seconds before the dictionary."""
    rows = t.feed_events.where("timestamp is not null and trim(streamer) <> '' and trim(attacker) <> ''").select(
        F.lower(F.trim("streamer")).alias("key"), micros("timestamp").alias("us"), "id", F.trim("attacker").alias("name")
    ).distinct()
    resolved = N.resolve(rows.select("name"), _dictionary(t), characters=LABELS)
    return N.resolve_in_time(rows, resolved).select("id", "name", "canonical")


@R.add("ref_r12_promoted_variants", """
with n as (select lower(regexp_replace(trim(attacker), '[^A-Za-z0-9]', '', 'g')) as k, trim(attacker) as variant, count(*) as seen from feed_events where trim(attacker) <> '' group by 1, 2)
select k, variant as canonical from (select *, row_number() over (partition by k order by seen desc, variant) as rn from n where seen >= 3) where rn = 1""")
def r12(t: Tables) -> DataFrame:
    """The variant of each key seen most often, three times at least."""
    n = t.feed_events.select(F.trim("attacker").alias("variant")).where("variant <> ''").groupBy(F.lower(F.regexp_replace("variant", "[^A-Za-z0-9]", "")).alias("k"), "variant").agg(F.count("*").alias("seen"))
    return n.where("seen >= 3").groupBy("k").agg(F.min_by("variant", F.struct(-F.col("seen"), "variant")).alias("canonical"))


def _audit_pairs(t: Tables, least: float) -> DataFrame:
    """Pairs of names of one three-letter block with a ratio of ``least``; large blocks too (``prefix_pairs``)."""
    names = _players(t).where("matches_played >= 2").select(F.col("player").alias("text"), F.lower(F.substring("player", 1, 3)).alias("head"))
    pairs = S.prefix_pairs(names, least)
    return pairs.select("a", "b", S.ratio(F.lower("a"), F.lower("b")).alias("r")).where(F.col("r") >= least).select("a", "b", F.round("r", 6).alias("ratio"))


@R.add("ref_j18_blocked_pairs")
def j18(t: Tables) -> DataFrame:
    return _audit_pairs(t, 0.8)


@R.add("ref_j19_j20_review_pairs")
def j19(t: Tables) -> DataFrame:
    """All pairs of a ratio of 0.70 or more for a person to review, with the reason; those of 1 differ in letter case only (J20 has them, J19 not)."""
    from feedloom.operators.identity import pairs_at_least

    pairs = pairs_at_least(_players(t), 0.70)
    reason = F.when(F.lower(F.substring("a", 1, 3)) != F.lower(F.substring("b", 1, 3)), "different prefix").when(X.norm("a") == X.norm("b"), "same letters")
    reason = reason.when(X.stem("a") == X.stem("b"), "same stem").when(F.col("ratio") > 0.85, "very similar").otherwise("similar")
    return pairs.select("a", "b", F.round("ratio", 6).alias("ratio"), reason.alias("reason"))


def _truth_and_reads(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = t.matches.select("match_id", F.lower("streamer").alias("game"))
    truth = t.match_kills.where("timestamp is not null and trim(victim) <> ''").dropDuplicates(["id"]).join(m, "match_id")
    truth = truth.select("game", "id", micros("timestamp").alias("us"), F.trim("attacker").alias("attacker"), F.trim("victim").alias("victim"))
    e = t.feed_events.where("timestamp is not null and trim(streamer) <> ''").dropDuplicates(["id"])
    rows = e.select(F.lower(F.trim("streamer")).alias("game"), "id", micros("timestamp").alias("us"), F.trim("attacker").alias("attacker"), F.trim("victim").alias("victim"), "event_type", F.col("raw_text").alias("text"))
    return truth, rows.where("event_type = 'Kill' and victim <> ''"), rows


@R.add("ref_j21_q7_scores")
def q7(t: Tables) -> DataFrame:
    """Stored kills as truth against the kill events of each stream."""
    truth, reads, _ = _truth_and_reads(t)
    return E.scores(truth, reads)


@R.add("ref_j22_q7_misses")
def q7b(t: Tables) -> DataFrame:
    return E.misses(*_truth_and_reads(t))


_BANNERS = "(select match_id, kill_count || ' SQUADS LEFT - ' || players_observed || ' players' as r from matches union all select match_id, players_observed || ' squads' from matches)"


@R.add("ref_f41_squads", f"""
select match_id, r as banner, case when try_cast(nullif(regexp_extract(lower(r), '([0-9]{{1,2}})\\s*squads?', 1), '') as int) between 1 and 20 then cast(regexp_extract(lower(r), '([0-9]{{1,2}})\\s*squads?', 1) as int) end as squads,
case when try_cast(nullif(regexp_extract(lower(r), 'squads?.*?([0-9]{{1,2}})\\s*players?', 1), '') as int) between 1 and 60 then cast(regexp_extract(lower(r), 'squads?.*?([0-9]{{1,2}})\\s*players?', 1) as int) end as players from {_BANNERS}""")
def f41(t: Tables) -> DataFrame:
    """Banners about every match, with and without the number of players."""
    k, p = F.col("kill_count").cast("string"), F.col("players_observed").cast("string")
    texts = F.array(F.concat(k, F.lit(" SQUADS LEFT - "), p, F.lit(" players")), F.concat(p, F.lit(" squads")))
    rows = t.matches.select("match_id", F.explode(texts).alias("banner")).withColumn("x", X.squads_left("banner"))
    return rows.select("match_id", "banner", "x.squads", "x.players")


@R.add("ref_f58_name_status", """
select player, case when contains(lower(player), 'twitch') then 'overlay' when lower(player) in ('knocked', 'eliminated', 'squad') then 'system text' when regexp_matches(regexp_replace(lower(player), '[^a-z]', '', 'g'), '[bcdfghjklmnpqrstvwxz]{5,}') then 'mangled' else 'correct' end as status from player_ratings""")
def f58(t: Tables) -> DataFrame:
    low = F.lower("player")
    status = F.when(F.contains(low, F.lit("twitch")), "overlay").when(low.isin("knocked", "eliminated", "squad"), "system text")
    status = status.when(F.regexp_replace(low, "[^a-z]", "").rlike("[bcdfghjklmnpqrstvwxz]{5,}"), "mangled").otherwise("correct")
    return t.player_ratings.select("player", status.alias("status"))


@R.add("ref_d2_shape_filter", "select filename from crop_labels where label is not null and length(label) between 4 and 40 and regexp_full_match(label, '[A-Za-z0-9 _.<>\\[\\]-]*')")
def d2(t: Tables) -> DataFrame:
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 _.<>[]-"
    return t.crop_labels.where("label is not null and length(label) between 4 and 40").where(X.only_characters("label", letters)).select("filename")


QUERIES, ORACLE = R.queries, R.oracle
