"""Scalar functions, label and quality queries (F, Q, D of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import fixed as V
from feedloom.functions import lines as L
from feedloom.functions import similarity as S
from feedloom.functions import text as X
from feedloom.operators.quality import (
    STAGE_LIMITS, Invariant, grade_stages, reading_accuracy, run_invariants, settings_metrics, stage_limits, stage_metrics, stage_report,
)
from feedloom.plans.registry import Registry, Tables

R = Registry()
#: Names of the default labels in the test tables.
LABELS = ["Kestrel", "Bramble", "Bulwark", "Cinder", "Corsair", "Drift", "Ember", "Halcyon", "Harrow", "Lumen", "Mantis", "Marrow", "Osprey", "Pylon", "Quarry", "Rook", "Sable", "Thicket", "Tundra", "Vesper"]
#: What stands between two names in the texts of the test tables.
MARKER = r"<[^>]*>|\[[^\]]*\]|(?:(?<=\s)x)?>[->]*|-+>|\b(?:(?:gun|kill)icon|eliminated|knocked(?: down)?|killed|down(?:ed)?|cracked|picked up)\b"
RULES = X.TextRules(
    typos={"eliminatad": "eliminated", "knoeked": "knocked"}, common_words=["knocked", "eliminated"], weapons=["R-44", "longshot"], characters=LABELS, marker=MARKER
)

_E = "(select distinct id, attacker as a, victim as v, raw_text as r, canonical as c from feed_events)"
_NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


def events(t: Tables) -> DataFrame:
    return t.feed_events.select("id", F.col("attacker").alias("a"), F.col("victim").alias("v"), F.col("raw_text").alias("r"), F.col("canonical").alias("c")).distinct()


@R.add("ref_f2_levenshtein", f"select id, levenshtein(lower(r), lower(c)) as edits from {_E} where r is not null and c is not null")
def f2(t: Tables) -> DataFrame:
    return events(t).where("r is not null and c is not null").select("id", F.levenshtein(F.lower("r"), F.lower("c")).cast("long").alias("edits"))


R.oracle["ref_f2_levenshtein"] = R.oracle["ref_f2_levenshtein"].replace("levenshtein(lower(r), lower(c))", "levenshtein(lower(r), lower(c))::bigint")


@R.add("ref_f1_ratio")
def f1(t: Tables) -> DataFrame:
    """Ratcliff-Obershelp ratio of attacker and victim, over distinct pairs."""
    pairs = t.match_kills.select("attacker", "victim").where("attacker is not null and victim is not null").distinct()
    return pairs.select("attacker", "victim", F.round(S.ratio(F.lower("attacker"), F.lower("victim")), 6).alias("ratio"))


@R.add("ref_f3_word_edits")
def f3(t: Tables) -> DataFrame:
    rows = events(t).where("r is not null and c is not null").select("r", "c").distinct()
    return rows.select("r", "c", S.word_levenshtein(F.split(F.lower("r"), " "), F.split("c", " ")).alias("edits"))


@R.add("ref_f4_confusions")
def f4(t: Tables) -> DataFrame:
    """How often each character was read for another one, over labelled crops."""
    label = t.crop_labels.where("label is not null and label <> 'EMPTY'").select(F.col("filename").alias("crop_filename"), "label")
    pairs = t.feed_events.select(F.trim("crop_filename").alias("crop_filename"), "raw_text").where("raw_text is not null").distinct().join(label, "crop_filename")
    return pairs.select(F.inline(S.confusions(F.lower("label"), F.lower("raw_text")))).groupBy("kind", "truth", "read").agg(F.count("*").alias("n"))


@R.add("ref_f5_norm", f"select id, {_NORM.format('a')} as norm from {_E} where a is not null")
def f5(t: Tables) -> DataFrame:
    return events(t).where("a is not null").select("id", X.norm("a").alias("norm"))


@R.add("ref_f6_f7_stem", f"""
select id, {_NORM.format("regexp_replace(a, '\\[[^\\]]*\\]', '', 'g')")} as norm, regexp_replace({_NORM.format("regexp_replace(a, '\\[[^\\]]*\\]', '', 'g')")}, '[0-9]+$', '') as stem from {_E} where a is not null""")
def f6(t: Tables) -> DataFrame:
    return events(t).where("a is not null").select("id", X.norm_untagged("a").alias("norm"), X.stem("a").alias("stem"))


@R.add("ref_f8_signature", f"select id, coalesce({_NORM.format('a')}, '') || '|' || coalesce({_NORM.format('v')}, '') as sig from {_E}")
def f8(t: Tables) -> DataFrame:
    return events(t).select("id", X.line_signature("a", "v").alias("sig"))


@R.add("ref_f9_digits", f"select id, regexp_replace(a, '[^0-9]', '', 'g') as digits, regexp_replace(a, '[0-9]', '', 'g') as rest from {_E} where a is not null")
def f9(t: Tables) -> DataFrame:
    return events(t).where("a is not null").select("id", X.digits("a").alias("digits"), X.not_digits("a").alias("rest"))


@R.add("ref_f10_confusion_key")
def f10(t: Tables) -> DataFrame:
    return t.player_ratings.select("player", X.confusion_key("player").alias("key"))


@R.add("ref_f13_digit_conflict")
def f13(t: Tables) -> DataFrame:
    pairs = t.account_merges.select(F.trim("canonical").alias("x"), F.trim("dup").alias("y")).where("x <> '' and y <> ''").distinct()
    return pairs.select("x", "y", S.digit_conflict(F.col("x"), F.col("y")).alias("conflict"))


@R.add("ref_f15_length_bound", "select distinct attacker, victim from match_kills where 2 * least(length(attacker), length(victim)) >= 0.85 * (length(attacker) + length(victim))")
def f15(t: Tables) -> DataFrame:
    return t.match_kills.select("attacker", "victim").where(S.length_bound("attacker", "victim", 0.85)).distinct()


@R.add("ref_f16_name_confidence", """
select player, round(0.7 * least(matches_played / 10, 1.0) + 0.3 * greatest(0.0, 1 - (epoch(timestamp '2018-01-30') - epoch(cast(last_updated as timestamp))) / 604800), 6) as confidence from player_ratings where last_updated is not null""")
def f16(t: Tables) -> DataFrame:
    age = F.unix_timestamp(F.lit("2018-01-30 00:00:00")) - F.unix_timestamp("last_updated")
    return t.player_ratings.where("last_updated is not null").select("player", F.round(X.name_confidence("matches_played", age), 6).alias("confidence"))


_TAGGED = "regexp_replace(regexp_replace(regexp_replace(r, '\\[?\\s*b[il]ee?d\\s*[oqdgc0]?u[a-z]?\\s*\\]?', '[Bleed Out]', 'gi'), '\\[bla?ed\\s*out\\]', '[Bleed Out]', 'gi'), '\\[blg\\s', '[Bleed ', 'gi')"
_TYPED = f"replace(replace(lower({_TAGGED}), 'eliminatad', 'eliminated'), 'knoeked', 'knocked')"
_SPACED = f"regexp_replace(regexp_replace(regexp_replace({_TYPED}, '([A-Za-z0-9_])(knocked)', '\\1 \\2', 'gi'), '([A-Za-z0-9_])(eliminated)', '\\1 \\2', 'gi'), '([a-z])([A-Z])', '\\1 \\2', 'g')"
_NORMAL = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_SPACED}, 'enemy\\s+shield\\s+broken', 'Enemy Shield Broken', 'gi'), 'my\\s+shield\\s+broken', 'My Shield Broken', 'gi'), 'bleed\\s+out', 'Bleed Out', 'gi'), '\\s+', ' ', 'g'))"


@R.add("ref_f21_f24_normal_line", f"select id, {_NORMAL} as line from {_E} where r is not null")
def f24(t: Tables) -> DataFrame:
    return events(t).where("r is not null").select("id", X.normalize_line("r", RULES).alias("line"))


@R.add("ref_f22_typos", f"select id, replace(replace(lower(r), 'eliminatad', 'eliminated'), 'knoeked', 'knocked') as line from {_E} where r is not null")
def f22(t: Tables) -> DataFrame:
    return events(t).where("r is not null").select("id", X.fix_typos("r", RULES).alias("line"))


def _in_sql(column: str, steps: list[tuple[str, str, str]]) -> str:
    for _, pattern, new in steps:
        column = f"regexp_replace({column}, '{pattern.replace("'", "''")}', '{new}', 'g')"
    return column


#: DuckDB's patterns have no back references, so doubling is said with substrings.
_CLEAN = _in_sql("trim(a)", V.NAME_STEPS[:-1])


@R.add("ref_f25_clean_name", f"""
select id, case when length(n) >= 10 and length(n) % 2 = 0 and left(n, length(n) // 2) = right(n, length(n) // 2) then left(n, length(n) // 2) else n end as name
from (select id, {_CLEAN} as n from {_E} where a is not null)""")
def f25(t: Tables) -> DataFrame:
    return events(t).where("a is not null").select("id", X.clean_name(F.trim("a")).alias("name"))


def _words_in_sql(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"


_NO_NAME = """
n is null or trim(lower(n)) in {words} or (length(n) <= 12 and contains(lower(n), 'icon')) or contains(lower(n), '[bleed') or contains(lower(n), 'bleed]')
or regexp_full_match(trim(n), '\\[[^\\]]*\\]') or left(n, 1) in ('.', ',', '/', '-', '_', '=', '|', ':', ';') or regexp_matches(n, '[/<>\\\\|]')
or suffix(lower(n), 'suggested') or suffix(lower(n), 'spotted') or regexp_full_match(n, '[-_:@\\s0-9]+') or length(n) < 3
or regexp_full_match(n, '[0-9]{{1,3}}') or regexp_replace(lower(n), '[^a-z0-9]', '', 'g') in ('r44', 'longshot') or regexp_matches(lower(n), '(^|[^a-z0-9])(r-44|longshot)($|[^a-z0-9])')"""
_ALWAYS = {*V.BROADCAST_TAGS, "gun", *(c.lower() for c in LABELS)}
_FREE = _NO_NAME.format(words=_words_in_sql(_ALWAYS | set(V.EVENT_WORDS) | {"knocked", "eliminated"})) + " or regexp_matches(n, '\\S\\s+\\S+\\s+\\S')"
_PLACED = _NO_NAME.format(words=_words_in_sql(_ALWAYS | (set(V.EVENT_WORDS) & set(V.NOTICE_WORDS))))


@R.add("ref_f27_no_name", f"""
with w as (select unnest(string_split(r, ' ')) as n from feed_events_texts), x as (select distinct n from (select n from w union all select attacker from feed_events union all select victim from feed_events) where n is not null)
select n as name, ({_FREE}) as in_text, ({_PLACED}) as by_place from x""".replace("feed_events_texts", "(select raw_text as r from feed_events where raw_text is not null)"))
def f27(t: Tables) -> DataFrame:
    """Every word of every line and every name, in both forms of the test."""
    words = t.feed_events.select(F.explode(F.split("raw_text", " ")).alias("n"))
    names = t.feed_events.select(F.explode(F.array("attacker", "victim")).alias("n"))
    rows = words.unionByName(names).where("n is not null").distinct()
    return rows.select(F.col("n").alias("name"), L.no_name("n", RULES).alias("in_text"), L.no_name("n", RULES, by_place=True).alias("by_place"))


@R.add("ref_f28_names_by_place")
def f28(t: Tables) -> DataFrame:
    """The name that each side of a line's markers holds."""
    sides = t.feed_events.select("raw_text").distinct().select(F.explode(F.split("raw_text", r"<[^>]*>|\[[^\]]*\]|>+")).alias("segment")).where("trim(segment) <> ''").distinct()
    return sides.select("segment", L.names_by_place("segment", RULES).alias("name"))


@R.add("ref_f29_names_in_text")
def f29(t: Tables) -> DataFrame:
    lines = t.feed_events.where("raw_text is not null").select("raw_text").distinct()
    return lines.select(F.col("raw_text").alias("line"), F.array_join(L.names_in_text("raw_text", RULES), "|").alias("names"))


@R.add("ref_f30_pairs_of_names")
def f30(t: Tables) -> DataFrame:
    lines = t.feed_events.where("raw_text is not null").select("raw_text").distinct()
    return lines.withColumn("p", L.pair_of_names("raw_text", RULES)).where("p.victim is not null").select(F.col("raw_text").alias("line"), "p.attacker", "p.victim")


@R.add("ref_f31_digit_names")
def f31(t: Tables) -> DataFrame:
    """Lines with a name on one side and a number of the other side's name, made a digits-only name, on the other."""
    lines = t.match_kills.where("trim(attacker) <> ''").select(F.concat_ws(" ", F.trim("attacker"), F.lit("<skull>"), F.regexp_extract("victim", "[0-9]{4}", 0)).alias("line")).distinct()
    return lines.withColumn("p", L.pair_of_names("line", RULES, digits=True)).where("p.victim is not null").select("line", "p.attacker", "p.victim")


@R.add("ref_f26_weapon", f"""
select id, regexp_full_match(a, '[0-9]{{1,3}}') or {_NORM.format('a')} in ('r44', 'longshot') or regexp_matches(lower(a), '(^|[^a-z0-9])(r-44|longshot)($|[^a-z0-9])') as weapon from {_E} where a is not null""")
def f26(t: Tables) -> DataFrame:
    return events(t).where("a is not null").select("id", X.is_weapon("a", RULES).alias("weapon"))


_KINDS = """
case when regexp_matches(lower(r), '\\bentered\\b|abilit') then null
when regexp_extract(regexp_extract(lower(r), '.*(<\\s*(?:kill|gun|skull)[_\\s]*(?:icon)?\\s*>|\\b(?:kill|gun)icon\\b)', 1), 'kill|gun|skull') in ('kill', 'skull') then 'Kill'
when regexp_extract(regexp_extract(lower(r), '.*(<\\s*(?:kill|gun|skull)[_\\s]*(?:icon)?\\s*>|\\b(?:kill|gun)icon\\b)', 1), 'kill|gun|skull') = 'gun' then 'Knock'
when contains(lower(r), 'care package') and contains(lower(r), 'containing') then 'CarePackage'
when contains(lower(r), 'shield broken') then 'ShieldBroken' when contains(lower(r), 'bleed out') then 'BleedOut' when contains(lower(r), 'spotted') then 'Ping'
when contains(lower(r), 'reviving') then 'Revive' when contains(lower(r), 'suggested') and contains(lower(r), 'location') then 'SuggestLocation'
when contains(lower(r), 'revealed') and (contains(lower(r), 'enemies') or contains(lower(r), 'map')) then 'Scan' when contains(lower(r), 'enemy audio') then 'Audio'
when contains(lower(r), 'pinged') and contains(lower(r), 'loot') then 'PingLoot' when contains(lower(r), 'eliminated') then 'Eliminated'
when contains(lower(r), 'looted') and contains(lower(r), 'care package') then 'LootedCarePackage' end"""


@R.add("ref_f32_event_type", f"select id, {_KINDS} as kind from {_E}")
def f32(t: Tables) -> DataFrame:
    return events(t).select("id", X.event_type("r").alias("kind"))


#: A line of every kind, put together from two names (fixed values).
_TEMPLATES = [
    "{a} <kill_icon> {v}", "{a} <gun_icon> {v}", "{a} <gun_icon> {v} <kill_icon> {a}", "{a} killicon {v}", "{a}: care package containing armor", "enemy shield broken {a}",
    "{a} [Bleed Out] {v}", "{a} spotted an enemy", "{a}: reviving {v}", "{a} suggested a location", "{a} revealed the map", "enemy audio", "{a} pinged loot",
    "champion {a} has been eliminated", "{a} looted a care package", "squad entered the ring <kill_icon>", "new ability <gun_icon>", "nothing at all",
]


@R.add("ref_f32_every_kind", "with p as (select distinct attacker as a, victim as v from match_kills where trim(attacker) <> '' and trim(victim) <> ''), l as (select distinct r from ("
+ " union all ".join(f"select replace(replace('{x}', '{{a}}', a), '{{v}}', v) as r from p" for x in _TEMPLATES) + f")) select r as line, {_KINDS} as kind from l")
def f32b(t: Tables) -> DataFrame:
    """Lines of every kind, about all pairs of names of match_kills."""
    pairs = t.match_kills.where("trim(attacker) <> '' and trim(victim) <> ''").select("attacker", "victim").distinct()
    made = F.array(*(F.replace(F.replace(F.lit(x), F.lit("{a}"), F.col("attacker")), F.lit("{v}"), F.col("victim")) for x in _TEMPLATES))
    return pairs.select(F.explode(made).alias("line")).distinct().select("line", X.event_type("line").alias("kind"))


@R.add("ref_f33_parse_line")
def f33(t: Tables) -> DataFrame:
    """Parsed lines beside the stored names."""
    rows = events(t).where("r is not null").select("id", F.trim("a").alias("stored_attacker"), F.trim("v").alias("stored_victim"), "r")
    return L.parse_lines(rows, "r", RULES).select("id", "event_type", "attacker", "victim", "stored_attacker", "stored_victim")


@R.add("ref_f34_trace")
def f34(t: Tables) -> DataFrame:
    """How every different line is read, step by step."""
    rows = t.feed_events.where("raw_text is not null").select("raw_text").distinct()
    return L.trace_lines(rows, "raw_text", RULES).select(F.col("raw_text").alias("line"), F.posexplode("trace").alias("step", "what"))


@R.add("ref_f35_noise", f"""
select id, r from {_E} where r is null or length(r) < 8 or length(regexp_replace(r, '[^\\p{{L}}\\p{{N}} ]', '', 'g')) < 0.6 * length(r) or regexp_full_match(r, '[0-9\\-\\[\\]()]+')
or length(r) - length(replace(r, '—', '')) > 3 or length(r) - length(replace(r, '|', '')) > 3 or length(r) - length(replace(r, '-', '')) > 5
or len(list_distinct(string_split(r, ''))) < length(r) / 3 or regexp_matches(r, '^[a-z]{{1,2}}\\s')""")
def f35(t: Tables) -> DataFrame:
    return events(t).where(X.looks_like_noise("r")).select("id", "r")


@R.add("ref_f36_feed_content", f"select id, coalesce(regexp_matches(lower(r), 'gun_icon|gunicon|kill_icon|killicon|reviving|bleed|spotted|shield|pinged|scan|audio|eliminated'), false) as feed from {_E}")
def f36(t: Tables) -> DataFrame:
    return events(t).select("id", X.feed_content("r").alias("feed"))


@R.add("ref_f37_non_latin", "select doc_id from documents where regexp_matches(text, '[\\x{0400}-\\x{04FF}\\x{0600}-\\x{06FF}\\x{0E00}-\\x{0E7F}\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]')")
def f37(t: Tables) -> DataFrame:
    return t.documents.where(X.non_latin("text")).select("doc_id")


_ICONED = "(select distinct id, replace(replace(replace(raw_text, '<skull>', '<KILL_ICON>'), '[R-44]', '<gun_icon>'), '>>', 'gunicon') as r from feed_events where raw_text is not null)"


def _iconed(t: Tables) -> DataFrame:
    """The lines with the icons of the reader instead of the markers of the test tables."""
    r = F.col("raw_text")
    for old, new in (("<skull>", "<KILL_ICON>"), ("[R-44]", "<gun_icon>"), (">>", "gunicon")):
        r = F.replace(r, F.lit(old), F.lit(new))
    return t.feed_events.where("raw_text is not null").select("id", r.alias("r")).distinct()


@R.add("ref_f38_neutral_marker", f"""
select id, regexp_replace(r, '<[^>]*icon[^>]*>|\\b(gun|kill)icon\\b', '<ICON>', 'gi') as line,
case when contains(lower(r), '<kill_icon>') then 'kill' when contains(lower(r), '<gun_icon>') then 'gun' end as marker,
regexp_replace(r, '<[^>]*icon[^>]*>|\\b(gun|kill)icon\\b', '<GUN_ICON>', 'gi') as as_gun,
regexp_replace(regexp_replace(r, '<[^>]*icon[^>]*>|\\b(gun|kill)icon\\b', '<GUN_ICON>', 'gi'), '<GUN_ICON>', '<KILL_ICON>') as as_kill from {_ICONED}""")
def f38(t: Tables) -> DataFrame:
    """Icons told, written neutrally, and set as decided."""
    return _iconed(t).select(
        "id", X.neutral_marker("r").alias("line"), X.gap_marker("r").alias("marker"), X.apply_marker("r", F.lit("gun")).alias("as_gun"), X.apply_marker("r", F.lit("kill")).alias("as_kill")
    )


@R.add("ref_f43_label_tiers", """
select filename, case when t = 'EMPTY' then 'noise' when t is null or t = '' or contains(t, chr(10)) or length(t) < 4
or regexp_matches(lower(t), 'because|sorry|i |the image|this image|i can|i see|note:|please') or length(regexp_replace(t, '[^\\p{L}\\p{N} ]', '', 'g')) < 0.5 * length(t) then null
when contains(t, '<GUN_ICON>') then 'high' when length(t) >= 12 then 'medium' else 'low' end as tier from (select filename, trim(label) as t from crop_labels)""")
def f43(t: Tables) -> DataFrame:
    return t.crop_labels.select("filename", X.quality_tier("label").alias("tier"))


@R.add("ref_f45_crop_time", "select filename, try_strptime(regexp_extract(filename, '([0-9]{8}_[0-9]{6})_line', 1), '%Y%m%d_%H%M%S') as at from crop_labels")
def f45(t: Tables) -> DataFrame:
    return t.crop_labels.select("filename", X.crop_time("filename").cast("timestamp_ntz").alias("at"))


@R.add("ref_f51_hamming", "select a.match_id, bit_count(xor(a.k, a.p)) as distance from (select match_id, kill_count::bigint as k, players_observed::bigint as p from matches) a")
def f51(t: Tables) -> DataFrame:
    return t.matches.select("match_id", X.hamming64(F.col("kill_count").cast("long"), F.col("players_observed").cast("long")).alias("distance"))


@R.add("ref_f53_elapsed", "select match_id, cast((epoch_us(end_time) - epoch_us(start_time)) // 60000000 as varchar) || 'm ' || cast((epoch_us(end_time) - epoch_us(start_time)) // 1000000 % 60 as varchar) || 's' as elapsed from matches where end_time >= start_time")
def f53(t: Tables) -> DataFrame:
    s = F.floor((F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1_000_000)
    return t.matches.where("end_time >= start_time").select("match_id", X.elapsed(s).alias("elapsed"))


@R.add("ref_f54_minutes", "select match_id, round((epoch_us(end_time) - epoch_us(start_time)) / 6e7, 6) as minutes from matches where end_time is not null")
def f54(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    return t.matches.where("end_time is not null").select("match_id", F.round(us / 6e7, 6).alias("minutes"))


@R.add("ref_f55_charset", "select filename, regexp_full_match(label, '[a-zA-Z0-9 _.<>\\[\\]-]*') as plain from crop_labels where label is not null")
def f55(t: Tables) -> DataFrame:
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 _.<>[]-"
    return t.crop_labels.where("label is not null").select("filename", X.only_characters("label", letters).alias("plain"))


@R.add("ref_f57_acceptable", """
select filename, coalesce(trim(label) <> 'EMPTY' and not contains(trim(label), chr(10)) and length(trim(label)) >= 4 and length(regexp_replace(trim(label), '[^\\x00-\\x7F]', '', 'g')) >= 0.8 * length(trim(label))
and length(regexp_replace(trim(label), '[^\\p{L}\\p{N} <>]', '', 'g')) >= 0.5 * length(trim(label)), false) as good from crop_labels""")
def f57(t: Tables) -> DataFrame:
    return t.crop_labels.select("filename", X.acceptable_transcription("label").alias("good"))


def _invariants(t: Tables) -> list[Invariant]:
    k, p, r = t.match_kills, t.match_placements, t.player_ratings
    known = t.feed_events.select(F.col("id").alias("source_event_id"))
    crops = t.crop_labels.select(F.col("filename").alias("crop_filename"))
    fell = k.select("match_id", F.col("victim").alias("player"))
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return [
        Invariant("icon_vote_domain", "error", t.feed_events.where("icon_vote is not null and icon_vote not in ('', 'kill', 'gun')"), F.col("id")),
        Invariant("read_count_ge_1", "error", t.feed_events.where("read_count < 1"), F.col("id")),
        Invariant("rated_kill_has_a_name", "error", k.where(missing("attacker") & missing("victim")), F.col("id")),
        Invariant("source_event_resolves", "warn", k.where("source_event_id is not null").join(known, "source_event_id", "left_anti"), F.col("id")),
        Invariant("no_self_kills", "error", k.where("trim(attacker) <> '' and trim(attacker) = trim(victim)"), F.col("id")),
        Invariant("no_default_labels_rated", "warn", r.where(X.character_with_number("player", RULES)), F.col("player")),
        Invariant("matches_played_ge_1", "error", r.where("matches_played < 1"), F.col("player")),
        Invariant("rating_ranges", "error", r.where("rd < 30 or rd > 350 or vol <= 0 or elo < 100"), F.col("player")),
        Invariant("placement_backed_by_kill", "warn", p.where("survived = 0 and kill_order_out > 0").join(fell, ["match_id", "player"], "left_anti"), F.concat_ws("|", "match_id", "player")),
        Invariant("crop_files_exist", "warn", k.where(~missing("crop_filename")).withColumn("crop_filename", F.trim("crop_filename")).join(crops, "crop_filename", "left_anti"), F.col("id")),
    ]


@R.add("ref_q4_invariants", """
select 'icon_vote_domain' as "check", count(*) as violations from feed_events where icon_vote is not null and icon_vote not in ('', 'kill', 'gun')
union all select 'read_count_ge_1', count(*) from feed_events where read_count < 1
union all select 'rated_kill_has_a_name', count(*) from match_kills where coalesce(trim(attacker), '') = '' and coalesce(trim(victim), '') = ''
union all select 'source_event_resolves', count(*) from match_kills k where source_event_id is not null and not exists (select 1 from feed_events e where e.id = k.source_event_id)
union all select 'no_self_kills', count(*) from match_kills where trim(attacker) <> '' and trim(attacker) = trim(victim)
union all select 'no_default_labels_rated', count(*) from player_ratings where regexp_matches(lower(trim(player)), '^(kestrel|bramble|bulwark|cinder|corsair|drift|ember|halcyon|harrow|lumen|mantis|marrow|osprey|pylon|quarry|rook|sable|thicket|tundra|vesper)[0-9]{4}$')
union all select 'matches_played_ge_1', count(*) from player_ratings where matches_played < 1
union all select 'rating_ranges', count(*) from player_ratings where rd < 30 or rd > 350 or vol <= 0 or elo < 100
union all select 'placement_backed_by_kill', count(*) from match_placements p where survived = 0 and kill_order_out > 0 and not exists (select 1 from match_kills k where k.match_id = p.match_id and k.victim = p.player)
union all select 'crop_files_exist', count(*) from match_kills k where coalesce(trim(crop_filename), '') <> '' and not exists (select 1 from crop_labels l where l.filename = trim(k.crop_filename))""")
def q4(t: Tables) -> DataFrame:
    return run_invariants(_invariants(t)).select("check", "violations")


@R.add("ref_q3_invariant_examples")
def q3(t: Tables) -> DataFrame:
    """As ref_q4_invariants, with severities and up to eight examples each."""
    return run_invariants(_invariants(t)).withColumn("examples", F.array_join("examples", ", "))


_STAGES = """
with e as (select *, trim(attacker) as a, trim(victim) as v from feed_events), k as (select * from e where event_type = 'Kill'),
c as (select epoch_us(timestamp) - lag(epoch_us(timestamp)) over (partition by lower(trim(streamer)), a, v, epoch_us(timestamp) // 3600000000 order by timestamp, id) <= 5000000 as close from k where a <> '' and v <> '' and timestamp is not null),
m as (
select 'database' as stage, 'kill_without_attacker_pct' as metric, 100.0 * count(*) filter (where coalesce(a, '') = '') / count(*) as value from k
union all select 'database', 'kill_without_victim_pct', 100.0 * count(*) filter (where coalesce(v, '') = '') / count(*) from k
union all select 'database', 'kill_low_confidence_pct', 100.0 * count(*) filter (where attacker_conf < 0.5) / count(*) from k
union all select 'database', 'latest_age_h', (epoch_us(timestamp '2018-01-29 00:00:00') - max(epoch_us(timestamp))) / 3.6e9 from e
union all select 'database', 'duplicate_pairs_5s', count(*) filter (where close) from c
union all select 'parsing', 'self_kills', count(*) filter (where a <> '' and a = v) from k
union all select 'parsing', 'short_names', count(*) filter (where a <> '' and length(a) < 3) from k
union all select 'parsing', 'long_names', count(*) filter (where length(a) > 30) from k
union all select 'parsing', 'game_words', count(*) filter (where lower(a) in ('ring', 'squad', 'knocked')) + count(*) filter (where lower(v) in ('ring', 'squad', 'knocked')) from k
union all select 'parsing', 'character_names', count(*) filter (where lower(a) in {who}) + count(*) filter (where lower(v) in {who}) from k
union all select 'validation', 'corrected_pct', 100.0 * count(*) filter (where gemini_corrected = 1) / count(*) from e
union all select 'matches', 'mega_match_pct', 100.0 * count(*) filter (where kill_count >= 100) / count(*) from matches
union all select 'matches', 'longest_min', max((epoch_us(end_time) - epoch_us(start_time)) / 6e7) from matches
union all select 'matches', 'no_matches', (count(*) = 0)::int from matches
union all select 'ratings', 'no_players', (count(*) = 0)::int from player_ratings
union all select 'ratings', 'negative', count(*) filter (where elo < 0) from player_ratings
union all select 'ratings', 'extreme', count(*) filter (where elo > 3000) from player_ratings
union all select 'ratings', 'unranked_all', (count(*) > 0 and count(*) filter (where matches_played >= 3) = 0)::int from player_ratings),
l(stage, metric, warn, fail) as (values {limits}),
g as (select m.stage, m.metric, round(value, 3) as value, case when value >= fail then 'fail' when value >= warn then 'warn' else 'ok' end as status from m join l on l.stage = m.stage and l.metric = m.metric)
""".format(who=_words_in_sql(c.lower() for c in LABELS), limits=", ".join(f"('{s}', '{m}', {w}, {'null' if f is None else f})" for s, m, w, f in STAGE_LIMITS))


def _graded(t: Tables) -> DataFrame:
    as_of = F.lit("2018-01-29 00:00:00").cast("timestamp")
    metrics = stage_metrics(t.feed_events, t.matches, t.player_ratings, as_of, ["ring", "squad", "knocked"], LABELS)
    return grade_stages(metrics, stage_limits(t.spark))


@R.add("ref_q1_q2_graded_metrics", _STAGES + "select * from g")
def q1(t: Tables) -> DataFrame:
    return _graded(t).withColumn("value", F.round("value", 3))


@R.add("ref_q2_stage_report", _STAGES + """
, r as (select stage, case status when 'fail' then 3 when 'warn' then 2 else 1 end as n from g)
select stage, case max(n) when 3 then 'fail' when 2 then 'warn' else 'ok' end as status from (select stage, n from r union all select 'overall', n from r) group by stage""")
def q2(t: Tables) -> DataFrame:
    return stage_report(_graded(t))


@R.add("ref_q1_settings_stages", """
select * from (values ('config', 'least_confidence', 0.3, 'ok'), ('config', 'crop_window_s', 3.0, 'warn'), ('config', 'agreement', 0.85, 'ok'), ('api', 'server_latency_ms', null, 'skip')) as v(stage, metric, value, status)""")
def q1b(t: Tables) -> DataFrame:
    return settings_metrics(t.spark, {"least_confidence": 0.3, "crop_window_s": 3.0, "agreement": 0.85})


@R.add("ref_q12_reading_accuracy")
def q12(t: Tables) -> DataFrame:
    """Raw texts against the labels of their crops, by quality of the label, with equal parsed results."""
    label = t.crop_labels.where("label is not null").select(F.col("filename").alias("crop_filename"), "label", F.coalesce(F.nullif("quality", F.lit("")), F.lit("none")).alias("quality"))
    pairs = t.feed_events.select(F.trim("crop_filename").alias("crop_filename"), F.col("raw_text").alias("text")).distinct().join(label, "crop_filename").select("label", "text", "quality")
    return reading_accuracy(pairs, lambda rows, c: L.parse_lines(rows, c, RULES))


@R.add("ref_st12_agreement")
def st12(t: Tables) -> DataFrame:
    """Raw texts checked against the labels of their crops; corrections are parsed anew."""
    from feedloom.operators.retro import agreement

    label = t.crop_labels.where("label is not null").select(F.col("filename").alias("crop_filename"), F.col("label").alias("text"))
    rows = t.feed_events.where("raw_text is not null").dropDuplicates(["id"]).withColumn("crop_filename", F.trim("crop_filename"))
    second = rows.select("id", "crop_filename").join(label, "crop_filename").select("id", "text")
    checked, corrections = agreement(rows.select("id", "streamer", "timestamp", F.col("raw_text").alias("text")), second, lambda r, c: L.parse_lines(r, c, RULES))
    return checked.join(corrections.select("id", "attacker", "victim"), "id", "left").select("id", "verdict", F.round("likeness", 6).alias("likeness"), "attacker", "victim")


@R.add("ref_q10_leaked_words", """
select w as word, count(*) as n from (select lower(trim(attacker)) as w from feed_events union all select lower(trim(victim)) from feed_events)
where w in ('pacebot_meridian', 'knocked', 'eliminated', 'squad', 'teammate', 'ring') group by 1""")
def q10(t: Tables) -> DataFrame:
    words = F.lower(F.col("w")).isin("pacebot_meridian", "knocked", "eliminated", "squad", "teammate", "ring")
    rows = t.feed_events.select(F.explode(F.array(F.lower(F.trim("attacker")), F.lower(F.trim("victim")))).alias("w")).where(words)
    return rows.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n"))


@R.add("ref_q13_label_agreement")
def q13(t: Tables) -> DataFrame:
    label = t.crop_labels.where("label is not null and label <> 'EMPTY'").select(F.col("filename").alias("crop_filename"), "label")
    pairs = t.feed_events.select("id", F.trim("crop_filename").alias("crop_filename"), "raw_text").distinct().join(label, "crop_filename")
    r = S.ratio(F.lower("raw_text"), F.lower("label"))
    return pairs.withColumn("r", r).groupBy(F.when(F.col("r") >= 0.99, "exact").when(F.col("r") >= 0.8, "partial").otherwise("disagree").alias("agreement")).agg(F.count("*").alias("n"))


@R.add("ref_d1_holdout", "select filename from crop_labels l where label is not null and not exists (select 1 from match_kills k where trim(k.crop_filename) = l.filename)")
def d1(t: Tables) -> DataFrame:
    used = t.match_kills.select(F.trim("crop_filename").alias("filename"))
    return t.crop_labels.where("label is not null").select("filename").join(used, "filename", "left_anti")


_BUCKET = "(('0x' || left(md5(filename || '|11'), 8))::bigint % 10)"


@R.add("ref_d3_split", f"""
select filename, part, unnest(range(1, case when part = 'train' and quality = 'gold' then 7 else 2 end))::int as copy
from (select filename, quality, case when {_BUCKET} = 0 then 'valid' else 'train' end as part from crop_labels where label is not null and label <> 'EMPTY')""")
def d3(t: Tables) -> DataFrame:
    """Seeded 90/10 split by hash, gold rows of the training part six times over."""
    rows = t.crop_labels.where("label is not null and label <> 'EMPTY'").select("filename", "label", "quality")
    bucket = F.conv(F.left(F.md5(F.concat("filename", F.lit("|11"))), F.lit(8)), 16, 10).cast("long") % 10
    times = F.when((F.col("part") == "train") & (F.col("quality") == "gold"), 6).otherwise(1)
    return rows.withColumn("part", F.when(bucket == 0, "valid").otherwise("train")).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select("filename", "part", "copy")


@R.add("ref_d4_label_words", """
select filename, word, place - 1 as place from (select filename, unnest(w) as word, generate_subscripts(w, 1) as place from (select filename, string_split(label, ' ') as w from crop_labels where label is not null and label <> 'EMPTY') where len(w) = 3)""")
def d4(t: Tables) -> DataFrame:
    rows = t.crop_labels.where("label is not null and label <> 'EMPTY'").select("filename", F.split("label", " ").alias("w")).where(F.size("w") == 3)
    return rows.select("filename", F.posexplode("w").alias("place", "word")).select("filename", "word", F.col("place").cast("long").alias("place"))


@R.add("ref_d5_training_labels", "select filename, case when upper(trim(coalesce(label, ''))) in ('', 'EMPTY') then '' else label end as target from crop_labels where quality = 'gold' or upper(trim(coalesce(label, ''))) in ('', 'EMPTY')")
def d5(t: Tables) -> DataFrame:
    noise = F.upper(F.trim(F.coalesce("label", F.lit("")))).isin("", "EMPTY")
    return t.crop_labels.where((F.col("quality") == "gold") | noise).select("filename", F.when(noise, "").otherwise(F.col("label")).alias("target"))


QUERIES, ORACLE = R.queries, R.oracle
