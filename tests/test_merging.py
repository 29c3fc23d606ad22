import datetime as dt

from feedloom.operators.matches import build_matches, match_events
from feedloom.operators.merge import merge_matches
from feedloom.operators.ratings import period_update

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = (
    "id long, streamer string, timestamp timestamp_ntz, event_type string, attacker string, victim string, attacker_conf double, victim_conf double, source string, session string"
)


def feed(streamer, first_id, shift, players, kind="Kill"):
    return [
        (first_id + k, streamer, T0 + dt.timedelta(seconds=20 * p + shift), kind, f"attacker{p}x", f"victim{p}y", 0.9, 0.8, "trocr", "clash")
        for k, p in enumerate(players)
    ]


def test_two_streams_of_one_match(spark):
    rows = feed("a", 1, 0, range(5)) + feed(" B ", 100, 12, range(2, 8)) + feed("c", 200, 7200, range(4)) + feed("d", 300, 0, [0, 1])
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    alone = {r.streamer: r.kill_count for r in build_matches(df).collect()}
    assert alone == {"a": 5, "b": 6, "c": 4}
    merged = merge_matches(match_events(df)).groupBy("match_id", "merged_from").count().collect()
    assert sorted(r["count"] for r in merged) == [4, 8] and sum(r.merged_from != "" for r in merged) == 1


def test_no_events(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert build_matches(df).count() == 0 and merge_matches(match_events(df)).count() == 0


def test_period_update_is_the_published_example(spark):
    ratings = spark.createDataFrame(
        [("me", 1000.0, 200.0, 0.06), ("x", 900.0, 30.0, 0.06), ("y", 1050.0, 100.0, 0.06), ("z", 1200.0, 300.0, 0.06), ("idle", 990.0, 80.0, 0.06)],
        "player string, elo double, rd double, vol double",
    )
    results = spark.createDataFrame([("me", "x", 1.0), ("me", "y", 0.0), ("me", "z", 0.0)], "player string, opponent string, score double")
    got = {r.player: (round(r.elo, 3), round(r.rd, 3), round(r.vol, 6)) for r in period_update(ratings, results).collect()}
    assert got["me"] == (964.051, 151.517, 0.059996) and got["idle"] == (990.0, 80.0, 0.06)


def test_views_that_share_a_line_are_found_without_their_overlaps(spark):
    from feedloom.operators.merge import MARGIN_US, SKEW_US, mergeable_pairs

    reach = SKEW_US + MARGIN_US
    rows = [("a", "x", reach - 5, "Anna_Long", "Berta_42"), ("b", "y", reach + 5, "anna_long", "berta_4Z"), ("c", "y", 2 * reach - 4, "Anna_Long", "Berta_42")]
    rows += [("d", "x", 0, "Anna_Long", "Berta_42"), ("e", "z", reach, "Somebody", "Other"), ("f", "z", -reach, "Anna_Long", "Berta_42"), ("f", "z", 9, None, "Other")]
    got = mergeable_pairs(spark.createDataFrame(rows, "match_id string, key string, us long, attacker string, victim string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b"), ("d", "f")]
