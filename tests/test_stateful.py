import datetime as dt
import random

import pytest

from feedloom.functions import glicko as G
from feedloom.operators import dedup as D
from feedloom.operators.graph import components
from feedloom.operators.matches import split_points, survival
from feedloom.operators.merge import Seen, View, merge_views
from feedloom.operators.ratings import match_rows, rate_all, rate_match
from feedloom.operators.votes import best_variant, vote
from feedloom.streaming import states as ST


def chain(names, kind, **rules):
    state, r = D.State(), D.DedupRules(**rules)
    return [D.step(state, k * D.S, k, kind, "attacker", v, r) for k, v in enumerate(names, 1)]


JITTER = ["victimname", "victimnamc", "victimnane", "vlctimname", "victimnarne", "victimnamee"]


def test_chain_caps():
    kept = chain(JITTER, "Kill")
    assert len(set(kept)) == 2 and kept[2:] == [2] * 4
    assert len(set(chain(JITTER, "Knock"))) == 6


def test_exact_repeat_counts_for_its_anchor():
    assert chain(["same"] * 3, "Knock") == [1, 1, 1]
    state = D.State()
    assert [D.step(state, t * D.S, t, "Kill", None, "x", D.DedupRules()) for t in (1, 2)] == [1, 2]


def test_victim_guard_keeps_numbered_names():
    names = ["gibraltar2127", "gibraltar1619", "gibraltar2819", "gibraltar7120"]
    assert len(set(chain(names, "Kill"))) == 2
    assert len(set(chain(names, "Kill", guard_victims=True))) == 4
    assert len(set(chain(["gibraltar2127", "gibraltar2i27", "gibraltar212l", "gibraltar2127"], "Kill", guard_victims=True))) <= 2


def test_batch_equals_plain_run(spark):
    rnd = random.Random(8)
    rows, us = [], 0
    for i in range(300):
        us += rnd.choice([1, 5, 30, 200]) * D.S
        rows.append((rnd.choice("ab"), i, us, rnd.choice(["Kill", "Knock"]), rnd.choice(["ann", "bob", None]), rnd.choice(JITTER), 1))
    got = {r.id: r.kept_id for r in D.dedup_events(spark.createDataFrame(rows, D.READS)).collect()}
    states = {"a": D.State(), "b": D.State()}
    assert got == {r[1]: D.step(states[r[0]], r[2], r[1], r[3], r[4], r[5], D.DedupRules()) for r in rows}
    folded = D.fold_reads(D.dedup_events(spark.createDataFrame(rows, D.READS)))
    assert folded.agg({"read_count": "sum"}).first()[0] == 300


def test_stream_equals_batch(spark, tmp_path):
    rows, us = [], 1_700_000_000 * D.S
    rnd = random.Random(1)
    for i in range(60):
        us += rnd.choice([1, 4, 40]) * D.S
        rows.append(("s", i, us, "Kill", "ann", rnd.choice(JITTER[:3]), 1))
    want = {r.id: r.kept_id for r in D.dedup_events(spark.createDataFrame(rows, D.READS)).collect()}
    late = rows[:20][::-1] + rows[20:] + [("s", 999, us + 10_000 * D.S, "Kill", "ann", "x", 1), ("s", 1000, us + 20_000 * D.S, "Kill", "ann", "x", 1)]
    for k in range(0, len(late), 20):
        part = spark.createDataFrame(late[k : k + 20], D.READS).selectExpr("*", "timestamp_micros(us) as ts")
        part.coalesce(1).write.json(str(tmp_path / f"in/{k:03d}"))
    src = spark.readStream.schema(D.READS + ", ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    q = D.stream_dedup(src.withWatermark("ts", "5000 seconds")).writeStream.format("memory").queryName("kept").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = {r.id: r.kept_id for r in spark.table("kept").collect() if r.id < 999}
    finally:
        q.stop()
    assert got == want


def kills(n, t0=0, shift=0, prefix="p"):
    return [Seen((t0 + 20 * k + shift) * D.S, k, f"{prefix}attacker{k}", f"{prefix}victim{k}") for k in range(n)]


def test_merge_of_two_views():
    a, b = View("a", "A", kills(5)), View("b", "B", kills(8, shift=15)[3:] + [])
    b.kills[0].attacker_conf = 1.0
    a.kills[4].attacker_conf = 0.5
    shared = merge_views([a, View("b", "B", kills(8, shift=15)[2:8])])
    assert len(shared) == 1 and len(shared[0].kills) == 8 and shared[0].merged in (["a"], ["b"])
    two = merge_views([View("a", "A", kills(5)), View("b", "B", kills(5, prefix="other"))])
    assert len(two) == 2
    assert len(merge_views([View("a", "A", kills(5)), View("b", "A", kills(5))])) == 2
    assert len(merge_views([View("a", "A", kills(5)), View("b", "B", kills(5, t0=9000))])) == 2


def test_clock_skew_is_taken_out():
    mine = kills(4)
    theirs = [Seen(e.us + 15 * D.S, e.id, e.attacker, e.victim) for e in mine[:3]] + [Seen(200 * D.S, 9, "late", "one")]
    (m,) = merge_views([View("a", "A", mine), View("b", "B", theirs)])
    assert m.kills[-1].us == 185 * D.S


def test_split_points():
    times = [k * D.S for k in range(80)]
    assert split_points(times, [(f"p{k % 45}", None) for k in range(80)]) == [0]
    times = [k * D.S for k in range(40)] + [(k + 80) * D.S for k in range(40)]
    names = [(f"a{k}", None) for k in range(40)] + [(f"b{k}", None) for k in range(40)]
    assert split_points(times, names) == [0, 40]
    assert split_points([5], [("a", "b")]) == [0]


def test_survival(spark):
    rows = [("m", "a", "b", 1), ("m", "b", "c", 2), ("m", "c", "a", 3), ("m", None, "d", 4)]
    got = {r.player: (r.eliminated, r.order_out) for r in survival(spark.createDataFrame(rows, "match_id string, attacker string, victim string, kill_order int")).collect()}
    assert got == {"a": (True, 3), "b": (False, 4), "c": (False, 4), "d": (True, 4)}


def test_published_rating_example():
    import numpy as np

    mu_j, phi_j, s = np.array([-100, 50, 200]) / G.SCALE, np.array([30, 100, 300]) / G.SCALE, np.array([1, 0, 0])
    g = 1 / np.sqrt(1 + 3 * phi_j**2 / np.pi**2)
    e = 1 / (1 + np.exp(-g * (0 - mu_j)))
    new = G.update_arrays([1000.0], [200.0], [0.06], [(g**2 * e * (1 - e)).sum()], [(g * (s - e)).sum()])
    assert [round(float(x[0]), d) for x, d in zip(new, (3, 3, 6))] == [964.051, 151.517, 0.059996]


def test_ratings_do_not_depend_on_row_order(spark):
    rnd = random.Random(2)
    rows = []
    for m in range(30):
        for o in range(8):
            a, v = rnd.sample(range(12), 2)
            rows.append((m * 8 + o, f"m{m:02d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=m, minutes=o), f"player{a:02d}", f"player{v:02d}", o + 1, 0.9, 0.9))
    schema = "id long, match_id string, timestamp timestamp_ntz, attacker string, victim string, kill_order int, attacker_conf double, victim_conf double"
    run = lambda r: sorted((x.match_id, x.player, round(x.elo_after, 9)) for x in rate_all(match_rows(spark.createDataFrame(r, schema))).collect())
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    assert run(rows) == run(shuffled)
    import numpy as np

    ratings = {}
    rate_match(ratings, ["a", "b"], np.array([1, 2]), np.array([False, True]))
    assert ratings["b"][0] > 1000 > ratings["a"][0] and 30 <= ratings["a"][1] <= 350


def test_components(spark):
    edges = spark.createDataFrame([("b", "c"), ("a", "b"), ("x", "y"), ("q", "q"), ("d", "c")], "a string, b string")
    assert {r.member: r.group for r in components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_votes():
    assert vote(["jolly kemo", "jolly kemo", "jo1ly kemo"]) == "jolly kemo"
    assert best_variant(["abc", "abcd", "abcd"]) == "abcd" and best_variant(["a b", "a  b", ""]) == "a b" and best_variant([]) is None


def test_small_states():
    s, shown = ST.Squads(), []
    for r in (20, 18, 18, 19, 3, 3, 3, 3, None, 20, 20):
        s, x = ST.squads_step(s, r)
        shown.append(x)
    assert shown == [20, 20, 18, 18, 18, 18, 18, 3, 3, 3, 20] and s.match == 1
    s, shown = ST.Squads(), []
    for r in (10, 9, 8, 12, 7, 18, 7, 6, 1, 2, 1, 1):  # reads that don't rise confirm a drop; a small rise leaves the count alone
        s, x = ST.squads_step(s, r)
        shown.append(x)
    assert shown == [10, 10, 8, 8, 8, 8, 7, 7, 7, 7, 7, 1]
    s, out = ST.Streak(), []
    for hit in [True] * 6 + [False, True]:
        s, x = ST.streak_step(s, hit)
        out.append(x)
    assert out == [False] * 4 + [True, True, False, False]
    h, a = ST.hash_step(ST.Hashes(), 0, 0b1111)
    h, b = ST.hash_step(h, 1_000_000, 0b1110)
    h, c = ST.hash_step(h, 40_000_000, 0b1110)
    assert (a, b, c) == (True, False, True)
    p, x = ST.proposal_step(ST.Proposal(), (0.2, 0.3))
    p, far = ST.proposal_step(p, (0.6, 0.3))
    p, y = ST.proposal_step(p, (0.65, 0.3))
    assert (x, far, y) == (None, None, [0.65, 0.3])
    r, n = ST.recent_step(ST.RecentNames(), 0, "Maggie8793")
    r, n2 = ST.recent_step(r, 1_000_000, "Magg1e8793")
    assert n2 == "Maggie8793"


@pytest.mark.parametrize("reads, decision", [("gggkggg", "gun"), ("gkggkg", "gun"), ("kkkkk", "kill"), ("ggkkkk", "kill"), ("kk", "gun"), ("kkkgggg", "gun")])
def test_icon_decision(spark, reads, decision):
    from feedloom.operators.matches import icon_decision

    df = spark.createDataFrame([("x", k, {"g": "gun", "k": "kill"}[c]) for k, c in enumerate(reads)], "key string, n int, vote string")
    assert icon_decision(df, "key", ["n"], "vote").first().decision == decision


def test_tracks_and_their_markers(spark):
    from feedloom.operators.votes import flushed_tracks, track_reads

    reads = ["ann <GUN_ICON> bob", "ann <KILL_ICON> bob", "ann <KILL_ICON> bob", "ann <KILL_ICON> bob", "other line of text"]
    df = spark.createDataFrame([("s", k, k * D.S, text) for k, text in enumerate(reads)] + [("s", 9, 60 * D.S, reads[0])], "key string, id long, us long, text string")
    voted = {r.track: (r.last_us, r.reads, r.icon_vote) for r in flushed_tracks(track_reads(df, markers="voted")).collect()}
    assert voted == {0: (3 * D.S, 4, "kill"), 4: (4 * D.S, 1, None), 9: (60 * D.S, 1, "gun")}
    same = {r.id: r.track for r in track_reads(df, markers="same").collect()}
    assert same == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 9: 9}


def test_seeded_chains_and_refused_rows(spark):
    rows = [("s", k, k * 300 * D.S, "Kill", "ann", "bobby12", 1) for k in range(4)] + [("s", 10, 5000 * D.S, "Kill", None, " ", 1), ("s", 11, 5001 * D.S, "Ping", None, None, 1)]
    df = spark.createDataFrame(rows, D.READS)
    plain = {r.id: r.kept_id for r in D.dedup_events(df).collect()}
    seeded = {r.id: r.kept_id for r in D.dedup_events(df, D.DedupRules(seed_us=1800 * D.S)).collect()}
    assert plain == {0: 0, 1: 1, 2: 2, 3: 3, 10: None, 11: 11}
    assert seeded == {0: 0, 1: 1, 2: 1, 3: 1, 10: None, 11: 11}


def test_guard_of_two_players_with_a_like_name():
    from feedloom.functions.similarity import other_player_of_one_line as other

    assert other("gibraltar2127", ["gibraltar1619"]) and not other("gibraltar2127", ["gibraltar2121"])
    assert not other("gibraltar", ["gibraltar1619"]) and not other("gibraltar2127", ["gibraltar2127", "gibraltar1619"]) and not other("zed2127", ["gibraltar1619"])
    assert other("2127", ["1619"])


def test_looks_back(spark):
    from feedloom.operators import retro as RE

    rows = [("s", k, t * D.S, "Kill", "ann", "bob", 1) for k, t in enumerate((0, 100, 200, 300, 400, 700, 3000))]
    got = {r.id: (r.place, r.kept) for r in RE.exact_chains(spark.createDataFrame(rows, D.READS)).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, True), 3: (4, True), 4: (5, False), 5: (5, False), 6: (1, True)}
    jitter = [("s", 1, 0, "ann", "bobby99"), ("s", 2, 50 * D.S, "Ann", "bxbby9x"), ("s", 3, 900 * D.S, "ann", "bxbby9x"), ("s", 4, 60 * D.S, "zed", "bxbby9x"), ("s", 5, 70 * D.S, "ann", "other")]
    pairs, clusters = RE.residual_jitter(spark.createDataFrame(jitter, "key string, id long, us long, attacker string, victim string"))
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 2)] and [r.rows for r in clusters.collect()] == [2]
    three = [("s", k, k * D.S, "Kill", "ann", v, 1) for k, v in enumerate(("bob", "bob", "bob", "bub"))]
    out = {r.variant: r.n for r in D.dedup_variants(spark.createDataFrame(three, D.READS), {"a": RE.RETRO, "b": D.DedupRules(rated_cap=4)}).groupBy("variant").agg({"kept_id": "count"}).withColumnRenamed("count(kept_id)", "n").collect()}
    assert out == {"a": 4, "b": 4}
    kept = D.dedup_events(spark.createDataFrame(three, D.READS), D.DedupRules(exact_us=-1))
    assert {r.grade: r.n for r in RE.deletion_audit(kept).collect()} == {"exact": 1, "flagged": 1}
    (chain,) = RE.chain_statistics(kept).where("kept_id = 1").collect()
    assert chain.rows == 3 and chain.span_s == 2.0 and 0.7 < chain.least_ratio < 0.9


def test_agreement(spark):
    from feedloom.functions.lines import parse_lines
    from feedloom.functions.text import TextRules
    from feedloom.operators.retro import agreement

    t0 = dt.datetime(2024, 1, 1)
    reads = spark.createDataFrame([(1, "s", t0, "Alice <KILL_ICON> Robert"), (2, "s", t0, "garbage zzz"), (3, "s", t0, "x"), (4, "s", t0, "y")], "id long, streamer string, timestamp timestamp_ntz, text string")
    second = spark.createDataFrame([(1, "Alice <KILL_ICON> Robert"), (2, "Carol <KILL_ICON> David"), (3, "EMPTY"), (4, "nothing like it")], "id long, text string")
    checked, corrections = agreement(reads, second, lambda r, c: parse_lines(r, c, TextRules()))
    assert {r.id: r.verdict for r in checked.collect()} == {1: "confirmed", 2: "correction", 4: "correction"}
    (row,) = corrections.collect()
    assert (row.id, row.event_type, row.attacker, row.victim, row.source) == (2, "Kill", "Carol", "David", "check")


def test_stage_metrics_and_reports(spark):
    from pyspark.sql import functions as F

    from feedloom.operators import quality as Q

    t0 = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(1, "s", t0, "Kill", "ann", "bob", 0.9, 0), (2, "s", t0 + dt.timedelta(seconds=3), "Kill", "ann", "bob", 0.2, 1), (3, "s", t0, "Kill", "zed", "zed", 0.9, 0), (4, "s", t0, "Ping", "", None, 0.1, 0)],
        "id long, streamer string, timestamp timestamp_ntz, event_type string, attacker string, victim string, attacker_conf double, gemini_corrected int",
    )
    matches = spark.createDataFrame([(t0, t0 + dt.timedelta(minutes=150), 120), (t0, None, 3)], "start_time timestamp_ntz, end_time timestamp_ntz, kill_count int")
    ratings = spark.createDataFrame([("ann", 900.0, 5), ("bob", -1.0, 1)], "player string, elo double, matches_played int")
    metrics = Q.stage_metrics(events, matches, ratings, F.lit("2024-01-01 10:00:00").cast("timestamp"), ["ring"], ["Zed"])
    got = {r.metric: (round(r.value, 3), r.status) for r in Q.grade_stages(metrics, Q.stage_limits(spark)).collect()}
    assert got["kill_low_confidence_pct"] == (33.333, "warn") and got["duplicate_pairs_5s"] == (1.0, "warn") and got["self_kills"] == (1.0, "warn")
    assert got["character_names"] == (2.0, "warn") and got["mega_match_pct"] == (50.0, "fail") and got["longest_min"] == (150.0, "warn") and got["negative"][1] == "warn"
    assert got["kill_without_attacker_pct"] == (0.0, "ok") and got["no_matches"] == (0.0, "ok")
    report = {r.stage: r.status for r in Q.stage_report(Q.grade_stages(metrics, Q.stage_limits(spark))).collect()}
    assert report["matches"] == "fail" and report["validation"] == "ok" and report["overall"] == "fail"
    nothing = Q.stage_metrics(events.limit(0), matches.limit(0), ratings.limit(0), F.lit("2024-01-01").cast("timestamp"), [], [])
    assert {r.metric: r.status for r in Q.grade_stages(nothing, Q.stage_limits(spark)).collect()}["no_players"] == "warn"


def test_reading_accuracy_and_replay(spark):
    from feedloom.functions.lines import parse_lines
    from feedloom.functions.text import TextRules
    from feedloom.operators.quality import reading_accuracy, replay_scores

    pairs = spark.createDataFrame([("Alice <kill_icon> Robert", "alice <kill_icon> robert", "gold"), ("Alice <kill_icon> Robert", "Carol <gun_icon> Robert", "gold"), ("x", None, "noise")], "label string, text string, quality string")
    got = {r.quality: r for r in reading_accuracy(pairs, lambda r, c: parse_lines(r, c, TextRules())).collect()}
    assert (got["gold"].rows, got["gold"].exact_pct, got["noise"].empty_pct) == (2, 50.0, 100.0) and got["gold"].parsed_pct in (0.0, 50.0)
    row = "game string, id long, us long, attacker string, victim string"
    truth = spark.createDataFrame([("g", 1, 0, "a", "bobby"), ("g", 2, 300 * D.S, "a", "carol")], row)
    reads = spark.createDataFrame([("g", 11, 0, "a", "bobby"), ("g", 12, 9 * D.S, "a", "bobby"), ("g", 13, 301 * D.S, "a", "carol")], row)
    kept = spark.createDataFrame([(11,), (12,)], "id long")
    (r,) = replay_scores(truth, reads, kept).collect()
    assert (r.truth, r.read_deaths, r.kept_deaths, r.read_recall_pct, r.kept_recall_pct, r.kept_precision_pct, r.lost_to_suppression, r.over_count) == (2, 2, 1, 100, 50, 100, 1, 2.0)
