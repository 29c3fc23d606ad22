import random

import pytest

from feedloom.llm.components import connected_components, forest_levels
from feedloom.llm.ranking import distributed_rank, feed_comparisons, item_strengths, usable_kills


def brute(edges):
    group = {}
    for a, b in edges:
        if a and b and a.strip(" ") and b.strip(" ") and a.strip(" ") != b.strip(" "):
            x, y = a.strip(" "), b.strip(" ")
            merged = group.get(x, {x}) | group.get(y, {y})
            for m in merged:
                group[m] = merged
    return {m: min(g) for m, g in group.items()}


def found(spark, edges, **kw):
    return {r.member: r.group for r in connected_components(spark.createDataFrame(edges, "a string, b string"), **kw).collect()}


def test_random_graphs_over_several_levels(spark):
    rnd = random.Random(2)
    edges = [(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(100)]
    edges += [(f"c{k}", f"c{k + 1}") for k in range(60)] + [("hub", f"s{k}") for k in range(50)]  # a chain and a star
    edges += [(None, "q"), ("q", "  "), (" n1", "n2 "), ("self", "self"), ("Ä", "Z"), ("z", "Ä")]
    want = brute(edges)
    assert found(spark, edges) == want
    assert found(spark, edges, edges_per_range=10, least_ranges=8) == want


def test_few_levels_whatever_the_names_are(spark):
    """A chain in id order, one whose neighbours never lie in one range, and a hub with most edges."""
    ordered = spark.range(50_000).selectExpr("format_string('m%06d', id) a", "format_string('m%06d', id + 1) b")
    filed = forest_levels(ordered, edges_per_range=782, least_ranges=64)
    assert len(filed) <= 7
    assert connected_components(ordered, 782, 64).groupBy("group").count().collect() == [("m000000", 50_001)]
    name = "format_string('s%03d_%06d', ({0}) % 40, ({0}) div 40)"
    apart = spark.range(2_000).selectExpr(name.format("id") + " a", name.format("id + 1") + " b")
    assert len(forest_levels(apart, edges_per_range=50, least_ranges=40)) <= 11
    hub = spark.range(3_000).selectExpr("'hub' a", "format_string('x%06d', id) b")
    assert connected_components(hub, 100, 4).groupBy("group").count().collect() == [("hub", 3_001)]


def test_no_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, [("x", "x"), (None, None)]) == {}


def test_strengths_recover_an_order_despite_uneven_counts(spark):
    rnd = random.Random(4)
    true = {f"p{k}": 1.6**k for k in range(8)}
    rows = []
    for _ in range(3000):
        a, b = rnd.sample(sorted(true), 2)
        if rnd.random() < 0.5:
            a = "p5"  # in half of all comparisons
        if a != b:
            w, x = (a, b) if rnd.random() < true[a] / (true[a] + true[b]) else (b, a)
            rows.append((w, x, 1.0, "clash"))
    rows += [("top", "p7", 1.0, ""), (None, "p1", 1.0, ""), ("p1", " ", 1.0, ""), ("p1", "p1", 1.0, ""), ("p1", "p2", 0.0, "")]
    df = spark.createDataFrame(rows, "winner string, loser string, weight double, item string")
    for limit in (1_000_000,):
        got = distributed_rank(item_strengths(df, tolerance=0.005, broadcast_items=limit)).orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
        assert [r["item"] for r in got if r["item"] != "top"] == sorted(true, reverse=True)


def test_no_comparisons(spark):
    assert item_strengths(spark.createDataFrame([], "winner string, loser string, weight double")).count() == 0


def test_comparisons(spark):
    kills = spark.createDataFrame([(1, " a", "b "), (1, " a", "b "), (2, "a", "a"), (3, None, "b"), (4, "a", "b")], "id long, attacker string, victim string")
    assert [tuple(r) for r in usable_kills(kills).collect()] == [("a", "b")] * 2


def test_every_place_beats_all_earlier_ones_whatever_is_tied(spark):
    kills = spark.createDataFrame([(1, "x", "y")], "id long, attacker string, victim string")
    rows = [(" m", "out", 1)] + [("m", f"s{k}", 9) for k in range(5)] + [("m", "mid", 4), ("m", "mid", 4), ("t", "only", 1), ("t", "tied", 1)]
    places = spark.createDataFrame(rows, "match_id string, player string, kill_order_out int")
    got = {(r.winner, r.loser): r.weight for r in feed_comparisons(kills, places).collect()}
    pairs = {("mid", "out")} | {(f"s{k}", loser) for k in range(5) for loser in ("out", "mid")}
    assert set(got) == pairs | {("x", "y")} and got["x", "y"] == 1.0
    assert all(abs(got[p] - 2 * 0.05 / 7) < 1e-12 for p in pairs)


def test_strengths_are_the_stationary_distribution(spark):
    rnd = random.Random(7)
    rows = [(f"p{i}", f"p{j}", 1.0) for i in range(40) for j in (i + 1, i + 2) if j < 40 for _ in range(1 + rnd.randrange(3))]
    rows += [(f"p{j}", f"p{i}", 1.0) for i in range(40) for j in (i + 1,) if j < 40 and rnd.random() < 0.5]  # a long chain settles slowly
    s = {f"p{i}": 1.0 for i in range(40)}
    for _ in range(5000):
        into, out = ({k: 0.5 / (v + 1) for k, v in s.items()} for _ in range(2))
        for w, x, n in rows:
            into[w] += n * s[x] / (s[w] + s[x])
            out[x] += n / (s[w] + s[x])
        s = {k: into[k] / out[k] for k in s}
        level = 1.0
        for v in s.values():
            level *= v ** (1 / len(s))
        s = {k: v / level for k, v in s.items()}
    df = spark.createDataFrame(rows, "winner string, loser string, weight double")
    got = {r["item"]: r.strength for r in item_strengths(df).collect()}
    assert all(abs(got[k] / v - 1) < 1e-4 for k, v in s.items())
    few = df.where("winner in ('p0', 'p1', 'p2', 'p3', 'p4') and loser in ('p0', 'p1', 'p2', 'p3', 'p4')")
    named = few.selectExpr("explode(array(winner, loser, ' never met', null, ' ')) item")
    vectors, tables = ({r["item"]: r.strength for r in item_strengths(few, items=named, broadcast_items=n, tolerance=1e-3).collect()} for n in (1_000_000, 0))
    plain = {r["item"]: r.strength for r in item_strengths(few, tolerance=1e-3).collect()}
    assert set(vectors) == set(tables) == set(plain) == {"p0", "p1", "p2", "p3", "p4"}
    assert all(abs(tables[k] / v - 1) < 1e-6 and abs(plain[k] / v - 1) < 1e-9 for k, v in vectors.items())
    with pytest.raises(ArithmeticError):
        item_strengths(df, most_steps=3)
