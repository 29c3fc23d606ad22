from feedloom.functions.fixed import CHARACTERS
from feedloom.functions.names import resolve, resolve_in_time
from feedloom.operators import evaluation as E
from feedloom.operators.identity import cluster_names, key_edges
from feedloom.operators.joins import nearest, overlapping, within
from feedloom.operators.quality import snapshot_diff

ROW = "game string, id long, us long, attacker string, victim string"
S = 1_000_000


def test_scores_and_misses(spark):
    truth = spark.createDataFrame([("g", 1, 0, "a", "victimone"), ("g", 2, 10 * S, "a", "victimtwo"), ("g", 3, 500 * S, "b", "gone")], ROW)
    reads = spark.createDataFrame([("g", 11, 5 * S, "a", "v1ctimone"), ("g", 12, 6 * S, "a", "victimone"), ("g", 13, 900 * S, "b", "gone")], ROW)
    got = E.scores(truth, reads).first()
    assert (got.matched, got.recall_pct, got.precision_pct) == (2, 66, 66)
    texts = spark.createDataFrame([("g", 11 * S, "xx victimtwo yy")], "game string, us long, text string")
    m = E.misses(truth, reads, texts).first()
    assert m.never_captured + m.lost_downstream == 3 - got.matched


def test_joins_in_time(spark):
    a = spark.createDataFrame([("k", 1, 100), ("k", 2, 10_000), ("q", 3, 5)], "key string, id long, us long")
    b = spark.createDataFrame([("k", "x", 90), ("k", "y", 110), ("k", "z", 125)], "key string, name string, at long")
    assert sorted((r.id, r.name) for r in within(a, b, ["key"], "us", "at", 10).collect()) == [(1, "x"), (1, "y")]
    assert {r.id: (r.name, r.distance_us) for r in nearest(a, b, ["key"], "id", "us", "at", "name").collect()} == {1: ("x", 10), 2: ("z", 9875)}
    spans = spark.createDataFrame([("a", 0, 10), ("b", 13, 20), ("c", 40, 50), ("d", 0, 100)], "id string, s long, e long")
    assert sorted((r.id_a, r.id_b) for r in overlapping(spans, "s", "e", "id", 3, 7).collect()) == [("a", "b"), ("a", "d"), ("b", "d"), ("c", "d")]


def test_clusters(spark):
    rows = [("Jimmy", 9, 1, 1, 1.0), ("jimmy", 5, 1, 1, 1.0), ("jimmyy", 5, 1, 1, 1.0), ("Robert", 4, 1, 1, 1.0), ("iakme", 2, 1, 1, 1.0), ("lakme", 1, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "player string, matches_played int, total_kills int, total_deaths int, peak_elo double")
    got = {r.player: r.canonical for r in cluster_names(df, CHARACTERS).collect()}
    assert got["jimmy"] == got["jimmyy"] == "Jimmy" and got["lakme"] == "iakme" and "Robert" not in got


def test_resolution(spark):
    d = spark.createDataFrame([("Jimmy", "Jimmy", 20, False), ("Jimmy", "J1mmy", 2, False), ("Gibraltar", "Gibraltar", 5, True)], "canonical string, variant string, seen int, protected boolean")
    names = spark.createDataFrame([("J1mmy",), ("Gibra1tar",), ("abc",), ("Nobody",)], "name string")
    assert {r.name: r.canonical for r in resolve(names, d).collect()} == {"J1mmy": "Jimmy", "Gibra1tar": "Gibraltar", "abc": "abc", "Nobody": "Nobody"}


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("y", 3), ("z", None), ("w", 4)], "k string, v int")
    assert sorted((r.k, r.what) for r in snapshot_diff(a, b, "k", ["v"]).collect()) == [("w", "added"), ("x", "removed"), ("y", "changed")]


def test_line_text_and_zone(spark):
    boxes = spark.createDataFrame([("l", 0, 40, "Ann"), ("l", 44, 10, "b"), ("l", 60, 30, "c"), ("l", 200, 40, "Bob")], "line string, x int, w int, text string")
    assert E.line_text(boxes, "line").first().text == "Annb c <GUN_ICON> Bob"
    z = E.derive_zone(spark.createDataFrame([("s", 0.7, 0.1, 0.9, 0.2), ("s", 0.6, 0.2, 0.95, 0.5), ("s", 0.1, 0.3, 0.2, 0.4)], "s string, x0 double, y0 double, x1 double, y1 double"), "s").first()
    assert (z.x0, z.y0, z.x1) == (0.6, 0.1, 0.95) and abs(z.y1 - 0.34) < 1e-9


def test_registered_scores_use_the_window_of_the_misses(spark, tmp_path):
    from feedloom.plans.names_eval import QUERIES

    at = "timestamp'2024-05-01 10:00:{}'"
    spark.sql("select 'm' as match_id, 'g' as streamer").write.parquet(f"{tmp_path}/matches.parquet")
    spark.sql(f"select 1L as id, 'm' as match_id, {at.format('00')} as timestamp, 'anna' as attacker, 'victimone' as victim").write.parquet(f"{tmp_path}/match_kills.parquet")
    event = f"select 7L as id, 'G ' as streamer, {at.format('40')} as timestamp, 'anna' as attacker, 'victimone' as victim, 'Kill' as event_type, 'x' as raw_text"
    spark.sql(event).write.parquet(f"{tmp_path}/feed_events.parquet")
    assert QUERIES["ref_j21_q7_scores"](spark, str(tmp_path)).first().matched == 1


def test_all_pairs_for_review(spark, tmp_path):
    import random
    from difflib import SequenceMatcher

    from feedloom.plans.names_eval import QUERIES

    rnd = random.Random(5)
    names = ["abc", "abd", "Casey", "casey", "Xabcde", "Yabcdf", "axbxcxdxe", "aybyczdze", "n" * 70, "n" * 66 + "mmmm", *("".join(rnd.choice("abCd1") for _ in range(rnd.randrange(3, 12))) for _ in range(150))]
    names = sorted(set(names))
    spark.createDataFrame([(n, 9 - k % 5) for k, n in enumerate(names)], "player string, matches_played int").write.parquet(f"{tmp_path}/player_ratings.parquet")
    order = sorted(names, key=lambda n: (-(9 - names.index(n) % 5), n))
    want = {}
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            r = SequenceMatcher(None, a.lower(), b.lower()).ratio()
            if r >= 0.70:
                want[a, b] = round(r, 6)
    rows = QUERIES["ref_j19_j20_review_pairs"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.ratio for r in rows} == want and len(rows) == len(want)
    assert all((r.reason == "different prefix") == (r.a[:3].lower() != r.b[:3].lower()) for r in rows)


def test_blocked_pairs_of_a_large_block(spark, tmp_path):
    from difflib import SequenceMatcher

    from feedloom.plans.names_eval import QUERIES

    names = sorted({f"Jon{k * 7919 % 1000:03d}{'xyz'[k % 3] * (k % 4)}" for k in range(120)} | {"abcd", "abce", "abcdefg"})
    rows = [(n, 5) for n in names] + [("Jon001x9", 1)]
    spark.createDataFrame(rows, "player string, matches_played int").write.parquet(f"{tmp_path}/player_ratings.parquet")
    pairs = [(a, b, SequenceMatcher(None, a.lower(), b.lower()).ratio()) for a in names for b in names if a < b and a[:3].lower() == b[:3].lower()]
    want = sorted((a, b, round(r, 6)) for a, b, r in pairs if r >= 0.8)
    assert sorted(tuple(r) for r in QUERIES["ref_j18_blocked_pairs"](spark, str(tmp_path)).collect()) == want and len(want) > 50


def test_candidates_lose_no_pair(spark):
    import random
    from difflib import SequenceMatcher

    from feedloom.functions.similarity import candidate_pairs

    rnd = random.Random(11)
    names = set()
    for _ in range(140):
        n = "".join(rnd.choice("abcdAB1") for _ in range(rnd.randrange(4, 16)))
        names |= {n, "".join(c for c in n if rnd.random() > 0.1) or "abcd", n[: len(n) // 2] + rnd.choice("xyab") + n[len(n) // 2 :]}
    names = sorted(n for n in names if len(n) >= 4)
    df = spark.createDataFrame([(n,) for n in names], "text string")
    for least in (0.82, 0.85):
        want = {(a, b) for a in names for b in names if a < b and max(SequenceMatcher(None, a.lower(), b.lower()).ratio(), SequenceMatcher(None, b.lower(), a.lower()).ratio()) >= least}
        got = {(r.a, r.b) for r in candidate_pairs(df, None, least).collect()}
        assert want <= got and len(want) > 100


def test_similar_names_are_all_of_them(spark):
    import random
    from difflib import SequenceMatcher

    from feedloom.operators.identity import similar_names

    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("abcA") for _ in range(rnd.randrange(3, 11))) for _ in range(160)})
    rows = [(n, k % 4) for k, n in enumerate(names)]
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = set()
    for k, (a, _) in enumerate(order):
        for b, _ in order[k + 1 :]:
            x, y = a.lower(), b.lower()
            if min(len(x), len(y)) >= 4 and SequenceMatcher(None, x, y).ratio() >= (0.70 if x[:3] == y[:3] else 0.82):
                want.add((a, b))
    assert {(r.a, r.b) for r in similar_names(spark.createDataFrame(rows, "player string, matches_played int")).collect()} == want


def test_resolution_in_time(spark):
    rows = [("k", 0, 1, "Velvet_1234"), ("k", 5 * S, 2, "Velvet_12B4"), ("k", 30 * S, 3, "Velvet_12B4"), ("k", 31 * S, 4, "abc"), ("q", 0, 5, "Other")]
    resolved = spark.createDataFrame([("Velvet_12B4", "Velvet_9999")], "name string, canonical string")
    got = {r.id: r.canonical for r in resolve_in_time(spark.createDataFrame(rows, "key string, us long, id long, name string"), resolved).collect()}
    assert got == {1: "Velvet_1234", 2: "Velvet_1234", 3: "Velvet_9999", 4: "abc", 5: "Other"}


def test_tightened_zone(spark):
    zone = spark.createDataFrame([("s", 0.1, 0.1, 0.9, 0.3), ("t", 0.0, 0.0, 1.0, 0.2)], "s string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([("s", 0.3, 0.15, 0.6, 0.16), ("s", 0.05, 0.15, 0.6, 0.2)], zone.schema)
    got = {r.s: tuple(round(v, 6) for v in r[1:]) for r in E.tighten_zone(zone, boxes, "s").collect()}
    assert got == {"s": (0.28, 0.13, 0.62, 0.18), "t": (0.0, 0.0, 1.0, 0.2)}


def _alike(seed: int, heads: list[str], count: int) -> list[str]:
    import random

    rnd = random.Random(seed)
    names = {rnd.choice(heads) + "".join(rnd.choice("bdklmnrtv") + rnd.choice("aeiou") for _ in range(4)) + f"{rnd.randrange(10_000)}" for _ in range(count)}
    return sorted(names | {n[:-3] + "x" + n[-2:] for n in list(names)[::9]})


def test_prefixes_of_many_names_leave_few_pairs_to_compare(spark, monkeypatch):
    from difflib import SequenceMatcher

    from feedloom.functions import similarity as S

    monkeypatch.setattr(S, "CELL", 60)
    names = _alike(2, ["Quiet_", "quick_", "mar", "Tin"], 400)
    texts = spark.createDataFrame([(n, n[:3].lower()) for n in names], "text string, head string")
    pairs = [(a, b) for a in names for b in names if a < b and a[:3].lower() == b[:3].lower()]
    want = {(a, b) for a, b in pairs if SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.8}
    got = [tuple(r) for r in S.prefix_pairs(texts, 0.8).collect()]
    assert want <= set(got) and len(got) == len(set(got)) < 1.5 * len(want) < len(pairs) / 20 and len(want) > 40


def test_common_letter_pairs_leave_few_pairs_to_compare(spark, monkeypatch):
    from difflib import SequenceMatcher

    from feedloom.functions import similarity as S

    monkeypatch.setattr(S, "LEAST_BLOCK", 100)
    names = _alike(3, ["Quiet_", "mar", "Tin", "long-"], 350)
    want = {(a, b) for a in names for b in names if a < b and SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.82}
    got = [tuple(r) for r in S.candidate_pairs(spark.createDataFrame([(n,) for n in names], "text string"), None, 0.82).collect()]
    assert want <= set(got) and len(got) == len(set(got)) < 2 * len(want) and len(want) > 30


def test_names_are_read_once_to_be_resolved(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        read.add(1)
        return name

    d = spark.createDataFrame([("Jimmy", "Jimmy", 20, False)], "canonical string, variant string, seen int, protected boolean")
    names = spark.createDataFrame([("J1mmy",), ("Jimmy",), ("Nobody",)], "name string").select(counted("name").alias("name"))
    got = {r.name: r.canonical for r in resolve(names, d, 0.75).collect()}
    assert got == {"J1mmy": "Jimmy", "Jimmy": "Jimmy", "Nobody": "Nobody"} and read.value <= 6


def test_live_coverage_meets_rows_of_its_slot_only(spark):
    import random

    from pyspark.sql import functions as F

    from feedloom.streaming.live import coverage

    rnd = random.Random(4)
    edges = [0, 9 * S, 10 * S, 19 * S, 19 * S - 1, 9 * S + 1, -S, -10 * S, -10 * S - 1]
    a, h = ([("k", k, us) for k, us in enumerate(edges + [rnd.randrange(-60 * S, 200 * S) for _ in range(80)])] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "key string, id long, us long").select("key", "id", F.timestamp_micros("us").alias("ts"))
    got = coverage(frame(a), frame(h))
    want = sorted((i, j) for _, i, s in a for _, j, t in h if s - 10 * S <= t <= s + 9 * S)
    assert sorted((r.anchor, r.hit) for r in got.collect()) == want
    assert "hit_slot" in got._jdf.queryExecution().sparkPlan().toString().split("Join")[1].split("\n")[0]


def test_ratio_with_a_bound_is_the_ratio():
    import random

    from feedloom.functions.similarity import ratio_if_at_least, ratio_of

    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcé1 漢") for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    for a in texts:
        for b in texts:
            r = ratio_of(a, b)
            assert ratio_if_at_least(a, b, 0.7) == (r if r >= 0.7 else None)


def test_clusters_over_several_blocks(spark, monkeypatch):
    from feedloom.functions import similarity as S

    monkeypatch.setattr(S, "LEAST_BLOCK", 5)
    names = [f"{c}ongname{k}{k}{k}{c}" for c in "bdfg" for k in range(4)]
    rows = [(n, 5) for n in names] + [("x" + n[1:-1].upper() + n[-1], 1) for n in names]
    got = {r.player: r.canonical for r in cluster_names(spark.createDataFrame(rows, "player string, matches_played int"), CHARACTERS).collect()}
    assert len(got) == 2 * len(names) - len(set(got.values())) and all(k in got for k, n in rows if n == 1 and k not in got.values())


def _clusters_by_hand(rows, edges):
    """Groups of the names from all pairs and further ``edges``."""
    from difflib import SequenceMatcher

    parent = {n: n for n, _ in rows}

    def top(n):
        return n if parent[n] == n else top(parent[n])

    for a, b in edges:
        parent[top(b)] = top(a)
    rows = [(n, m or 0) for n, m in rows]
    for a, m in rows:
        for b, k in rows:
            if a < b and min(len(a), len(b)) >= 4:
                x, y = (a.lower(), b.lower()) if m >= k else (b.lower(), a.lower())
                if SequenceMatcher(None, x, y).ratio() >= (0.70 if x[:3] == y[:3] else 0.82):
                    parent[top(b)] = top(a)
    groups = {}
    for n in parent:
        groups.setdefault(top(n), set()).add(n)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_clusters_are_those_of_all_pairs(spark, monkeypatch):
    import random

    from feedloom.functions import similarity as S

    for name, value in (("LEAST_BLOCK", 40), ("CELL", 7), ("PAIRS_AT_ONCE", 50)):
        monkeypatch.setattr(S, name, value)
    rnd = random.Random(11)
    names = {"".join(rnd.choice("bdfgBD") for _ in range(rnd.randrange(2, 9))) for _ in range(130)}
    names |= {"pre" + "".join(rnd.choice("kmpt") for _ in range(rnd.randrange(2, 6))) for _ in range(40)}
    rows = [(n, rnd.choice([None, 0, 1, 5])) for n in sorted(names)]
    rows += [(n, 3) for n, _ in rows[::9]]  # repeated, with other matches
    df = spark.createDataFrame(rows, "player string, matches_played int")
    members = {}
    for r in cluster_names(df, []).collect():
        members.setdefault(r.canonical, {r.canonical}).add(r.player)
    assert {frozenset(g) for g in members.values()} == _clusters_by_hand(rows, key_edges(df, []).collect())


def test_clusters_of_many_alike_names_leave_few_edges(spark, monkeypatch):
    from feedloom.functions import similarity as S
    from feedloom.operators import graph

    monkeypatch.setattr(S, "LEAST_BLOCK", 100)
    seen, components = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges, *a, **k: seen.append(edges.count()) or components(edges, *a, **k))
    names = [f"{c}olden{k:03d}marionette" for c in "bg" for k in range(150)]
    got = cluster_names(spark.createDataFrame([(n, 5) for n in names], "player string, matches_played int"), []).collect()
    assert len(got) == len(names) - 1 and {r.canonical for r in got} == {names[0]}
    assert max(seen) < 3 * len(names)  # 44,850 pairs
