import datetime as dt

from feedloom.operators.references import ReferenceState, existence_deltas, fold, orphan_keys, orphan_references, orphan_report, reference_deltas, references

KILLS = "id long, match_id string, timestamp timestamp_ntz, source_event_id long, crop_filename string, extra string, key string"
PLACES = "match_id string, player string, parent string"
T0 = dt.datetime(2024, 1, 1)


def world(spark, kills, places, events=(), crops=(), matches=()):
    refs = references(spark.createDataFrame(kills, KILLS), spark.createDataFrame(places, PLACES))
    return refs, [
        existence_deltas(spark.createDataFrame([(x,) for x in events], "id long"), "feed_events", "id"),
        existence_deltas(spark.createDataFrame([(x,) for x in crops], "filename string"), "crop_labels", "filename"),
        existence_deltas(spark.createDataFrame([(x,) for x in matches], "match_id string"), "matches", "match_id"),
    ]


def test_orphans(spark):
    kills = [
        (1, "m", T0, 10, " a.png ", "", ""), (1, "m", T0, 10, " a.png ", "", ""), (2, "m", T0, 11, "b.png", "", ""),
        (3, "m", None, None, "  ", "", ""),
    ]
    places = [(" m_1514795580 ", " P ", ""), ("gone_1514795580", "Q", ""), ("gone", None, ""), (None, "R", "")]
    refs, have = world(spark, kills, places, [10], ["a.png"], ["m_1514795580"])
    got = orphan_references(refs, fold(reference_deltas(refs), *have))
    assert sorted((r.child_table, r.ref_field, r.row_key) for r in got.collect()) == [
        ("match_kills", "crop_filename", "2"), ("match_kills", "source_event_id", "2"),
        ("match_placements", "match_id", "gone_1514795580|Q"), ("match_placements", "match_id", "gone|"),
    ]
    report = {(r.ref_field, r.day): r.orphans for r in orphan_report(got).collect()}
    assert report[("match_id", dt.date(2018, 1, 1))] == 1 and report[("match_id", None)] == 1


def test_changes_fold_in_any_order(spark):
    keys = lambda *k: spark.createDataFrame([("t", x) for x in k], "parent string, key string")
    plus, minus = reference_deltas(keys("a", "b", "b")), reference_deltas(keys("b"), -1)
    parents = spark.createDataFrame([("a",), ("b",)], "id string")
    state = fold(plus)
    assert {r.key for r in orphan_keys(state).collect()} == {"a", "b"}
    late = fold(state, existence_deltas(parents, "t", "id"))
    assert orphan_keys(late).count() == 0
    deleted = fold(late, existence_deltas(parents.where("id = 'b'"), "t", "id", -1), minus)
    assert [(r.key, r.refs, r.exists) for r in deleted.where("exists = 0").collect()] == [("b", 1, 0)]
    assert {r.key for r in orphan_keys(fold(deleted, minus)).collect()} == set()


def test_empty(spark):
    refs, have = world(spark, [], [])
    assert orphan_references(refs, fold(reference_deltas(refs), *have)).count() == 0


def test_kept_state_through_insertions_late_arrivals_and_deletions(spark):
    from feedloom.session import fresh_path

    keys = lambda *k: spark.createDataFrame([("t", x) for x in k], "parent string, key string")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id string")
    state = ReferenceState(spark, fresh_path(spark, "state"), buckets=4)
    orphans = lambda: {r.key for r in orphan_keys(state.read()).collect()}
    state.apply(reference_deltas(keys("a", "b", "b", "c")), existence_deltas(ids("a"), "t", "id"))
    assert orphans() == {"b", "c"}
    before = dict(state.store.manifest().buckets)
    state.apply(existence_deltas(ids("c"), "t", "id"))  # late
    assert orphans() == {"b"} and sum(before[b] != f for b, f in state.store.manifest().buckets.items() if b in before) <= 1
    state.apply(existence_deltas(ids("a"), "t", "id", -1), reference_deltas(keys("b"), -1))  # deleted
    assert orphans() == {"a", "b"}
    state.apply(reference_deltas(keys("a", "b"), -1), reference_deltas(keys("c"), -1), existence_deltas(ids("c"), "t", "id", -1))
    assert orphans() == set() and state.read().count() == 0
    state.apply(reference_deltas(keys("b")))
    assert orphans() == {"b"}
