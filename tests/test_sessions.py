import datetime as dt
import random

from feedloom.operators.sessions import SessionTable, local_sessions, sessionize_in_batches, usable_events
from feedloom.session import fresh_path

T0 = dt.datetime(2024, 1, 1, 23, 59, 0)
SCHEMA = "id long, streamer string, timestamp timestamp_ntz, created_at long, key string, us string"


def brute(rows, gap=90_000_000):
    by = {}
    for id_, streamer, ts, *_ in set(rows):
        if streamer and streamer.strip(" ") and ts is not None:
            by.setdefault(streamer.strip(" ").lower(), []).append((int((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)), id_))
    out = []
    for key, events in by.items():
        events.sort()
        part = [events[0]]
        for e in events[1:]:
            if e[0] - part[-1][0] > gap:
                out.append((key, part))
                part = []
            part.append(e)
        out.append((key, part))
    return sorted((k, p[0][0], p[-1][0], min(i for _, i in p), max(i for _, i in p), len(p)) for k, p in out)


def made(df):
    return sorted((r.key, r.start_us, r.end_us, r.min_id, r.max_id, r.events) for r in df.collect())


def sample(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        name = rnd.choice(["A", " a ", "b", None, "  ", "B "])
        ts = None if rnd.random() < 0.05 else T0 + dt.timedelta(seconds=rnd.choice([rnd.random() * 20000, rnd.randrange(0, 20000, 90)]))
        rows.append((i, name, ts, rnd.randrange(100), "clash", "clash"))
    return rows + rnd.sample(rows, n // 10)


def test_edges_of_the_gap(spark):
    us = dt.timedelta(microseconds=1)
    gap = dt.timedelta(seconds=90)
    rows = [(1, "x", T0, 1, "", ""), (2, "X ", T0 + gap, 1, "", ""), (3, "x", T0 + 2 * gap + us, 1, "", ""), (3, "x", T0 + 2 * gap + us, 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = made(local_sessions(usable_events(df)))
    assert [(a, b, n) for _, _, _, a, b, n in got] == [(1, 2, 2), (3, 3, 1)]


def test_batches_equal_brute_force_and_one_batch(spark):
    rows = sample(600, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert made(local_sessions(usable_events(df))) == want
    assert made(sessionize_in_batches(df, batches=4)) == want


def test_late_batch_bridges_stored_sessions_across_midnight(spark):
    t = lambda s: T0 + dt.timedelta(seconds=s)
    first = [(1, "s", t(0), 0, "", ""), (2, "s", t(150), 0, "", ""), (9, "s", t(90000), 0, "", "")]
    late = [(3, "s", t(75), 0, "", "")]
    table = SessionTable(spark, fresh_path(spark, "test"))
    table.apply(usable_events(spark.createDataFrame(first, SCHEMA)))
    assert len(made(table.read())) == 3
    before = table.store.manifest()
    table.apply(usable_events(spark.createDataFrame(late, SCHEMA)))
    assert made(table.read()) == brute(first + late)
    assert table.store.manifest().version == before.version + 1


def test_empty_and_unusable(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sessionize_in_batches(df).count() == 0
    df = spark.createDataFrame([(1, None, T0, 1, "", ""), (2, "a", None, None, "", "")], SCHEMA)
    assert sessionize_in_batches(df).count() == 0


def test_rows_that_come_again_count_once_and_far_days_stay(spark):
    t = lambda d, s: T0 + dt.timedelta(days=d, seconds=s)
    rows = [(k, "s", t(d, s), 0, "", "") for k, (d, s) in enumerate([(0, 0), (0, 60), (3, 5), (9, 0), (9, 50)])]
    table = SessionTable(spark, fresh_path(spark, "test"), seen=True)
    table.apply(usable_events(spark.createDataFrame(rows, SCHEMA)))
    folder = dict(table.store.manifest().buckets)
    table.apply(usable_events(spark.createDataFrame([rows[1], rows[1], (7, "s", t(0, 100), 0, "", ""), (8, "s", t(9, 90), 0, "", "")], SCHEMA)))
    assert made(table.read()) == brute([*rows, (7, "s", t(0, 100), 0, "", ""), (8, "s", t(9, 90), 0, "", "")])
    after = table.store.manifest().buckets
    days = sorted(map(int, after))
    assert after[str(days[1])] == folder[str(days[1])] and after[str(days[0])] != folder[str(days[0])] and after[str(days[2])] != folder[str(days[2])]
    assert table.store.vacuum() == 0
    table.apply(usable_events(spark.createDataFrame([(k + 20, "s", t(d, 7), 0, "", "") for k, d in enumerate((0, 3, 9))], SCHEMA)))
    assert table.store.vacuum() >= 1 and sum(r.events for r in table.read().collect()) == 10
