import random

from feedloom.llm.runs import canonical_values, collapse_runs

SCHEMA = "key string, us long, id long, value string, bucket string, session string"


def brute(rows, gap):
    rows = sorted({r[:4] for r in rows if r[0] is not None and r[1] is not None}, key=lambda r: (r[0], r[1], r[2]))
    out, run = [], None
    for key, us, i, value in rows:
        if run and run[0] == key and run[1] == value and us - run[3] <= gap and value is not None:
            run[3] = us
            run[4].append(i)
        else:
            run = [key, value, us, us, [i]]
            out.append(run)
    return sorted((k, v, s, e, min(i), max(i), len(i)) for k, v, s, e, i in out if v is not None)


def test_against_brute_force_with_runs_over_buckets(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.randrange(3000), i, rnd.choice(["x", "x", "y", None]), "c", "c") for i in range(500)]
    rows += rows[:40] + [(None, 5, 900, "x", "", ""), ("a", None, 901, "x", "", "")]
    rows += [("c", 10 * k, 1000 + k, "z", "", "") for k in range(300)]  # one run over many buckets
    for bucket in (7, 50, 10_000):
        got = collapse_runs(spark.createDataFrame(rows, SCHEMA), 12, bucket)
        assert sorted((r.key, r.value, r.start_us, r.end_us, r.min_id, r.max_id, r.events) for r in got.collect()) == brute(rows, 12)


def test_empty(spark):
    assert collapse_runs(spark.createDataFrame([], SCHEMA), 10).count() == 0


def test_canonical_values(spark):
    ev = spark.createDataFrame([("s", 1, 1, " Bob ", "al"), ("s", 2, 2, "Bobby", None), ("s", 3, 3, "", "al")], "key string, us long, id long, attacker string, victim string")
    names = spark.createDataFrame([("al", "Alan")], "name string, canonical string")
    got = {r.id: r.value for r in canonical_values(ev, names, "attacker", "victim").collect()}
    assert got == {1: "Bob\nAlan", 2: None, 3: None}
