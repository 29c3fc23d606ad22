import datetime as dt
import json

from feedloom import schemas
from feedloom.sources import files, sinks


def test_event_csv(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("timestamp,streamer,attacker,victim,attacker_conf,extra\n2024-01-01 00:00:01, s ,A, ,bad,x\nnever,s,A,B,1,x\n2024-01-01 00:00:02,s,,B,0.0,x\n")
    got = [(r.timestamp, r.streamer, r.attacker, r.victim, r.attacker_conf) for r in files.read_event_csv(spark, str(p)).orderBy("timestamp").collect()]
    assert got == [(dt.datetime(2024, 1, 1, 0, 0, 1), "s", "A", None, 0.5), (dt.datetime(2024, 1, 1, 0, 0, 2), "s", None, "B", 0.0)]


def test_json_inputs(spark, tmp_path):
    p = tmp_path / "v.jsonl"
    p.write_text('{"t": 1, "kind": "kill", "attacker": "a", "victim": "b"}\nbroken\n')
    assert [r.victim for r in files.read_json_lines(spark, str(p), schemas.VISION_JSON).collect()] == ["b"]
    d = tmp_path / "d.json"
    d.write_text(json.dumps({"Bob": {"variants": {"Bob": 2, "B0b": 1}, "total_seen": 3, "last_seen": 5.0, "protected": False}}))
    old = files.read_dictionary(spark, str(d))
    both = files.player_dictionary_update(old, old).first()
    assert both.total_seen == 6 and both.variants == {"Bob": 4, "B0b": 2}
    (tmp_path / "bad.json").write_text("{")
    assert files.read_dictionary(spark, str(tmp_path / "bad.json")).count() == 0


def test_crops_and_board(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "20240101_000001_line3_ab12.png").write_bytes(b"x")
    (tmp_path / "s" / "other.png").write_bytes(b"xy")
    got = {r.filename: (r.line, r.hex) for r in files.list_crops(spark, str(tmp_path)).collect()}
    assert got["20240101_000001_line3_ab12.png"] == (3, "ab12") and got["other.png"][0] is None
    html = "<table><tr><td>#1</td><td> A &amp; B </td><td>1,234 RP</td></tr><tr><td>x</td><td>n</td><td>1</td></tr><tr><td>1</td><td>late</td><td>9</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, html.replace("A &amp; B", "C"))], "page_id long, html string")
    assert [tuple(r) for r in files.scrape_board(pages).collect()] == [(1, "A & B", 1234)]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("m1", 1, 5.0), ("m2", 2, 7.0)], "match_id string, n int, peak double")
    new = spark.createDataFrame([("m2", 9, 6.0), ("m3", 3, 1.0)], "match_id string, n int, peak double")
    once = sinks.upsert(t, new, ["match_id"], ("peak",))
    assert sorted(tuple(r) for r in once.collect()) == [("m1", 1, 5.0), ("m2", 9, 7.0), ("m3", 3, 1.0)]
    again = sinks.replace_matches(sinks.replace_matches(t, new), new)
    assert sorted(r.match_id for r in again.collect()) == ["m1", "m2", "m3"]
    path = str(tmp_path / "pub")
    sinks.publish(t, path)
    before = sinks.published(spark, path)
    sinks.publish(once, path)
    assert before.count() == 2 and sinks.published(spark, path).count() == 3
    assert sinks.append_if_empty(spark, str(tmp_path / "b"), lambda: t) and not sinks.append_if_empty(spark, str(tmp_path / "b"), lambda: t)
    assert sinks.delete_ids(t, new.select("match_id"), "match_id").count() == 1
    assert sinks.rename_values(t, ["match_id"], {"m1": "x"}).where("match_id = 'x'").count() == 1


def test_conform(spark):
    df = schemas.conform(spark.createDataFrame([(1, "s")], "id long, streamer string"), schemas.EVENTS)
    row = df.first()
    assert row.read_count == 1 and row.attacker_conf == 1.0 and row.attacker is None and len(df.columns) == 16


def test_small_files_caches_and_backups(spark, tmp_path):
    from feedloom.sources import files as SRC
    from feedloom.sources import sinks as K

    path = str(tmp_path / "cache.json")
    assert K.read_small_file(spark, path) is None
    K.write_small_file(spark, "no json", path)
    assert K.update_cache(spark, path, "a", 1) == {"a": 1} and K.update_cache(spark, path, "ä", [2]) == {"a": 1, "ä": [2]}
    one, two = (spark.createDataFrame([(k, "x|y\nz")], "k int, v string") for k in (1, 2))
    csv = str(tmp_path / "board")
    assert K.write_csv_with_backup(one, csv, "20240101") is None
    backup = K.write_csv_with_backup(two, csv, "20240102")
    read = lambda p: [r.k for r in spark.read.option("header", True).option("multiLine", True).csv(p).collect()]
    assert read(csv) == ["2"] and read(backup) == ["1"]
    K.write_csv_with_backup(one, csv, "20240102")
    assert read(csv) == ["1"] and read(backup) == ["1"]
    assert K.markdown_report(one, "T") == "# T\n\n| k | v |\n| - | - |\n| 1 | x\\|y z |\n"
    assert SRC.probe(spark, csv + "-none", ["k"]) == {"exists": False, "columns": [], "missing": ["k"]}
    assert K.drop_table(spark, csv) and not K.drop_table(spark, csv)


def test_deleted_entries(spark):
    from feedloom.sources.sinks import delete_where

    rows = [("a", 1, 5.0, False), ("b", 9, 5.0, False), ("c", 1, 5.0, True), ("d", 9, None, None), ("e", 9, 1.0, False)]
    df = spark.createDataFrame(rows, "name string, total_seen int, last_seen double, protected boolean")
    names = lambda **kw: sorted(r.name for r in delete_where(df, **kw).collect())
    assert names() == list("abcde") and names(least_seen=2) == list("bcde") and names(last_seen_before=2.0) == list("abcd")
    assert names(least_seen=2, last_seen_before=2.0, names=["c"]) == list("bd")


def test_a_cluster_must_name_the_shared_folder(spark, monkeypatch):
    import pytest

    from feedloom import session

    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError):
        session.shared_folder(type("S", (), {"sparkContext": Context()})())


def test_forgotten_tables_are_gone_and_others_stay(spark):
    import os

    from feedloom.session import forget, materialize

    a, b = (materialize(spark.range(3), "test") for _ in range(2))
    forget(a, spark.range(2))
    assert not os.path.exists(a._materialized) and b.count() == 3
