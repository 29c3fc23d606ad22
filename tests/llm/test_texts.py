import random

import pytest

from feedloom.llm.mixing import mix, sainte_lague
from feedloom.llm.packing import best_fit, exact_patterns, pack
from feedloom.llm.sentences import sentence_ends, sentences


@pytest.mark.parametrize(
    "text, parts",
    [
        ("We met at 9 p.m. Tuesday to talk. It was late.", ["We met at 9 p.m. Tuesday to talk.", "It was late."]),
        ("We removed logs, etc. No change.", ["We removed logs, etc.", "No change."]),
        ("Check logs, crops, etc. before you post.", ["Check logs, crops, etc. before you post."]),
        ('He told me: "Do not touch it! It stops." Really?', ['He told me: "Do not touch it! It stops."', "Really?"]),
        ("Er schrieb: „Läuft wieder. Danke.“ und schloss den Fall.", ["Er schrieb: „Läuft wieder. Danke.“ und schloss den Fall."]),
        ("Am 15. März lief es. Die 4. Runde u. a. hängt.", ["Am 15. März lief es.", "Die 4. Runde u. a. hängt."]),
        ("Il a écrit : « Ça marche. Merci. » et il est parti. Fini !", ["Il a écrit : « Ça marche. Merci. » et il est parti.", "Fini !"]),
        ("他说：“掉线了。又掉线了。”然后就走了。日志里写着「完成。」我等了很久……还是正常。", ["他说：“掉线了。又掉线了。”然后就走了。", "日志里写着「完成。」", "我等了很久……还是正常。"]),
        ("彼は「落ちた。また落ちた。」と書いた。「動きました。」", ["彼は「落ちた。また落ちた。」と書いた。", "「動きました。」"]),
        ("ทำไมตารางค้าง ภาพในรอบที่3หาย", ["ทำไมตารางค้าง", "ภาพในรอบที่3หาย"]),
        ('그는 "끊겼다. 또 끊겼다."라고 썼다.', ['그는 "끊겼다. 또 끊겼다."라고 썼다.']),
        ("डॉ. ओसविन ने फ़ाइल भेजी। यह ठीक है।", ["डॉ. ओसविन ने फ़ाइल भेजी।", "यह ठीक है।"]),
        ("كتب د. أوسوين: «توقف.» ثم غادر. لماذا يتوقف؟", ["كتب د. أوسوين: «توقف.» ثم غادر.", "لماذا يتوقف؟"]),
        ("It is dead. notes.v2.txt was empty. tau0 is None.", ["It is dead.", "notes.v2.txt was empty.", "tau0 is None."]),
        ("See https://a.b/c?d=1.5 first. Wait... does it load? I waited ... and left.", ["See https://a.b/c?d=1.5 first.", "Wait... does it load?", "I waited ... and left."]),
        ("1. One.\n\n2. Two\n\n> - quoted\ntext", ["1. One.", "2. Two", "> - quoted\ntext"]),
        ("Before\n```py\nx = 1. Not a sentence.\n```\nAfter", ["Before", "After"]),
        ("a\r\nb\r\n\r\nc", ["a\r\nb", "c"]),
        ("```\nopen. Code.", []),
        ("Is it (worse!) both? (It was fine before.) Yes", ["Is it (worse!) both?", "(It was fine before.)", "Yes"]),
        ("I restarted the app. 3 times it crashed.", ["I restarted the app.", "3 times it crashed."]),
        ("He is in the state of the art. 5 people saw it.", ["He is in the state of the art.", "5 people saw it."]),
        ("Voir l'art. 5 de la charte. Fini.", ["Voir l'art. 5 de la charte.", "Fini."]),
        ("It took 40 ms. Then it froze. Ms. Tavell saw it.", ["It took 40 ms.", "Then it froze.", "Ms. Tavell saw it."]),
        ("Me dijo que no. 5 personas lo vieron.", ["Me dijo que no.", "5 personas lo vieron."]),
        ("Il a écrit : « " + "Ça marche. " * 200 + "Merci. » Fini !", ["Il a écrit : « " + "Ça marche. " * 200 + "Merci. »", "Fini !"]),
        ("- 12) " + "x" * 300 + ". Next", ["- 12) " + "x" * 300 + ".", "Next"]),
        ("", []), (None, []), (" \n\t ", []), ("---\n\n>", []),
    ],
)
def test_sentences(text, parts):
    ends = sentence_ends(text)
    assert len(ends) == len(parts)
    for end, part in zip(ends, parts):
        assert text[:end].endswith(part)


def test_sentences_of_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 50_000 + "end. Next", "x")], "doc_id long, text string, char_end string")
    got = sentences(df).collect()
    assert [(r.doc_id, r.char_end) for r in sorted(got)] == [(1, 4), (1, 9), (4, 250_004), (4, 250_009)]
    assert sentences(df.where("doc_id = 2")).count() == 0


def test_exact_patterns_fill_and_respect_counts():
    rnd = random.Random(1)
    counts = {}
    for _ in range(3000):
        x = rnd.randrange(1, 300)
        counts[x] = counts.get(x, 0) + 1
    patterns, left = exact_patterns(counts, 256) if max(counts) <= 256 else exact_patterns({k: v for k, v in counts.items() if k <= 256}, 256)
    used = {}
    for p in patterns:
        assert sum(p) == 256 and len(p) <= 4
        for x in p:
            used[x] = used.get(x, 0) + 1
    assert all(used.get(x, 0) + left.get(x, 0) == n for x, n in counts.items() if x <= 256)


def test_best_fit():
    boxes = best_fit({6: 1, 5: 1, 4: 1, 3: 1, 2: 2}, 10)
    assert sorted(map(sorted, boxes)) == [[2, 2], [2, 3, 5], [4, 6]][1:] + [[2]] or sorted(map(sorted, boxes)) == [[2], [2, 3, 5], [4, 6]]
    assert all(sum(b) <= 10 for b in boxes)


@pytest.mark.parametrize("shard", [20_000, 50])
def test_pack_keeps_every_token(spark, shard):
    rnd = random.Random(3)
    items = [(k, rnd.choice([0, None, 1, 64, 64, 200, 1000, rnd.randrange(1, 120)]), "x") for k in range(300)]
    df = spark.createDataFrame(items, "item long, size long, spec string")
    specs = spark.createDataFrame([("s", 64), ("m", 256), ("bad", 0), ("none", None)], "spec string, capacity long")
    rows = pack(df, specs, shard).collect()
    assert {r.spec for r in rows} == {"s", "m"}
    for spec, capacity in (("s", 64), ("m", 256)):
        of_item, of_box = {}, {}
        for r in (r for r in rows if r.spec == spec):
            of_item.setdefault(r.item, []).append(r.size)
            of_box.setdefault((r.shard, r.container), []).append((r.size, r.fill))
        assert {k: sum(v) for k, v in of_item.items()} == {k: n for k, n, _ in items if n}
        for k, v in of_item.items():
            assert len(v) == 1 or (sum(v) > capacity and sorted(v)[1:] == [capacity] * (len(v) - 1))
        assert all(sum(s for s, _ in v) == v[0][1] <= capacity for v in of_box.values())
    assert pack(df.where("1 = 0"), specs).count() == 0


def test_sainte_lague():
    assert sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    assert sainte_lague({"a": 1, "b": 1}, 3) == {"a": 2, "b": 1}
    assert sainte_lague({"a": 9, "b": 1}, 10, {"a": 4, "b": 100}) == {"a": 4, "b": 6}
    assert sainte_lague({}, 5) == {} and sainte_lague({"a": 0}, 5) == {"a": 0}
    assert sainte_lague({"a": 1, "b": 2}, 9, {"a": 1, "b": 1}) == {"a": 1, "b": 1}


def test_mix_reaches_targets_and_caps(spark):
    rnd = random.Random(9)
    docs = [(k, rnd.choice(["big", "big", "big", " big ", "mid", "mid", "tiny", None, "other"]), rnd.randrange(0, 400), "x") for k in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, uses string")
    goals = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.5, 4), ("never", None, 1)], "source string, target_share double, max_repeats int")
    selection, report = mix(df, goals, docs_per_cell=500)
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"big", "mid", "tiny", "absent", "other"}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(by[s].reached_share - share) < 0.02 and by[s].most_uses <= by[s].max_repeats
    assert by["absent"].tokens_used == by["other"].tokens_used == 0
    assert selection.groupBy("doc_id").count().where("count > 1").count() == 0
    again = {tuple(r) for r in mix(df.repartition(7), goals, docs_per_cell=500)[0].collect()}
    assert again == {tuple(r) for r in selection.collect()}
    assert mix(df.where("1 = 0"), goals)[0].count() == 0


def test_a_short_source_does_not_shrink_the_others(spark):
    docs = [(k, "big", 100, "question") for k in range(2000)] + [(5000 + k, "mid", 100, "question") for k in range(900)]
    docs += [(9000, "scarce", 10, "question"), (9001, None, 5000, "question"), (9002, "other", 5000, "question")]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, doc_type string")
    goals = spark.createDataFrame([("big", 0.58, 1), ("mid", 0.3, 2), ("scarce", 0.02, 4), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    selection, report = mix(df, goals, of_all=True)
    by, total = {r.source: r for r in report.collect()}, 300_010
    for s, share in (("big", 0.58), ("mid", 0.3)):
        assert abs(by[s].tokens_used / total - share) < 0.01 and abs(by[s].reached_of_all - share) < 0.01
    assert by["scarce"].tokens_used == 40 and by["scarce"].missing_tokens == round(0.02 * total) - 40
    assert by["absent"].tokens_used == 0 and by["absent"].missing_tokens == round(0.1 * total)
    assert all(r.most_uses <= r.max_repeats for r in by.values())


def test_p8_gives_all_tokens_as_the_total(spark, tmp_path):
    from feedloom.llm.text_queries import p8_shares

    texts = [(k, "big", "some words of a text " * 40) for k in range(300)] + [(900, "scarce", "short")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    goals = [("big", 0.9, 1), ("scarce", 0.1, 4)]
    spark.createDataFrame(goals, "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/source_targets.parquet")
    got = {r.source: r for r in p8_shares(spark, str(tmp_path)).collect()}
    assert got["big"].tokens_used > 0.88 * got["big"].tokens_available and got["scarce"].tokens_used == 4 * got["scarce"].tokens_available
