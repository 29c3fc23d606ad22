import pytest

from feedloom.functions import lines as L
from feedloom.functions import names as N
from feedloom.functions import similarity as S
from feedloom.functions import text as X

MARKER = r"<[^>]*>|\[[^\]]*\]|(?:(?<=\s)x)?>[->]*|-+>|\b(?:(?:gun|kill)icon|eliminated|knocked(?: down)?|killed|down(?:ed)?)\b"
GAME = X.TextRules(common_words=["spotted"], weapons=["R-99", "mag", "longshot"], marker=MARKER)
RULES = X.TextRules(typos={"shieid": "shield"}, common_words=["spotted"], weapons=["R-99", "mag"])


def one(spark, text, make):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, kind",
    [
        ("a <KILL_ICON> b", "Kill"), ("a <gun_icon> b", "Knock"), ("a <gun_icon> b <kill_icon> c", "Kill"), ("squad entered the ring <kill_icon>", None),
        ("x: care package containing y", "CarePackage"), ("My shield broken", "ShieldBroken"), ("a [Bleed Out] b", "BleedOut"), ("a spotted an enemy", "Ping"),
        ("suggested a location", "SuggestLocation"), ("pinged loot", "PingLoot"), ("enemy audio", "Audio"), ("a eliminated b", "Eliminated"), ("nothing", None), (None, None),
    ],
)
def test_event_type(spark, text, kind):
    assert one(spark, text, X.event_type) == kind


@pytest.mark.parametrize("raw, clean", [("..Bob..", "Bob"), ("[ABC]Bob", "Bob"), ("TTV_Bob", "Bob"), ("Bob_spotted an", "Bob"), ("pathfinder1574pathfinder1574", "pathfinder1574"), ("bobbob", "bobbob"), (None, None)])
def test_clean_name(spark, raw, clean):
    assert one(spark, raw, X.clean_name) == clean


@pytest.mark.parametrize("name, weapon", [("r-99", True), ("R99", True), ("maggie8793", False), ("big mag", True), ("120", True), ("1200", False)])
def test_weapons_are_whole_tokens(spark, name, weapon):
    assert one(spark, name, lambda c: X.is_weapon(c, RULES)) is weapon


def test_lines(spark):
    df = spark.createDataFrame([(1, "Ann_1 <skull> [ABC]Bob"), (2, "Ann <skull> ann"), (3, "  <skull> Bob"), (4, None), (5, "x" * 20000)], "id int, raw string")
    got = {r.id: (r.event_type, r.attacker, r.victim) for r in L.parse_lines(df, "raw", GAME).collect()}
    assert got[1] == ("Kill", "Ann_1", "Bob") and got[2] == got[3] == got[4] == (None, None, None) and got[5][0] is None


def test_names_of_tagged_merged_and_digit_lines(spark):
    rows = [
        ("[ZTB]MellowRanukune7784 >> SunnyDamuteki5033", "MellowRanukune7784", "SunnyDamuteki5033"),
        ("[GARF] Noble Venereme 6665 [LONGSHOT] [ZTB]Kindly", "Noble Venereme 6665", "Kindly"),
        ("Alice <gun_icon> Robert <kill_icon> Charles", "Robert", "Charles"),
        ("Alice <kill_icon> 949930934", "Alice", "949930934"), ("3043 <gun_icon> 949930934", None, None), ("11 <gun_icon> 3043 <kill_icon> Alice", None, "Alice"),
        ("[BTA] reo <kill_icon> Shu", "reo", "Shu"), ("Alice x> Robert", "Alice", "Robert"), ("Alice knocked [ABC] Robert", "Alice", "Robert"), ("[ABC] Alice", None, "alice"),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "id int, raw string")
    got = {r.id: (r.attacker, r.victim) for r in L.parse_lines(df, "raw", GAME).collect()}
    assert [got[k] for k in range(len(rows))] == [r[1:] for r in rows]


def test_normalization(spark):
    assert one(spark, "enemyshieid  broken", lambda c: X.fix_typos(c, RULES)) == "enemyshield  broken"
    assert one(spark, "a [blEed 0ur] b", X.normalize_brackets) == "a [Bleed Out] b"
    assert one(spark, "bobspotted you", lambda c: X.fix_missing_spaces(c, RULES)) == "bob spotted you"
    assert one(spark, "[TAG]Kes-trel12", X.stem) == "kestrel"
    assert one(spark, "https://www.site.tv/Some_One/", X.channel_name) == "Some_One"
    assert one(spark, "16 SQUADS LEFT 48 PLAYERS", X.squads_left).asDict() == {"squads": 16, "players": 48}
    assert X.TextRules.from_json("/nonexistent").typos == {}


def test_look_alike_keys(spark):
    k = lambda t: one(spark, t, X.confusion_key)
    assert k("iakme") == k("lakme") and k("axle1456") != k("axle8599")


def test_similarity(spark):
    assert S.ratio_of("maggie5636", "maggie8793") == 0.7
    assert S.ratio_at_least("maggie5636", "maggie8793", 0.7) and not S.ratio_at_least("maggie5636", "maggie8793", 0.71)
    assert S.word_edits(["a", "b"], ["a", "c", "d"]) == 2
    assert S.confusions_of("kitten", "sitten") == [{"kind": "substitute", "truth": "k", "read": "s"}]
    df = spark.createDataFrame([("maggie8793", "maggie5636"), ("wraith5812", "wraith8812"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(S.digit_conflict(df.a, df.b)).collect()] == [True, False, False]


@pytest.mark.parametrize(
    "name, label",
    [("miraqe6442", ("mirage", "6442")), ("oct ane172b", ("octane", "1728")), ("miraqe644b", ("mirage", "6448")), ("Mirage12S", (None, None)), ("Mirage 12S", (None, None)), ("shagots yt", (None, None)), (None, (None, None)), ("octane", (None, None))],
)
def test_default_labels(spark, name, label):
    got = one(spark, name, lambda c: N.default_label(c, ["Mirage", "Octane", "Gibraltar"]))
    assert (got.character, got.number) == label


def test_identities(spark):
    pairs = [("axle8b44", "axlebb44", True), ("iakme", "lakme", True), ("gibraltar2127", "gibraltar1619", False), ("axle1456", "axle8599", False), ("gibraltar2127", "gibraltarzizi", False), ("abc", "abc", False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all(r.same == r.got for r in df.select("same", N.same_identity("a", "b", X.CHARACTERS).alias("got")).collect())


@pytest.mark.parametrize("a, b, within, across", [("Kestrel_12", "kestrel12", True, True), ("Kestrel", "[TAG]Kestrel99", True, True), ("abcd1", "abcdx2", False, True), ("abcdefgh", "abcdexyz", False, True), ("abc", "xyz", False, False), (None, "x", False, False), ("kestre1", "kestrel", True, True)])
def test_tolerant_equality(spark, a, b, within, across):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(N.tolerant_equal("a", "b"), N.tolerant_equal("a", "b", across=True)).first() == (within, across)


NAMES = ["I AM HERE", "you", "spotted", "live", "Octane", "un_icon", "x[Bleed", "[x78]", "-name", "R-99", "evan", "a/b", "one two three", "ab", "1234", "foosuggested", "", None, "Normal_Name", "120"]


def test_no_names_in_both_forms_and_both_engines(spark):
    reader = L.Reader(GAME)
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r.n: (r.free, r.placed) for r in df.select("n", L.no_name("n", GAME).alias("free"), L.no_name("n", GAME, True).alias("placed")).collect()}
    assert got == {n: (reader.no_name(n, False), reader.no_name(n, True)) for n in NAMES}
    assert {n for n, (_, placed) in got.items() if not placed} == {"I AM HERE", "you", "evan", "one two three", "Normal_Name"}
    assert {n for n, (free, _) in got.items() if not free} == {"evan", "Normal_Name"}


@pytest.mark.parametrize(
    "segment, certain, name",
    [
        ("I AM HERE", False, "I AM HERE"), ("[BTA] reo", False, "reo"), ("reo", False, None), ("Shu", True, "Shu"), ("Octane", False, None), ("[Octane]", False, "[Octane]"),
        ("Octane1234", False, "Octane1234"), ("enemy shield broken", False, None), ("longshot Bobby", False, "Bobby"), ("ab", False, None), ("gun_icon Bobby", False, "Bobby"),
    ],
)
def test_names_by_place(segment, certain, name):
    assert L.Reader(GAME).name_by_place(segment, certain=certain) == name


@pytest.mark.parametrize("text, names", [("ge aredmah", ["gearedmah"]), ("the Bobby", ["Bobby"]), ("spotted Bobby and Alice", ["Bobby", "Alice"]), ("[Octane] x", ["[Octane]"]), ("Octane", []), ("ab", [])])
def test_names_in_text(text, names):
    assert L.Reader(GAME).free_names(text) == names


@pytest.mark.parametrize(
    "line, kind, attacker, victim",
    [
        ("Alice <KILL_ICON> Robert", "Kill", "Alice", "Robert"), ("Alice <gun_icon> Robert", "Knock", "Alice", "Robert"), ("Alice gunicon Robert killicon Charles", "Kill", "Robert", "Charles"),
        ("[BTA] reo <KILL_ICON> Shu", "Kill", "reo", "Shu"), ("location revealed <gun_icon> Set", None, None, None), ("Alice <KILL_ICON> 949930934", "Kill", "Alice", "949930934"),
        ("949930934 <gun_icon> Alice", "Knock", "949930934", "Alice"), ("3043 <gun_icon> 949930934", None, None, None), ("Alice <KILL_ICON> alice", None, None, None),
        ("squad entered the ring <KILL_ICON> Alice", None, None, None), ("Alice: care package containing armor", "CarePackage", "Alice", None), ("Champion Alice has been eliminated", "ChampionEliminated", None, "Alice"),
        ("Alice spotted an enemy", "Ping", "Alice", None), ("you spotted an enemy", "Ping", "You", None), ("Alice pinged loot", "PingLoot", "Alice", None), ("you pinged loot", "PingLoot", "You", None),
        ("Alice [Bleed Out] Robert", "BleedOut", "Alice", "Robert"), ("AliceBleed Out] I AM HERE", "BleedOut", "Alice", "I AM HERE"), ("Alice: reviving Robert", "Revive", "Alice", "Robert"),
        ("reviving Robert", "Revive", "You", "Robert"), ("Alice something Robert", None, "Alice", "Robert"), ("OctaneRobert", None, "Robert", None), ("Octane1234 <gun_icon> Robert", "Knock", "Octane1234", "Robert"),
        ("", None, None, None), (None, None, None, None),
    ],
)
def test_every_shape_of_line(spark, line, kind, attacker, victim):
    rules = X.TextRules(common_words=["spotted", "enemy", "something", "loot", "pinged"], weapons=["longshot"])
    df = spark.createDataFrame([(line,)], "raw string")
    got = L.parse_lines(df, "raw", rules).first()
    low = lambda t: t.lower() if t else t
    assert (got.event_type, low(got.attacker), low(got.victim)) == (kind, low(attacker), low(victim))


def test_traces_tell_the_words_and_the_result(spark):
    df = spark.createDataFrame([("Alice <gun_icon> [BTA] Robert",), (None,)], "raw string")
    steps = L.trace_lines(df, "raw", GAME).collect()[0].trace
    assert "behind a tag" in " ".join(steps)
    assert steps[-1] == "Knock: 'Alice' -> 'Robert'"


def test_markers_set_as_decided(spark):
    both = lambda d: one(spark, "A <gil_icon> B <KILL_ICON> C", lambda c: X.apply_marker(c, __import__("pyspark").sql.functions.lit(d)))
    assert both("gun") == "A <GUN_ICON> B <GUN_ICON> C" and both("kill") == "A <KILL_ICON> B <GUN_ICON> C"


@pytest.mark.parametrize("label, tier", [("EMPTY", "noise"), ("", None), (None, None), ("a\nb long", None), ("abc", None), ("I see a line of text", None), ("----abc", None), ("Ann <GUN_ICON> Bob", "high"), ("twelve signs", "medium"), ("short", "low")])
def test_label_tiers(spark, label, tier):
    assert one(spark, label, X.quality_tier) == tier


@pytest.mark.parametrize("path, safe", [("crops/a/b_1.png", True), ("../x", False), ("/etc/x", False), ("a/../b", False), ("a b", False), (None, False), ("", False)])
def test_safe_paths(spark, path, safe):
    assert one(spark, path, X.safe_path) is safe


def test_hashes():
    from feedloom.functions import hashes as H

    image = [float((r * 7 + c * 3) % 11) for r in range(32) for c in range(32)]
    near = [v + 0.01 * (k % 3) for k, v in enumerate(image)]
    far = image[::-1]
    for of in (H.average_hash_of, H.difference_hash_of, H.frequency_hash_of):
        distance = lambda a, b: ((of(a) ^ of(b)) & (2**64 - 1)).bit_count()  # noqa: B023, E731
        assert of(image) == of(list(image)) and distance(image, near) < distance(image, far)
        assert of(None) is None and of([1.0, 2.0, 3.0]) is None and of([]) is None
