import random

import pytest

from feedloom.llm.spellings import TWO_EDITS, _by_head, attribute, keys_of, log_likelihood, parse, spelling_counts, variant_pairs, fold


@pytest.mark.parametrize(
    "name, number, letters",
    [
        ("[AB1] Jolly_Kemoturi_3238", "3238", "jollykemoturi"),
        ("HCG TenderKekavome6844", "6844", "tenderkekavome"),
        ("3238 Jolly Kemoturi", "3238", "jollykemoturi"),
        ("50JollyKemoturi", "50", "jollykemoturi"),
        ("4nxiousDodarue6512", "6512", "anxiousdodarue"),
        ("9rurnpyDazopanume", "", "grurnpydazopanume"),
        ("GRUMPYDAZOPANUME", "", "grumpydazopanume"),
        ("1234", "1234", ""),
        ("Bob_12345", "12345", "bob"),
        ("007123456789 Bob", "007123456789", "bob"),
        ("--", "", ""),
        ("x" * 5000, "", "x" * 5000),
    ],
)
def test_parse(name, number, letters):
    assert parse(name)[:2] == (number, letters)


def pairs(spark, counts):
    df = spark.createDataFrame([(k, v) for k, v in counts.items()], "name string, n long")
    return {(r.name_a, r.name_b) for r in variant_pairs(attribute(df)).collect()}


def closed(*groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def test_channels_and_false_friends(spark):
    player = {
        "Dorothea_Mudolero_9937": 90, "dorothea mudolero 9937": 9, "D. Mudolero 9937": 8, "Dot_Mudolero_9937": 4, "Drth_Mudolero_9937": 5,
        "Mudolero_Dorothea_9937": 6, "[XX] Dorothea_Mudolero_9937": 3, "D0rothca_Mudo1ero_9937": 2, "Dorothea_Mudoleor_9937": 2, "Dorothea_Mudlero_9937": 1,
    }
    other_number = {"Dorothea_Mudolero_9938": 50}
    plain = {"Wistful Namakarupo": 40, "WistfulNamakaarupo": 2, "vvistfulnamakarupo": 2, "W.Namakarupo": 3}
    words = {f"{w}{n}": 5 for w in ("Harrow", "Marrow") for n in (1076, 2423, 3123, 4452, 9178)}
    got = pairs(spark, player | other_number | plain | words)
    assert got == closed(player, plain)


def test_counts_are_of_rows_and_blank_names_are_missing(spark):
    df = spark.createDataFrame([(1, " a ", "x"), (1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "  ", "x")], "row long, name string, n string")
    assert [(r.name, r.n) for r in spelling_counts(df.select("row", "name")).collect()] == [("a", 2)]


def test_empty(spark):
    assert attribute(spark.createDataFrame([], "name string, n long")).count() == 0


def test_letterless_and_huge_names(spark):
    assert pairs(spark, {"1234": 5, "---": 3, "x" * 3000: 2, "x" * 3001: 1, "é" * 12: 2}) <= {("x" * 3000, "x" * 3001)}


def test_order_of_rows_does_not_matter(spark):
    counts = {f"Velvet_Rulakite_{k}": 20 for k in range(1000, 1020)} | {f"Vlvt Rulakite {k}": 3 for k in range(1000, 1020)}
    items = list(counts.items())
    random.Random(1).shuffle(items)
    assert pairs(spark, counts) == pairs(spark, dict(items)) == closed(*[(f"Velvet_Rulakite_{k}", f"Vlvt Rulakite {k}") for k in range(1000, 1020)])


def test_numbers_of_any_length_are_compared_whole(spark):
    assert pairs(spark, {"Bob_12345": 9, "Bob_72345": 5, "Bob_2345": 4, "bob 12345": 2}) == {("Bob_12345", "bob 12345")}


def test_pet_names_are_learned_from_the_data(spark):
    """'Zed' for 'Ferdinand' is in no list; two players use it, a third one has it without a number."""
    counts = {f"Ferdinand_{r}_{k}": 30 for k, r in ((1111, "Mokatulo"), (2222, "Ribanesu"), (3333, "Tavolime"))}
    counts |= {"Zed_Mokatulo_1111": 4, "Zed_Ribanesu_2222": 3, "Ferdinand Gorumatesi": 9, "Zed Gorumatesi": 2, "Otto_Tavolime_3333": 2}
    want = closed({"Ferdinand_Mokatulo_1111", "Zed_Mokatulo_1111"}, {"Ferdinand_Ribanesu_2222", "Zed_Ribanesu_2222"}, {"Ferdinand Gorumatesi", "Zed Gorumatesi"})
    assert pairs(spark, counts) == want


def test_every_pair_that_the_channel_allows_shares_a_key():
    rnd = random.Random(5)
    pets = _by_head([("dorothea", "dot"), ("dorothea", "thea"), ("william", "bill")])
    letters = "abcimvwrnlue"
    seen = 0
    for trial in range(6000):
        number = rnd.choice(["", "12", "3456"])
        size = rnd.choice([3, 5, 8, 9, 10, 11, 12, 13, 18, 41, 43])
        a = "".join(rnd.choice(letters) for _ in range(size))
        if trial % 4 == 0:
            a = rnd.choice(["dorothea", "dot", "william", "thea"]) + a
        b = a
        kind = rnd.randrange(4)
        if kind == 0:
            b = rnd.choice(["dorothea", "dot", "bill", a[:1], a[:2]]) + a[rnd.randrange(1, 9) :]
        elif kind == 1:
            k = rnd.randrange(len(a))
            b = a[k:] + a[:k]
        else:
            for _ in range(kind - 1):
                k = rnd.randrange(len(b) + 1)
                b = rnd.choice([b[:k] + rnd.choice(letters) + b[k:], b[:k] + b[k + 1 :], b[:k] + rnd.choice(letters) + b[k + 1 :], b[:k] + b[k : k + 2][::-1] + b[k + 2 :]])
        if not a or not b:
            continue
        ways = [log_likelihood((number, x, fold(x), "", 0), (number, y, fold(y), "", 0), pets) for x, y in ((a, b), (b, a))]
        if any(w is not None for w in ways):
            seen += 1
            for crowded in {number == "", True}:
                assert keys_of(number, a, crowded, pets) & keys_of(number, b, crowded, pets), (number, a, b, crowded)
    assert seen > 3000 and TWO_EDITS == 9
