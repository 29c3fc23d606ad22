"""Variant spellings of typed names, by noisy-channel attribution.

Distinct spellings are ranked by frequency. Every spelling may stand for a
more frequent one (its candidate canonical form) from which the channel could
have made it: a change of case or separators, a clan tag, look-alike
characters, swapped name parts, an abbreviated or pet first name, or one or two
typing errors. Each is attached to the candidate of highest posterior
(log frequency + log likelihood), or stays canonical itself.

Pet names come from a file (``pet_names``) and from the data: two first parts
that are no typing errors of each other and stand before the same rest and
number for several players are forms of one name.

Candidates meet under keys and are never compared with all others. Every pair
that the channel allows has a key in common, so no link is lost to them:
 - sorted letters: the same letters in another order, case or separators;
 - the last letters with the first one: abbreviated first parts;
 - the rest with the full name behind a pet name;
 - edits: what is left when one or two letters are taken away. Two edits of a
   long name leave its first or its last four letters with one at most, so
   within a number of few spellings these ends alone make the keys.
The number is part of every key, so spellings with different numbers never
meet, and a number with many spellings (or none) takes the keys of the whole
name, under which only spellings within reach of each other meet.

Defined cases: null and blank names are missing; names are compared without
surrounding blanks; names without letters have no variants; the number is the
whole run of digits, however long; of equally frequent spellings the first in
code-point order ranks higher, and a posterior tie goes to the higher rank; one
row may appear any number of times.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import forget, materialize

#: "full name: pet names" a line.
DEFAULT_PET_NAMES = os.path.join(os.path.dirname(__file__), "pet_names.txt")
#: Players for whom two first parts must stand for each other before they count as forms of one name.
LEAST_CONTEXTS = 2
#: Letters at the end that an abbreviation or a pet name leaves as they are, with and without a number.
KEPT, KEPT_UNNUMBERED = 6, 8
#: Letters from which on even crowded numbers take the ends of a name (of twelve letters) as keys.
LONG = 41
#: Letters from which on two edits are allowed, with and without a number.
TWO_EDITS, TWO_EDITS_UNNUMBERED = 9, 12

_LEET = str.maketrans("0123456789", "olzeasbtbg")
_NARROW = str.maketrans({"i": "l", "c": "e", "v": "u"})
_FOLD = str.maketrans({"i": "l", "c": "e", "v": "u", "m": "rn", "w": "uu"})
_TAG = re.compile(r"^(?:\[[^\]]*\]\s*|[A-Z]{2,5} (?=.*[a-z]))")
_SPLIT = re.compile(r"[^0-9A-Za-z\u0080-\U0010ffff]+|(?<=[a-z0-9])(?=[A-Z])")
#: A first part with so many different rests, and so large a share of those of the other one, is no typing error of it.
WORD_RESTS, WORD_SHARE = 3, 0.1
_VOWELS = set("aeiou")


def _letters(text: str) -> str:
    return "".join(ch for ch in text.translate(_LEET).casefold() if ch.isalpha())


def fold(letters: str) -> str:
    """Look-alike letters made one: m/rn, w/vv, i/l, c/e, v/u. Wide letters become two, so parts fold as the whole does."""
    return letters.translate(_FOLD)


def parse(name: str) -> tuple[str, str, str]:
    """(identifying number or '', letters, first part or '' if there is one part only).

    The number is the run of digits at the end, else two or more at the start.
    Digits elsewhere, and one at the end straight after a letter, are look-alikes of letters.
    """
    text = _TAG.sub("", name, count=1) or name
    number = ""
    end = re.search(r"[0-9]+$", text)
    if end and (len(end[0]) > 1 or not text[: end.start()][-1:].isalpha()):
        number, text = end[0], text[: end.start()]
    elif start := re.match(r"[0-9]{2,}", text):
        number, text = start[0], text[start.end() :]
    parts = [p for p in map(_letters, _SPLIT.split(text)) if p]
    return number, "".join(parts), parts[0] if len(parts) > 1 else ("".join(parts) if number else "")


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parsed = [parse(x) for x in pdf["name"]]
        letters = [p[1] for p in parsed]
        yield pd.DataFrame(
            {
                "id": pdf["id"],
                "name": pdf["name"],
                "n": pdf["n"],
                "number": [p[0] for p in parsed],
                "letters": letters,
                "word": [fold(x) for x in letters],
                "first": [p[2] for p in parsed],
            }
        )


def _without(text: str, edits: int) -> set[str]:
    """``text`` and what is left of it when up to ``edits`` letters are taken away. Texts within so many edits share one of them."""
    out = {text}
    last = out
    for _ in range(edits):
        last = {t[:k] + t[k + 1 :] for t in last for k in range(len(t))}
        out = out | last
    return out


def _ends_within_one(text: str, size: int) -> set[str]:
    """Keys of the first and the last ``size`` letters, of which one is edited once at most if the text has two edits."""
    head, tail = text[: size + 1], text[-size - 1 :]
    return {"<" + x for x in _without(head[:-1], 1) | _without(head, 1)} | {">" + x for x in _without(tail[1:], 1) | _without(tail, 1)}


def keys_of(number: str, letters: str, crowded: bool, pets: dict[str, tuple[tuple[str, str], ...]]) -> set[str]:
    """Keys of a spelling; any two that ``log_likelihood`` links have one in common."""
    word = fold(letters)
    if not word:
        return set()
    keys = {"~" + "".join(sorted(word))}
    least = KEPT if number else KEPT_UNNUMBERED
    if len(letters) > least:
        keys.add(f"={letters[0]}{letters[-least:]}")
    for k in range(1, min(len(word) - least, max(map(len, pets), default=0)) + 1):
        keys.update(f"+{person}/{word[k:]}" for _, person in pets.get(word[:k], ()))
    two = TWO_EDITS if number else TWO_EDITS_UNNUMBERED
    # The narrow fold maps letters one by one, so it brings no two texts further apart.
    for text in {word, letters.translate(_NARROW)}:
        if len(text) <= two:
            keys |= _without(text, 1)
        if len(word) >= two:
            # Lengths of both kinds overlap by two, as far as two edits reach.
            if len(text) <= (LONG + 1 if crowded else 10):
                keys |= _without(text, 2)
            if len(text) >= (LONG if crowded else 9):
                keys |= _ends_within_one(text, 12 if crowded else 4)
    return {f"{number}|{k}" for k in keys}


def read_pet_names(path: str | None) -> list[tuple[str, str]]:
    """(full, pet) of a file with lines "full: pet pet"; none without a path."""
    if not path:
        return []
    with open(path, encoding="utf-8") as f:
        lines = [line.partition(":") for line in f if ":" in line]
    return [(full.strip(), pet) for full, _, pets in lines for pet in pets.split()]


def _by_head(pairs: list[tuple[str, str]]) -> dict[str, tuple[tuple[str, str], ...]]:
    """folded form -> (folded form of the same person's name, person); ``pairs`` are (person, pet)."""
    forms: dict[str, list[str]] = {}
    for full, pet in pairs:
        forms.setdefault(full, [full]).append(pet)
    out: dict[str, dict[tuple[str, str], None]] = {}
    for full, names in forms.items():
        for a in names:
            for b in names:
                if fold(a) != fold(b):
                    out.setdefault(fold(a), {})[fold(b), full] = None
    return {k: tuple(v) for k, v in out.items()}


def learned_pet_names(parsed: DataFrame, least_contexts: int = LEAST_CONTEXTS, most: int = 100_000) -> list[tuple[str, str]]:
    """(full, pet): first parts that stand before one rest and number, the more frequent one first, for several players.

    Per rest and number the other first parts are held against the most frequent one, so pairs grow with spellings and
    not with their square. They are bounded by the vocabulary of first names; more than ``most`` are an error.
    """
    rest = F.expr("substr(letters, length(first) + 1)")
    forms = (
        parsed.where("number <> '' and first <> '' and first <> letters")
        .withColumn("rest", rest)
        .where(F.length("rest") >= KEPT)
        .groupBy("number", "rest", "first")
        .agg(F.sum("n").alias("n"))
    )
    top = forms.groupBy("number", "rest").agg(F.max_by("first", F.struct("n", "first")).alias("full"))
    pairs = (
        forms.join(top, ["number", "rest"])
        .where("first <> full and levenshtein(first, full, 2) < 0")
        .groupBy("full", "first")
        .agg(F.count(F.lit(1)).alias("contexts"))
        .where(F.col("contexts") >= least_contexts)
        .select("full", "first")
        .orderBy("full", "first")
        .limit(most + 1)
        .collect()
    )
    if len(pairs) > most:
        raise ValueError(f"more than {most} pairs of first names")
    return [(full, pet) for full, pet in pairs if not (_shortened(pet, full) or _osa(fold(pet), fold(full), 2) <= 2)]


def spelling_counts(*names: DataFrame) -> DataFrame:
    """(name, n): trimmed spellings with the number of different rows that hold them.

    Each input has (row, name): copies of a row have the same ``row``.
    """
    out = names[0]
    for more in names[1:]:
        out = out.unionByName(more)
    return (
        out.select(F.trim("name").alias("name"), "row")
        .where("name <> ''")
        .groupBy("name", "row")
        .agg(F.lit(1).alias("one"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _osa(a: str, b: str, most: int) -> int:
    """Edits incl. swaps of neighbours between a and b; most + 1 if there are more."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return old[-1]


def _shortened(short: str, full: str) -> bool:
    """Whether ``short`` is a beginning of ``full`` or its skeleton without later vowels."""
    return full.startswith(short) or short == full[:1] + "".join(c for c in full[1:] if c not in _VOWELS)


def _abbreviated(short: str, full: str, least: int) -> bool:
    """Whether ``short`` is ``full`` with its beginning shortened and at least ``least`` last letters kept."""
    if not least < len(short) < len(full):
        return False
    tail = 0
    while tail < len(short) and short[-tail - 1] == full[-tail - 1]:
        tail += 1
    # The common tail may reach into the shortened part.
    for kept in range(min(tail, len(short) - 1), least - 1, -1):
        if _shortened(short[: len(short) - kept], full[: len(full) - kept]):
            return True
    return False


def _pet_swap(a: str, b: str, least: int, pets: dict[str, tuple[tuple[str, str], ...]]) -> bool:
    for k in range(1, min(len(a) - least, max(map(len, pets), default=0)) + 1):
        rest = a[k:]
        if b.endswith(rest) and any(form == b[: len(b) - len(rest)] for form, _ in pets.get(a[:k], ())):
            return True
    return False


def log_likelihood(canon: tuple, variant: tuple, pets: dict[str, tuple[tuple[str, str], ...]]) -> float | None:
    """Log likelihood that ``canon`` was typed as ``variant``; None: never. ``pets`` is of ``_by_head``.

    Both are (number, letters, word, first part, number of different rests seen with that first part).
    """
    number, letters_c, c, first_c, rests_c = canon
    _, letters_v, v, first_v, rests_v = variant
    if c == v:
        return -1.0 if letters_c == letters_v else -2.0
    if len(c) == len(v) and len(c) >= 8 and v in c + c:
        return -3.0
    least = KEPT if number else KEPT_UNNUMBERED
    if _abbreviated(letters_v, letters_c, least):
        return -4.0
    if _abbreviated(letters_c, letters_v, least):
        return -5.0
    if _pet_swap(c, v, least, pets) or _pet_swap(v, c, least, pets):
        return -5.0
    if first_c != first_v and fold(first_c) != fold(first_v) and two_words(rests_c, rests_v):
        return None
    length = min(len(c), len(v))
    most = 0 if length < 4 else 1 if length < (TWO_EDITS if number else TWO_EDITS_UNNUMBERED) else 2
    d = min(_osa(c, v, most), _osa(letters_c, letters_v, most))
    return -3.0 - 3.0 * d if d <= most else None


def two_words(rests_a: int, rests_b: int) -> bool:
    """Whether two first parts are words of their own: typing errors of a word are rare beside it."""
    few, many = sorted((rests_a, rests_b))
    return few >= WORD_RESTS and few >= WORD_SHARE * many


def attribute(counts: DataFrame, pet_names: str | None = DEFAULT_PET_NAMES, crowd: int = 200) -> DataFrame:
    """(name, canonical) of every spelling in ``counts`` (name, n).

    A number is crowded with more than ``crowd`` spellings, and more than a ten-thousandth of all.
    """
    parsed = materialize(
        counts.select("name", "n", F.monotonically_increasing_id().alias("id")).mapInPandas(
            _parse_batches, "id long, name string, n long, number string, letters string, word string, first string"
        ),
        "spellings",
    )
    pets = _by_head(read_pet_names(pet_names) + learned_pet_names(parsed))
    bound = max(crowd, parsed.count() // 10_000)
    crowded = parsed.groupBy("number").agg(F.count(F.lit(1)).alias("k")).where(f"k > {bound} or number = ''").select("number", F.lit(True).alias("crowded"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = zip(pdf["number"], pdf["letters"], pdf["crowded"])
            yield pd.DataFrame({"id": pdf["id"], "keys": [sorted(keys_of(g, t, bool(c), pets)) for g, t, c in columns]})

    # At most 10,000 crowded numbers.
    blocked = (
        parsed.select("id", "number", "letters")
        .join(F.broadcast(crowded), "number", "left")
        .select("id", "number", "letters", F.coalesce("crowded", F.lit(False)).alias("crowded"))
        .mapInPandas(keyed, "id long, keys array<string>")
        .select("id", F.explode("keys").alias("key"))
        .select("id", F.xxhash64("key").alias("key"))
    )
    meeting = blocked.join(blocked.select("key", F.col("id").alias("c_id")), "key").where("id < c_id").select("id", "c_id").distinct()
    words = (
        parsed.where("first <> '' and (first <> letters or number <> '')")
        .groupBy("first")
        .agg(F.count_distinct(F.struct("number", F.expr("substr(letters, length(first) + 1)"))).alias("rests"))
    )
    ready = parsed.join(words, "first", "left").select(
        "id", "name", "n", "number", "letters", "word", "first", F.coalesce("rests", F.lit(0)).alias("rests")
    )
    canon = ready.select(*(F.col(x).alias("c_" + x) for x in ready.columns))
    sides = [x.removeprefix("c_") for x in canon.columns]
    higher = F.expr("c_n > n or (c_n = n and c_name < name)")
    pairs = (
        meeting.join(ready, "id")
        .join(canon, "c_id")
        .where("number = c_number")  # hashed keys may collide
        .select(
            *(F.when(higher, F.col(x)).otherwise(F.col("c_" + x)).alias(x) for x in sides),
            *(F.when(higher, F.col("c_" + x)).otherwise(F.col(x)).alias("c_" + x) for x in sides),
        )
        .where(
            f"right(letters, {KEPT}) = right(c_letters, {KEPT}) or levenshtein(word, c_word, 4) >= 0 or levenshtein(letters, c_letters, 4) >= 0"
            f" or right(word, {KEPT}) = right(c_word, {KEPT})"
            " or (length(word) = length(c_word) and instr(concat(c_word, c_word), word) > 0)"
        )
    )

    def _score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep: list[tuple] = []
            for number, ci, name, cn, cl, cw, cf, ck, vi, vl, vw, vf, vk in zip(
                pdf["number"], pdf["c_id"], pdf["c_name"], pdf["c_n"], pdf["c_letters"], pdf["c_word"], pdf["c_first"], pdf["c_rests"],
                pdf["id"], pdf["letters"], pdf["word"], pdf["first"], pdf["rests"],
            ):
                ll = log_likelihood((number, cl, cw, cf, ck), (number, vl, vw, vf, vk), pets)
                if ll is not None:
                    keep.append((vi, ci, name, math.log(cn) + ll, cn))
            yield pd.DataFrame(keep, columns=["id", "c_id", "c_name", "posterior", "c_n"])

    best = (
        pairs.mapInPandas(_score_batches, "id long, c_id long, c_name string, posterior double, c_n long")
        .groupBy("id")
        .agg(F.min_by("c_id", F.struct(-F.col("posterior"), -F.col("c_n"), "c_name")).alias("parent"))
    )
    tree = materialize(
        parsed.select("id", "name").join(best, "id", "left").select("id", "name", F.coalesce("parent", "id").alias("root")), "attached"
    )
    # Every parent ranks above its child, so the links are a forest; jumping halves its depth.
    while True:
        up = tree.select(F.col("id").alias("root"), F.col("root").alias("up"))
        jumped = tree.join(up, "root").select("id", "name", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved"))
        done = tree
        tree = materialize(jumped, "attached")
        forget(done)
        if tree.where("moved").isEmpty():
            break
        tree = tree.drop("moved")
    heads = tree.where("id = root").select("root", F.col("name").alias("canonical"))
    return tree.join(heads, "root").select("name", "canonical")


def variant_pairs(attributed: DataFrame) -> DataFrame:
    """Pairs of different spellings of one canonical form (groups hold one owner's spellings)."""
    a = attributed.select("canonical", F.col("name").alias("name_a"))
    b = attributed.select("canonical", F.col("name").alias("name_b"))
    return a.join(b, "canonical").where("name_a < name_b").select("name_a", "name_b")


def feed_spellings(events: DataFrame, ratings: DataFrame) -> DataFrame:
    """Counts over feed_events.attacker, feed_events.victim and player_ratings.player."""
    both = events.select(
        F.explode(
            F.array(
                F.struct((F.col("id") * 2).alias("row"), F.col("attacker").alias("name")),
                F.struct((F.col("id") * 2 + 1).alias("row"), F.col("victim").alias("name")),
            )
        ).alias("x")
    ).select("x.row", "x.name")
    return spelling_counts(both, ratings.select(F.lit(-1).cast("long").alias("row"), F.col("player").alias("name")))
