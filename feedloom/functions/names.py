"""Identity of names: default labels, identity keys, tolerant equality, and look-up in a dictionary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import fixed as V
from feedloom.functions.similarity import candidate_pairs, ratio, ratio_if_at_least, ratio_of
from feedloom.functions.text import confusion_key, norm_untagged, stem
from feedloom.session import materialize


def nearest(col: str | Column, among: list[str], least: float, strictly: bool = False) -> Column:
    """The most similar text of a short list, the first of equals, if its ratio is ``least`` or more. Every different text is compared once a batch."""
    plain = [(w, w.lower().replace(" ", "")) for w in among]

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            best = max(((ratio_of(text, p), -k, w) for k, (w, p) in enumerate(plain)), default=(0.0, 0, None))
            return best[2] if best[0] > least or (best[0] == least and not strictly) else None

        known = {t: one(t) for t in texts.dropna().unique()}
        return pd.Series([known.get(t) for t in texts], dtype="object")

    return find(col)


def default_label(name: str | Column, characters: list[str]) -> Column:
    """struct(character, number) of a default label, even if misread; null fields for ordinary names.

    A label is a beginning like a character's name and a block of three or four signs with two real digits at least, whose
    letters are digits by their shape. A stray short word may follow.
    """
    col = F.col(name) if isinstance(name, str) else name
    low = F.lower(F.trim(col))
    part = lambda k: F.regexp_extract(low, f"^{V.LABEL}$", k)
    number = F.translate(part(2), "".join(V.LABEL_DIGITS), "".join(V.LABEL_DIGITS.values()))
    fits = (F.length(F.regexp_replace(part(2), "[^0-9]", "")) >= 2) & number.rlike("^[0-9]{3,4}$")
    who = F.lower(F.replace(nearest(F.when(fits, F.replace(part(1), F.lit(" "), F.lit(""))), characters, V.LABEL_LIKENESS), F.lit(" "), F.lit("")))
    return F.struct(who.alias("character"), F.when(who.isNotNull(), number).alias("number"))


def identity_key(name: str | Column, characters: list[str]) -> Column:
    """One text for all spellings of an identity: that of its default label, or its look-alike key; null for keys under four signs.

    Two names are one identity if their keys are equal: labels by character and number, a label and another name never.
    """
    label, key = default_label(name, characters), confusion_key(name)
    return F.when(label["number"].isNotNull(), F.concat_ws(":", F.lit("label"), label["character"], label["number"])).when(
        F.length(key) >= 4, F.concat(F.lit("name:"), key)
    )


def same_identity(a: str | Column, b: str | Column, characters: list[str]) -> Column:
    return F.coalesce(identity_key(a, characters) == identity_key(b, characters), F.lit(False))


def tolerant_equal(a: str | Column, b: str | Column, across: bool = False) -> Column:
    """Equal up to a misreading: similar, one the beginning of the other (four signs or more), or of one stem.

    0.82 is similar enough within one source; ``across`` sources it is 0.6, and five common first signs do as well.
    Only pairs that the columns leave open go to Python.
    """
    x, y = norm_untagged(a), norm_untagged(b)
    both = (x != "") & (y != "")
    long = (F.length(x) >= 4) & (F.length(y) >= 4)
    begins = F.startswith(x, y) | F.startswith(y, x)
    if across:
        begins = begins | (F.substring(x, 1, 5) == F.substring(y, 1, 5))
    known = (x == y) | (long & begins) | ((stem(a) != "") & (stem(a) == stem(b)))
    open_ = both & ~known
    alike = ratio(F.when(open_, x), F.when(open_, y)) >= (0.6 if across else 0.82)
    return F.coalesce(both & (known | F.coalesce(alike, F.lit(False))), F.lit(False))


def character_of(token: str | Column, typos: dict[str, str], characters: list[str], least: float = 0.80) -> Column:
    """Character that a token of three letters or more, without digits, stands for: exact, a known typo, or more similar than ``least``."""
    col = F.col(token) if isinstance(token, str) else token
    low = F.replace(F.lower(F.trim(col)), F.lit(" "), F.lit(""))
    exact = {c.lower().replace(" ", ""): c for c in characters} | {k.lower().replace(" ", ""): v for k, v in typos.items()}
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in exact.items() for x in kv)), low) if exact else F.lit(None).cast("string")
    fits = (F.length(low) >= 3) & ~low.rlike("[0-9]")
    return F.when(fits, F.coalesce(known, nearest(F.when(fits & known.isNull(), low), characters, least, strictly=True)))


def learn_typos(tokens: DataFrame, typos: dict[str, str], characters: list[str]) -> DataFrame:
    """(token, character) of the different ``tokens`` (token) that are a character's name misread and in no list yet."""
    listed = {k.lower() for k in typos} | {c.lower() for c in characters}
    return tokens.select(F.lower("token").alias("token")).distinct().where(~F.col("token").isin(sorted(listed))).select(
        "token", character_of("token", {}, characters).alias("character")
    ).where("character is not null")


def resolve(names: DataFrame, dictionary: DataFrame, least: float = 0.85, characters: list[str] | None = None) -> DataFrame:
    """(name, canonical, score): every name looked up in a dictionary (canonical, variant, seen, protected[, pro]).

    Names under four letters stay themselves. An exact canonical name wins; then a misread character; then the best
    weighted similarity with a canonical name or a variant, where equal identity keys count as 0.95 and names of other
    numbers don't count; names without a match stay themselves. Candidates are all pairs that can reach ``least``, so
    none is lost. Nothing is learned on the way, so the order of rows is no matter.
    """
    characters = V.CHARACTERS if characters is None else characters
    if "pro" not in dictionary.columns:
        dictionary = dictionary.withColumn("pro", F.lit(False))
    entries = dictionary.groupBy("canonical").agg(F.max("seen").alias("seen"), F.max("protected").alias("protected"), F.max("pro").alias("pro"))
    sure = F.least(F.col("seen") / 10, F.lit(1.0))
    distinct = materialize(names.select("name").where("name is not null").distinct(), "names")
    looked = distinct.join(entries.withColumn("name", F.col("canonical")), "name", "left")
    exact_score = F.when(F.col("protected"), F.lit(1.0)).otherwise(0.6 + 0.4 * sure)
    known = looked.where("canonical is not null and length(name) >= 4").select("name", "canonical", exact_score.alias("score"))
    open_ = materialize(looked.where("canonical is null and length(name) >= 4").select("name", character_of("name", {}, characters).alias("who")), "unknown-names")
    as_character = open_.where("who is not null").select("name", F.col("who").alias("canonical"), F.lit(1.0).alias("score"))
    unknown = open_.where("who is null").select("name")
    forms = dictionary.select("canonical", F.col("variant").alias("form")).unionByName(entries.select("canonical", F.col("canonical").alias("form"))).distinct()
    alike = (
        candidate_pairs(unknown.select(F.col("name").alias("text")), forms.select(F.col("form").alias("text")).distinct(), least)
        .withColumn("r", ratio(F.lower("a"), F.lower("b")))
        .where(F.col("r") >= least)
        .select(F.col("a").alias("name"), F.col("b").alias("form"), "r")
    )
    by_key = (
        unknown.withColumn("key", identity_key("name", characters))
        .join(forms.withColumn("key", identity_key("form", characters)), "key")
        .select("name", "form", F.lit(0.95).alias("r"))
    )
    end = lambda c: F.regexp_extract(c, "([0-9]{3,})$", 1)
    conflict = (end("name") != "") & (end("canonical") != "") & (F.coalesce(ratio(end("name"), end("canonical")), F.lit(1.0)) < 0.6)
    scored = (
        alike.unionByName(by_key)
        .join(forms, "form")
        .groupBy("name", "canonical")
        .agg(F.max("r").alias("r"))
        .where(~conflict)
        .join(entries, "canonical")
    )
    score = F.when(F.col("pro"), 0.8 * F.col("r") + 0.2 * sure).when(F.col("protected"), 0.4 * F.col("r") + 0.6).otherwise(0.6 * F.col("r") + 0.4 * sure)
    best = scored.withColumn("score", score).groupBy("name").agg(F.max_by(F.struct("canonical", "score"), F.struct("score", "canonical")).alias("x"))
    found = known.unionByName(as_character).unionByName(best.select("name", "x.canonical", "x.score"))
    return distinct.join(found, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"), F.coalesce("score", F.lit(0.0)).alias("score"))


RECENT_US, RECENT_LIKENESS = 10_000_000, 0.70


def resolve_in_time(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """``rows`` (key, us, id, name) with ``canonical``: a name like one of the last ten seconds is that one, else as ``resolved`` says.

    Of several recent names the most similar counts, the latest seen of equals. A silence of more than ten seconds leaves nothing to
    look back on, so it parts a key into stretches that are folded on their own.
    """
    from feedloom.operators.dedup import _stretches, fold_sorted

    looked = rows.select("key", "us", "id", "name").join(resolved.select("name", F.col("canonical").alias("_by_table")), "name", "left")

    def step(recent: dict[str, int], row: dict) -> tuple:
        us, name, hit = row["us"], row["name"], None
        for old in [n for n, at in recent.items() if us - at > RECENT_US]:
            del recent[old]
        if isinstance(name, str) and len(name) >= 4:
            if name in recent:
                hit = name
            else:
                low = name.lower()
                near = [(r, at, n) for n, at in recent.items() if (r := ratio_if_at_least(low, n.lower(), RECENT_LIKENESS)) is not None]
                hit = max(near)[2] if near else None
        canonical = hit or (row["_by_table"] if isinstance(row["_by_table"], str) else name)
        if isinstance(canonical, str) and len(canonical) >= 4:
            recent[canonical] = us
        return row["key"], us, row["id"], name, canonical

    placed = _stretches(looked, ["key"], RECENT_US)
    return fold_sorted(placed, ["key", "stretch"], ["us", "id", "name"], dict, step, "key string, us long, id long, name string, canonical string")
