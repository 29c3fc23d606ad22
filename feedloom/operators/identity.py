"""Clusters of names that stand for one player, and what follows from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.names import identity_key
from feedloom.functions.similarity import block_ties, candidate_pairs, possible_pairs, prefix_pairs, prefix_ties, ratio, ratio_of
from feedloom.session import materialize


def choose_canonical(players: DataFrame, cluster: str) -> DataFrame:
    """(cluster, canonical): mixed case first, then most matches, longest, first by name."""
    name = F.col("player")
    mixed = ((name != F.lower(name)) & (name != F.upper(name))).cast("int")
    best = F.min_by("player", F.struct(-mixed, -F.col("matches_played"), -F.length("player"), "player"))
    return players.groupBy(cluster).agg(best.alias("canonical"))


def roll_up(ratings: DataFrame, alias: DataFrame) -> DataFrame:
    """Statistics per canonical name; ``alias`` has (player, canonical)."""
    named = ratings.join(alias, "player", "left").withColumn("canonical", F.coalesce("canonical", "player"))
    return named.groupBy("canonical").agg(
        F.sum("total_kills").alias("kills"), F.sum("total_deaths").alias("deaths"), F.sum("matches_played").alias("matches"), F.max("peak_elo").alias("peak")
    )


def apply_alias(rows: DataFrame, alias: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with names replaced by their canonical form."""
    for c in columns:
        names = alias.select(F.col("player").alias(c), F.col("canonical").alias("_canonical"))
        rows = rows.join(names, c, "left").withColumn(c, F.coalesce("_canonical", c)).drop("_canonical")
    return rows


def merge_placements(placements: DataFrame, alias: DataFrame) -> DataFrame:
    """Placements under canonical names; where a match has several of one player, the canonical name's own row stays."""
    from pyspark.sql import Window

    named = placements.join(alias, "player", "left").withColumn("_own", F.col("canonical").isNull()).withColumn("_to", F.coalesce("canonical", "player"))
    first = F.row_number().over(Window.partitionBy("match_id", "_to").orderBy(F.desc("_own"), "player"))
    return named.withColumn("_n", first).where("_n = 1").withColumn("player", F.col("_to")).drop("_own", "_to", "_n", "canonical")


LEAST_LENGTH = 4
SAME_PREFIX, OTHER_PREFIX = 0.70, 0.82


def _long_names(players: DataFrame) -> DataFrame:
    return players.select("player", F.coalesce("matches_played", F.lit(0)).alias("matches"), F.lower("player").alias("low")).where(F.length("low") >= LEAST_LENGTH)


def similar_names(players: DataFrame) -> DataFrame:
    """Pairs (a, b) of names whose ratio reaches 0.70 with a common three-letter prefix, else 0.82; the player of more matches first.

    Names with a common prefix meet under it, all others in pairs of blocks;
    what upper bounds of the ratio leave is compared. No pair is lost to them.
    """
    n = _long_names(players)
    by_prefix = prefix_pairs(n.select(F.col("player").alias("text"), F.substring("low", 1, 3).alias("head")), SAME_PREFIX)
    others = candidate_pairs(n.select(F.col("player").alias("text")), None, OTHER_PREFIX)
    side = lambda s: n.select(F.col("player").alias(s), F.col("matches").alias(f"matches_{s}"), F.col("low").alias(f"low_{s}"))
    pairs = by_prefix.unionByName(others).distinct().join(side("a"), "a").join(side("b"), "b")
    ahead = F.col("matches_a") >= F.col("matches_b")  # a < b by name
    first, second = (F.when(ahead, F.col(x)).otherwise(F.col(y)) for x, y in (("low_a", "low_b"), ("low_b", "low_a")))
    least = F.when(F.substring("low_a", 1, 3) == F.substring("low_b", 1, 3), SAME_PREFIX).otherwise(OTHER_PREFIX)
    return pairs.withColumn("r", ratio(first, second)).where(F.col("r") >= least).select(
        F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b")
    )


BLOCK = 500


def pairs_at_least(players: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio): all pairs of names whose ratio without letter case is ``least`` or more; of matches, more first, as in ``similar_names``.

    Nothing is left out by blocking: names are dealt to blocks, every two blocks
    meet in one group, and there only upper bounds of the ratio come before it,
    by length, by common letters and by the longest common subsequence. Work is
    that of all pairs, most of them in numpy.
    """
    n = players.select("player", F.coalesce("matches_played", F.lit(0)).alias("matches"), F.lower("player").alias("low")).where("low <> ''").distinct()
    blocks = max(1, -(-n.count() // BLOCK))
    own = n.withColumn("own", F.pmod(F.xxhash64("player"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = own.withColumn("other", other).select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).drop("other")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sides = (pdf, pdf) if i == j else (pdf[pdf["own"] == i], pdf[pdf["own"] == j])
        x, y = (list(zip(side["low"], side["player"], side["matches"])) for side in sides)
        rows = []
        for p, q in possible_pairs([r[0] for r in x], [r[0] for r in y], least):
            if i == j and p >= q:
                continue
            first, second = sorted((x[p], y[q]), key=lambda r: (-r[2], r[1]))
            r = ratio_of(first[0], second[0])
            if r >= least:
                rows.append((first[1], second[1], r))
        return pd.DataFrame(rows, columns=["a", "b", "ratio"])

    return met.groupBy("i", "j").applyInPandas(run, "a string, b string, ratio double")


def key_edges(players: DataFrame, characters: list[str]) -> DataFrame:
    """Names of one identity (look-alike key, or default label with its number), each tied to the first of its group."""
    keyed = players.select("player", identity_key("player", characters).alias("key")).where("key is not null")
    first = keyed.groupBy("key").agg(F.min("player").alias("b"))
    return keyed.join(first, "key").where("player <> b").select(F.col("player").alias("a"), "b")


def base_token_edges(players: DataFrame) -> DataFrame:
    """A name of several words tied to the name that is its first word."""
    single = players.where(~F.contains("player", F.lit(" "))).groupBy(F.lower("player").alias("k")).agg(F.max("player").alias("b"))
    multi = players.where(F.contains("player", F.lit(" "))).select(F.col("player").alias("a"), F.lower(F.split("player", " ")[0]).alias("k"))
    return multi.where(F.length("k") >= LEAST_LENGTH).join(single, "k").select("a", "b")


def cluster_names(ratings: DataFrame, characters: list[str]) -> DataFrame:
    """(player, canonical) of names that are not their own canonical form.

    Groups are those of the pairs of ``similar_names`` and of both kinds of edges, but the pairs are never listed, as their number
    grows with the square of the names: groups of names leave only what ties them (``prefix_ties``, then ``block_ties`` over what is tied by then).
    """
    from feedloom.operators.graph import components

    known = ratings.count()
    n = _long_names(ratings).select(F.col("player").alias("text"), "low", "matches").distinct()
    by_prefix = prefix_ties(n.withColumn("tie", F.col("text")).withColumn("head", F.substring("low", 1, 3)), SAME_PREFIX)
    near = materialize(components(by_prefix.unionByName(key_edges(ratings, characters)).unionByName(base_token_edges(ratings)), members=known), "near")
    tied = n.join(near.select(F.col("member").alias("text"), "group"), "text", "left").withColumn("tie", F.coalesce("group", "text")).drop("group")
    far = block_ties(materialize(tied, "names"), OTHER_PREFIX)
    groups = components(near.select(F.col("member").alias("a"), F.col("group").alias("b")).unionByName(far), members=known)
    named = ratings.select("player", "matches_played").join(groups.withColumnRenamed("member", "player"), "player")
    return named.join(choose_canonical(named, "group"), "group").where("player <> canonical").select("player", "canonical")
