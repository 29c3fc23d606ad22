"""Ratings from matches: valid names, comparisons inside a match, and the fold over matches in order.

A match becomes one compact row. The fold needs all matches in order of time,
so it runs as a stream through one task that holds the ratings of the players
met so far and never the matches. Everything before it (sums per match, de-duplication,
survival) is distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import glicko as G
from feedloom.functions.names import default_label
from feedloom.operators.matches import most_confident, stat_dedup, survival

ELO_FLOOR = 100.0
MOST_RATED = 60


# Patterns of lower-cased names that are readings of something else.
NO_PLAYER = [r"^[0-9]+[a-z]{1,4}$", r"^twitch\.", r"^ping[_.]", r"\[bleed", r"bleed\]", r"^\[[^\]]*\]$"]
LEAST_NAME, MOST_DIGITS = 4, 0.4


def hidden_player(name: str, characters: list[str]) -> Column:
    """A character's name, bare, in brackets or with a number, or a default label even if misread: nobody in particular."""
    low = F.lower(name)
    plain = F.trim(F.regexp_replace(low, r"[\[\]()]", ""))
    if not characters:
        return F.lit(False)
    spellings = sorted({c.lower() for c in characters} | {c.lower().replace(" ", "") for c in characters})
    numbered = F.lit("^(" + "|".join(spellings) + ")[ ]*[0-9]+$")
    return plain.isin(spellings) | F.rlike(low, numbered) | default_label(name, characters)["number"].isNotNull()


def valid_player(name: str, characters: list[str], common_words: list[str]) -> Column:
    """Names that may be rated: no hidden player, common word, letters repeated over and over, code or reading of something else."""
    n, low = F.col(name), F.lower(name)
    letters = F.regexp_replace(n, r"[^\p{L}]", "")
    refuse = [
        n.isin(characters),
        hidden_player(name, characters),
        F.length(n) < LEAST_NAME,
        low.isin([w.lower() for w in common_words]),
        (F.length(letters) >= 4) & (F.size(F.array_distinct(F.split(letters, ""))) <= 2),
        F.length(F.regexp_replace(n, r"[^0-9]", "")) > MOST_DIGITS * F.length(n),
        *(low.rlike(p) for p in NO_PLAYER),
    ]
    return n.isNotNull() & ~F.coalesce(reduce(Column.__or__, refuse), F.lit(True))


def match_rows(kills: DataFrame, valid: Column | None = None) -> DataFrame:
    """One row a match: (match_id, first_us, players array<struct<player, order_out, survived>>), the most confident 60."""
    rated = survival(kills).select("match_id", "player", "order_out", (~F.col("eliminated")).alias("survived"))
    if valid is not None:
        rated = rated.where(valid)
    capped = rated.join(most_confident(kills, MOST_RATED), ["match_id", "player"], "left_semi")
    first = kills.groupBy("match_id").agg(F.min(F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("first_us"))
    players = capped.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("order_out", "player", "survived"))).alias("players"))
    return players.join(first, "match_id").select("match_id", "first_us", "players")


def match_results(order: np.ndarray, survived: np.ndarray) -> np.ndarray:
    """score[i, j]: 1 where i outlasted j, 0 where j outlasted i, nan where unknown."""
    out = np.full((len(order), len(order)), np.nan)
    dead = ~survived
    both = dead[:, None] & dead[None, :]
    out[both & (order[:, None] > order[None, :])] = 1.0
    out[both & (order[:, None] < order[None, :])] = 0.0
    beats = survived[:, None] & dead[None, :]
    out[beats] = 1.0
    out[beats.T] = 0.0
    return out


def rate_match(ratings: dict[str, list[float]], players: list[str], order: np.ndarray, survived: np.ndarray) -> list[tuple]:
    """Update ``ratings`` (player -> rating, rd, vol, matches, peak) by one match; placements (player, before, after)."""
    state = np.array([ratings.setdefault(p, [G.RATING0, G.RD0, G.VOL0, 0, G.RATING0])[:3] for p in players])
    score = match_results(order, survived)
    known = ~np.isnan(score)
    n = known.sum(axis=1)
    w = np.where(n <= G.MOST_EFFECTIVE, 1.0, G.MOST_EFFECTIVE / np.maximum(n, 1))
    mu, phi = (state[:, 0] - G.RATING0) / G.SCALE, state[:, 1] / G.SCALE
    gj = 1 / np.sqrt(1 + 3 * phi**2 / np.pi**2)
    e = 1 / (1 + np.exp(-gj[None, :] * (mu[:, None] - mu[None, :])))
    v_inv = w * np.where(known, (gj**2)[None, :] * e * (1 - e), 0).sum(axis=1)
    gain = w * np.where(known, gj[None, :] * (np.nan_to_num(score) - e), 0).sum(axis=1)
    rating, rd, vol = G.update_arrays(state[:, 0], state[:, 1], state[:, 2], v_inv, gain)
    rating = np.maximum(ELO_FLOOR, rating)
    out = []
    for k, p in enumerate(players):
        old = ratings[p]
        out.append((p, old[0], float(rating[k])))
        ratings[p] = [float(rating[k]), float(rd[k]), float(vol[k]), old[3] + 1, max(old[4], float(rating[k]))]
    return out


PLACEMENTS = "match_id string, player string, kill_order_out int, survived int, elo_before double, elo_after double, elo_change double, rd double, vol double, matches_played int, peak_elo double"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ratings: dict[str, list[float]] = {}
    for pdf in batches:
        rows = []
        for match_id, players in zip(pdf["match_id"], pdf["players"]):
            names = [p["player"] for p in players]
            order = np.array([p["order_out"] for p in players])
            survived = np.array([p["survived"] for p in players], dtype=bool)
            for (p, before, after), o, s in zip(rate_match(ratings, names, order, survived), order, survived):
                r = ratings[p]
                rows.append((match_id, p, int(o), int(s), before, after, after - before, r[1], r[2], r[3], r[4]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACEMENTS.split(", ")])


def rate_all(matches: DataFrame) -> DataFrame:
    """Placements of all ``match_rows`` with the ratings after each, in order of time (ties by match id)."""
    return matches.repartition(1).sortWithinPartitions("first_us", "match_id").mapInPandas(_fold, PLACEMENTS)


def final_ratings(placements: DataFrame, kills: DataFrame) -> DataFrame:
    """player_ratings of the last placement of each player, with de-duplicated kills and deaths."""
    last = placements.groupBy("player").agg(F.max_by(F.struct("elo_after", "rd", "vol", "matches_played", "peak_elo"), "matches_played").alias("x"))
    side = lambda n, k, d: F.struct(F.trim(n).alias("player"), F.lit(k).alias("k"), F.lit(d).alias("d"))
    stats = (
        stat_dedup(kills)
        .select(F.inline(F.array(side("attacker", 1, 0), side("victim", 0, 1))))
        .groupBy("player")
        .agg(F.sum("k").alias("total_kills"), F.sum("d").alias("total_deaths"))
    )
    return last.join(stats, "player", "left").select(
        "player", F.col("x.elo_after").alias("elo"), "x.rd", "x.vol", "x.matches_played",
        F.coalesce("total_kills", F.lit(0)).alias("total_kills"), F.coalesce("total_deaths", F.lit(0)).alias("total_deaths"), "x.peak_elo",
    )


def period_update(ratings: DataFrame, results: DataFrame) -> DataFrame:
    """One rating period for many players at once, all in columns: ``results`` (player, opponent, score)."""
    mine = ratings.select("player", F.col("elo").alias("r"), F.col("rd").alias("d"), "vol")
    theirs = ratings.select(F.col("player").alias("opponent"), F.col("elo").alias("ro"), F.col("rd").alias("do"))
    games = results.join(mine, "player").join(theirs, "opponent")
    mu, mu_j, phi_j = (F.col("r") - G.RATING0) / G.SCALE, (F.col("ro") - G.RATING0) / G.SCALE, F.col("do") / G.SCALE
    e = G.expected(mu, mu_j, phi_j)
    n = F.count(F.lit(1))
    w = F.when(n <= G.MOST_EFFECTIVE, F.lit(1.0)).otherwise(G.MOST_EFFECTIVE / n)
    sums = games.groupBy("player").agg((w * F.sum(G.g(phi_j) ** 2 * e * (1 - e))).alias("v_inv"), (w * F.sum(G.g(phi_j) * (F.col("score") - e))).alias("gain"))
    new = G.update(F.col("r"), F.col("d"), F.col("vol"), F.col("v_inv"), F.col("gain"))
    return mine.join(sums, "player", "left").withColumn("x", new).select("player", F.greatest(F.lit(ELO_FLOOR), "x.rating").alias("elo"), "x.rd", "x.vol")
