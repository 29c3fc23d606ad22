"""Scoring against a truth set: greedy matches in time, recall, precision, and where the misses were lost."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.names import tolerant_equal
from feedloom.functions.similarity import ratio_at_least
from feedloom.operators.dedup import STRETCHES_A_TASK, _stretches
from feedloom.operators.joins import within

PAIRED = "game string, truth_id long, read_id long"


def candidates(truth: DataFrame, reads: DataFrame, slack_us: int = 45_000_000) -> DataFrame:
    """Truth and read of a game with tolerant equal victims, close in time. Both have (game, id, us, attacker, victim)."""
    a = truth.select("game", F.col("id").alias("truth_id"), F.col("us").alias("at"), F.col("attacker").alias("true_attacker"), F.col("victim").alias("true_victim"))
    b = reads.select("game", F.col("id").alias("read_id"), "us", "attacker", "victim")
    return within(a, b, ["game"], "at", "us", slack_us).where(tolerant_equal("true_victim", "victim", across=True))


def greedy_pairs(pairs: DataFrame, slack_us: int = 45_000_000) -> DataFrame:
    """One to one: every truth row in order of time takes the first free read.

    Truth rows that compete for a read are at most twice ``slack_us`` apart,
    so a silence of the candidates longer than that parts a game into
    stretches, which are matched on their own.
    """
    placed = _stretches(pairs.withColumnRenamed("us", "read_us").withColumnRenamed("at", "us"), ["game"], 2 * slack_us)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for truth, part in pdf.sort_values(["us", "truth_id", "read_us", "read_id"]).groupby("truth_id", sort=False):
            free = [r for r in part["read_id"] if r not in used]
            if free:
                used.add(free[0])
                rows.append((part["game"].iloc[0], truth, free[0]))
        return pd.DataFrame(rows, columns=["game", "truth_id", "read_id"])

    return placed.groupBy("game", F.floor(F.col("stretch") / STRETCHES_A_TASK)).applyInPandas(run, PAIRED)


def scores(truth: DataFrame, reads: DataFrame, slack_us: int = 45_000_000) -> DataFrame:
    """Per game: truth, reads, matched, recall and precision as whole per cent, rounded down."""
    matched = greedy_pairs(candidates(truth, reads, slack_us), slack_us).groupBy("game").agg(F.count("*").alias("matched"))
    t, r = (df.groupBy("game").agg(F.count("*").alias(n)) for df, n in ((truth, "truth"), (reads, "reads")))
    pct = lambda n: F.when(F.col(n) > 0, F.floor(100 * F.coalesce("matched", F.lit(0)) / F.col(n)))
    return t.join(r, "game", "full").join(matched, "game", "left").select(
        "game", "truth", "reads", F.coalesce("matched", F.lit(0)).alias("matched"), pct("truth").alias("recall_pct"), pct("reads").alias("precision_pct")
    )


def ever_seen(truth: DataFrame, texts: DataFrame, slack_us: int = 6_000_000) -> DataFrame:
    """Truth rows whose victim appears in some raw text nearby: contained, or similar to it or to one of its words."""

    @F.pandas_udf("boolean")
    def appears(names: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for n, line in zip(names, lines):
            n, line = (n or "").lower(), (line or "").lower()
            out.append(bool(n) and (n in line or ratio_at_least(n, line, 0.6) or any(ratio_at_least(n, w, 0.8) for w in line.split())))
        return pd.Series(out)

    a = truth.select("game", F.col("id").alias("truth_id"), F.col("us").alias("at"), "victim")
    b = texts.select("game", "us", "text")
    return within(a, b, ["game"], "at", "us", slack_us).where(appears("victim", "text")).select("game", "truth_id").distinct()


def misses(truth: DataFrame, reads: DataFrame, texts: DataFrame) -> DataFrame:
    """Missed truth rows of each game, by whether a text ever showed them."""
    hit = greedy_pairs(candidates(truth, reads)).select("game", F.col("truth_id").alias("id"))
    seen = ever_seen(truth, texts).select("game", F.col("truth_id").alias("id"), F.lit(True).alias("seen"))
    lost = truth.select("game", "id").join(hit, ["game", "id"], "left_anti").join(seen, ["game", "id"], "left")
    return lost.groupBy("game").agg(F.count_if(F.col("seen").isNull()).alias("never_captured"), F.count_if(F.col("seen")).alias("lost_downstream"))


def best_confident(candidates_: DataFrame, key: str) -> DataFrame:
    """Best candidate by the geometric mean of its letters' probabilities; the first of equals. (key, place, text, probs)."""
    mean = F.exp(F.aggregate(F.transform("probs", lambda p: F.log(p)), F.lit(0.0), lambda a, x: a + x) / F.size("probs"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "place"))
    return candidates_.withColumn("confidence", mean).withColumn("_r", rank).where("_r = 1").drop("_r", "probs")


def derive_zone(boxes: DataFrame, key: str, cap_height: float = 0.24, reject_top: float = 0.26) -> DataFrame:
    """Union of line boxes (x0, y0, x1, y1 as fractions) of a key, without boxes that start too low, with a capped height."""
    good = boxes.where(F.col("y0") <= reject_top)
    zone = good.groupBy(key).agg(*(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    return zone.withColumn("y1", F.least("y1", F.col("y0") + cap_height))


def tighten_zone(zone: DataFrame, boxes: DataFrame, key: str, margin: float = 0.02, least_height: float = 0.04) -> DataFrame:
    """``zone`` (x0, y0, x1, y1) of a key drawn in to its boxes with a margin; it never grows, nor gets lower than ``least_height``.

    Boxes outside the zone don't count; a key without boxes keeps its zone.
    """
    inside = boxes.join(zone.select(key, *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1"))), key)
    inside = inside.where("x0 >= _x0 and y0 >= _y0 and x1 <= _x1 and y1 <= _y1")
    fit = inside.groupBy(key).agg(*(f(c).alias(f"_{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    joined = zone.join(fit, key, "left")
    low = lambda c: F.greatest(F.col(c), F.col(f"_{c}") - margin)
    high = lambda c: F.least(F.col(c), F.col(f"_{c}") + margin)
    tight = joined.select(key, *(F.coalesce(low(c), F.col(c)).alias(c) for c in ("x0", "y0")), *(F.coalesce(high(c), F.col(c)).alias(c) for c in ("x1", "y1")), F.col("y1").alias("_old"))
    return tight.withColumn("y1", F.greatest("y1", F.least("_old", F.col("y0") + least_height))).drop("_old")


def line_text(boxes: DataFrame, line: str, icon_gap: int = 80, space_gap: int = 5) -> DataFrame:
    """Words of a line put together by their gaps: over ``icon_gap`` an icon stands between, over ``space_gap`` a blank."""
    order = Window.partitionBy(line).orderBy("x", "text")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)
    glue = F.when(gap > icon_gap, " <GUN_ICON> ").when(gap > space_gap, " ").otherwise("")
    words = boxes.withColumn("_s", F.struct("x", F.concat(glue, F.col("text")).alias("t")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("_s")), lambda s: s["t"]), "")
    return words.groupBy(line).agg(joined.alias("text"))
