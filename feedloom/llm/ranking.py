"""One ranking of all items from pairwise comparisons, by a Markov chain.

The chain moves from the loser of a comparison to its winner. The rate from j
to i is (wins of i over j) / (strength i + strength j): normalised so that
neither many comparisons nor strong opponents bias it. Every item is also
smoothed by ``smoothing`` wins and losses against a virtual item of mean (log)
strength, which connects the chain and keeps unbeaten items finite. A step of the power
iteration moves the present strengths along these rates and divides what
arrives at an item by the rate at which it leaves; the stationary distribution,
where both agree, is the maximum of the (smoothed) Bradley-Terry likelihood.
Plain steps take about 140 to settle the ranks, so each goes on from where the
last ``MEMORY`` steps together point (Anderson's acceleration of log strengths).
The accelerated start of a step is checked by the step itself: the end is where
a plain step changes nothing beyond the tolerance, and running out of steps is
an error.

There are two forms of a step, of equal results. While there are at most
``broadcast_items`` items (counted first), the vector of strengths, 8 bytes an
item, is broadcast, and the comparisons lie in packed blocks of arrays in the
shared folder, so that a step is one pass of array sums, added up in a tree. Beyond that count
strengths reach the comparisons by shuffle joins and stay in tables. Sums are
combined before the shuffle, so an item in a third of all comparisons is no
hot spot.

Defined cases: comparisons without winner or loser, of an item with itself or
of weight not above 0 don't count; names are compared without surrounding
blanks; without comparisons there is no ranking; equal strengths are ranked by
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import forget, materialize

#: What all comparisons of a match weigh per placement in it.
PLACEMENT_WEIGHT = 0.05
#: Steps that an accelerated one looks back on.
MEMORY = 5


def usable_kills(kills: DataFrame) -> DataFrame:
    """(winner, loser) of the rows with two different names, repeated rows once."""
    return (
        kills.select("id", F.trim("attacker").alias("winner"), F.trim("victim").alias("loser"))
        .where("winner <> '' and loser <> '' and winner <> loser")
        .distinct()
        .select("winner", "loser")
    )


def _places(placements: DataFrame) -> DataFrame:
    """(m, player, out): one row a player of a match, its latest place."""
    return (
        placements.select(F.trim("match_id").alias("m"), F.trim("player").alias("player"), F.col("kill_order_out").alias("out"))
        .where("m <> '' and player <> '' and out is not null")
        .groupBy("m", "player")
        .agg(F.max("out").alias("out"))
    )


def placement_comparisons(placements: DataFrame, weight: float = PLACEMENT_WEIGHT) -> DataFrame:
    """(winner, loser, weight): each player against everybody of the match with a lower place; tied ones are not compared.

    A pair of a match of n players weighs 2 ``weight`` / n, so a match weighs in proportion to n and not to its pairs.
    """
    rows = _places(placements).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("m")))
    later = rows.select("m", F.col("player").alias("winner"), F.col("out").alias("later"), (F.lit(2 * weight) / F.col("n")).alias("weight"))
    earlier = rows.select("m", F.col("player").alias("loser"), F.col("out").alias("earlier"))
    return later.join(earlier, "m").where("later > earlier").select("winner", "loser", "weight")


def feed_items(kills: DataFrame, placements: DataFrame) -> DataFrame:
    """(item): every name on either side of a kill or in a placement."""
    sides = kills.select(F.explode(F.array("attacker", "victim")).alias("item"))
    return sides.unionByName(placements.select(F.col("player").alias("item"))).distinct()


def feed_comparisons(kills: DataFrame, placements: DataFrame) -> DataFrame:
    """Kills count 1; a place gained says less about strength and counts PLACEMENT_WEIGHT."""
    return usable_kills(kills).withColumn("weight", F.lit(1.0)).unionByName(placement_comparisons(placements))


class _Ahead:
    """Where a vector and its last ``MEMORY`` plain steps point (Anderson's acceleration), from sums over all items alone."""

    def __init__(self) -> None:
        self.best = float("inf")

    def misled(self, change: float) -> bool:
        """Whether the look back led away; then it is to be forgotten."""
        restart = change > 10 * self.best
        self.best = change if restart else min(self.best, change)
        return restart

    @staticmethod
    def weights(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        return np.linalg.lstsq(gram / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale


def _unsettled(most_steps: int, change: float, tolerance: float) -> ArithmeticError:
    return ArithmeticError(f"strengths not settled after {most_steps} steps: the last one moved one by {change:g}, allowed is {tolerance:g}")


def item_strengths(
    comparisons: DataFrame,
    smoothing: float = 0.5,
    tolerance: float = 1e-7,
    most_steps: int = 300,
    broadcast_items: int = 1_000_000,
    items: DataFrame | None = None,
) -> DataFrame:
    """(item, strength) of all items in ``comparisons`` (winner, loser, weight); the mean log strength is 0.

    The steps end when no log strength moves by more than ``tolerance`` against their mean; if ``most_steps`` don't
    get there, ArithmeticError tells how far they came. ``items`` (item) may name all items there are, and others, where
    that is known without going through the comparisons.
    """
    clean = comparisons.select(F.trim("winner").alias("winner"), F.trim("loser").alias("loser"), F.col("weight").cast("double").alias("w")).where(
        "winner <> '' and loser <> '' and winner <> loser and w > 0"
    )
    if items is None:
        clean = materialize(clean, "comparisons")
        items = clean.select(F.explode(F.array("winner", "loser")).alias("item"))
    items = materialize(items.select(F.trim("item").alias("item")).where("item <> ''").distinct(), "items")
    n = items.count()
    if not n:
        return items.select("item", F.lit(1.0).alias("strength"))
    if n <= broadcast_items:
        return _by_vectors(clean, items, smoothing, tolerance, most_steps)
    sums = clean.groupBy("winner", "loser").agg(F.sum("w").alias("w"))
    return _by_tables(sums, items, smoothing, tolerance, most_steps)


def _by_vectors(comparisons: DataFrame, items: DataFrame, smoothing: float, tolerance: float, most_steps: int) -> DataFrame:
    spark = comparisons.sparkSession
    names = np.sort(items.toPandas()["item"].to_numpy(dtype=object))  # at most broadcast_items
    n = len(names)
    ids = F.broadcast(spark.createDataFrame(pd.DataFrame({"item": names, "i": np.arange(n, dtype=np.int32)}), "item string, i int"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "w"))
            pairs, at = np.unique(a.astype(np.int64) * n + b, return_inverse=True)  # repeated pairs of a block become one
            columns = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32), np.bincount(at, w)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["a", "b", "w"])

    blocks = materialize(
        comparisons.join(ids.withColumnsRenamed({"item": "winner", "i": "a"}), "winner")
        .join(ids.withColumnsRenamed({"item": "loser", "i": "b"}), "loser")
        .select("a", "b", "w")
        .mapInArrow(packed, "a binary, b binary, w binary"),
        "comparisons",
    )

    def packed_sums(into: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (into, out)], names=["into", "out"])

    def added(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        into, out = np.zeros(n), np.zeros(n)
        for batch in batches:
            for x, y in zip(batch.column("into"), batch.column("out")):
                into += np.frombuffer(x.as_buffer(), np.float64)
                out += np.frombuffer(y.as_buffer(), np.float64)
        return into, out

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed_sums(*added(batches))

    parts = blocks.rdd.getNumPartitions()

    def flows(strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast(strength)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sent.value
            into, out = np.zeros(n), np.zeros(n)
            for batch in batches:
                for a, b, w in zip(*(batch.column(c) for c in ("a", "b", "w"))):
                    a, b = (np.frombuffer(x.as_buffer(), np.int32) for x in (a, b))
                    rate = np.frombuffer(w.as_buffer(), np.float64) / (s[a] + s[b])
                    into += np.bincount(a, rate * s[b], n)
                    out += np.bincount(b, rate, n)
            yield packed_sums(into, out)

        # One pair of vectors a task, added up eight at a time; the driver adds the last eight.
        sums, left = blocks.mapInArrow(partial, "into binary, out binary"), parts
        while left > 8:
            left = -(-left // 8)
            sums = sums.repartition(left).mapInArrow(together, "into binary, out binary")
        result = added(sums.toArrow().to_batches())
        sent.destroy()
        return result

    x, was, was_step, ahead, met = np.zeros(n), None, None, _Ahead(), None
    dx: list[np.ndarray] = []
    dstep: list[np.ndarray] = []
    change = float("inf")
    for _ in range(most_steps):
        into, out = flows(np.exp(x))
        met = into + out > 0 if met is None else met  # items of no comparison stay out of it
        virtual = smoothing / (np.exp(x) + 1)
        step = np.where(met, np.log((into + virtual) / (out + virtual)) - x, 0.0)
        step[met] -= step[met].mean() if met.any() else 0.0
        change = float(np.abs(step).max())
        if change < tolerance:
            forget(blocks)
            strength = pd.DataFrame({"item": names[met], "strength": np.exp(x + step)[met]})
            return spark.createDataFrame(strength, "item string, strength double")
        if was is not None:
            dx, dstep = [x - was, *dx][:MEMORY], [step - was_step, *dstep][:MEMORY]
        was, was_step = x, step
        if ahead.misled(change):
            dx, dstep, was = [], [], None
        x = x + step
        if dx:
            past = np.array(dstep)
            x = x - ahead.weights(past @ past.T / n, past @ step / n) @ (np.array(dx) + past)
            x = np.where(met, x - x[met].mean(), 0.0)
    raise _unsettled(most_steps, change, tolerance)


def _by_tables(sums: DataFrame, items: DataFrame, smoothing: float, tolerance: float, most_steps: int) -> DataFrame:
    items = materialize(items.withColumn("i", F.monotonically_increasing_id()), "items")
    by_id = materialize(
        sums.join(items.withColumnsRenamed({"item": "winner", "i": "a"}), "winner")
        .join(items.withColumnsRenamed({"item": "loser", "i": "b"}), "loser")
        .select("a", "b", "w")
        .repartition("a"),
        "comparisons",
    )
    # x: log strength of mean 0, step: what a plain step adds to it; dx and dstep: their last differences, newest first.
    none = F.array().cast("array<double>")
    now = items.select("i", F.lit(0.0).alias("x"), *(F.lit(None).cast("double").alias(c) for c in ("was", "was_step")), none.alias("dx"), none.alias("dstep"))
    now, known, ahead, change, before = materialize(now, "strengths"), -1, _Ahead(), float("inf"), None
    for _ in range(most_steps):
        side = now.select("i", F.exp("x").alias("s"))
        flows = (
            by_id.join(side.select(F.col("i").alias("a"), F.col("s").alias("sa")), "a")
            .join(side.select(F.col("i").alias("b"), F.col("s").alias("sb")), "b")
            .withColumn("rate", F.col("w") / (F.col("sa") + F.col("sb")))
            .select(
                F.inline(
                    F.array(
                        F.struct(F.col("a").alias("i"), (F.col("rate") * F.col("sb")).alias("into"), F.lit(0.0).alias("out")),
                        F.struct(F.col("b").alias("i"), F.lit(0.0).alias("into"), F.col("rate").alias("out")),
                    )
                )
            )
            .groupBy("i")
            .agg(F.sum("into").alias("into"), F.sum("out").alias("out"))
        )
        virtual = F.lit(smoothing) / (F.exp("x") + 1)
        step = F.log((F.col("into") + virtual) / (F.col("out") + virtual)) - F.col("x")
        push = lambda new, old: F.when(F.col("was").isNull(), F.col(old)).otherwise(F.slice(F.concat(F.array(new), F.col(old)), 1, MEMORY))
        after = materialize(
            flows.join(now, "i")
            .withColumn("step", step)
            .select("i", "x", "step", push(F.col("x") - F.col("was"), "dx").alias("dx"), push(F.col("step") - F.col("was_step"), "dstep").alias("dstep")),
            "strengths",
        )
        if before is not None:
            forget(before)
        before = after
        known = min(known + 1, MEMORY)
        past = range(known)
        d = lambda j: F.col("dstep")[j]
        row = after.agg(
            F.max("step"), F.min("step"), F.avg("step"),
            *(F.avg(d(j) + F.col("dx")[j]) for j in past),
            *(F.covar_pop(d(j), F.col("step")) for j in past),
            *(F.covar_pop(d(i), d(j)) for i in past for j in past),
        ).first()
        most, least, drift, *sums = row
        change = max(most - drift, drift - least)
        if change < tolerance:
            return items.join(after, "i").select("item", F.exp(F.col("x") + F.col("step") - F.lit(float(drift))).alias("strength"))
        means, right, gram = (np.array(v, dtype=float) for v in (sums[:known], sums[known : 2 * known], sums[2 * known :]))
        restart = ahead.misled(change)
        go = F.col("x") + F.col("step") - F.lit(float(drift))
        if known > 0 and not restart:
            weights = ahead.weights(gram.reshape(known, known), right)
            for j in past:
                go = go - F.lit(float(weights[j])) * (F.col("dx")[j] + d(j) - F.lit(float(means[j])))
        now = after.select("i", go.alias("x"), F.col("x").alias("was"), F.col("step").alias("was_step"), "dx", "dstep")
        if restart:
            now, known = now.withColumns({"dx": none, "dstep": none}), 0
    raise _unsettled(most_steps, change, tolerance)


def distributed_rank(strengths: DataFrame) -> DataFrame:
    """``strengths`` with ``rank`` from 1, the strongest first. Only one count a partition meets in one place."""
    parts = materialize(
        strengths.repartitionByRange(F.desc("strength"), F.asc("item")).withColumn("part", F.spark_partition_id()), "ranges"
    )
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("strength"), "item"))
    return parts.withColumn("k", inside).join(F.broadcast(offsets), "part").select("item", "strength", (F.col("before") + F.col("k")).alias("rank"))
