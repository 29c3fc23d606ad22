"""Joins in time: intervals, nearest rows and overlaps, by time buckets.

Both sides get an equi key of (key, bucket of time), and the exact condition is
checked on candidates only. The right side is put into the buckets that its
window touches, so each pair meets once and no theta join over whole tables
remains. Buckets are as wide as the window, so a row enters two or three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width)).cast("long")


def within(left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str, window_us: int) -> DataFrame:
    """Pairs of rows with equal ``keys`` and times at most ``window_us`` apart, both ends included."""
    spread = F.explode(F.sequence(_bucket(F.col(right_us) - window_us, window_us), _bucket(F.col(right_us) + window_us, window_us)))
    a = left.withColumn("_b", _bucket(F.col(left_us), window_us))
    b = right.withColumn("_b", spread)
    return a.join(b, [*keys, "_b"]).where(F.abs(F.col(left_us) - F.col(right_us)) <= window_us).drop("_b")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_us: str, right_us: str, tie: str, window_us: int) -> DataFrame:
    """Per left row the nearest right row in the window (earliest ``tie`` of equal distances); rows without one are left out."""
    value = F.struct(F.abs(F.col(left_us) - F.col(right_us)).alias("distance"), F.col(tie).alias("tie"))
    return (
        within(left, right, keys, left_us, right_us, window_us)
        .groupBy(left_id)
        .agg(F.min(value).alias("m"))
        .select(left_id, F.col("m.tie").alias(tie), F.col("m.distance").alias("distance_us"))
    )


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_us: str, right_us: str, tie: str, cell_us: int = 3_600_000_000) -> DataFrame:
    """Per left row the nearest right row of its key at any distance; of equal distances the one before, then the smallest ``tie``.

    Rows are ordered inside cells of time only. What a row cannot see in its
    cell is carried in from the nearest cell that has a right row, by windows
    over one row a cell.
    """
    from pyspark.sql import Window

    cell = lambda c: F.floor(F.col(c) / F.lit(cell_us)).cast("long")
    a = left.select(*keys, F.col(left_us).alias("us"), F.col(left_id).alias("id"), F.lit(None).cast("struct<us:bigint,tie:string>").alias("r"))
    b = right.select(*keys, F.col(right_us).alias("us"), F.lit(None).cast("long").alias("id"), F.struct(F.col(right_us).alias("us"), F.col(tie).cast("string").alias("tie")).alias("r"))
    rows = a.unionByName(b).withColumn("cell", cell("us"))
    cells = rows.groupBy(*keys, "cell").agg(F.max("r").alias("latest"), F.min("r").alias("earliest"))
    along = Window.partitionBy(*keys).orderBy("cell")
    carried = cells.select(
        *keys, "cell",
        F.last("latest", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"),
        F.first("earliest", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("from_behind"),
    )
    up = Window.partitionBy(*keys, "cell").orderBy("us", F.col("r.tie").asc_nulls_last())
    down = Window.partitionBy(*keys, "cell").orderBy(F.desc("us"), F.col("r.tie").desc_nulls_last())
    past = F.last("r", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    future = F.last("r", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("past", past).withColumn("future", future).where("id is not null").join(carried, [*keys, "cell"])
    found = found.withColumns({"past": F.coalesce("past", "from_before"), "future": F.coalesce("future", "from_behind")})
    back, ahead = F.col("us") - F.col("past.us"), F.col("future.us") - F.col("us")
    best = F.when(F.col("future").isNull() | (back <= ahead), F.col("past")).otherwise(F.col("future"))
    return found.where(best.isNotNull()).select(F.col("id").alias(left_id), best["tie"].alias(tie), F.abs(best["us"] - F.col("us")).alias("distance_us"))


def overlapping(spans: DataFrame, start_us: str, end_us: str, id_: str, slop_us: int, width_us: int, crowd: int = 2_000) -> DataFrame:
    """Pairs (id_a < id_b) of spans that overlap when ``slop_us`` may lie between them.

    A pair is made in the first bucket that both touch. A bucket of more than
    ``crowd`` spans is dealt to cells by one side, and its other side goes to
    all of them, so no task compares more than ``crowd`` with all.
    """
    reach = spans.select("*", F.explode(F.sequence(_bucket(F.col(start_us) - slop_us, width_us), _bucket(F.col(end_us) + slop_us, width_us))).alias("_b"))
    sizes = reach.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("long").alias("_cells"))
    reach = reach.join(sizes, "_b")
    own = F.pmod(F.xxhash64(F.col(id_)), F.col("_cells"))
    a = reach.select("_b", own.alias("_c"), *(F.col(c).alias(f"{c}_a") for c in spans.columns))
    b = reach.select("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1)).alias("_c"), *(F.col(c).alias(f"{c}_b") for c in spans.columns))
    first = F.greatest(_bucket(F.col(f"{start_us}_a") - slop_us, width_us), _bucket(F.col(f"{start_us}_b") - slop_us, width_us))
    meets = (F.col(f"{start_us}_a") - slop_us <= F.col(f"{end_us}_b")) & (F.col(f"{start_us}_b") - slop_us <= F.col(f"{end_us}_a"))
    return a.join(b, ["_b", "_c"]).where((F.col("_b") == first) & (F.col(f"{id_}_a") < F.col(f"{id_}_b")) & meets).drop("_b", "_c")


def around(rows: DataFrame, key: str, at: str, reach: int, cell: int = 3_600) -> DataFrame:
    """``rows`` with ``around``, how many rows of the key are at most ``reach`` away in ``at`` (a LONG), itself included.

    Equal times are counted first, and frames run inside cells of time, into
    whose edges the counts of the neighbours are copied.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(key, at).agg(F.count(F.lit(1)).alias("_n"))
    home = F.floor(F.col(at) / cell).cast("long")
    spread = F.array_distinct(F.array(F.floor((F.col(at) - reach) / cell).cast("long"), home, F.floor((F.col(at) + reach) / cell).cast("long")))
    inside = counts.withColumn("_home", home).withColumn("_cell", F.explode(spread))
    frame = Window.partitionBy(key, "_cell").orderBy(at).rangeBetween(-reach, reach)
    summed = inside.withColumn("around", F.sum("_n").over(frame)).where("_home = _cell").select(key, at, "around")
    return rows.join(summed, [key, at])
