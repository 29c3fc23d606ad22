"""Groups of everything linked directly or through others.

Edges are cut into ranges of (smaller end, larger end) of bounded size: what
is named in order lies together, and a hub with a third of all edges is spread
over ranges. Union-find inside each range leaves a spanning forest of stars
(member, root of its local tree). A member of several forests is filed under
one of its local roots and ties the others to it; only these ties go on to the
next level, whose ranges are unions of neighbouring ones. When no ties are
left, the filed members find their global root by walking the levels back.

Roots are not the smallest members but those of least priority, a hash of
member and level. Every member that is not of least priority among its
neighbours in some range leaves the graph, a third of them on average at the
worst, so there are at most about log1.5(ranges) levels whatever the names
are, and two where neighbours lie in one range. No task holds more than a
range's edges or one member's local roots (one a range at most), the driver
holds nothing but counts, and roots with more than a range's members are looked
up by broadcast (members / range size of them at most), so none of them is a
hot key of a shuffle.

Defined cases: an edge without one of its ends, or from a member to itself,
ties nothing; repeated and reversed edges change nothing; an empty table has
no groups; members are compared without surrounding blanks; the group id is
the smallest member in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.session import forget, materialize

STAR = "member string, root string"


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(member, root: least priority in its tree) of every member in one range, roots included."""
    number: dict[str, int] = {}
    members: list[str] = []
    weight: list[tuple[int, str]] = []
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def known(name: str, priority: int) -> int:
        k = number.setdefault(name, len(members))
        if k == len(members):
            members.append(name)
            weight.append((priority, name))
            parent.append(k)
        return k

    for pdf in batches:
        for a, b, pa, pb in zip(pdf["a"], pdf["b"], pdf["pa"].tolist(), pdf["pb"].tolist()):
            x, y = find(known(a, pa)), find(known(b, pb))
            if x != y:
                low, high = (x, y) if weight[x] < weight[y] else (y, x)
                parent[high] = low
    for k in range(0, len(members), 50_000):
        part = members[k : k + 50_000]
        yield pd.DataFrame({"member": part, "root": [members[find(number[x])] for x in part]})


def _priority(name: str, level: int) -> Column:
    return F.xxhash64(name, F.lit(level))


def forests(edges: DataFrame, ranges: int, level: int) -> DataFrame:
    """Stars of the local spanning forests of ``edges`` (a, b) in so many ranges."""
    cut = edges.repartition(1) if ranges == 1 else edges.repartitionByRange(ranges, "a", "b")
    return cut.select("a", "b", _priority("a", level).alias("pa"), _priority("b", level).alias("pb")).mapInPandas(_union_find, STAR)


def forest_levels(edges: DataFrame, edges_per_range: int, least_ranges: int) -> list[DataFrame]:
    """The filed members (member, root) of every level, until no ties are left."""
    level = materialize(
        edges.select(F.trim(F.col("a").cast("string")).alias("a"), F.trim(F.col("b").cast("string")).alias("b"))
        .where("a <> '' and b <> '' and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    filed: list[DataFrame] = []
    n = level.count()
    while n:
        k = len(filed)
        stars = materialize(forests(level, max(1 if k else least_ranges, -(-n // edges_per_range)), k), "forest")
        order = F.struct(_priority("root", k), "root")
        chosen = stars.groupBy("member").agg(F.min_by("root", order).alias("best"), F.max_by("root", order).alias("other"))
        filed.append(materialize(chosen.select("member", F.col("best").alias("root")), "filed"))
        tied = chosen.where("best <> other").select("member", "best")
        done = level
        level = materialize(
            stars.join(tied, "member").where("root <> best").select(F.least("best", "root").alias("a"), F.greatest("best", "root").alias("b")).distinct(),
            "ties",
        )
        forget(stars, done)
        n = level.count()
    forget(level)
    return filed


def _look_up(rows: DataFrame, known: DataFrame, bound: int) -> DataFrame:
    """``rows`` (member, root) with ``up``, what ``known`` (root, up) says of the root, if anything.

    Roots of more than ``bound`` rows, at most rows / ``bound`` of them, are looked up by broadcast, all others by a shuffle join.
    """
    crowded = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("root")
    hot = F.broadcast(crowded.join(known, "root", "left").withColumn("crowded", F.lit(True)))
    split = rows.join(hot, "root", "left")
    rest = split.where("crowded is null").select("root", "member").join(known, "root", "left").select("member", "root", "up")
    return split.where("crowded").select("member", "root", "up").unionByName(rest)


def connected_components(edges: DataFrame, edges_per_range: int = 500_000, least_ranges: int = 4) -> DataFrame:
    """(member, group) for every member of an edge of ``edges`` (a, b) between two different ends."""
    filed = forest_levels(edges, edges_per_range, least_ranges)
    if not filed:
        return edges.sparkSession.createDataFrame([], "member string, group string")
    groups = filed[-1]
    for stars in reversed(filed[:-1]):
        # Roots that go on to a later level are filed there; all others are final.
        up = groups.select(F.col("member").alias("root"), F.col("root").alias("up"))
        done = groups
        groups = materialize(_look_up(stars, up, edges_per_range).select("member", F.coalesce("up", "root").alias("root")), "groups")
        forget(stars, done)
    lowest = groups.groupBy("root").agg(F.min("member").alias("up"))
    return _look_up(groups, lowest, edges_per_range).select("member", F.col("up").alias("group"))


def merged_match_edges(matches: DataFrame) -> DataFrame:
    """(a, b) of matches.merged_from, an untidy comma list."""
    return matches.select(F.col("match_id").alias("a"), F.explode(F.split("merged_from", ",")).alias("b"))


def account_edges(merges: DataFrame) -> DataFrame:
    return merges.select(F.col("canonical").alias("a"), F.col("dup").alias("b"))
