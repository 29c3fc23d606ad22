"""Connected components by alternating star contractions, for identity clusters of names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import forget, materialize


def _at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def top(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    if parent:
        yield pd.DataFrame({"member": list(parent), "group": [top(x) for x in parent]})


def components(edges: DataFrame, at_once: int = 200_000, members: int | None = None) -> DataFrame:
    """(member, group) of undirected ``edges`` (a, b); the group is the smallest member.

    Up to ``at_once`` edges (counted first) are united in one task, and so are
    any between no more ``members``, if that bound is known, than so many edges
    can have: edges stream by, only members are held. Beyond that
    large-star and small-star steps connect every node with the smallest of its
    neighbourhood until only stars remain; each step is two aggregations, and a
    node's edges are never gathered in one row.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= at_once or (members is not None and members <= 2 * at_once):
        kind = now.schema["a"].dataType.simpleString()
        return now.repartition(1).mapInPandas(_at_once, f"member {kind}, group {kind}")
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "small-star")
        settled = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        forget(now, large)
        now = after
        if settled:
            break
    heads = now.select(F.col("b").alias("member"), F.col("b").alias("group")).distinct()
    return now.select(F.col("a").alias("member"), F.col("b").alias("group")).unionByName(heads)
