"""Items put into containers of fixed capacity, with little room unused.

Items are dealt by hash to shards of bounded size; each shard fills its own
containers, so only a shard's last containers can stay half empty. Inside a
shard only the lengths and how many items have them matter. Sums of single and
of pairs of lengths are indexed once per shard; from the longest length down, a
container opened by an item is completed by one, two or three available
lengths that fill its gap exactly, found at the exact complement of the index.
Counts only fall, so a combination that ran out never comes back: every entry
of the index (for a triple: its first length, under the sum that it completes)
is passed over once, and the search costs what the index holds and not a scan
for each container. What finds no complement is placed best-fit: into the
container with the least sufficient room.

Defined cases: items of size 0 or null take no room and are left out; an item
of exactly the capacity fills a container; a larger one is cut into whole
containers and a rest, and only such items are cut; equal lengths are taken in
the order of ids; the outcome depends on the items alone, not on partitions;
an empty table has no containers; specs without a positive capacity are left
out; more than ``most_specs`` specs are refused, as every item meets each of
them; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 20_000
PACKED = "spec string, shard long, container long, item long, piece long, size long, fill long, capacity long"


class _Sums:
    """Available lengths under counts, with an index of their single, pair and triple sums up to ``capacity``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = [0] * (capacity + 1)
        for length, n in counts.items():
            self.counts[length] = n
        self.lengths = sorted(counts, reverse=True)
        there = np.zeros(capacity + 1, dtype=bool)
        there[self.lengths] = True
        self.there = there
        #: sum -> the larger lengths of its pairs, largest last, as far as they were not yet found to be used up
        self.pairs: dict[int, list[int]] = {}
        #: sum -> first lengths of its triples, largest last
        self.triples: dict[int, list[int]] = {}
        self.ascending = self.lengths[::-1]

    def _pairs_of(self, total: int) -> list[int]:
        found = self.pairs.get(total)
        if found is None:
            high = np.arange((total + 1) // 2, total)
            found = self.pairs[total] = (high[self.there[high] & self.there[total - high]]).tolist()
        return found

    def pair(self, total: int, but: int = 0) -> tuple[int, int] | None:
        """Two available lengths that add up to ``total``, the most unequal ones; one of ``but`` is spoken for."""
        if total < 2:
            return None
        counts, entries = self.counts, self._pairs_of(total)
        at = len(entries) - 1
        while at >= 0:
            x = entries[at]
            y = total - x
            if counts[x] - (x == but) >= 1 + (x == y) and counts[y] - (y == but) >= 1:
                return x, y
            if at == len(entries) - 1 and (counts[x] < 1 + (x == y) or counts[y] < 1):
                entries.pop()  # used up for good, not only spoken for
            at -= 1
        return None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that add up to ``gap``."""
        if self.counts[gap]:
            return (gap,)
        if two := self.pair(gap):
            return two
        firsts = self.triples.get(gap)
        if firsts is None:
            firsts = self.triples[gap] = self.ascending[: bisect.bisect_right(self.ascending, gap - 2)]
        while firsts:
            x = firsts[-1]
            if self.counts[x] and (two := self.pair(gap - x, but=x)):
                return (x, *two)
            firsts.pop()
        return None


def exact_patterns(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], dict[int, int]]:
    """Length combinations that fill ``capacity`` exactly, and the counts that are left."""
    sums = _Sums(counts, capacity)
    left = sums.counts
    patterns = [(capacity,)] * left[capacity]
    left[capacity] = 0
    for first in sums.lengths:
        while left[first]:
            left[first] -= 1
            rest = sums.filling(capacity - first)
            if rest is None:
                left[first] += 1
                break
            for x in rest:
                left[x] -= 1
            patterns.append((first, *rest))
    return patterns, {k: left[k] for k in sums.lengths if left[k]}


def best_fit(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Containers of the remaining lengths, longest first into the least sufficient room."""
    rooms: dict[int, list[list[int]]] = defaultdict(list)
    order: list[int] = []
    containers: list[list[int]] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = bisect.bisect_left(order, length)
            if k < len(order):
                room = order[k]
                box = rooms[room].pop()
                if not rooms[room]:
                    del order[k]
            else:
                room, box = capacity, []
                containers.append(box)
            box.append(length)
            room -= length
            if room:
                if not rooms[room]:
                    bisect.insort(order, room)
                rooms[room].append(box)
    return containers


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    exact, left = exact_patterns(counts, capacity)
    return exact + [tuple(c) for c in best_fit(left, capacity)]


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    spec, shard, capacity = pdf["spec"].iloc[0], int(pdf["shard"].iloc[0]), int(pdf["capacity"].iloc[0])
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows: list[tuple] = []
    container = 0
    for item, size in sorted(zip(pdf["item"].tolist(), pdf["size"].tolist()), reverse=True):
        piece = 0
        while size > capacity:
            rows.append((spec, shard, container, item, piece, capacity, capacity, capacity))
            container, piece, size = container + 1, piece + 1, size - capacity
        waiting[size].append((item, piece))
    for lengths in pack_lengths({k: len(v) for k, v in waiting.items()}, capacity):
        fill = sum(lengths)
        for length in lengths:
            item, piece = waiting[length].pop()
            rows.append((spec, shard, container, item, piece, length, fill, capacity))
        container += 1
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])


def pack(items: DataFrame, specs: DataFrame, shard_items: int = SHARD_ITEMS, most_specs: int = 100, most_tasks: int = 20_000) -> DataFrame:
    """``items`` (item, size) in containers of every spec (spec, capacity): one row per piece.

    ``specs`` is a fixed small list; every item meets each of its rows. The
    number of shards follows from the count of the items, and each shard of a
    spec is a task of its own as long as there are at most ``most_tasks``.
    """
    sized = items.where("size > 0").select(F.col("item").cast("long").alias("item"), F.col("size").cast("long").alias("size"))
    shards = max(1, -(-sized.count() // shard_items))
    chosen = specs.select("spec", "capacity").where("capacity > 0").distinct().orderBy("spec", "capacity").limit(most_specs + 1).collect()
    if len(chosen) > most_specs:
        raise ValueError(f"more than {most_specs} specs")
    if not chosen:
        return items.sparkSession.createDataFrame([], PACKED)
    capacities = [
        F.struct(F.lit(k).cast("long").alias("k"), F.lit(r.spec).alias("spec"), F.lit(int(r.capacity)).cast("long").alias("capacity"))
        for k, r in enumerate(chosen)
    ]
    # Ranges of numbered groups, as hashed ones would put several into one task.
    return (
        sized.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
        .withColumn("c", F.explode(F.array(*capacities)))
        .select("item", "size", "shard", "c.spec", "c.capacity", (F.col("shard") * len(chosen) + F.col("c.k")).alias("group"))
        .repartitionByRange(min(shards * len(chosen), most_tasks), "group")
        .groupBy("group")
        .applyInPandas(_pack_shard, PACKED)
    )
