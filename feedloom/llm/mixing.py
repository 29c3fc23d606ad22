"""Records of several sources mixed to target weights.

Documents are dealt by hash to cells of bounded size, ordered there by a seeded
hash and cut into blocks of about equal size in tokens. Sainte-Lague
apportionment gives each source a whole number of ``block_tokens`` by highest
quotients (share / 1, / 3, / 5, ...), each source's to its groups of cells the
same way, and each group's to its cells. There are as many groups as cells in
a group, so the driver sees sources times the root of the cells, and a task
that apportions a group as many rows. A shard (the documents of a source in a
cell) then takes whole rounds while a source is repeated, and after that each
block, in seeded order, that fits what is left of its quota, and at last single
documents of the blocks left over in the same way. So no document is used more
often than ``max_repeats``, no two uses differ by more than one within a shard,
and what a shard is short of is less than its smallest unused document.

With ``of_all`` each source is to have its share of all tokens of the documents,
those of no source or target included: a source that is short of it gives all it
has ``max_repeats`` times, the others stay at their own share, and the report
says what is missing.

Otherwise shares are strict. The total is the largest at which no source that
has documents runs out: min over sources of (tokens * max_repeats / share). With
``total_tokens`` a larger one may be asked for; then sources that run out give
all they have and their missing blocks go to the others by their next quotients.

Defined cases: sources are compared without surrounding blanks; documents
without a source or of one without a target, and empty ones, are not used;
sources with a target and no documents get no block, and strict shares are then
taken relative to each other (not those of all tokens); shares not above 0 or null count as no target,
repeats below 1 or null as no use; of a source listed twice the larger share
counts; ties between quotients go to the first source in code-point order; of
rows with one doc_id the first by source and tokens counts; an empty table
gives an empty mixture; more than ``most_sources`` targets are refused.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialize

BLOCK_TOKENS = 1024


def sainte_lague(weights: dict, seats: int, most: dict | None = None) -> dict:
    """Whole numbers of ``seats`` by highest quotients weight / (2 n + 1), no more than ``most`` each.

    A start by rounding down takes whole seats at once, so the work is that of
    the parties and not of the seats.
    """
    most = {k: seats for k in weights} if most is None else most
    live = {k: w for k, w in weights.items() if w > 0 and most.get(k, 0) > 0}
    given = {k: 0 for k in weights}
    seats = min(seats, sum(most[k] for k in live))
    if not live or seats <= 0:
        return given
    # A divisor below the final one gives no party more than it is due.
    low, high = 0.0, 2.0 * (seats + len(live)) / min(live.values())
    total = lambda m: sum(min(most[k], int(w * m + 0.5)) for k, w in live.items())
    for _ in range(200):
        mid = (low + high) / 2
        if total(mid) <= seats:
            low = mid
        else:
            high = mid
    given |= {k: min(most[k], int(w * low + 0.5)) for k, w in live.items()}
    heap = [(-w / (2 * given[k] + 1), k) for k, w in live.items() if given[k] < most[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(given.values())):
        _, k = heapq.heappop(heap)
        given[k] += 1
        if given[k] < most[k]:
            heapq.heappush(heap, (-live[k] / (2 * given[k] + 1), k))
    return given


BLOCKS = "source string, doc_id long, tokens long, cell long, block long, order long"


def make_blocks(documents: DataFrame, cells: int, seed: int, block_tokens: int) -> DataFrame:
    """BLOCKS of ``documents`` (source, doc_id, tokens): documents in seeded order, a block ends where its tokens are full."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "source", "tokens"], na_position="last").drop_duplicates("doc_id").sort_values(["key", "doc_id"])
        before = pdf.groupby("source", dropna=False)["tokens"].cumsum() - pdf["tokens"]
        pdf = pdf.assign(block=before // block_tokens, order=range(len(pdf)))
        return pdf[["source", "doc_id", "tokens", "cell", "block", "order"]]

    return (
        documents.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(cells)))
        .withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
        .groupBy("cell")
        .applyInPandas(cut, BLOCKS)
    )


def _choose(seed: int):
    """The rows of one shard, in seeded order of its blocks, with their uses; ``plan`` has its rounds and its gap."""

    def choose(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or plan.empty:
            return pd.DataFrame({c.split()[0]: [] for c in SELECTED.split(", ")})
        rounds, gap = int(plan["rounds"].iloc[0]), int(plan["gap"].iloc[0])
        sizes = rows.groupby("block")["tokens"].sum()
        blocks = np.random.default_rng([seed, int(rows["cell"].iloc[0])]).permutation(np.sort(sizes.index.to_numpy()))
        taken = set()
        for block in blocks.tolist():
            if sizes[block] <= gap:
                gap -= int(sizes[block])
                taken.add(block)
        extra = rows["block"].isin(taken).to_numpy()
        tokens = rows["tokens"].to_numpy()
        for k in np.argsort(rows["order"].to_numpy(), kind="stable").tolist() if gap else []:
            if not extra[k] and tokens[k] <= gap:
                gap -= int(tokens[k])
                extra[k] = True
        out = rows.assign(uses=rounds + extra.astype("int32"))
        return out[out["uses"] > 0][[c.split()[0] for c in SELECTED.split(", ")]]

    return choose


SELECTED = "doc_id long, source string, tokens long, cell long, block long, uses int"


def mix(
    documents: DataFrame,
    targets: DataFrame,
    seed: int = 42,
    block_tokens: int = BLOCK_TOKENS,
    docs_per_cell: int = 20_000,
    total_tokens: int | None = None,
    of_all: bool = False,
    most_sources: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """``documents`` (doc_id, source, tokens): (selection, report).

    The selection has (doc_id, source, tokens, cell, block, uses); the report
    (source, target_share, tokens_available, max_repeats, quota_blocks,
    tokens_used, reached_share, most_uses, wanted_tokens, missing_tokens, reached_of_all)
    has every source of either side. ``reached_share`` is that of the mixture,
    ``reached_of_all`` that of all tokens of ``documents``.
    """
    spark = documents.sparkSession
    listed = (
        targets.select(F.trim("source").alias("source"), "target_share", "max_repeats")
        .where("source <> '' and target_share > 0 and max_repeats >= 1")
        .groupBy("source")
        .agg(F.max("target_share").alias("share"), F.max_by("max_repeats", "target_share").alias("repeats"))
        .limit(most_sources + 1)
        .collect()  # the fixed list of targets
    )
    if len(listed) > most_sources:
        raise ValueError(f"more than {most_sources} sources with a target")
    goals = {r.source: (r.share, r.repeats) for r in listed}
    source = F.trim("source")
    sized = materialize(
        documents.select(
            F.when(source != "", source).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("long").alias("tokens")
        ).where("tokens > 0"),
        "sized",
    )
    cells = max(1, -(-sized.count() // docs_per_cell))
    everything = materialize(make_blocks(sized, cells, seed, block_tokens), "blocks")
    all_tokens = everything.agg(F.sum("tokens")).first()[0] or 0
    sized = everything.where("source is not null")
    blocks = sized.where(F.col("source").isin(list(goals)))
    groups = math.isqrt(cells - 1) + 1
    shards = materialize(
        blocks.groupBy("source", "cell").agg(F.sum("tokens").alias("tokens")).withColumn("group", F.col("cell") % groups), "shards"
    )
    per_group = {
        (r.source, r.group): r.tokens
        for r in shards.groupBy("source", "group").agg(F.sum("tokens").alias("tokens")).collect()  # targets times the root of the cells
    }
    have: dict[str, int] = {}
    for (name, _), tokens in per_group.items():
        have[name] = have.get(name, 0) + tokens
    limit = {s: max(1, -(-have[s] * goals[s][1] // block_tokens)) for s in have}  # the last block may be a part of one
    if of_all:
        total = all_tokens * sum(share for share, _ in goals.values())
        shares = {s: goals[s][0] / sum(share for share, _ in goals.values()) for s in sorted(goals)}
        quota = {s: min(n, limit.get(s, 0)) for s, n in sainte_lague(shares, round(total / block_tokens)).items()}
    else:
        shares = {s: goals[s][0] / sum(goals[t][0] for t in have) for s in sorted(have)}
        reachable = min((have[s] * goals[s][1] / shares[s] for s in shares), default=0)
        total = reachable if total_tokens is None else total_tokens
        quota = sainte_lague(shares, round(total / block_tokens), limit)
    wanted_tokens = {s: round(total * share) for s, share in shares.items()}
    due: list[tuple[str, int, int, int]] = []
    for name, n in quota.items():
        of = {g: tokens for (s, g), tokens in per_group.items() if s == name}
        repeats = goals[name][1]
        if n and n * block_tokens >= have[name] * repeats:  # all of it
            due += [(name, g, -1, repeats) for g in of]
        elif n:
            most = {g: -(-t * repeats // block_tokens) for g, t in of.items()}
            due += [(name, g, k, repeats) for g, k in sainte_lague({g: float(t) for g, t in of.items()}, n, most).items()]

    def turns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, repeats = int(pdf["due"].iloc[0]), int(pdf["repeats"].iloc[0])
        of = dict(sorted(zip(pdf["cell"].tolist(), pdf["tokens"].tolist())))
        if n < 0:
            wanted = {cell: t * repeats for cell, t in of.items()}
        else:
            most = {cell: -(-t * repeats // block_tokens) for cell, t in of.items()}
            given = sainte_lague({cell: float(t) for cell, t in of.items()}, n, most)
            wanted = {cell: min(given[cell] * block_tokens, t * repeats) for cell, t in of.items()}
        rows = [(pdf["source"].iloc[0], cell, w // of[cell], w % of[cell]) for cell, w in wanted.items()]
        return pd.DataFrame(rows, columns=["source", "cell", "rounds", "gap"])

    plan = (
        shards.join(F.broadcast(spark.createDataFrame(due, "source string, group long, due long, repeats long")), ["source", "group"])
        .groupBy("source", "group")
        .applyInPandas(turns, "source string, cell long, rounds long, gap long")
    )
    selection = materialize(
        blocks.groupBy("source", "cell").cogroup(plan.groupBy("source", "cell")).applyInPandas(_choose(seed), SELECTED), "mixture"
    )
    goal_rows = spark.createDataFrame(
        [(s, share, repeats, quota.get(s, 0), wanted_tokens.get(s, 0)) for s, (share, repeats) in goals.items()],
        "source string, target_share double, max_repeats int, quota_blocks long, wanted_tokens long",
    )
    used = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    all_used = used.agg(F.sum("tokens_used").alias("all_used"))
    report = (
        sized.groupBy("source")
        .agg(F.sum("tokens").alias("tokens_available"))
        .join(goal_rows, "source", "full")
        .join(used, "source", "left")
        .crossJoin(F.broadcast(all_used))  # one row
        .select(
            "source",
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce("tokens_available", F.lit(0)).cast("long").alias("tokens_available"),
            F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            F.coalesce("quota_blocks", F.lit(0)).cast("long").alias("quota_blocks"),
            F.coalesce("tokens_used", F.lit(0)).cast("long").alias("tokens_used"),
            F.coalesce(F.col("tokens_used") / F.col("all_used"), F.lit(0.0)).alias("reached_share"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            F.coalesce("wanted_tokens", F.lit(0)).cast("long").alias("wanted_tokens"),
            F.greatest(F.coalesce("wanted_tokens", F.lit(0)) - F.coalesce("tokens_used", F.lit(0)), F.lit(0)).cast("long").alias("missing_tokens"),
            (F.coalesce("tokens_used", F.lit(0)) / F.lit(float(max(all_tokens, 1)))).alias("reached_of_all"),
        )
    )
    return selection, report
