"""Repeated reads looked at afterwards: chains over stored rows, what is left of them, and audits of what was taken away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.similarity import ratio
from feedloom.functions.text import line_signature, norm
from feedloom.operators.dedup import S, DedupRules, _stretches, fold_sorted
from feedloom.operators.graph import components
from feedloom.operators.joins import within

#: Rule sets of clean-ups over stored rows: the most similar chain, no look at victims alone, one cap for all types.
RETRO = DedupRules(exact_us=-1, victim_similarity=2.0, best_match=True, one_cap=2, rated_types=())
RETRO_MERGED = DedupRules(exact_us=-1, victim_similarity=2.0, best_match=True, one_cap=2, rated_types=(), merge_types=True)
RETRO_DRIFTING = DedupRules(exact_us=-1, victim_similarity=2.0, best_match=True, one_cap=4, rated_types=(), drifting=True, as_written=True)

CHAINED = "key string, event_type string, attacker string, victim string, id long, us long, place long, kept boolean"


def exact_chains(rows: DataFrame, gap_us: int = 150 * S, look_back_us: int = 1800 * S, most: int = 4) -> DataFrame:
    """``rows`` (key, event_type, attacker, victim, id, us) of equal names and type in chains: ``place`` in the chain, and whether the row is kept.

    A row less than ``gap_us`` behind the last one is next in its chain. A new
    chain counts the rows kept in the ``look_back_us`` before it. Rows beyond
    ``most`` go. A silence longer than the look-back leaves nothing to count,
    so stretches between such silences are folded on their own.
    """
    keys = ["key", "event_type", "attacker", "victim"]
    named = rows.where("trim(attacker) <> '' and trim(victim) <> ''").select(*keys, "id", "us")

    def step(state: dict, row: dict) -> tuple:
        us, last = row["us"], state["last"]
        kept = state["kept"] = [k for k in state["kept"] if k >= us - look_back_us]
        state["place"] = state["place"] + 1 if last is not None and us - last < gap_us else len(kept) + 1
        state["last"] = us
        if state["place"] <= most:
            kept.append(us)
        return (*(row[c] for c in (*keys, "id", "us")), state["place"], state["place"] <= most)

    # Nulls of the type are a key of their own.
    placed = _stretches(named.withColumn("event_type", F.coalesce("event_type", F.lit(""))), keys, max(gap_us, look_back_us))
    return fold_sorted(placed, [*keys, "stretch"], ["us", "id"], lambda: {"kept": [], "place": 0, "last": None}, step, CHAINED)


def residual_jitter(survivors: DataFrame, window_us: int = 150 * S, least: float = 0.55, below: float = 0.82) -> tuple[DataFrame, DataFrame]:
    """(pairs, clusters) of rows that one misread name left apart, among ``survivors`` (key, id, us, attacker, victim).

    A pair has one side equal in letters and digits and the other alike, from
    ``least`` to under ``below``. Rows meet under the equal side, so no pair of
    rows is made without one. Clusters are (group, rows), what pairs tie together.
    """
    rows = survivors.where("trim(attacker) <> '' and trim(victim) <> ''").select("key", "id", "us", norm("attacker").alias("na"), norm("victim").alias("nv"))

    def side(equal: str, other: str) -> DataFrame:
        a = rows.select("key", F.col(equal).alias("same"), F.col("id").alias("a"), F.col("us").alias("at"), F.col(other).alias("x"))
        b = rows.select("key", F.col(equal).alias("same"), F.col("id").alias("b"), F.col("us").alias("bt"), F.col(other).alias("y"))
        first = (F.col("at") < F.col("bt")) | ((F.col("at") == F.col("bt")) & (F.col("a") < F.col("b")))
        near = within(a, b, ["key", "same"], "at", "bt", window_us).where(first & (F.col("x") != F.col("y")))
        return near.withColumn("r", ratio("x", "y")).where(F.col("r").between(least, below) & (F.col("r") < below)).select("a", "b")

    pairs = side("na", "nv").unionByName(side("nv", "na")).distinct()
    clusters = components(pairs).groupBy("group").agg(F.count(F.lit(1)).alias("rows"))
    return pairs, clusters


def chain_statistics(kept: DataFrame) -> DataFrame:
    """(kept_id, rows, span_s, least_ratio) of chains of two rows or more; ``kept`` is of ``dedup.dedup_events``. Lines are compared with the kept one."""
    lines = kept.where("kept_id is not null").select("kept_id", "id", "us", line_signature("attacker", "victim").alias("line"))
    own = lines.where("id = kept_id").select("kept_id", F.col("line").alias("kept_line"))
    scored = lines.join(own, "kept_id").withColumn("r", F.when(F.col("line") == F.col("kept_line"), F.lit(1.0)).otherwise(ratio("kept_line", "line")))
    return (
        scored.groupBy("kept_id")
        .agg(F.count(F.lit(1)).alias("rows"), ((F.max("us") - F.min("us")) / 1e6).alias("span_s"), F.min("r").alias("least_ratio"))
        .where("rows > 1")
    )


def deletion_audit(kept: DataFrame, sure: float = 0.90) -> DataFrame:
    """(grade, n): suppressed rows by how safe that was: 'exact' (same letters and digits), 'similar' (``sure``), or 'flagged' to be looked at."""
    sig = line_signature("attacker", "victim")
    own = kept.where("id <> kept_id").select("id", "kept_id", sig.alias("line"))
    first = kept.where("id = kept_id").select("kept_id", sig.alias("kept_line"))
    pairs = own.join(first, "kept_id")
    same = F.col("line") == F.col("kept_line")
    r = ratio(F.when(~same, F.col("line")), F.col("kept_line"))
    return pairs.withColumn("r", r).groupBy(F.when(same, "exact").when(F.col("r") >= sure, "similar").otherwise("flagged").alias("grade")).agg(F.count(F.lit(1)).alias("n"))


def chains_to_look_at(kept: DataFrame, largest: int = 3, borderline: int = 4) -> DataFrame:
    """(why, kept_id, rows, span_s, least_ratio): the longest chains and those of least likeness; ties by id."""
    chains = chain_statistics(kept)
    long = chains.orderBy(F.desc("rows"), "kept_id").limit(largest).withColumn("why", F.lit("largest"))
    unlike = chains.orderBy("least_ratio", "kept_id").limit(borderline).withColumn("why", F.lit("borderline"))
    return long.unionByName(unlike).select("why", "kept_id", "rows", "span_s", "least_ratio")


def repeated_deaths(deaths: DataFrame, window_us: int = 120 * S) -> DataFrame:
    """(game, victim_key, death, first_us, last_us, reads): reads of one death put together; a later one of the same victim is another death.

    Rows of one victim key (letters and digits) are parted by more than ``window_us``; the window slides with every read.
    """
    order = Window.partitionBy("game", "victim_key").orderBy("us", "id")
    rows = deaths.select("game", "id", "us", norm("victim").alias("victim_key")).where("victim_key <> ''")
    opens = F.when(F.col("us") - F.lag("us").over(order) <= window_us, 0).otherwise(1)
    numbered = rows.withColumn("o", opens).withColumn("death", F.sum("o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("game", "victim_key", "death").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("reads"), F.min("id").alias("id"))


def agreement(reads: DataFrame, second: DataFrame, parse, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(checked, corrections): ``reads`` (id, streamer, timestamp, text) against a second reading ``second`` (id, text) of the same rows.

    From a likeness of ``least`` on a read is confirmed, else it is a correction: the second text is parsed
    (``parse(rows, column)``), and if that gives a kill, it becomes an event row of source 'check'. A second reading that is
    missing, blank or EMPTY says nothing.
    """
    other = second.select("id", F.trim("text").alias("second")).where("second <> '' and second <> 'EMPTY'")
    pairs = reads.join(other, "id")
    r = F.coalesce(ratio(F.lower("text"), F.lower("second")), F.lit(0.0))
    checked = pairs.withColumn("likeness", r).withColumn("verdict", F.when(F.col("likeness") >= least, "confirmed").otherwise("correction"))
    corrected = parse(checked.where("verdict = 'correction'").select("id", "streamer", "timestamp", "second"), "second").where("event_type = 'Kill'")
    corrections = corrected.select(
        "id", "streamer", "timestamp", F.col("second").alias("raw_text"), "canonical", "event_type", "attacker", "victim",
        F.lit("check").alias("source"), F.lit(1).alias("gemini_corrected"),
    )
    return checked.select("id", "likeness", "verdict"), corrections

