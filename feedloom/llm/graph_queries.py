"""Queries of groups (p5) and of the ranking from comparisons (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.components import account_edges, connected_components, merged_match_edges
from feedloom.llm.ranking import distributed_rank, feed_comparisons, feed_items, item_strengths, usable_kills
from feedloom.session import table

PACE = "PaceBot_Meridian"


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {
        "match": merged_match_edges(table(spark, folder, "matches")),
        "player": account_edges(table(spark, folder, "account_merges")),
    }
    out = [
        connected_components(edges).select(F.lit(kind).alias("kind"), F.col("group").alias("group_id"), F.col("member").alias("member_id"))
        for kind, edges in kinds.items()
    ]
    return out[0].unionByName(out[1])


def p5_all_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every match id and account name, those tied to nothing as a group of their own."""
    own = (
        table(spark, folder, "matches")
        .select(F.lit("match").alias("kind"), F.trim("match_id").alias("member_id"))
        .unionByName(table(spark, folder, "player_ratings").select(F.lit("player").alias("kind"), F.trim("player").alias("member_id")))
        .where("member_id <> ''")
        .distinct()
    )
    tied = p5_found(spark, folder)
    return own.join(tied, ["kind", "member_id"], "full").select(
        "kind", F.coalesce("group_id", "member_id").alias("group_id"), "member_id"
    )


def _strengths(spark: SparkSession, folder: str) -> DataFrame:
    kills, places = table(spark, folder, "match_kills"), table(spark, folder, "match_placements")
    return item_strengths(feed_comparisons(kills, places), items=feed_items(kills, places))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    strengths = _strengths(spark, folder)
    kills = usable_kills(table(spark, folder, "match_kills"))
    often = (
        kills.select(F.explode(F.array("winner", "loser")).alias("item"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where("rows >= 20")
    )
    pace = strengths.where(F.col("item") == PACE).select(F.col("strength").alias("pace"))
    return (
        strengths.join(often, "item")
        .crossJoin(F.broadcast(pace.agg(F.max("pace").alias("pace"))))  # one row
        .where("strength > pace")
        .select(F.col("item").alias("player"))
    )


def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All players by rank, with their strength and log strength."""
    return distributed_rank(_strengths(spark, folder)).select(
        F.col("item").alias("player"), "rank", "strength", F.log("strength").alias("log_strength")
    )


QUERIES = {"p5_found": p5_found, "p5_all_groups": p5_all_groups, "p3_found": p3_found, "p3_ranking": p3_ranking}

_LINKS = """
with recursive e as (
  select 'match' as kind, trim(match_id) as a, trim(x) as b from (select match_id, unnest(string_split(merged_from, ',')) as x from matches)
  union all select 'player', trim(canonical), trim(dup) from account_merges),
l as (select distinct kind, a, b from (select kind, a, b from e union all select kind, b, a from e) where a <> '' and b <> '' and a <> b),
r as (select distinct kind, a as member, a as reached from l
      union select r.kind, r.member, l.b from r join l on l.kind = r.kind and l.a = r.reached),
g as (select kind, min(reached) as group_id, member as member_id from r group by kind, member)
"""

ORACLE = {
    "p5_found": _LINKS + "select kind, group_id, member_id from g",
    "p5_all_groups": _LINKS
    + """select kind, group_id, member_id from g union
    select kind, id, id from (select 'match' as kind, trim(match_id) as id from matches
      union select 'player', trim(player) from player_ratings) o
    where id <> '' and not exists (select 1 from g where g.kind = o.kind and g.member_id = o.id)""",
}
