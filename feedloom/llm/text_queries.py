"""Queries over documents: containers (p7), mixtures (p8) and sentences (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.mixing import mix
from feedloom.llm.packing import pack
from feedloom.llm.sentences import sentence_boundaries, sentences
from feedloom.llm.tokens import token_sizes
from feedloom.session import materialize, table


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Contents and fill of every container of every spec, one row per piece of a document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    items = materialize(token_sizes(documents).select(F.col("doc_id").alias("item"), F.col("tokens").alias("size")), "sizes")
    specs = table(spark, folder, "pack_specs").select("spec", F.col("capacity_tokens").alias("capacity"))
    return pack(items, specs).select(
        "spec", "shard", "container", F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"), "fill",
        (F.col("capacity") - F.col("fill")).alias("unused"),
    )


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec: number of containers, tokens, capacity and the share that is filled."""
    pieces = p7_containers(spark, folder)
    return (
        pieces.groupBy("spec", "shard", "container")
        .agg(F.max("fill").alias("fill"), F.max("unused").alias("unused"))
        .groupBy("spec")
        .agg(
            F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.sum("unused").alias("unused"),
            (F.sum("fill") / F.sum(F.col("fill") + F.col("unused"))).alias("filled_share"),
        )
    )


def p7_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec: documents packed, containers over their capacity, texts cut though they fit, and tokens lost or packed twice."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    sizes = materialize(token_sizes(documents).where("tokens > 0").select(F.col("doc_id").alias("item"), F.col("tokens").alias("size")), "sizes")
    specs = table(spark, folder, "pack_specs").select("spec", F.col("capacity_tokens").alias("capacity"))
    pieces = materialize(pack(sizes, specs), "containers")
    boxes = pieces.groupBy("spec", "shard", "container").agg(F.sum("size").alias("fill"), F.max("capacity").alias("capacity"))
    over = boxes.groupBy("spec").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("over_capacity"))
    of_item = pieces.groupBy("spec", "item").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("packed"), F.max("capacity").alias("capacity"))
    checked = of_item.join(sizes, "item").groupBy("spec").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("wrongly_cut"),
        F.sum(F.abs(F.col("packed") - F.col("size"))).alias("tokens_amiss"),
    )
    return checked.join(over, "spec").select("spec", "documents", "over_capacity", "wrongly_cut", "tokens_amiss")


def p8_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Per source with a target: documents used too often, chosen twice, or of another source."""
    selection = _mixture(spark, folder)[0]
    known = table(spark, folder, "documents").select("doc_id", F.trim("source").alias("own"))
    goals = table(spark, folder, "source_targets").select(F.trim("source").alias("source"), "max_repeats")
    of_doc = selection.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("uses").alias("uses")).join(known, "doc_id")
    joined = goals.join(of_doc, "source", "left")
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return joined.groupBy("source").agg(
        bad(F.col("uses") > F.col("max_repeats")).alias("used_too_often"), bad(F.col("rows") > 1).alias("chosen_twice"), bad(F.col("own") != F.col("source")).alias("of_another_source")
    )


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = token_sizes(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mix(documents, table(spark, folder, "source_targets"), of_all=True)


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached share of every source, and what it is short of."""
    return _mixture(spark, folder)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_boundaries(table(spark, folder, "documents"))


def p9_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence with its place and text."""
    return sentences(table(spark, folder, "documents"))


QUERIES = {
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_validity": p7_validity,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p8_validity": p8_validity,
    "p9_found": p9_found,
    "p9_sentences": p9_sentences,
}
ORACLE = {
    "p7_validity": "select spec, (select count(*) from documents where text <> '') as documents, 0 as over_capacity, 0 as wrongly_cut, 0 as tokens_amiss from pack_specs",
    "p8_validity": "select trim(source) as source, 0 as used_too_often, 0 as chosen_twice, 0 as of_another_source from source_targets",
}
