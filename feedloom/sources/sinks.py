"""Writing results: idempotent replacement, upserts, renames and atomic publishing.

Parquet has no row updates: an upsert is a join that makes the new table, and
publishing swaps it in whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str) -> str:
    """Write a version of a table and point to it by an atomic rename: readers see the old or the new one."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    fs = spark._jvm.org.apache.hadoop.fs
    temp, final = fs.Path(f"{path}/_next.{version}"), fs.Path(f"{path}/LATEST.json")
    system = temp.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(temp, True)
    out.write(bytearray(json.dumps({"version": version}), "utf-8"))
    out.close()
    context = fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    context.rename(system.makeQualified(temp), system.makeQualified(final), options)
    return version


def published(spark: SparkSession, path: str) -> DataFrame:
    line = spark.read.text(f"{path}/LATEST.json").first()[0]
    return spark.read.parquet(f"{path}/{json.loads(line)['version']}")


def replace_matches(table: DataFrame, new: DataFrame, key: str = "match_id") -> DataFrame:
    """All rows of the keys in ``new`` replaced by its rows; running it again changes nothing."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], keep_larger: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` over those of ``table`` with equal ``keys``; columns in ``keep_larger`` never fall."""
    old = table.select(*keys, F.struct(*[c for c in table.columns if c not in keys]).alias("_o"))
    fresh = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_n"))
    joined = old.join(fresh, keys, "full")
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in keep_larger:
            out.append(F.greatest(F.col(f"_o.{c}"), F.col(f"_n.{c}")).alias(c))
        else:
            out.append(F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c))
    return joined.select(*out)


def delete_ids(table: DataFrame, ids: DataFrame, id_: str = "id") -> DataFrame:
    return table.join(ids.select(id_), id_, "left_anti")


def rename_values(table: DataFrame, columns: list[str], names: dict[str, str]) -> DataFrame:
    """A few values renamed in place."""
    return table.replace(names, subset=columns) if names else table


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def append_if_empty(spark: SparkSession, path: str, make) -> bool:
    """Bootstrap a table from ``make()`` only where none is."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(jvm) and not spark.read.parquet(path).isEmpty():
        return False
    make().write.mode("append").parquet(path)
    return True


def recreate(df: DataFrame, path: str) -> None:
    """A table dropped and written anew."""
    df.write.mode("overwrite").parquet(path)


def drop_table(spark: SparkSession, path: str) -> bool:
    """Whether there was a table to drop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_small_file(spark: SparkSession, text: str, path: str) -> None:
    """A small text (a cache, a report) under ``path``, swapped in by a rename: readers see the old or the new one."""
    fs = spark._jvm.org.apache.hadoop.fs
    at, system = _file_system(spark, path)
    temp = fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(temp, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    context = fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    context.rename(system.makeQualified(temp), system.makeQualified(at), options)


def read_small_file(spark: SparkSession, path: str) -> str | None:
    at, system = _file_system(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def update_cache(spark: SparkSession, path: str, key: str, value: object) -> dict:
    """One entry of a JSON cache set; a missing or broken cache starts empty."""
    try:
        cache = json.loads(read_small_file(spark, path) or "{}")
    except ValueError:
        cache = {}
    cache[key] = value
    write_small_file(spark, json.dumps(cache, sort_keys=True), path)
    return cache


def write_csv_with_backup(df: DataFrame, path: str, day: str) -> str | None:
    """A result as one CSV with header; the file that was there stays as ``path``.bak_``day`` (of two on one day the first). Its path, if any."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    at, system = _file_system(spark, path)
    backup = None
    if system.exists(at):
        backup = f"{path}.bak_{day}"
        if not system.exists(fs.Path(backup)):
            system.rename(at, fs.Path(backup))
        else:
            system.delete(at, True)
    df.coalesce(1).write.option("header", True).csv(path)
    return backup


def markdown_report(df: DataFrame, title: str, most_rows: int = 10_000) -> str:
    """A small result as a Markdown table; more than ``most_rows`` rows are refused."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def reparsed(table: DataFrame, parse, text: str = "raw_text") -> DataFrame:
    """All rows of an event table with the parsed columns made anew from their text; rows without a text stay as they are."""
    columns = ["canonical", "event_type", "attacker", "victim"]
    fresh = parse(table.where(f"{text} is not null").drop(*columns), text).select(*table.columns)
    return fresh.unionByName(table.where(f"{text} is null"))


def delete_where(table: DataFrame, least_seen: int | None = None, last_seen_before: float | None = None, names: list[str] | None = None) -> DataFrame:
    """A dictionary without entries seen too rarely, not seen since, or of these names; protected ones stay unless named."""
    from functools import reduce

    tests = []
    if least_seen is not None:
        tests.append(F.col("total_seen") < least_seen)
    if last_seen_before is not None:
        tests.append(F.col("last_seen") < last_seen_before)
    goes = reduce(lambda a, b: a | b, tests, F.lit(False)) & ~F.coalesce("protected", F.lit(False))
    if names:
        goes = goes | F.col("name").isin(names)
    return table.where(~F.coalesce(goes, F.lit(False)))
