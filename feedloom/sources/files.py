"""File inputs: legacy CSV, JSON lines, label lists, dictionaries, crop listings and scraped boards."""

from __future__ import annotations

import re
from html import unescape
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from feedloom import schemas


def read_event_csv(spark: SparkSession, path: str) -> DataFrame:
    """Legacy event CSV with a header in any order. Bad confidences count as one half, rows without a readable time are left out."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    get = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    conf = lambda c: F.coalesce(F.when(F.trim(get(c)) != "", F.trim(get(c))).try_cast("double"), F.lit(0.5))
    text = lambda c: F.when(F.trim(get(c)) != "", F.trim(get(c)))
    at = F.try_to_timestamp(F.trim(get("timestamp")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return raw.select(
        F.trim(get("streamer")).alias("streamer"), at.alias("timestamp"), get("raw_text").alias("raw_text"), get("canonical").alias("canonical"),
        get("event_type").alias("event_type"), text("attacker").alias("attacker"), text("victim").alias("victim"),
        conf("attacker_conf").alias("attacker_conf"), conf("victim_conf").alias("victim_conf"),
    ).where("timestamp is not null")


def read_json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("mode", "DROPMALFORMED").json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Player dictionary, one JSON document: (name, variants, total_seen, last_seen, protected, pro). Broken documents are empty."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.from_json("value", schemas.PLAYER_MAP, {"mode": "PERMISSIVE"}).alias("m")).where("m is not null")
    return entries.select(F.explode("m").alias("name", "e")).select("name", "e.*")


def read_board_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BOARD_CSV).option("header", True).csv(path)


def list_crops(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, at, line, hex, length) of crop images below ``folder``; no image is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(name, r"^([0-9]{8}_[0-9]{6})_line([0-9]+)_([0-9a-f]{4})\.png$", k)
    return files.select("path", name.alias("filename"), F.try_to_timestamp(part(1), F.lit("yyyyMMdd_HHmmss")).alias("at"), part(2).try_cast("int").alias("line"), part(3).alias("hex"), "length")


def player_dictionary_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two dictionaries as one: counts added, variants added key by key, the later sighting, any protection."""
    a = old.select("name", F.struct("variants", "total_seen", "last_seen", "protected").alias("a"))
    b = new.select("name", F.struct("variants", "total_seen", "last_seen", "protected").alias("b"))
    none = F.create_map().cast("map<string,int>")
    add = F.map_zip_with(F.coalesce("a.variants", none), F.coalesce("b.variants", none), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return a.join(b, "name", "full").select(
        "name", add.alias("variants"), (F.coalesce("a.total_seen", F.lit(0)) + F.coalesce("b.total_seen", F.lit(0))).alias("total_seen"),
        F.greatest("a.last_seen", "b.last_seen").alias("last_seen"),
        (F.coalesce("a.protected", F.lit(False)) | F.coalesce("b.protected", F.lit(False))).alias("protected"),
    )


@udtf(returnType="rank int, name string, points long")
class BoardRows:
    """Rows (rank, name, points) of the tables of one HTML page."""

    def eval(self, html: Any):
        for row in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", html or ""):
            cells = [unescape(re.sub(r"(?s)<[^>]+>", " ", c)).strip() for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", row)]
            if len(cells) >= 3 and re.fullmatch(r"#?\d+", cells[0]) and re.search(r"\d", cells[2]):
                yield int(cells[0].lstrip("#")), " ".join(cells[1].split()), int(re.sub(r"\D", "", cells[2]))


def scrape_board(pages: DataFrame) -> DataFrame:
    """Board of all ``pages`` (page_id, html): the first name of each rank, by page."""
    found = pages.lateralJoin(BoardRows(F.col("html").outer())).select("page_id", "rank", "name", "points")
    return found.groupBy("rank").agg(F.min_by(F.struct("name", "points"), F.struct("page_id", "name")).alias("x")).select("rank", "x.name", "x.points")


def import_event_csv(spark: SparkSession, csv: str, path: str) -> int:
    """A legacy CSV appended to an event table with its defaults; the number of rows added."""
    rows = schemas.conform(read_event_csv(spark, csv), schemas.EVENTS)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def probe(spark: SparkSession, path: str, wanted: list[str]) -> dict[str, object]:
    """What is known of a table without reading it: whether it is there, its columns, and which of the wanted ones are missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {"exists": False, "columns": [], "missing": list(wanted)}
    columns = spark.read.parquet(path).columns
    return {"exists": True, "columns": columns, "missing": [c for c in wanted if c not in columns]}


def file_age_hours(spark: SparkSession, path: str, now_ms: int) -> float | None:
    """Hours since the file was written; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return (now_ms - system.getFileStatus(at).getModificationTime()) / 3_600_000 if system.exists(at) else None


def refresh_board(spark: SparkSession, path: str, make, now_ms: int, day: str, most_age_h: float = 24.0, least_rows: int = 200, force: bool = False) -> str:
    """A board kept fresh: 'fresh' if it is young enough, 'refused' if ``make()`` gives too few rows to be sane, else 'written'."""
    from feedloom.sources.sinks import write_csv_with_backup

    age = file_age_hours(spark, path, now_ms)
    if not force and age is not None and age <= most_age_h:
        return "fresh"
    board = make()
    if board.limit(least_rows).count() < least_rows:
        return "refused"
    write_csv_with_backup(board, path, day)
    return "written"
