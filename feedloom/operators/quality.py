"""Checks over tables: invariants, snapshots and their differences, metric thresholds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, what, old_values, new_values) of rows added, removed or changed."""
    a = old.select(key, F.struct(*values).alias("old_values"))
    b = new.select(key, F.struct(*values).alias("new_values"))
    what = F.when(F.col("old_values").isNull(), "added").when(F.col("new_values").isNull(), "removed").otherwise("changed")
    differs = ~F.col("old_values").eqNullSafe(F.col("new_values"))
    return a.join(b, key, "full").where(differs).select(key, what.alias("what"), "old_values", "new_values")


@dataclass
class Invariant:
    """Rows of ``violations`` break the rule; ``example`` says which."""

    name: str
    severity: str
    violations: DataFrame
    example: Column


def run_invariants(checks: list[Invariant], examples: int = 8) -> DataFrame:
    """(check, severity, violations, examples): one row a check, with the first few examples in order.

    Every task keeps its own few smallest examples, and only these meet.
    """
    parts = []
    for c in checks:
        rows = c.violations.select(c.example.cast("string").alias("example"))
        total = rows.agg(F.count(F.lit(1)).alias("violations"))
        first = rows.orderBy("example").limit(examples).agg(F.sort_array(F.collect_list("example")).alias("examples"))
        parts.append(total.crossJoin(first).select(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), "violations", "examples"))
    return reduce(DataFrame.unionByName, parts)


def grade(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``metrics`` (metric, value) against ``thresholds`` (metric, warn, fail; a fixed list): status ok, warn or fail."""
    status = F.when(F.col("value") >= F.col("fail"), "fail").when(F.col("value") >= F.col("warn"), "warn").otherwise("ok")
    return metrics.join(F.broadcast(thresholds), "metric", "left").select("metric", "value", F.when(F.col("fail").isNull(), "skip").otherwise(status).alias("status"))


def overall(graded: DataFrame) -> DataFrame:
    """Worst status of all, skipped ones ignored."""
    order = F.when(F.col("status") == "fail", 3).when(F.col("status") == "warn", 2).when(F.col("status") == "ok", 1).otherwise(0)
    worst = F.max(order)
    return graded.agg(F.when(worst == 3, "fail").when(worst == 2, "warn").when(worst == 1, "ok").otherwise("skip").alias("overall"))


def share(test: Column, of: Column | None = None) -> Column:
    """Per cent of rows (of those where ``of`` holds) that pass ``test``; null tests don't pass, no rows give 0."""
    n = F.count(F.lit(1)) if of is None else F.count_if(of)
    hit = F.coalesce(test, F.lit(False)) if of is None else F.coalesce(test & of, F.lit(False))
    return F.coalesce(100.0 * F.count_if(hit) / F.when(n > 0, n), F.lit(0.0))


# Fixed values: (stage, metric, warn from, fail from); no fail: a stage only warns of it.
STAGE_LIMITS = [
    ("database", "kill_without_attacker_pct", 5.0, None), ("database", "kill_without_victim_pct", 5.0, None),
    ("database", "kill_low_confidence_pct", 20.0, None), ("database", "duplicate_pairs_5s", 1.0, None), ("database", "latest_age_h", 24.0, None),
    ("parsing", "self_kills", 1.0, None), ("parsing", "short_names", 1.0, None), ("parsing", "long_names", 1.0, None), ("parsing", "game_words", 1.0, None),
    ("parsing", "character_names", 1.0, None), ("validation", "corrected_pct", 50.0, None),
    ("matches", "mega_match_pct", 0.001, 5.0), ("matches", "longest_min", 120.0, None), ("matches", "no_matches", 1.0, None),
    ("ratings", "no_players", 1.0, None), ("ratings", "negative", 1.0, None), ("ratings", "extreme", 1.0, None), ("ratings", "unranked_all", 1.0, None),
]


def stage_limits(spark) -> DataFrame:
    return spark.createDataFrame(STAGE_LIMITS, "stage string, metric string, warn double, fail double")


def stage_metrics(events: DataFrame, matches: DataFrame, ratings: DataFrame, as_of: Column, game_words: list[str], characters: list[str]) -> DataFrame:
    """(stage, metric, value) of the tables: every stage is one aggregation over its table.

    ``as_of`` is the present; the stages of settings and of the server are no tables (``settings_metrics``).
    """
    kill = F.col("event_type") == "Kill"
    a, v = F.trim("attacker"), F.trim("victim")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False))).cast("double")
    words, who = [w.lower() for w in game_words], [c.lower() for c in characters]

    def tall(df: DataFrame, stage: str) -> DataFrame:
        return df.unpivot([], df.columns, "metric", "value").select(F.lit(stage).alias("stage"), "metric", F.col("value").cast("double").alias("value"))

    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    pair = Window.partitionBy(F.lower(F.trim("streamer")), a, v, F.floor(us / 3_600_000_000)).orderBy("timestamp", "id")
    kills = events.where(kill & ~blank(a) & ~blank(v) & F.col("timestamp").isNotNull())
    close = kills.select((us - F.lag(us).over(pair) <= 5_000_000).alias("close")).agg(count(F.col("close")).alias("duplicate_pairs_5s"))
    database = events.agg(
        share(blank(a), kill).alias("kill_without_attacker_pct"), share(blank(v), kill).alias("kill_without_victim_pct"),
        share(F.col("attacker_conf") < 0.5, kill).alias("kill_low_confidence_pct"),
        ((F.unix_micros(as_of.cast("timestamp")) - F.max(us)) / 3.6e9).alias("latest_age_h"),
    )
    parsing = events.where(kill).agg(
        count(~blank(a) & (a == v)).alias("self_kills"), count(~blank(a) & (F.length(a) < 3)).alias("short_names"),
        count(F.length(a) > 30).alias("long_names"), (count(F.lower(a).isin(words)) + count(F.lower(v).isin(words))).alias("game_words"),
        (count(F.lower(a).isin(who)) + count(F.lower(v).isin(who))).alias("character_names"),
    )
    validation = events.agg(share(F.col("gemini_corrected") == 1).alias("corrected_pct"))
    minutes = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 6e7
    of_matches = matches.agg(
        share(F.col("kill_count") >= 100).alias("mega_match_pct"), F.coalesce(F.max(minutes), F.lit(0.0)).alias("longest_min"),
        (F.count(F.lit(1)) == 0).cast("double").alias("no_matches"),
    )
    of_ratings = ratings.agg(
        (F.count(F.lit(1)) == 0).cast("double").alias("no_players"), count(F.col("elo") < 0).alias("negative"), count(F.col("elo") > 3000).alias("extreme"),
        ((F.count(F.lit(1)) > 0) & (F.count_if(F.col("matches_played") >= 3) == 0)).cast("double").alias("unranked_all"),
    )
    parts = [tall(database, "database"), tall(close, "database"), tall(parsing, "parsing"), tall(validation, "validation"), tall(of_matches, "matches"), tall(of_ratings, "ratings")]
    return reduce(DataFrame.unionByName, parts)


# Fixed values: (setting, lowest, highest) of sane settings.
SETTING_RANGES = [("least_confidence", 0.1, 0.7), ("crop_window_s", 5.0, None), ("agreement", 0.5, 0.99), ("server_latency_ms", None, 500.0)]


def settings_metrics(spark, settings: dict[str, float]) -> DataFrame:
    """(stage, metric, value, status) of the stages 'config' and 'api', which are settings and measurements and no tables; what is not given is skipped."""
    rows = []
    for name, low, high in SETTING_RANGES:
        value = settings.get(name)
        status = "skip" if value is None else "warn" if (low is not None and value < low) or (high is not None and value > high) else "ok"
        rows.append(("api" if name.startswith("server") else "config", name, None if value is None else float(value), status))
    return spark.createDataFrame(rows, "stage string, metric string, value double, status string")


def grade_stages(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(stage, metric, value, status) by the limits of each metric."""
    status = F.when(F.col("value") >= F.col("fail"), "fail").when(F.col("value") >= F.col("warn"), "warn").otherwise("ok")
    graded = metrics.join(F.broadcast(limits), ["stage", "metric"], "left")
    return graded.select("stage", "metric", "value", F.when(F.col("warn").isNull(), "skip").otherwise(status).alias("status"))


def stage_report(graded: DataFrame) -> DataFrame:
    """(stage, status) with the worst status of every stage, and of 'overall', where skipped ones don't count."""
    order = F.when(F.col("status") == "fail", 3).when(F.col("status") == "warn", 2).when(F.col("status") == "ok", 1).otherwise(0)
    worst = F.max(order)
    name = F.when(worst == 3, "fail").when(worst == 2, "warn").when(worst == 1, "ok").otherwise("skip").alias("status")
    return graded.groupBy("stage").agg(name).unionByName(graded.agg(name).select(F.lit("overall").alias("stage"), "status"))


def reading_accuracy(pairs: DataFrame, parse) -> DataFrame:
    """Scores of reads against labels: ``pairs`` (label, text, quality), ``parse(rows, column)`` gives event_type, attacker and victim.

    Per quality: rows, exact share regardless of letter case, mean likeness, mean character and word error rates, share of equal
    parsed results (of lines that parse to something), and share of reads of two signs at most (what noise should give).
    """
    from feedloom.functions.similarity import ratio, word_levenshtein

    rows = pairs.select(F.monotonically_increasing_id().alias("_row"), F.trim("label").alias("label"), F.coalesce(F.trim("text"), F.lit("")).alias("text"), "quality")
    read = lambda c: F.struct(*(F.coalesce(x, F.lit("")).alias(x) for x in ("event_type", "attacker", "victim"))).alias(c)
    both = parse(parse(rows, "label").select("_row", "label", "text", "quality", read("of_label")), "text").withColumn("of_text", read("x"))
    empty = F.struct(*(F.lit("").alias(x) for x in ("event_type", "attacker", "victim")))
    words = lambda c: F.split(F.lower(c), r"\s+")
    scored = both.withColumns(
        {
            "likeness": ratio(F.lower("label"), F.lower("text")),
            "character_errors": F.levenshtein("label", "text") / F.greatest(F.length("label"), F.lit(1)),
            "word_errors": word_levenshtein(words("label"), words("text")) / F.greatest(F.size(words("label")), F.lit(1)),
            "parsed": (F.col("of_label") == F.col("of_text")) & (F.col("of_label") != empty),
        }
    )
    mean = lambda c: F.round(F.avg(c), 4)
    return scored.groupBy("quality").agg(
        F.count(F.lit(1)).alias("rows"), F.round(share(F.lower("label") == F.lower("text")), 1).alias("exact_pct"), mean("likeness").alias("likeness"),
        mean("character_errors").alias("character_error_rate"), mean("word_errors").alias("word_error_rate"),
        F.round(share(F.col("parsed")), 1).alias("parsed_pct"), F.round(share(F.length("text") <= 2), 1).alias("empty_pct"),
    )


def replay_scores(truth: DataFrame, reads: DataFrame, kept: DataFrame, slack_us: int = 45_000_000) -> DataFrame:
    """Suppression scored against a truth set, game by game: what it costs and what it leaves.

    ``truth`` and ``reads`` (game, id, us, attacker, victim), ``kept`` the ids that suppression kept. Reads before and after
    it are put together to deaths (a victim's reads within two minutes), both are matched with the truth, and the surviving
    rows are held against the deaths that they stand for (over-count).
    """
    from feedloom.operators.evaluation import candidates, greedy_pairs
    from feedloom.operators.retro import repeated_deaths

    survived = reads.join(kept.select("id"), "id", "left_semi")

    def matched(rows: DataFrame, name: str) -> DataFrame:
        deaths = repeated_deaths(rows)
        first = rows.join(deaths.select("id"), "id", "left_semi")
        pairs = greedy_pairs(candidates(truth, first, slack_us))
        n = deaths.groupBy("game").agg(F.count(F.lit(1)).alias(f"{name}_deaths"))
        return n.join(pairs.groupBy("game").agg(F.count(F.lit(1)).alias(f"{name}_matched")), "game", "left")

    total = truth.groupBy("game").agg(F.count(F.lit(1)).alias("truth"))
    rows = survived.groupBy("game").agg(F.count(F.lit(1)).alias("kept_rows"))
    out = total.join(matched(reads, "read"), "game", "left").join(matched(survived, "kept"), "game", "left").join(rows, "game", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    pct = lambda a, b: F.when(n(b) > 0, F.floor(100 * n(a) / n(b)))
    return out.select(
        "game", "truth", n("read_deaths").alias("read_deaths"), n("kept_deaths").alias("kept_deaths"),
        pct("read_matched", "truth").alias("read_recall_pct"), pct("kept_matched", "truth").alias("kept_recall_pct"),
        pct("kept_matched", "kept_deaths").alias("kept_precision_pct"), F.greatest(n("read_matched") - n("kept_matched"), F.lit(0)).alias("lost_to_suppression"),
        F.round(n("kept_rows") / F.when(n("kept_deaths") > 0, F.col("kept_deaths")), 2).alias("over_count"),
    )
