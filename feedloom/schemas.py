"""Explicit schemas of the tables and file inputs; missing columns get their defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = (
    "id LONG, streamer STRING, timestamp TIMESTAMP_NTZ, raw_text STRING, canonical STRING, event_type STRING, attacker STRING, victim STRING, "
    "attacker_conf DOUBLE, victim_conf DOUBLE, source STRING, gemini_corrected INT, crop_filename STRING, icon_vote STRING, read_count INT, created_at LONG"
)
MATCHES = "match_id STRING, streamer STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, kill_count INT, players_observed INT, merged_from STRING"
KILLS = (
    "id LONG, match_id STRING, timestamp TIMESTAMP_NTZ, attacker STRING, victim STRING, kill_order INT, attacker_conf DOUBLE, victim_conf DOUBLE, "
    "source_event_id LONG, crop_filename STRING"
)
PLACEMENTS = "match_id STRING, player STRING, kill_order_out INT, survived INT, elo_before DOUBLE, elo_after DOUBLE, elo_change DOUBLE"
RATINGS = "player STRING, elo DOUBLE, rd DOUBLE, vol DOUBLE, matches_played INT, total_kills INT, total_deaths INT, peak_elo DOUBLE, last_updated STRING"

READS_JSON = "t DOUBLE, ri INT, box ARRAY<INT>, crop STRING, text STRING"
VISION_JSON = "t INT, kind STRING, attacker STRING, victim STRING"
ELIMINATIONS_JSON = "vic_norm STRING, vic_disp STRING, atk STRING, t0 DOUBLE, t1 DOUBLE, n INT, ets ARRAY<STRING>, atks ARRAY<STRING>"
SQUADS_JSON = "t DOUBLE, squads INT, players INT, raw STRING"
BOARD_CSV = "Rank INT, Player STRING, RP LONG"
LABELS_CSV = "filename STRING, streamer STRING, filepath STRING, label STRING, quality STRING"
PLAYER_MAP = "MAP<STRING, STRUCT<variants: MAP<STRING,INT>, total_seen: INT, last_seen: DOUBLE, protected: BOOLEAN, pro: BOOLEAN>>"

DEFAULTS = {"attacker_conf": 1.0, "victim_conf": 1.0, "gemini_corrected": 0, "icon_vote": "", "read_count": 1, "rd": 350.0, "vol": 0.06, "survived": 0}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of ``ddl``; those that it lacks have their default or null."""
    out = []
    for column in ddl.replace("ARRAY<STRING>", "ARRAY_STRING").split(", "):
        name, kind = column.split(" ", 1)
        value = F.col(name) if name in df.columns else F.lit(DEFAULTS.get(name))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)
