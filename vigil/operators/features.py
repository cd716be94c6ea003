"""Behaviour features of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import micros, night
from vigil.operators.sliding import busiest_window

FEATURES = ("failed_logins", "unique_ports", "unique_usernames", "events_per_minute", "active_minutes", "night_ratio", "burst_score", "fail_ratio")
#: Sources below which nothing is scored.
MIN_SOURCES = 3


def behaviour(events: DataFrame) -> DataFrame:
    """source_ip and its eight features, over events of all types with a source. The night ratio uses each event's own offset."""
    known = events.where(F.length("source_ip") > 0)
    offset = F.col("tz_offset_s") if "tz_offset_s" in events.columns else None
    failed = F.count_if(F.col("event_type") == "failed_login")
    totals = known.groupBy("source_ip").agg(
        F.count("*").alias("total"), failed.alias("failed"), F.count_distinct(F.when(F.col("port") != 0, F.col("port"))).alias("ports"), F.count_distinct(F.when(F.length("username") > 0, F.col("username"))).alias("users"),
        ((F.max(micros(F.col("event_time"))) - F.min(micros(F.col("event_time")))) / 60_000_000).alias("active"), F.avg(night(F.col("event_time"), offset)).alias("night"),
    )
    busy = busiest_window(known, ["source_ip"], 60)
    total = F.col("total")
    return totals.join(busy, "source_ip").select(
        "source_ip", F.col("failed").cast("double").alias("failed_logins"), F.col("ports").cast("double").alias("unique_ports"), F.col("users").cast("double").alias("unique_usernames"),
        (total / F.greatest("active", F.lit(1.0))).alias("events_per_minute"), F.col("active").alias("active_minutes"), F.col("night").alias("night_ratio"),
        F.when(total <= 1, 1.0).otherwise(F.col("busiest") / total).alias("burst_score"), (F.col("failed") / total).alias("fail_ratio"),
    )


def auth_evidence(events: DataFrame) -> DataFrame:
    """source_ip, failed_users (distinct), has_success, invalid_fails, total_fails."""
    known = events.where(F.length("source_ip") > 0)
    failed = F.col("event_type") == "failed_login"
    return known.groupBy("source_ip").agg(
        F.count_distinct(F.when(failed & (F.length("username") > 0), F.col("username"))).alias("failed_users"), F.bool_or(F.col("event_type") == "successful_login").alias("has_success"),
        F.count_if(failed & F.coalesce(F.contains(F.col("raw_line"), F.lit("invalid user")), F.lit(False))).alias("invalid_fails"), F.count_if(failed).alias("total_fails"),
    )


def derive_labels(events: DataFrame) -> DataFrame:
    """Labels of sources with logins: malicious with any failure (failed_attempts), benign with successes alone."""
    fails = F.count_if(F.col("event_type") == "failed_login")
    ok = F.count_if(F.col("event_type") == "successful_login")
    by = events.where(F.length("source_ip") > 0).groupBy("source_ip").agg(fails.alias("failed_attempts"), ok.alias("ok")).where("failed_attempts > 0 or ok > 0")
    bad = F.col("failed_attempts") > 0
    return by.select("source_ip", F.when(bad, "brute_force").otherwise("benign").alias("class"), bad.alias("malicious"), "failed_attempts")
