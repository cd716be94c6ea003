"""Rules: thresholds, windows, ties, and random events against a plain loop."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.config import RuleConfig
from vigil.functions import scalars as X
from vigil.operators import detect, sliding

T0 = datetime(2024, 6, 15, 2, 0, 0)
SCHEMA = "event_type string, source_ip string, event_time timestamp, port int, username string, raw_line string"


def events(spark, rows):
    """rows: type, ip, seconds after T0, port."""
    return spark.createDataFrame([(t, ip, T0 + timedelta(seconds=s), port, "u", "x") for t, ip, s, port in rows], SCHEMA)


def found(df):
    return {(r.source_ip, r.event_count) for r in df.collect()}


def test_thresholds_and_windows(spark):
    rows = [("failed_login", "at", 60 * i, 1) for i in range(5)]
    rows += [("failed_login", "below", 60 * i, 1) for i in range(4)]
    rows += [("failed_login", "split", 60 * i + (1800 if i > 2 else 0), 1) for i in range(6)]
    rows += [("failed_login", "edge", 150 * i, 1) for i in range(5)]  # both ends of the window count
    rows += [("failed_login", "over", 151 * i, 1) for i in range(5)]
    rows += [("failed_login", "whole", 10 * i, 1) for i in range(40)] + [("failed_login", "slow", 90 * (i % 4) + 720 * (i // 4), 1) for i in range(80)]
    rows += [("successful_login", "other", i, 1) for i in range(9)] + [("failed_login", None, i, 1) for i in range(9)] + [("failed_login", "", i, 1) for i in range(9)]
    assert found(detect.brute_force(events(spark, rows))) == {("at", 5), ("edge", 5), ("whole", 40)}


def test_port_scans(spark):
    rows = [("connection", "scan", i * 0.24, 1000 + i) for i in range(500)]
    rows += [("connection", "same", i, 22) for i in range(100)] + [("failed_login", "ephemeral", i, 50_000 + i) for i in range(50)]
    rows += [("connection", "zero", i, i) for i in range(20)] + [("connection", "twenty", i, i + 1) for i in range(20)] + [("connection", "none", i, None) for i in range(30)]
    out = {r.source_ip: r for r in detect.rate(detect.port_scan(events(spark, rows))).collect()}
    assert set(out) == {"scan", "twenty"} and out["scan"].event_count == 500 and out["scan"].severity == "CRITICAL"
    assert out["scan"].details.unique_ports == list(range(1000, 1500)) and out["scan"].mitre.id == "T1046"


def test_floods_and_severity_bounds(spark):
    assert found(detect.flood_404(events(spark, [("http_404", "a", i, None) for i in range(30)] + [("http_404", "b", i, None) for i in range(29)]))) == {("a", 30)}
    cases = [("brute_force", 9, "LOW"), ("brute_force", 10, "MEDIUM"), ("brute_force", 30, "HIGH"), ("brute_force", 100, "CRITICAL"), ("port_scan", 49, "LOW"), ("port_scan", 50, "MEDIUM"), ("port_scan", 100, "HIGH"), ("port_scan", 500, "CRITICAL"), ("flood_404", 199, "HIGH"), ("flood_404", 200, "CRITICAL"), ("other", 9999, "LOW")]
    df = spark.createDataFrame(cases, "k string, n int, want string").withColumn("got", X.severity(F.col("k"), F.col("n")))
    assert all(r.got == r.want for r in df.collect())


def plain(rows, span, least, distinct):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((t, v) for k, t, v in rows if k == key)
        for i, (t, _) in enumerate(own):
            inside = [e for e in own[i:] if e[0] - t <= span]
            n = len({v for _, v in inside}) if distinct else len(inside)
            if n >= least:
                out[key] = (t, max(e[0] for e in inside), n)
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_events_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(12)}", rng.choice([rng.randrange(4000), rng.randrange(60) * 50]), rng.randrange(1, 9)) for _ in range(900)]
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=t), v) for k, t, v in rows], "k string, event_time timestamp, v int").repartition(5)
    for span, least in ((60, 5), (600, 12), (17, 3)):
        got = {r.k: ((r.first_seen - T0).seconds, (r.last_seen - T0).seconds, r.event_count) for r in sliding.first_count_window(df, ["k"], span, least).collect()}
        assert got == plain(rows, span, least, False)
        got = {r.k: ((r.first_seen - T0).seconds, (r.last_seen - T0).seconds, r.event_count) for r in sliding.first_distinct_window(df, ["k"], "v", span, min(least, 6)).collect()}
        assert got == plain(rows, span, min(least, 6), True)
        busy = {r.k: r.busiest for r in sliding.busiest_window(df, ["k"], span).collect()}
        assert busy == {k: max(sum(0 <= b - a <= span for k2, b, _ in rows if k2 == k) for k1, a, _ in rows if k1 == k) for k in {r[0] for r in rows}}


def test_no_events(spark):
    assert detect.detect(events(spark, [])).count() == 0


def test_plan_sends_only_what_windows_need(spark):
    df = events(spark, [("failed_login", "a", 1, 1)])
    plan = detect.brute_force(df, RuleConfig())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "raw_line" not in plan.split("Exchange")[0]


def test_one_source_in_one_window(spark):
    """Many events of one source within a window: work is in proportion to them."""
    def seconds(n):
        at = (F.lit(1718416800_000_000) + F.col("id") * (500_000_000 // n)).alias("us")
        rows = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_micros(at).alias("event_time"), (F.col("id") % 5000).cast("int").alias("v"))
        began = time.time()
        one = sliding.first_count_window(rows, ["k"], 600, 5).first()
        two = sliding.first_distinct_window(rows, ["k"], "v", 600, 20).first()
        assert one.event_count == n and two.event_count == min(n, 5000) and sliding.busiest_window(rows, ["k"], 600).first().busiest == n
        return time.time() - began

    seconds(4_000)
    few, many = seconds(40_000), seconds(400_000)
    assert many < 10 * few + 10


def test_all_rules_are_one_scan_and_three_exchanges(spark, tmp_path):
    rows = [("failed_login", "a", i, 1) for i in range(9)] + [("connection", "a", i, i) for i in range(40)] + [("http_404", "b", i, None) for i in range(40)]
    events(spark, rows).write.parquet(str(tmp_path / "events"))
    df = detect.detect(spark.read.parquet(str(tmp_path / "events")))
    assert sorted((r.incident_type, r.source_ip, r.event_count, r.details.unique_ports and len(r.details.unique_ports)) for r in df.collect()) == [("brute_force", "a", 9, None), ("flood_404", "b", 40, None), ("port_scan", "a", 39, 39)]
    plan = df._jdf.queryExecution().sparkPlan().toString(), spark.sql("SELECT 1") and df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan[0].count("FileScan") == 1 and plan[1].count("Exchange hashpartitioning") <= 3
    assert "ReadSchema: struct<event_type:string,source_ip:string,event_time:timestamp,port:int>" in plan[0]
