"""Evaluation, reports, privacy, exports, stored tables, scores, vectors."""

import hashlib
import hmac
import json
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.config import RuleConfig
from vigil.functions import privacy as P
from vigil.functions import scalars as X
from vigil.operators import anomaly, contract, detect, enrich, evaluate, features, report, vectors
from vigil.plans import driver_data as D
from vigil.sinks import documents, tables

T0 = datetime(2024, 6, 15, 2, 0, 0)
INC = "incident_type string, source_ip string, first_seen timestamp, last_seen timestamp, event_count int, details struct<window_minutes:int,threshold:int,unique_ports:array<int>>"


def incidents(spark, rows):
    full = [(k, ip, T0 + timedelta(seconds=a), T0 + timedelta(seconds=b), n, (10, 5, ports)) for k, ip, a, b, n, ports in rows]
    return detect.rate(spark.createDataFrame(full, INC))


def test_row_level_evaluation(spark):
    inc = incidents(spark, [("brute_force", "1.1.1.1", 0, 9, 5, None), ("brute_force", "2.2.2.2", 0, 9, 5, None), ("port_scan", "1.1.1.1", 60, 90, 20, [1])])
    truth = spark.createDataFrame([(T0 + timedelta(minutes=5), "1.1.1.1", "malicious"), (T0, "2.2.2.2", "benign"), (T0, "3.3.3.3", "malicious"), (T0, "4.4.4.4", "benign")], "timestamp timestamp, source_ip string, label string")
    r = evaluate.evaluate_rows(inc, truth).first()
    assert (r.true_positives, r.false_positives, r.false_negatives, r.true_negatives, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert r.fp_source_ips == ["2.2.2.2"] and r.fn_source_ips == ["3.3.3.3"]
    none = evaluate.evaluate_rows(inc, truth.limit(0)).first()
    assert (none.true_positives, none.precision, none.recall, none.f1) == (0, 0.0, 0.0, 0.0)


def labelled(spark):
    """Six attackers (one slow), two benign sources that rules flag, others quiet."""
    rows = []
    add = lambda kind, ip, times, user=lambda i: f"u{i}", port=lambda i: 22: rows.extend((kind, ip, T0 + timedelta(seconds=t), port(i), user(i), "Failed password for invalid user x" if kind == "failed_login" else "") for i, t in enumerate(times))
    for a in ("8.8.8.1", "8.8.8.2", "8.8.8.3"):
        add("failed_login", a, range(0, 120, 4))
    for a in ("9.9.9.1", "9.9.9.2"):
        add("connection", a, range(0, 60, 2), port=lambda i: 1000 + i)
    add("failed_login", "7.7.7.7", [720 * (i // 4) + 90 * (i % 4) for i in range(160)])  # below the rule for hours
    add("failed_login", "10.0.0.9", range(0, 60, 10), user=lambda i: "scanner")
    add("failed_login", "172.16.9.9", range(0, 60, 10), user=lambda i: "alice")
    add("successful_login", "172.16.9.9", [61], user=lambda i: "alice")
    for k in range(16):
        add("successful_login", f"192.168.0.{k}", [600 * k, 600 * k + 7000], user=lambda i, k=k: f"s{k}")
    df = spark.createDataFrame(rows, "event_type string, source_ip string, event_time timestamp, port int, username string, raw_line string")
    bad = ["8.8.8.1", "8.8.8.2", "8.8.8.3", "9.9.9.1", "9.9.9.2", "7.7.7.7"]
    return df, spark.createDataFrame([(ip, True) for ip in bad], "source_ip string, malicious boolean")


def test_sources_are_counted_without_lists(spark, sf):
    from vigil.plans.queries import QUERIES

    assert "collect_list" not in QUERIES["eval_ips"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    truth = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False), ("e", False)], "source_ip string, malicious boolean")
    flagged = truth.where("source_ip in ('a', 'c')")
    assert {(r.source_ip, r.cell) for r in evaluate.source_cells(truth, flagged).collect()} == {("a", "tp"), ("b", "fn"), ("c", "fp"), ("d", "tn"), ("e", "tn")}
    assert tuple(evaluate.count_sources(truth, flagged).first())[:5] == (1, 1, 2, 1, 0.5)


def test_three_levels_of_quality(spark):
    events, labels = labelled(spark)
    scores = anomaly.score_sources(events)
    m = {r.config: r for r in evaluate.quality(events, labels, ["10.0.0.9"], scores=scores).collect()}
    assert m["rules"].fp == ["10.0.0.9", "172.16.9.9"] and m["rules"].fn == ["7.7.7.7"] and m["rules"].precision == 0.7143
    assert m["rules+fp_reduction"].fp == [] and m["rules+fp_reduction"].precision == 1.0 and m["rules+fp_reduction"].recall == 0.8333
    assert m["full"].recall == 1.0 and m["full"].precision >= m["rules"].precision
    assert evaluate.evaluate_sources(labels.limit(0), labels).first().precision == 1.0
    assert evaluate.ground_truth_sources(events, labels, False).count() == 6


def test_suppressed_source_loses_its_scan_flag(spark):
    events, _ = labelled(spark)
    scan = events.where("source_ip = '9.9.9.1'").withColumn("source_ip", F.lit("10.0.0.9"))
    assert "10.0.0.9" not in {r.source_ip for r in evaluate.flagged_sources(events.union(scan), ["10.0.0.9"], level="rules+fp_reduction").collect()}


def test_compare_settings_and_contract(spark):
    events, _ = labelled(spark)
    one = evaluate.compare_summary(evaluate.compare_settings(events, RuleConfig(), RuleConfig(brute_force_count=20))).first()
    assert (one.only_a, one.only_b, one.both, one.net_change) == (2, 0, 5, -2)
    contract.assert_contract(spark)
    with pytest.raises(contract.ContractError, match="flood_404 needs http_404"):
        contract.assert_contract(spark, {"ssh": ("failed_login", "connection")})


def test_reports(spark):
    inc = incidents(spark, [("brute_force", "1.1.1.1", 0, 42, 12, None), ("port_scan", "1.1.1.1", 7300, 7500, 30, list(range(1, 31))), ("flood_404", "2.2.2.2", 100, 7900, 250, None)])
    rows = {r.incident_type: r for r in report.incident_rows(inc).collect()}
    assert [rows[k].duration for k in ("brute_force", "port_scan", "flood_404")] == ["42s", "3m 20s", "2h 10m"]
    assert rows["port_scan"].sample_ports == "1, 2, 3, 4, 5, 6, 7, 8..." and rows["brute_force"].sample_ports == "" and rows["flood_404"].severity == "CRITICAL" and rows["brute_force"].first_seen == "2024-06-15 02:00:00 UTC"
    assert [(r.label, r.brute_force, r.port_scan) for r in report.hourly_timeline(inc).orderBy("hour").collect()] == [("06-15 02:00", 1, 0), ("06-15 03:00", 0, 0), ("06-15 04:00", 0, 1)]
    assert report.route(inc).first().route == "critical" and report.route(inc.limit(0)).first().route == "no_incidents" and report.hourly_timeline(inc.limit(0)).count() == 0
    assert {r.source_ip: r.incident_type for r in report.first_incident_per_source(inc).collect()} == {"1.1.1.1": "brute_force", "2.2.2.2": "flood_404"}
    assert report.top_sources(inc, 0).count() == 1 and report.top_sources(inc, "x").count() == 3
    assert report.digest(inc.where("source_ip = '1.1.1.1'"), ["source_ip"]).first().digest == "- brute_force from 1.1.1.1, count=12, MITRE=T1110.001\n- port_scan from 1.1.1.1, count=30, MITRE=T1046"
    calls = spark.createDataFrame([(i % 4 > 0, 1, 100, 10, float(i)) for i in range(40)], "ok boolean, retries int, tokens_in long, tokens_out long, latency_ms double")
    m, good = report.call_metrics(calls).first(), sorted(float(i) for i in range(40) if i % 4)
    assert (m.total, m.succeeded, m.failed, m.p50, m.p95) == (40, 30, 10, float(np.median(good)), good[round(0.95 * 29)]) and abs(m.cost - (3000 / 1e6 + 300 * 5 / 1e6)) < 1e-12
    assert set(report.report(inc.select(F.lit("x").alias("event_type"), "source_ip"), inc)) >= {"kpis", "timeline", "incidents"}


def test_features(spark):
    events, _ = labelled(spark)
    f = {r.source_ip: r for r in features.behaviour(events).collect()}
    a = f["8.8.8.1"]
    assert (a.failed_logins, a.unique_usernames, a.fail_ratio, a.night_ratio) == (30, 30, 1.0, 1.0) and a.burst_score == 16 / 30 and abs(a.active_minutes - 116 / 60) < 1e-9
    offset = events.withColumn("tz_offset_s", F.lit(5 * 3600))
    assert {r.night_ratio for r in features.behaviour(offset.where("source_ip = '8.8.8.1'")).collect()} == {0.0}
    e = {r.source_ip: r for r in features.auth_evidence(events).collect()}
    assert (e["172.16.9.9"].failed_users, e["172.16.9.9"].has_success, e["8.8.8.1"].invalid_fails) == (1, True, 30)


def test_privacy(spark):
    names = ["alice", "ünï", "", None] + [f"10.0.0.{i}" for i in range(200)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, v string")
    key = P.new_key()
    for r in df.select("v", P.scrub_username(F.col("v")).alias("u"), P.pseudonym(F.col("v"), key).alias("p"), P.pseudonym(F.col("v"), P.new_key()).alias("q"), P.encrypt(F.col("v"), "s").alias("c"), P.decrypt(P.encrypt(F.col("v"), "s"), "s").alias("d"), P.decrypt(F.col("v"), "s").alias("e"), P.encrypt(F.col("v"), None).alias("n")).collect():
        if r.v:
            assert r.u == "user_" + hashlib.sha256(r.v.encode()).hexdigest()[:8] and r.p == "ip_" + hmac.new(key, r.v.encode(), "sha256").hexdigest()[:12] and r.q != r.p and r.c != r.v
        else:
            assert r.u == r.v and r.p == r.v
        assert r.d == r.v and r.e == r.v and r.n == r.v
    long = b"k" * 90
    assert df.limit(1).select(P.hmac_sha256(F.col("v"), long).alias("h")).first().h == hmac.new(long, b"alice", "sha256").hexdigest()


def test_repeats(spark):
    inc = incidents(spark, [("brute_force", "1.1.1.1", 0, 1, 5, None), ("port_scan", "1.1.1.1", 0, 1, 20, [1]), ("brute_force", "2.2.2.2", 0, 1, 5, None)])
    stored = spark.createDataFrame([("brute_force", "1.1.1.1", T0 - timedelta(minutes=10)), ("brute_force", "2.2.2.2", T0 - timedelta(minutes=31))], "incident_type string, source_ip string, detected_at timestamp")
    hidden = stored.withColumn("source_ip", P.encrypt(F.col("source_ip"), "s"))
    for s, secret in ((stored, None), (hidden, "s")):
        got = enrich.suppress_repeats(inc, s, F.lit(T0), 30, secret)
        assert {(r.incident_type, r.source_ip) for r in got.collect()} == {("port_scan", "1.1.1.1"), ("brute_force", "2.2.2.2")}
    assert enrich.suppress_repeats(inc, stored, F.lit(T0), 0).count() == 3 and enrich.suppress_repeats(inc, stored.limit(0), F.lit(T0), 30).count() == 3


def test_documents(spark):
    inc = incidents(spark, [("brute_force", "1.1.1.1", 0, 1, 12, None), ("brute_force", "3.3.3.3", 0, 1, 120, None), ("web_flood", None, 0, 1, 3, None)])
    alerts = {r.severity + r.category: r for r in documents.to_alerts(inc).collect()}
    assert alerts["CRITICALbrute_force"].title == "Brute-force attack from 3.3.3.3" and alerts["CRITICALbrute_force"].description == "120 events; MITRE T1110.001 (Credential Access)."
    assert alerts["LOWanomaly"].title == "Web Flood from unknown" and alerts["LOWanomaly"].source_ip is None and alerts["LOWanomaly"].description == "3 events; MITRE - (-)."
    assert "workflow_run_id" not in documents.to_alerts(inc).columns and documents.to_alerts(inc, "run7").first().workflow_run_id == "run7"
    assert {r.source_ip for r in documents.to_alerts(inc, nulls="empty").collect()} == {"1.1.1.1", "3.3.3.3", ""}
    doc = documents.to_search_docs(inc, "x.log").where("source_ip = ''").first()
    assert (doc.country, doc.technique_id, doc.known_bad, doc.log_file) == ("Unknown", "", False, "x.log") and len(doc) == 11
    top = documents.layer_techniques(inc).collect()
    assert [(r.technique_id, r.score, r.comment) for r in top] == [("T1110.001", 100, "brute_force: 120 events, CRITICAL")]
    layer = json.loads(documents.layer(inc).first().value)
    assert layer["description"] == "Detected 1 ATT&CK technique(s) across 3 incident(s)." and layer["techniques"][0]["score"] == 100 and layer["versions"]["layer"] == "4.5"
    scan = inc.union(incidents(spark, [("port_scan", "4.4.4.4", 0, 1, 20, [1])]))
    q = {(r.incident_type, r.target): r for r in documents.threshold_queries(scan).collect()}
    assert set(q) == {(k, t) for k in ("brute_force", "port_scan") for t in ("splunk", "esql", "sentinel")}
    assert q["brute_force", "splunk"].query == 'event_type="failed_login"\n\n| bin _time span=10m\n| stats count as event_count by _time src_ip\n\n| search event_count >= 5'
    assert q["port_scan", "esql"].query == 'from * metadata _id, _index, _version | where event_type=="connection"\n| eval timebucket=date_trunc(5minutes, @timestamp) | stats value_count=count_distinct(destination.port) by timebucket, source.ip\n| where value_count >= 20'
    assert q["port_scan", "sentinel"].query.endswith("| where value_count >= 20") and q["port_scan", "sentinel"].rule_id == str(uuid.uuid5(documents.RULE_NAMESPACE, "port_scan:corr"))
    assert {r.incident_type for r in documents.detection_rules(scan).collect()} == {"brute_force", "port_scan"}
    assert json.loads(documents.to_messages(inc).first().value)["first_seen"].startswith("2024-06-15T02:00:00.000")


def test_tables(spark, tmp_path):
    tables.create_tables(spark)
    tables.create_tables(spark)
    events, _ = labelled(spark)
    stored = tables.stored_events(events.withColumns({"log_type": F.lit("ssh"), "source_file": F.lit("f")}).withColumn("event_time", F.col("event_time") - F.make_interval(days=F.pmod(F.xxhash64("source_ip", "event_time"), F.lit(6)))), "key")
    path = str(tmp_path / "events")
    tables.store(stored, path, "event_date")
    before = spark.read.parquet(path)
    total, cutoff = before.count(), datetime(2024, 6, 13, 2, 1, 0)
    old = before.where(F.col("event_time") < F.lit(cutoff)).count()
    assert tables.purge(spark, path, "event_time", "event_date", "2024-06-15 02:01:00", 2) == old > 0
    after = spark.read.parquet(path)
    assert after.count() == total - old and after.agg(F.min("event_time")).first()[0] >= cutoff and tables.purge(spark, path, "event_time", "event_date", "2024-06-15 02:01:00", 0) == 0
    assert after.select(P.decrypt(F.col("source_ip"), "key").alias("ip")).where("ip like '8.8.8.%'").count() > 0 and after.where("source_ip like '8.8.8.%'").count() == 0
    row = tables.stored_incidents(incidents(spark, [("port_scan", "1.1.1.1", 0, 1, 20, [1, 2])])).first()
    assert json.loads(row.details)["unique_ports"] == [1, 2] and len(row.incident_id) == 64
    old, new = spark.createDataFrame([("T1", "a", 1), ("T2", "b", 1)], "k string, n string, v int"), spark.createDataFrame([("T1", "c", 1), ("T3", "d", 2)], "k string, n string, v int")
    assert {(r.k, r.n) for r in tables.upsert(old, new, "k", "v").collect()} == {("T1", "c"), ("T2", "b"), ("T3", "d")}


def test_alert_sink(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200 if "3.3.3.3" not in str(got[-1]) else 500)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(tables.AlertSink)
    alerts = documents.to_alerts(incidents(spark, [("brute_force", "1.1.1.1", 0, 1, 12, None), ("brute_force", "3.3.3.3", 0, 1, 12, None)]))
    alerts.write.format("alerts").option("url", f"http://127.0.0.1:{server.server_port}/").mode("append").save()
    server.shutdown()
    assert sorted(a["source_ip"] for a in got) == ["1.1.1.1", "3.3.3.3"]
    with pytest.raises(Exception, match="http or https"):
        alerts.write.format("alerts").option("url", "file:///x").mode("append").save()


def test_scores(spark, sf):
    rng = np.random.default_rng(1)
    rows = [(f"n{i}", *map(float, rng.normal(5, 1, 8))) for i in range(400)] + [("odd", *[60.0] * 8)]
    df = spark.createDataFrame(rows, "source_ip string, " + ", ".join(f"{c} double" for c in features.FEATURES))
    for detector in (anomaly.isolation_forest, anomaly.autoencoder):
        got = {r.source_ip: r.anomaly_score for r in detector(df).collect()}
        assert len(got) == 401 and got["odd"] == 1.0 and min(got.values()) == 0.0 and np.median(list(got.values())) < 0.5
        assert {r.source_ip: r.anomaly_score for r in detector(df.repartition(13)).collect()} == got
        assert detector(df.limit(2)).count() == 0
        same = spark.createDataFrame([(f"s{i}", *[1.0] * 8) for i in range(5)], df.schema)
        assert {r.anomaly_score for r in detector(same).collect()} == {0.0}
    assert anomaly.score_sources(D.events(spark, sf), "autoencoder").count() == 15


def test_autoencoder_trains_on_all_sources(spark):
    rng = np.random.default_rng(2)
    rows = [(f"n{i}", *map(float, rng.gamma(2, 1, 8))) for i in range(300)]
    df = spark.createDataFrame(rows, "source_ip string, " + ", ".join(f"{c} double" for c in features.FEATURES)).repartition(3)
    x = np.array([r[1:] for r in sorted(rows)])
    whole = anomaly.train_autoencoder((x - x.mean(0)) / x.std(0))
    spread = anomaly.train_spread(df.select(*features.FEATURES), len(rows), x.mean(0), x.std(0))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole, spread, strict=True))
    assert anomaly.autoencoder(df).count() == 300


def test_percentiles_of_many_latencies(spark):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.lognormal(3, 2, 3000), np.full(900, 7.5), rng.uniform(7.5, 7.6, 300)]), 6)
    for part in (x, x[:1], x[:2], x[:57], np.full(500, 2.0)):
        calls = spark.createDataFrame([(True, 0, 1, 1, float(v)) for v in part] + [(False, 1, 1, 1, -5.0)], "ok boolean, retries int, tokens_in long, tokens_out long, latency_ms double")
        r = report.call_metrics(calls, sort_rows=20).first()
        assert r.p95 == np.sort(part)[round(0.95 * (len(part) - 1))] and abs(r.p50 - np.median(part)) < 1e-9 and r.succeeded == len(part)
    plan = report.call_metrics(calls, sort_rows=20)._jdf.queryExecution().toString()
    assert "Window" not in plan and "percentile(" not in plan


def test_vectors(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [-1.0, 0.1]), ("z", [0.0, 0.0])], "item_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [2.0, 0.1]), ("q", [2.0, -0.1])], "query_id string, embedding array<double>")
    mean = vectors.mean_vector(queries, keys=("query_id",))
    assert mean.first().embedding == [2.0, 0.0]
    got = vectors.similar(mean, corpus, 2).orderBy("rank").collect()
    assert [(r.item_id, r.similarity) for r in got] == [("a", 1.0), ("b", 0.707)]
    named = spark.createDataFrame([(1, "T1", "Discovery", "Scan"), (2, "T2", "Access", "Guess")], "rank int, technique_id string, tactic string, name string")
    assert vectors.context_text(named).first().context == "Relevant ATT&CK techniques:\n  T1 (Discovery): Scan\n  T2 (Access): Guess" and vectors.context_text(named.limit(0)).first().context == ""
    texts = spark.createDataFrame([("a", "brute force password guessing"), ("b", "port scan of network services"), ("c", "password guessing attack")], "item_id string, text string")
    emb = vectors.embed(texts, "text")
    near = vectors.similar(emb.where("item_id = 'c'").withColumnRenamed("item_id", "query_id"), emb.where("item_id <> 'c'"), 1).first()
    assert near.item_id == "a"


def test_vectors_that_take_no_part(spark):
    """Null, empty, zero and non-finite vectors are left out on both sides; vectors of another length meet their own kind alone."""
    nan, inf = float("nan"), float("inf")
    items = [(i, [1.0, i / 10]) for i in range(10)] + [(20, [nan, 1.0]), (21, [nan, nan]), (22, [1.0, inf]), (23, [0.0, 0.0]), (24, []), (25, None), (26, [None, 1.0]), (30, [1.0, 0.0, 0.0]), (31, [0.0, 1.0, 0.0]), (40, [1e300, 0.0]), (41, [1e-300, 0.0])]
    c = spark.createDataFrame(items, "item_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(0, [2.0, 0.0]), (1, [nan, 1.0]), (2, None), (3, [0.0, 3.0, 0.0]), (4, [1.0]), (5, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = {}
    for r in vectors.similar(q, c, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.similarity))
    assert sorted(got) == [0, 3]
    assert {i for _, i, _ in got[0][:3]} | {i for _, i, _ in got[0]} >= {0} and sorted(got[3]) == [(1, 31, 1.0), (2, 30, 0.0)]
    assert len(got[0]) == 4 and all(s >= 0.99 for _, _, s in got[0])


def test_scores_tell_levels_apart(spark, sf):
    """The queries with a stand-in score have anomalies of both kinds, and the full level differs from the one below."""
    from vigil.plans.queries import QUERIES

    sf = sf.replace("sf0.001", "sf0.01")
    assert {r.detection for r in QUERIES["anomaly_labels"](spark, sf).collect()} == {"Rule + ML", "ML Only"}
    below = {r.config: (r.tp, r.fp) for r in QUERIES["eval_ips"](spark, sf).collect()}["rules+fp_reduction"]
    full = QUERIES["eval_ips_full"](spark, sf).first()
    assert (full.tp, full.fp) > below
    assert len({r.colour for r in QUERIES["score_series"](spark, sf).collect()}) > 1


def test_searches_take_every_hundredth_vector(spark, sf):
    from vigil.plans.queries import QUERIES

    e = D.table(spark, sf, "embeddings")
    ids = {r.vec_id for r in e.where("vec_id % 100 = 0").collect()}
    exact, near, filed = ({(r.query_id, r.item_id) for r in QUERIES[name](spark, sf).collect()} for name in ("cosine_topk", "ann_topk", "cell_topk"))
    assert {q for q, _ in exact} == {q for q, _ in near} == ids and len(exact) == 3 * len(ids)
    assert len(exact & near) >= 0.9 * len(exact) and len(exact & filed) >= 0.9 * len(exact)
    q, c = e.withColumnRenamed("vec_id", "query_id").where("query_id < 90"), e.withColumnRenamed("vec_id", "item_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(vectors.similar(q, c, query_rows=20, item_rows=70)) == rows(vectors.similar(q, c)) and vectors.similar(q.limit(0), c).count() == 0


def test_ids_and_text(spark):
    df = spark.createDataFrame([("x" * 20,), (" " * 30,), ("short",), (None,)], "t string")
    assert [r.g for r in df.select(X.good_text(F.col("t")).alias("g")).collect()] == [True, False, False, False]
    ns = uuid.uuid4()
    names = [f"rule {i} é" for i in range(50)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.uuid5(ns, F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(ns, r.n)) for r in got)


def test_retention_that_broke_off_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = spark.range(96).select((F.lit("2024-06-10 00:30:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id"))).alias("event_time"), "id").withColumn("event_date", F.to_date("event_time"))
    tables.store(rows, path, "event_date")
    assert tables.retention_job(spark, {path: ("event_time", "event_date", 2)}, "2024-06-13 12:00:00") == {path: 36}
    assert tables.retention_job(spark, {path: ("event_time", "event_date", 2)}, "2024-06-13 12:00:00") == {path: 0}
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(36, 96))
    assert tables.retention_job(spark, {path: ("event_time", "event_date", 1)}, "2024-06-13 00:00:00") == {path: 12}  # a cutoff at midnight


def test_stored_rows_and_reports(spark, sf, tmp_path):
    found = detect.detect(D.events(spark, sf), D.RULES)
    tables.store(tables.stored_incidents(found), str(tmp_path / "inc"), "detected_date")
    total = found.count()
    assert tables.read_incidents(spark, str(tmp_path / "inc")).count() == tables.read_incidents(spark, str(tmp_path / "inc"), "2020-01-01").count() == total
    assert tables.read_incidents(spark, str(tmp_path / "inc"), "2999-01-01").count() == 0
    folders = tables.write_report({"kpis": report.kpis(D.events(spark, sf), found), "chart": report.chart_series(found)}, str(tmp_path / "report"))
    assert [f.rsplit("/", 1)[1] for f in folders] == ["chart", "kpis"] and spark.read.json(folders[1]).first().incidents == total
    for _ in range(2):
        tables.write_evaluation(spark.createDataFrame([(0.5,)], "f1 double"), str(tmp_path / "eval"), "r1")
    assert spark.read.json(str(tmp_path / "eval")).count() == 1
    sent = []
    messages = documents.to_messages(found).union(spark.createDataFrame([(None,)], "value string"))
    assert tuple(documents.deliver(messages, lambda df: sent.append(df.count())).first()) == (total, 1) and sent == [total]


def test_search_in_cells_finds_most_of_what_exact_search_finds(spark, sf):
    from vigil.plans.queries import QUERIES

    want = {(r.query_id, r.item_id) for r in QUERIES["cosine_topk"](spark, sf).collect()}
    got = {(r.query_id, r.item_id) for r in QUERIES["ann_topk"](spark, sf).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_techniques_near_those_of_incidents(spark):
    from vigil.operators.vectors import similar_techniques

    techniques = spark.createDataFrame([("T1046", [1.0, 0.0]), ("T1", [0.9, 0.1]), ("T2", [0.0, 1.0])], "technique_id string, embedding array<double>")
    incidents = spark.createDataFrame([("port_scan", ("T1046",)), ("port_scan", ("T1046",))], "incident_type string, mitre struct<id:string>")
    got = similar_techniques(incidents, techniques, 2).orderBy("rank").collect()
    assert [(r.incident_type, r.technique_id, r.rank) for r in got] == [("port_scan", "T1046", 1), ("port_scan", "T1", 2)]


def test_cells_make_no_rows_of_pairs(spark):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))], "item_id long, embedding array<float>")
    queries = items.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    got = vectors.similar_in_cells(queries, items, cells=4, probes=4)  # all cells
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vectors.similar(queries, items).collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
