"""Streams: the same incidents as in batch, repeats, tailed files, arriving files."""

import json
import time
from datetime import datetime, timedelta

from vigil.config import RuleConfig
from vigil.operators import detect
from vigil.plans import driver_data as D
from vigil.sources import logs
from vigil.sources.tail import TailSource, read_new
from vigil.streaming import arrivals, delivery, detectors

T0 = datetime(2024, 6, 15, 2, 0, 0)


def drain(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, sf, tmp_path):
    events = D.events(spark, sf).select("event_type", "source_ip", "event_time", "port")
    flush = spark.createDataFrame([("failed_login", "flush", datetime(2024, 3, 15), 1), ("connection", "flush", datetime(2024, 3, 15), 1)], events.schema)
    folder = str(tmp_path / "in")
    events.union(flush).repartition(3).write.parquet(folder)
    cfg = RuleConfig.uniform(3, 1440)
    for name, stream, batch in (("brute", detectors.stream_brute_force, detect.brute_force), ("scan", detectors.stream_port_scan, detect.port_scan)):
        got = drain(stream(spark.readStream.schema(events.schema).parquet(folder), cfg, "40 days"), name, tmp_path)
        rows = lambda df: sorted((r.source_ip, r.first_seen, r.last_seen, r.event_count, tuple(r.details.unique_ports or ())) for r in df.collect())
        assert rows(got) == rows(batch(events, cfg)) and got.where("severity is null").count() == 0


def test_tumbling_stream(spark, tmp_path):
    rows = [("a", T0 + timedelta(seconds=i)) for i in range(5)] + [("b", T0)] + [("flush", T0 + timedelta(days=1))]
    folder = str(tmp_path / "t")
    df = spark.createDataFrame(rows, "source_ip string, event_time timestamp")
    df.write.parquet(folder)
    got = drain(detectors.stream_tumbling(spark.readStream.schema(df.schema).parquet(folder), 600, 3), "tumble", tmp_path).collect()
    assert [(r.source_ip, r.event_count) for r in got] == [("a", 5)]


def test_repeats_in_a_stream(spark, tmp_path):
    schema = "incident_type string, source_ip string, first_seen timestamp"
    folder = tmp_path / "inc"
    out = str(tmp_path / "out")
    batches = [[("b", "1", 0), ("b", "1", 1), ("s", "1", 0)], [("b", "1", 5), ("b", "2", 30)], [("x", "9", 200)], [("b", "1", 210)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(t, ip, T0 + timedelta(minutes=m)) for t, ip, m in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = detectors.stream_without_repeats(spark.readStream.schema(schema).parquet(str(folder)), 60)
        delivery.fan_out(stream, [lambda b: b.write.mode("append").parquet(out)], str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.incident_type, r.source_ip, (r.first_seen - T0).seconds // 60) for r in spark.read.parquet(out).collect())
    assert [g[:2] for g in got] == [("b", "1"), ("b", "1"), ("b", "2"), ("s", "1"), ("x", "9")] and got[1][2] == 210


def run(stream, out, cp):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(cp)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_state_is_bounded_and_can_be_seeded(spark, tmp_path):
    """After the time that reports are remembered no state is left; a query that starts from stored incidents repeats none of them."""
    schema = "event_type string, source_ip string, event_time timestamp"
    rows = [("failed_login", f"s{k}", T0 + timedelta(seconds=i)) for k in range(300) for i in range(6)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda **more: detectors.stream_brute_force(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), RuleConfig(), "1 minute", **more)
    for late in (T0 + timedelta(hours=1), T0 + timedelta(days=2)):
        spark.createDataFrame([("failed_login", "flush", late)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = run(stream(forget_minutes=600), tmp_path / "out", tmp_path / "cp")
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == found.select("source_ip").distinct().count() == 300
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # what the last event of `flush` waits with
    stored = found.where("source_ip < 's2'").select("incident_type", "source_ip", "first_seen")
    run(stream(stored=stored), tmp_path / "out2", tmp_path / "cp2")
    again = {r.source_ip for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert again == {r.source_ip for r in found.where("source_ip >= 's2'").collect()}


def test_python_state_grows_with_reported_sources_alone(spark, tmp_path):
    """100 sources of 60 events, every tenth with a window that is reported: the processor keeps a row for each of those ten, none for an
    event; incidents are those of the batch operator, whatever the parts, and rows without a time are left out."""
    schema = "event_type string, source_ip string, event_time timestamp, port int"
    quiet, busy = ([60 * 9 * i for i in range(60)], [60 * 9 * min(i, 40) + 20 * max(i - 40, 0) for i in range(60)])
    rows = [(kind, f"s{k}", T0 + timedelta(seconds=at), i % 30 + 1) for kind in ("failed_login", "connection") for k in range(100) for i, at in enumerate(quiet if k % 10 else busy)]
    df = spark.createDataFrame([*rows, ("failed_login", "s1", None, 1), ("connection", "s1", None, 1)], schema)
    flush = spark.createDataFrame([("failed_login", "flush", T0 + timedelta(days=3), 1), ("connection", "flush", T0 + timedelta(days=3), 1)], schema)
    df.union(flush).coalesce(2).write.parquet(str(tmp_path / "in"))
    got = lambda rows: sorted((r.source_ip, r.first_seen, r.last_seen, r.event_count, tuple(r.details.unique_ports or ())) for r in rows.collect())
    cfg = RuleConfig(port_scan_count=8)
    for name, stream, batch, more in (("brute", detectors.stream_brute_force, detect.brute_force, {}), ("scan", detectors.stream_port_scan, detect.port_scan, {"parts": 4})):
        q = run(stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cfg, "1 minute", **more), tmp_path / name, tmp_path / f"cp-{name}")
        found, want = got(spark.read.parquet(str(tmp_path / name))), got(batch(df, cfg))
        kept = [o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"] if o["operatorName"].startswith("transformWithState")]
        assert found == want and len(want) == 10 and sum(kept) <= 10


def test_a_forgotten_source_is_reported_again(spark, tmp_path):
    """Five events a burst, 10 minutes a window, 30 to remember: a burst at 0 is reported, those that start up to minute 40 are not, be they
    in one batch or in several whose watermarks lie between; the next one is."""
    schema = "event_type string, source_ip string, event_time timestamp"
    for parts, batches in ((2, [(0, 25, 39, 41, 60, 200)]), (1, [(0, 25), (39, 41), (60, 200)])):
        base = tmp_path / str(parts)
        for batch in batches:
            rows = [("failed_login", "a", T0 + timedelta(minutes=at, seconds=i)) for at in batch for i in range(5)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(base / "in"))
            run(detectors.stream_brute_force(spark.readStream.schema(schema).parquet(str(base / "in")), RuleConfig(), "0 minutes", forget_minutes=30, parts=parts), base / "out", base / "cp")
        assert sorted((r.first_seen - T0).seconds // 60 for r in spark.read.parquet(str(base / "out")).collect()) == [0, 41]


def test_a_retried_batch_skips_sinks_that_finished(spark, tmp_path):
    """The second of three sinks breaks after half of its work: on the next start each ends with each row once."""
    schema = "source_ip string, n int"
    spark.createDataFrame([(f"s{i}", i) for i in range(20)], schema).repartition(4).write.parquet(str(tmp_path / "in"))
    broken = [True]
    kept = delivery.batch_table(str(tmp_path / "b"))

    def second(batch, number):
        if broken:
            broken.clear()
            kept(batch.where("n < 10"), number)
            raise OSError("connection lost")
        kept(batch, number)

    appended = lambda name: lambda batch: batch.write.mode("append").parquet(str(tmp_path / name))
    sinks = {"first": appended("a"), "second": second, "third": appended("c")}
    failed = 0
    for _ in range(3):
        q = delivery.fan_out(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), sinks, str(tmp_path / "cp"))
        try:
            q.awaitTermination()
        except Exception:  # noqa: BLE001
            failed += 1
    assert failed == 1
    for name in "abc":
        assert sorted(r.n for r in spark.read.parquet(str(tmp_path / name)).collect()) == list(range(20)), name


def test_outcomes_of_rows(spark, tmp_path):
    """A receiver that rejects one row in ten: exactly those are reported, and they can be sent again with their keys."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def refuse_some(key, body):
        if json.loads(body)["n"] % 10 == 3:
            raise ValueError("rejected")
        (inbox / key).write_text(body)

    def take_all(key, body):
        (inbox / key).write_text(body)

    alerts = spark.createDataFrame([(i, T0, None) for i in range(200)], "n int, at timestamp, `a.b` string").repartition(5)
    out = str(tmp_path / "outcomes")
    got = delivery.deliver_rows(alerts, refuse_some, out, 1)
    assert sorted(json.loads(r.body)["n"] for r in got.where("not delivered").collect()) == list(range(3, 200, 10))
    assert {r.error for r in got.where("not delivered").collect()} == {"ValueError: rejected"} and got.where("delivered and error is null").count() == 180
    left = delivery.undelivered(spark, out)
    keys = {r.delivery_key for r in left.collect()}
    assert len(keys) == 20 and not keys & {f.name for f in inbox.iterdir()}
    delivery.deliver_rows(left, take_all, out, "1-again")
    assert delivery.undelivered(spark, out).count() == 0 and len(list(inbox.iterdir())) == 200 and keys <= {f.name for f in inbox.iterdir()}
    delivery.deliver_rows(alerts, take_all, out, 1)  # sent once more: the same keys
    assert len(list(inbox.iterdir())) == 200


def test_tailing(tmp_path, spark):
    f = tmp_path / "auth.log"
    assert read_new(str(f), 0) == ([], 0)
    f.write_bytes(b"one\r\n\ntwo\npart")
    rows, at = read_new(str(f), 0)
    assert [r[0] for r in rows] == ["one", "two"] and at == 10
    f.write_bytes(b"one\r\n\ntwo\npartial\n")
    assert [r[0] for r in read_new(str(f), at)[0]] == ["partial"]
    f.write_bytes(b"new\n")
    assert read_new(str(f), 18) == ([("new", str(f))], 4)
    spark.dataSource.register(TailSource)
    line = "Jun 15 02:00:0{} s sshd[1]: Failed password for root from 1.2.3.4 port 50000 ssh2\n"
    f.write_text(line.format(1) + line.format(2) + "Jun 15")
    out, cp = str(tmp_path / "rows"), str(tmp_path / "cp")
    for more, want in (("", 2), (" 02:00:03 s sshd[1]: Accepted password for root from 1.2.3.4 port 5 ssh2\n", 3)):
        with f.open("a") as end:
            end.write(more)
        parsed = logs.parse_ssh(spark.readStream.format("tail").option("paths", str(f)).load(), 2024)
        q = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
        for _ in range(60):
            q.processAllAvailable()
            if spark.read.parquet(out).count() >= want:
                break
            time.sleep(0.5)
        q.stop()
        assert spark.read.parquet(out).count() == want


def test_a_large_file_is_read_in_bounded_batches(tmp_path, spark):
    """First read of a large file: batches and ranges are bounded, every line comes once, lines longer than a range or a batch too; then
    the file is rotated before its last lines were read."""
    spark.dataSource.register(TailSource)
    f = tmp_path / "big.log"
    lines = [f"{i} " + "x" * (i * 37 % 200) for i in range(6000)] + ["long " + "y" * 150_000] + [f"after {i}" for i in range(50)]
    f.write_text("\n".join(lines) + "\nunfinished")
    out, cp = str(tmp_path / "rows"), str(tmp_path / "cp")

    def read(want):
        stream = spark.readStream.format("tail").option("paths", str(f)).option("maxBytesPerBatch", 100_000).option("bytesPerPartition", 20_000).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
        for _ in range(120):
            q.processAllAvailable()
            if spark.read.schema("value string, source_file string").parquet(out).count() >= want:
                break
            time.sleep(0.5)
        sizes = [p["numInputRows"] for p in q.recentProgress]
        q.stop()
        return sizes

    sizes = read(len(lines))
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == sorted(lines) and len([n for n in sizes if n]) >= 7
    with f.open("a") as end:
        end.write(" now\nlast of the old\n")
    f.rename(tmp_path / "big.log.1")
    f.write_text("first of the new\n")
    read(len(lines) + 3)
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == sorted([*lines, "unfinished now", "last of the old", "first of the new"])


def test_raw_messages_to_incidents(spark, tmp_path):
    line = "Jun 15 02:00:{:02d} s sshd[1]: Failed password for root from 1.2.3.4 port 50000 ssh2"
    folder = tmp_path / "topic"
    folder.mkdir()
    (folder / "m.txt").write_text("\n".join(json.dumps({"line": line.format(i), "source": "a", "ts": "2024-06-15T02:00:00.123456789Z"}) for i in range(9)) + "\nbroken\n")
    events = logs.parse_ssh(logs.open_envelope(spark.readStream.text(str(folder))), 2024)
    assert drain(events, "raw", tmp_path).count() == 9


def test_arriving_files(spark, tmp_path):
    folder, out, cp = tmp_path / "drop", str(tmp_path / "summary"), str(tmp_path / "cp2")
    folder.mkdir()
    line = "Jun 15 02:00:{:02d} s sshd[1]: Failed password for root from 1.2.3.4 port 50000 ssh2"
    (folder / "a.log").write_text("\n".join(line.format(i) for i in range(9)) + "\n")
    (folder / "skip.txt").write_text("x\n")
    arrivals.analyse_arrivals(spark, str(folder), out, cp, year=2024)
    (folder / "b.log").write_text(line.format(1) + "\n")
    arrivals.analyse_arrivals(spark, str(folder), out, cp, year=2024)
    got = sorted((r.source_file.rsplit("/", 1)[1], r.events, r.incidents, r.brute_force) for r in spark.read.parquet(out).collect())
    assert got == [("a.log", 9, 1, 1), ("b.log", 1, 0, 0)]


def test_whole_job(spark, tmp_path):
    from vigil.config import Allowlist
    from vigil.functions.ip import networks
    from vigil.plans.jobs import analyse, summarise_sources

    line = "Jun 15 02:00:{:02d} s sshd[1]: Failed password for u{} from {} port 50000 ssh2"
    ips = ["1.2.3.4"] * 9 + ["10.0.0.9"] * 9 + ["5.5.5.5", "6.6.6.6"]
    (tmp_path / "a.log").write_text("\n".join(line.format(i, i, ip) for i, ip in enumerate(ips)) + "\n")
    a = analyse(spark, str(tmp_path / "a.log"), allowlist=Allowlist(("10.0.0.0/8",)), intel=networks(spark, ["1.2.3.0/24"]), privacy={"scrub": True, "pseudonymise": True, "drop_raw": True, "key": b"k"}, year=2024)
    (inc,) = a.incidents.collect()
    assert inc.known_bad and inc.source_ip.startswith("ip_") and inc.event_count == 9 and inc.anomaly_score is not None
    assert a.events.where("raw_line is not null or username not like 'user_%'").count() == 0 and a.report()["kpis"].first().events == 11
    assert summarise_sources(spark, [str(tmp_path / "a.log")], year=2024).first().incidents == 2
