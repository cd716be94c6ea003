"""Parsers, feeds, labels, bundles."""

import json
from datetime import datetime

from vigil.config import Allowlist, ConfigError, RuleConfig, rules_from
from vigil.operators import cidr
from vigil.functions.ip import networks
from vigil.sources import feeds, logs

import pytest


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_ssh_lines(spark):
    got = logs.parse_ssh(lines(
        spark,
        "Jun 15 02:00:00 server sshd[1234]: Failed password for root from 1.2.3.4 port 50000 ssh2",
        "Jun 15 02:00:05 server sshd[2]: Failed password for invalid user bob from 2001:db8::1 port 22 ssh2",
        "Jun  5 03:00:00 server sshd[3]: Accepted publickey for alice from 172.16.0.10 port 54321 ssh2",
        "Jun 15 02:10:00 server sshd[4]: Connection from 10.0.0.55 port 1000 on 0.0.0.0 port 22",
        "Jun 15 02:10:01 server sshd[4]: Failed password for ünïcode from ::ffff:1.2.3.4 port 1 ssh2",
        "Jun 15 02:10:01 server sshd[4]: Failed password for invalid user  from 1.2.3.4 port 1 ssh2",
        "Feb 30 02:10:01 server sshd[4]: Failed password for x from 1.2.3.4 port 1 ssh2", "garbage", "",
    ), 2023).collect()
    assert [(r.event_type, r.source_ip, r.username, r.port) for r in got] == [("failed_login", "1.2.3.4", "root", 50000), ("failed_login", "2001:db8::1", "bob", 22), ("successful_login", "172.16.0.10", "alice", 54321), ("connection", "10.0.0.55", None, 1000), ("failed_login", "::ffff:1.2.3.4", "ünïcode", 1)]
    assert got[2].event_time == datetime(2023, 6, 5, 3, 0, 0) and got[0].raw_line.startswith("Jun 15")


def test_web_lines(spark):
    got = logs.parse_web(lines(
        spark, '203.0.113.66 - - [01/Mar/2024:09:00:00 +0000] "GET /admin/0.php HTTP/1.1" 404 512 "-" "sqlmap/1.7"', '::1 - bob [01/Mar/2024:02:30:00 -0330] "POST /a HTTP/1.1" 200 5', "no line", '1.1.1.1 - - [bad time] "GET / HTTP/1.1" 404 1',
    )).collect()
    assert [(r.event_type, r.source_ip, r.tz_offset_s) for r in got] == [("http_404", "203.0.113.66", 0), ("http_request", "::1", -12600)]
    assert got[1].event_time == datetime(2024, 3, 1, 6, 0, 0)


def test_windows_table_and_formats(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Time Created,EVENTID,Source IP,User,Port\n2024-06-01T10:00:00+02:00,4625,1.2.3.4,bob,445\n2024-06-01 10:00:00,4624,,,-\n2024-06-01 10:00:00,4688,5.5.5.5,x,1\n2024-06-01 10:00:00,,5.5.5.5,x,1\n,4625,1.1.1.1,a,1\n2024-06-01 10:00:00,abc,1.1.1.1,a,1\nshort\n")
    (tmp_path / "a.log").write_text("Jun 15 02:00:00 s sshd[1]: Failed password for root from 1.2.3.4 port 50000 ssh2\nx\n")
    (tmp_path / "b.log").write_text('203.0.113.66 - - [01/Mar/2024:09:00:00 +0000] "GET / HTTP/1.1" 404 1\n')
    paths = [str(tmp_path / f) for f in ("w.csv", "a.log", "b.log")]
    got = {r.source_file.rsplit("/", 1)[1]: r.format for r in logs.detect_formats(spark, paths).collect()}
    assert got == {"w.csv": "windows", "a.log": "ssh", "b.log": "web"}
    rows = logs.load_logs(spark, paths, year=2024).collect()
    w = [r for r in rows if r.log_type == "windows"]
    w = sorted(w, key=lambda r: ["failed_login", "successful_login", "event_4688", "event_0"].index(r.event_type))  # rows have no order
    assert [(r.event_type, r.source_ip, r.username, r.port) for r in w] == [("failed_login", "1.2.3.4", "bob", 445), ("successful_login", None, None, None), ("event_4688", "5.5.5.5", "x", 1), ("event_0", "5.5.5.5", "x", 1)]
    assert w[0].event_time == datetime(2024, 6, 1, 8) and w[0].tz_offset_s == 7200 and json.loads(w[0].raw_line)["User"] == "bob"
    assert len(rows) == 6 and {r.source_file.rsplit("/", 1)[1]: r.lines for r in logs.line_counts(spark, paths).collect()}["a.log"] == 2
    with pytest.raises(ValueError):
        logs.load_logs(spark, paths, "syslog")


def test_envelope(spark):
    wrapped = logs.envelope(spark.createDataFrame([("a line", "f.log")], "value string, source_file string"))
    assert set(json.loads(wrapped.first().value)) == {"line", "source", "ts"}
    got = logs.open_envelope(wrapped.union(lines(spark, "no json"))).collect()
    assert [(r.value, r.source_file) for r in got] == [("a line", "f.log")]


def test_feed_and_containment(spark, tmp_path):
    (tmp_path / "feed.txt").write_text("# comment\n\njunk\n10.1.2.3/16 # masked\n2001:db8::/33\n192.0.2.7\n")
    nets = feeds.load_threat_intel(spark, str(tmp_path / "feed.txt"))
    assert {r.net for r in nets.collect()} == {"10.1.0.0/16", "2001:db8::/33", "192.0.2.7/32"}
    assert feeds.load_threat_intel(spark, str(tmp_path / "missing.txt")).count() == 0 and feeds.load_threat_intel(spark, None).count() == 0
    ips = ["10.1.255.255", "10.2.0.0", "192.0.2.7", "192.0.2.8", "2001:db8:7fff::1", "2001:db8:8000::1", "::ffff:10.1.0.1", "010.1.0.1", "300.1.1.1", "x", "", None]
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "k int, source_ip string")
    assert {r.k for r in cidr.flag_networks(rows, nets, "bad").where("bad").collect()} == {0, 2, 4}
    assert {r.k for r in cidr.without_networks(rows, nets).collect()} == {1, 3, 5, 6, 7, 8, 9, 10, 11}
    assert cidr.flag_networks(rows, networks(spark, []), "bad").where("bad").count() == 0
    table = feeds.country_table(spark, {"10.0.0.0/8": "AA", "10.1.0.0/16": "BB", "2001:db8::/32": "CC"})
    assert [r.country for r in cidr.longest_match(rows, table, "country", "Unknown").orderBy("k").collect()][:6] == ["BB", "AA", "Unknown", "Unknown", "CC", "CC"]


def test_settings():
    assert rules_from({"thresholds": {"brute_force": {"count": 3, "window_seconds": 90}}, "detection": {"x": 1}}) == RuleConfig(brute_force_count=3, brute_force_window=1)
    assert rules_from(None) == RuleConfig() and rules_from({"thresholds": {"port_scan": {"window_seconds": 10}}}).port_scan_window == 1
    for bad in (0, -1, "x", None):
        with pytest.raises(ConfigError):
            rules_from({"thresholds": {"flood_404": {"count": bad}}})
    assert RuleConfig().override(flood_404_count=9, brute_force_count=None).flood_404_count == 9
    assert Allowlist.of({"ips": ["1.2.3.4 "], "usernames": None}) == Allowlist(("1.2.3.4",)) and Allowlist.of_csv(" a, ,b").networks == ("a", "b")


def test_labels_truth_and_techniques(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp,source_ip,label\n2024-01-01T00:00:00Z,1.1.1.1,Malicious\nbad,1.1.1.1,benign\n2024-01-01 00:00:00,,benign\n2024-01-01 00:00:00,2.2.2.2,unsure\n2024-01-01 00:00:00,2.2.2.2,benign\n")
    assert [(r.source_ip, r.label) for r in feeds.load_ground_truth(spark, str(tmp_path / "t.csv")).collect()] == [("1.1.1.1", "malicious"), ("2.2.2.2", "benign")]
    (tmp_path / "l.json").write_text(json.dumps({"benign_default": True, "allowlist": ["9.9.9.9"], "labels": {"1.1.1.1": {"class": "brute_force", "malicious": True}, "2.2.2.2": {"class": "benign", "malicious": False}}}))
    labels, allow, default = feeds.load_labels(spark, str(tmp_path / "l.json"))
    assert {(r.source_ip, r.malicious) for r in labels.collect()} == {("1.1.1.1", True), ("2.2.2.2", False)} and allow == ["9.9.9.9"] and default
    ref = lambda source, i: {"source_name": source, "external_id": i}
    objects = [
        {"type": "attack-pattern", "name": "A", "description": "d", "external_references": [ref("x", "T9"), ref("mitre-attack", "T1")], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "initial-access"}]},
        {"type": "attack-pattern", "name": "B", "external_references": [ref("mitre-attack", "T2")]}, {"type": "attack-pattern", "name": "C", "external_references": [ref("capec", "T3")]}, {"type": "malware", "name": "D", "external_references": [ref("mitre-attack", "T4")]},
    ]
    (tmp_path / "s.json").write_text(json.dumps({"objects": objects}))
    assert [tuple(r) for r in feeds.load_techniques(spark, str(tmp_path / "s.json")).collect()] == [("T1", "A", "Initial Access", "d"), ("T2", "B", "Unknown", "")]


def test_windows_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TimeCreated,EventID,IpAddress,TargetUserName,IpPort\n2024-06-15T02:00:00,4625,1.2.3.4,root,22\n")
    (tmp_path / "b.csv").write_text("user,port,id,timestamp,source ip\nann,443,4624,2024-06-15 03:00:00,5.6.7.8\n")
    (tmp_path / "c.csv").write_text("TimeCreated,EventID,IpAddress,TargetUserName,IpPort\n2024-06-15T04:00:00,4625,9.9.9.9,bob,1\n")
    (tmp_path / "empty.csv").write_text("")
    got = sorted((r.event_type, r.source_ip, r.username, r.port, r.source_file.rsplit("/", 1)[1]) for r in logs.read_windows(spark, str(tmp_path)).collect())
    assert got == [("failed_login", "1.2.3.4", "root", 22, "a.csv"), ("failed_login", "9.9.9.9", "bob", 1, "c.csv"), ("successful_login", "5.6.7.8", "ann", 443, "b.csv")]


def test_country_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("network,country\n10.0.0.7/8,ZZ\n10.1.0.0/16,AA\nnone,BB\n1.2.3.4,CC\n1.2.3.4/33,DD\n")
    from vigil.operators.cidr import longest_match
    from vigil.sources.feeds import load_countries

    ips = spark.createDataFrame([("10.1.2.3",), ("10.9.9.9",), ("1.2.3.4",), ("8.8.8.8",)], "source_ip string")
    got = {r.source_ip: r.country for r in longest_match(ips, load_countries(spark, str(tmp_path / "c.csv")), "country", "Unknown").collect()}
    assert got == {"10.1.2.3": "AA", "10.9.9.9": "ZZ", "1.2.3.4": "CC", "8.8.8.8": "Unknown"}
