"""Addresses, networks and ranges in built-in functions against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from vigil.functions.ip import network_text, networks, parsed_networks, v4_number, v6_digits
from vigil.functions.ipranges import range_networks
from vigil.operators import cidr
from vigil.operators.cidr import longest_match
from vigil.sources.feeds import count_bad_countries, load_countries, load_threat_intel


def number(text, kind):
    try:
        return int(kind(text))
    except (ValueError, TypeError):
        return None


def strange(rng):
    """Addresses in all spellings, and what is nearly one."""
    v4 = ".".join(str(rng.choice((0, 1, 9, 10, 99, 100, 255, 256, 300, "01", ""))) if rng.random() < 0.2 else str(rng.randrange(256)) for _ in range(rng.choice((4, 4, 4, 3, 5))))
    groups = [rng.choice(("0", "0", "1", "db8", "FFFF", "abcd", "00a", "12345", "g", "")) if rng.random() < 0.3 else f"{rng.randrange(65536):x}" for _ in range(rng.choice((8, 8, 7, 6, 3, 1, 9)))]
    text = ":".join(groups)
    if rng.random() < 0.5:
        at = rng.randrange(len(groups) + 1)
        text = ":".join(groups[:at]) + "::" + ":".join(groups[at + rng.randrange(3) :])
    if rng.random() < 0.2:
        text = text.rpartition(":")[0] + ":" + v4
    if rng.random() < 0.1:
        text += rng.choice(("%eth0", "%", "%a%b", " ", ":", "::"))
    return rng.choice((text, text, text, v4, str(ipaddress.IPv6Address(rng.getrandbits(128)))))


def test_addresses_equal_the_library(spark):
    rng = random.Random(11)
    texts = sorted({strange(rng) for _ in range(10_000)} | {"::", ":", ":::", "::1", "1::", "", "::ffff:1.2.3.4", "1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%lo"})
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", v4_number(F.col("ip")).alias("four"), v6_digits(F.col("ip")).alias("six"))
    n4 = n6 = 0
    for r in rows.collect():
        four, six = number(r.ip, ipaddress.IPv4Address), number(r.ip, ipaddress.IPv6Address)
        assert r.four == four and r.six == (None if six is None else f"{six:032x}"), r
        n4, n6 = n4 + (four is not None), n6 + (six is not None)
    assert n4 > 500 and n6 > 2000
    assert spark.sql("SELECT CAST(NULL AS STRING) AS ip").select(v6_digits(F.col("ip"))).first()[0] is None


def test_networks_equal_the_library(spark):
    rng = random.Random(12)
    texts = set()
    for _ in range(3000):
        base = strange(rng)
        texts.add(base + rng.choice(("", f"/{rng.randrange(140)}", f"/{rng.randrange(33)}", "/255.255.240.0", "/0.0.15.255", "/255.0.255.0", "/", "/x", "/8/8", "/008")))
    rows = parsed_networks(spark.createDataFrame([(t,) for t in sorted(texts)], "net string"), "net").withColumn("text", network_text(F.col("version"), F.col("prefix_len"), F.col("net_key"))).collect()
    got = {r.net: (r.version, r.prefix_len, r.net_key) for r in rows}
    assert all(r.text == str(ipaddress.ip_network(r.net.strip(), strict=False)) for r in rows if "%" not in r.net)
    for t in texts:
        try:
            net = ipaddress.ip_network(t.strip(), strict=False) if "%" not in t else None
        except ValueError:
            net = None
        if "%" not in t:
            first = net and int(net.network_address)
            assert got.get(t) == (net and (net.version, net.prefixlen, str(first) if net.version == 4 else f"{first:032x}")), t


def test_ranges_are_covered_by_the_fewest_networks(spark):
    rng = random.Random(13)
    rows = []
    for i in range(150):
        kind, bits = (ipaddress.IPv4Address, 32) if i % 2 else (ipaddress.IPv6Address, 128)
        width = rng.choice((0, 3, 8, 20, 31, 64, 70, 100, bits))
        a = rng.choice((0, rng.getrandbits(bits), (1 << bits) - 1 - rng.getrandbits(min(bits, 20))))
        b = min((1 << bits) - 1, a + rng.getrandbits(min(width, bits)) if width else a)
        rows.append((i, str(kind(a)), str(kind(b))))
    rows += [(1000, "1.1.1.9", "1.1.1.1"), (1001, "1.1.1.1", "::1"), (1002, "x", "1.1.1.1"), (1003, None, None)]
    got = {}
    for r in range_networks(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b").collect():
        got.setdefault(r.i, set()).add((r.version, r.prefix_len, r.net_key))
    for i, a, b in rows[:150]:
        want = {(n.version, n.prefixlen, str(int(n.network_address)) if n.version == 4 else f"{int(n.network_address):032x}") for n in ipaddress.summarize_address_range(ipaddress.ip_address(a), ipaddress.ip_address(b))}
        assert got[i] == want, (a, b)
    assert set(got) == set(range(150))


def test_the_narrowest_range_counts(spark, tmp_path):
    """Overlapping ranges and networks of both versions, against a plain search."""
    rng = random.Random(14)
    lines, spans = ["network,start,end,country"], []
    for i in range(60):
        kind, base, bits = (ipaddress.IPv4Address, int(ipaddress.IPv4Address("10.0.0.0")), 12) if i % 2 else (ipaddress.IPv6Address, int(ipaddress.IPv6Address("2001:db8::")), 68)
        if rng.random() < 0.3:
            net = ipaddress.ip_network((base + rng.getrandbits(bits), (32 if i % 2 else 128) - rng.randrange(bits)), strict=False)
            a, b = int(net[0]), int(net[-1])
            lines.append(f"{net},,,C{i:02d}")
        else:
            a, b = sorted(base + rng.getrandbits(bits) for _ in range(2))
            lines.append(f",{kind(a)},{kind(b)},C{i:02d}")
        spans.append((4 if i % 2 else 6, a, b, f"C{i:02d}"))
    bad = [",1.1.1.9,1.1.1.1,XX", "nonsense,,,XX", ",,,XX", "1.2.3.0/24,,,"]
    (tmp_path / "c.csv").write_text("\n".join(lines + bad) + "\n")
    ips = [str(ipaddress.IPv4Address(int(ipaddress.IPv4Address("10.0.0.0")) + rng.getrandbits(13))) for _ in range(200)] + [str(ipaddress.IPv6Address(int(ipaddress.IPv6Address("2001:db8::")) + rng.getrandbits(69))) for _ in range(200)]
    df = spark.createDataFrame([(ip,) for ip in ips], "source_ip string")
    got = {r.source_ip: r.country for r in longest_match(df, load_countries(spark, str(tmp_path / "c.csv")), "country", "Unknown", prefer="narrow").collect()}
    for ip in ips:
        x = ipaddress.ip_address(ip)
        inside = [(b - a, c) for v, a, b, c in spans if v == x.version and a <= int(x) <= b]
        assert got[ip] == min(inside, default=(0, "Unknown"))[1], ip
    assert count_bad_countries(spark, str(tmp_path / "c.csv")).first().bad_lines == len(bad)


def test_feed(spark, tmp_path):
    (tmp_path / "feed.txt").write_text("# list\n10.0.0.7/8 # first\n\n2001:DB8::/32\nnonsense\n1.2.3.4\n10.0.0.0/8\n")
    got = sorted((r.version, r.prefix_len, r.net_key) for r in load_threat_intel(spark, str(tmp_path / "feed.txt")).collect())
    assert got == [(4, 8, str(10 << 24)), (4, 32, str(0x01020304)), (6, 32, "20010db8" + "0" * 24)]
    assert load_threat_intel(spark, str(tmp_path / "none.txt")).count() == 0 and load_threat_intel(spark, None).count() == 0


def test_short_and_long_lists_agree(spark, monkeypatch):
    """Networks compared in place, and the same ones joined, against the library."""
    rng = random.Random(15)
    nets = [str(ipaddress.ip_network((rng.getrandbits(32), rng.randrange(4, 33)), strict=False)) for _ in range(12)] + [str(ipaddress.ip_network((rng.getrandbits(128), rng.randrange(2, 129)), strict=False)) for _ in range(12)] + ["0.0.0.0/32", "ffff::/16", "::/128"]
    ips = [strange(rng) for _ in range(600)] + [str(ipaddress.ip_network(n)[k]) for n in nets for k in (0, -1)] + ["", None, "0.0.0.0", "::", "0.0.0.1"]
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "k int, source_ip string").repartition(3)
    held = [ipaddress.ip_network(n) for n in nets]

    def inside(ip):
        try:
            x = ipaddress.ip_address((ip or "").partition("%")[0])
        except ValueError:
            return False
        return number(ip, type(x)) is not None and any(x in n for n in held if n.version == x.version)

    want = {i for i, ip in enumerate(ips) if inside(ip)}
    for most in (64, 3):
        monkeypatch.setattr(cidr, "LITERAL", most)
        table = networks(spark, nets)
        assert {r.k for r in cidr.flag_networks(rows, table, "bad").where("bad").collect()} == want
        assert {r.k for r in cidr.without_networks(rows, table).collect()} == set(range(len(ips))) - want
    monkeypatch.setattr(cidr, "LITERAL", 64)
    assert "hashpartitioning" not in cidr.without_networks(rows, networks(spark, nets))._jdf.queryExecution().executedPlan().toString()
