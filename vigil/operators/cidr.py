"""Containment joins of addresses and networks.

For each prefix length that occurs, an address has one masked key, so containment is an equi-join on (version, prefix length, key) that
Spark can broadcast or shuffle by its size; it is done on the distinct addresses only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.ip import v4_masked, v4_number, v6_digits, v6_masked


#: How an address's text becomes the number of a version 4 and the digits of a version 6 address.
Readers = tuple[Callable[[Column], Column], Callable[[Column], Column]]
STRICT: Readers = (v4_number, v6_digits)


def address_keys(addresses: DataFrame, prefixes: dict[int, list[int]], ip_col: str = "source_ip", readers: Readers = STRICT) -> DataFrame:
    """A row for each distinct address and prefix length: ip, version, prefix_len, net_key. Unparseable addresses have none. Mapped
    version 4 addresses (::ffff:a.b.c.d) count as version 6. readers: for texts that are no usual spelling of addresses."""
    ips = addresses.where(F.length(ip_col) > 0).select(F.col(ip_col).alias("ip")).distinct()
    parts = []
    if prefixes.get(4):
        n = readers[0](F.col("ip"))
        own = ips.withColumn("n", n).where("n is not null")
        parts.append(own.select("ip", F.lit(4).alias("version"), "n", F.explode(F.array(*map(F.lit, prefixes[4]))).alias("prefix_len")).select("ip", "version", "prefix_len", v4_masked(F.col("n"), F.col("prefix_len")).alias("net_key")))
    if prefixes.get(6):
        own = ips.where(F.contains(F.col("ip"), F.lit(":"))).withColumn("d", readers[1](F.col("ip"))).where("d is not null")
        parts.append(own.select("ip", F.lit(6).alias("version"), "d", F.explode(F.array(*map(F.lit, prefixes[6]))).alias("prefix_len")).select("ip", "version", "prefix_len", v6_masked(F.col("d"), F.col("prefix_len")).alias("net_key")))
    if not parts:
        return ips.sparkSession.createDataFrame([], "ip string, version int, prefix_len int, net_key string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def prefix_lengths(nets: DataFrame) -> dict[int, list[int]]:
    """The prefix lengths that occur, by version: 162 at most."""
    out: dict[int, list[int]] = {}
    for r in nets.select("version", "prefix_len").distinct().collect():
        out.setdefault(r.version, []).append(r.prefix_len)
    return {v: sorted(p) for v, p in out.items()}


def contained(addresses: DataFrame, nets: DataFrame, ip_col: str = "source_ip") -> DataFrame:
    """ip and the longest prefix_len of a network around it, for addresses that lie in any; each address once."""
    keys = address_keys(addresses, prefix_lengths(nets), ip_col)
    return keys.join(nets.select("version", "prefix_len", "net_key").distinct(), ["version", "prefix_len", "net_key"]).groupBy("ip").agg(F.max("prefix_len").alias("prefix_len"))


#: Lists of so many networks at most, such as allowlists, are compared with each address in place; longer ones are joined.
LITERAL = 64


def literal_ranges(nets: DataFrame) -> list[tuple[int, int, int]] | None:
    """(version, first, last) of each network of a short list, or None for a longer one, of which no more than LITERAL rows are fetched."""
    rows = nets.select("version", "prefix_len", "net_key").distinct().limit(LITERAL + 1).collect()
    if len(rows) > LITERAL:
        return None
    out = []
    for r in rows:
        first = int(r.net_key, 10 if r.version == 4 else 16)
        out.append((r.version, first, first + (1 << ((32 if r.version == 4 else 128) - r.prefix_len)) - 1))
    return out


def inside_ranges(ip: Column, ranges: list[tuple[int, int, int]]) -> Column:
    """Whether an address lies in one of the ranges; false for what is no address. Version 6 addresses compare as their digits."""
    text = {4: lambda n: n, 6: lambda n: f"{n:032x}"}
    out = F.lit(False)
    for version, key in ((4, v4_number(ip)), (6, v6_digits(ip))):
        own = [F.struct(F.lit(text[version](a)).cast("long" if version == 4 else "string").alias("a"), F.lit(text[version](b)).cast("long" if version == 4 else "string").alias("b")) for v, a, b in sorted(ranges) if v == version]
        if own:
            out = out | F.coalesce(_in_any(key, F.array(*own)), F.lit(False))
    return out


def _in_any(key: Column, ranges: Column) -> Column:
    """Whether the key, which is computed once, lies in one of the ranges (a, b)."""
    return F.get(F.transform(F.array(key), lambda n: F.exists(ranges, lambda r: (n >= r["a"]) & (n <= r["b"]))), F.lit(0))


def without_networks(events: DataFrame, nets: DataFrame, ip_col: str = "source_ip") -> DataFrame:
    """Events outside all networks; null and unparseable addresses stay. A short list is compared in place, without a shuffle of events."""
    ranges = literal_ranges(nets)
    if ranges is not None:
        return events.where(~inside_ranges(F.col(ip_col), ranges))
    inside = contained(events, nets, ip_col).select(F.col("ip").alias(ip_col))
    return events.join(inside, ip_col, "left_anti").select(*events.columns)


def flag_networks(rows: DataFrame, nets: DataFrame, flag: str, ip_col: str = "source_ip") -> DataFrame:
    """rows with a boolean: does the address lie in any network. A short list is compared in place."""
    ranges = literal_ranges(nets)
    if ranges is not None:
        return rows.drop(flag).withColumn(flag, inside_ranges(F.col(ip_col), ranges))
    inside = contained(rows, nets, ip_col).select(F.col("ip").alias(ip_col), F.lit(True).alias("__in"))
    return rows.drop(flag).join(inside, ip_col, "left").withColumn(flag, F.coalesce("__in", F.lit(False))).select(*[c for c in rows.columns if c != flag], flag)


def _less(table: DataFrame, prefer: str) -> list[Column]:
    """Columns that are the smaller the larger prefer is, a number or a struct of such."""
    kind = table.schema[prefer].dataType
    names = [f"{prefer}.{f.name}" for f in kind.fields] if isinstance(kind, T.StructType) else [prefer]
    return [(-F.col(n)).alias(f"o{i}") for i, n in enumerate(names)]


def longest_match(rows: DataFrame, table: DataFrame, value_col: str, default: str, ip_col: str = "source_ip", prefer: str = "prefix_len", readers: Readers = STRICT) -> DataFrame:
    """rows with the value of the longest network around the address, or of that with the largest `prefer`, such as `narrow` for ranges;
    equal ones by the smaller value. table: version, prefix_len, net_key, value_col and prefer. readers: as in address_keys()."""
    keys = address_keys(rows, prefix_lengths(table), ip_col, readers)
    best = keys.join(table, ["version", "prefix_len", "net_key"]).groupBy("ip").agg(F.min_by(value_col, F.struct(*_less(table, prefer), value_col)).alias("__value"))
    joined = rows.drop(value_col).join(best.withColumnRenamed("ip", ip_col), ip_col, "left")
    return joined.withColumn(value_col, F.coalesce("__value", F.lit(default))).select(*[c for c in rows.columns if c != value_col], value_col)


def filter_allowlist(events: DataFrame, nets: DataFrame | None = None, usernames: tuple[str, ...] = (), hostnames: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
    """Mark events of the allowlist: by network, user name or host name (where the column exists). Returns the events with
    `suppressed`, and the condition that keeps the others; `count_if(suppressed)` is the number left out."""
    marked = flag_networks(events, nets, "suppressed") if nets is not None else events.withColumn("suppressed", F.lit(False))
    drop = F.col("suppressed")
    if usernames and "username" in events.columns:
        drop = drop | F.coalesce(F.col("username").isin(*usernames), F.lit(False))
    if hostnames and "hostname" in events.columns:
        drop = drop | F.coalesce(F.col("hostname").isin(*hostnames), F.lit(False))
    return marked.withColumn("suppressed", drop), ~F.col("suppressed")
