"""Addresses and networks as sortable keys.

A version 4 address is its number as a long, a version 6 address its 32 hexadecimal digits. Both have a text key, so that a network
of any prefix length is the key of its masked first address.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V4 = r"^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"


def v4_number(ip: Column) -> Column:
    """The number of a dotted address; null for anything else, such as octets over 255 or with leading zeros."""
    parts = [F.regexp_extract(ip, _V4, k).try_cast("int") for k in (1, 2, 3, 4)]
    ok = parts[0].isNotNull()
    for p in parts:
        ok = ok & (p <= 255)
    return F.when(ok, ((parts[0].cast("long") * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def v6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of a version 6 address; null for anything else. `::`, an embedded version 4 address at the end and a
    zone (which is dropped) are read as usual."""
    none = F.array().cast("array<string>")

    def without_v4(text: Column) -> Column:
        """text with its embedded address, if there is one, as two groups."""
        last = F.substring_index(text, ":", -1)
        number = F.lpad(F.lower(F.hex(v4_number(last))), 8, "0")
        plain = _let(number, lambda h: F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(last)), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        return F.when(F.contains(text, F.lit(".")), plain).otherwise(text)

    def groups(side: Column) -> Column:
        return F.when(F.length(side) > 0, F.split(side, ":", -1)).otherwise(none)

    def digits(sides: Column) -> Column:
        both = F.struct(groups(F.get(sides, 0)).alias("head"), F.when(F.size(sides) == 2, groups(F.get(sides, 1))).otherwise(none).alias("tail"), F.size(sides).alias("sides"))
        return _let(both, joined)

    def joined(p: Column) -> Column:
        n = F.size(p["head"]) + F.size(p["tail"])
        whole = F.when(p["sides"] == 1, n == 8).otherwise((p["sides"] == 2) & (n <= 7))
        good = F.forall(F.concat(p["head"], p["tail"]), lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$")))
        text = lambda part: F.array_join(F.transform(part, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(whole & good, F.concat(text(p["head"]), F.repeat(F.lit("0000"), 8 - n), text(p["tail"])))

    bare = F.lower(F.regexp_replace(ip, "%[^%]+$", ""))
    return F.when(F.contains(ip, F.lit(":")), _let(bare, lambda t: _let(F.split(without_v4(t), "::", -1), digits)))


def network_text(version: Column, prefix_len: Column, net_key: Column) -> Column:
    """A network as it is usually written."""
    four = _let(net_key.try_cast("long"), lambda n: F.concat_ws(".", *((F.shiftright(n, k).bitwiseAND(F.lit(255))).cast("string") for k in (24, 16, 8, 0))))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(net_key, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))

    def shortened(text: Column) -> Column:
        """text with its longest run of two or more zero groups, of equal ones the first, as ::"""
        out = text
        for n in range(2, 9):
            run = rf"(^|:)0(:0){{{n - 1}}}(:|$)"
            out = F.when(F.rlike(text, F.lit(run)), F.concat(F.split(text, run, 2)[0], F.lit("::"), F.split(text, run, 2)[1])).otherwise(out)
        return out

    address = F.when(version == 4, four).otherwise(_let(F.array_join(groups, ":"), shortened))
    return F.concat(address, F.lit("/"), prefix_len.cast("string"))


def parsed_networks(rows: DataFrame, net: str) -> DataFrame:
    """rows (with a text column net) of addresses and ranges such as 10.0.0.0/8, 10.0.0.0/255.0.0.0 or 2001:db8::/32, with version,
    prefix_len and net_key; host bits are masked, and rows that hold neither are left out. In built-in functions, for feeds of any size."""
    once = lambda df, **made: df.withColumn("__n", F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items()))))).select("*", "__n.*").drop("__n")  # noqa: E731 - computed once for each row
    text = F.trim(F.col(net))
    address, suffix = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    slashes = F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))
    found = once(rows, __4=_let(address, v4_number), __6=_let(address, v6_digits), __s=suffix, __k=slashes)
    suffix, version = F.col("__s"), F.when(F.col("__4").isNotNull(), 4).when(F.col("__6").isNotNull(), 6)
    ones_first = lambda bits: F.when(F.rlike(bits, F.lit("^1*0*$")), F.length(F.replace(bits, F.lit("0"), F.lit("")))).when(F.rlike(bits, F.lit("^0*1*$")), F.length(F.replace(bits, F.lit("1"), F.lit(""))))
    mask = F.when(F.contains(suffix, F.lit(".")) & (version == 4), _let(F.lpad(F.bin(v4_number(suffix)), 32, "0"), ones_first))
    length = F.when(F.rlike(suffix, F.lit("^[0-9]{1,9}$")), suffix.try_cast("int"))
    size = F.when(F.col("__k") == 0, F.when(version == 4, 32).otherwise(128)).when(F.col("__k") == 1, F.coalesce(length, mask))
    known = once(found, version=version, prefix_len=size).where((F.col("version") == 4) & F.col("prefix_len").between(0, 32) | (F.col("version") == 6) & F.col("prefix_len").between(0, 128))
    key = F.when(F.col("version") == 4, v4_masked(F.col("__4"), F.least("prefix_len", F.lit(32)))).otherwise(v6_masked(F.col("__6"), F.col("prefix_len")))
    return known.withColumn("net_key", key).drop("__4", "__6", "__s", "__k")


def networks(spark, entries: list[str]) -> DataFrame:
    """version, prefix_len, net_key, net of IPs and CIDR ranges; host bits are masked and entries that are neither are left out.
    net_key is the masked address: a number in text for version 4, hexadecimal digits for version 6."""
    rows = []
    for entry in entries:
        try:
            net = ipaddress.ip_network(entry.strip(), strict=False)
        except ValueError:
            continue
        first = int(net.network_address)
        rows.append((net.version, net.prefixlen, str(first) if net.version == 4 else f"{first:032x}", str(net)))
    return spark.createDataFrame(rows, "version int, prefix_len int, net_key string, net string").distinct()


def v6_masked(digits: Column, prefix_len: Column) -> Column:
    """The digits with all bits behind the prefix zero."""
    whole = F.floor(prefix_len / 4).cast("int")
    bits = prefix_len % 4
    nibble = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    kept = F.when(bits == 1, nibble.bitwiseAND(8)).when(bits == 2, nibble.bitwiseAND(12)).when(bits == 3, nibble.bitwiseAND(14)).otherwise(F.lit(0))
    edge = F.when(bits > 0, F.lower(F.hex(kept))).otherwise(F.lit(""))
    return F.rpad(F.concat(F.substring(digits, F.lit(1), whole), edge), 32, "0")


def v4_masked(number: Column, prefix_len: Column) -> Column:
    """The number with all bits behind the prefix zero, as text."""
    size = F.pow(F.lit(2.0), 32 - prefix_len).cast("long")
    return (number - number % size).cast("string")
