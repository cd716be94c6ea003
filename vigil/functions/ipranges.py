"""Ranges of addresses, from a first to a last one, as the fewest networks that cover them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.ip import v4_number, v6_digits

_WIDE = "decimal(38,0)"
_BLOCKS = f"array<struct<at:{_WIDE},k:int>>"


def cover(first: Column, last: Column, bits: int) -> Column:
    """The fewest aligned blocks (at, of 2 ** k numbers) that make up first to last, both below 2 ** bits: blocks grow while they are
    aligned to where the rest begins, then shrink to where it ends."""
    size = F.array(*(F.lit(Decimal(2**k)).cast(_WIDE) for k in range(bits + 1)))
    end = last.cast(_WIDE) + 1

    def take(acc: Column, k: Column) -> Column:
        return F.struct((acc["x"] + F.get(size, k)).cast(_WIDE).alias("x"), F.concat(acc["out"], F.array(F.struct(acc["x"].alias("at"), k.alias("k")))).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fits = acc["x"] + F.get(size, s["k"]) <= end
        odd = F.floor(acc["x"] / F.get(size, s["k"])) % 2 == 1
        return F.when(fits & (~s["up"] | odd), take(acc, s["k"])).otherwise(acc)

    flagged = lambda ks, up: F.transform(ks, lambda k: F.struct(k.alias("k"), F.lit(up).alias("up")))
    steps = F.concat(flagged(F.sequence(F.lit(0), F.lit(bits - 1)), True), flagged(F.sequence(F.lit(bits), F.lit(0)), False))
    start = F.struct(first.cast(_WIDE).alias("x"), F.array().cast(_BLOCKS).alias("out"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _half(digits: Column, k: int) -> Column:
    return F.conv(F.substring(digits, 1 + 16 * k, 16), 16, 10).cast(_WIDE)


def _hex(number: Column) -> Column:
    return F.lpad(F.lower(F.conv(number.cast("string"), 10, 16)), 16, "0")


def range_networks(rows: DataFrame, first: str, last: str) -> DataFrame:
    """rows (with text columns first and last) with version, prefix_len and net_key, a row for each network of the range's cover, and
    narrow, which is larger for a narrower range. Rows whose ends are no addresses of one version, or in the wrong order, are left out.

    A version 4 range has 62 networks at most, a version 6 one 254."""
    a4, b4, a6, b6 = v4_number(F.trim(first)), v4_number(F.trim(last)), v6_digits(F.trim(first)), v6_digits(F.trim(last))
    ends = rows.withColumn("__e", F.explode(F.array(F.struct(a4.alias("__a4"), b4.alias("__b4"), a6.alias("__a6"), b6.alias("__b6"))))).select("*", "__e.*").drop("__e")  # once for each row
    net = lambda version, length, key: F.struct(F.lit(version).alias("version"), length.cast("int").alias("prefix_len"), key.alias("net_key"))

    four = ends.where("__a4 <= __b4").withColumn("__blocks", cover(F.col("__a4"), F.col("__b4"), 32))
    four = four.withColumn("__net", F.explode(F.transform("__blocks", lambda b: net(4, 32 - b["k"], b["at"].cast("string")))))
    narrow4 = F.struct(F.lit(0).cast(_WIDE).alias("high"), (F.col("__a4") - F.col("__b4")).cast(_WIDE).alias("low"))

    top = F.lit(Decimal(2**64 - 1)).cast(_WIDE)
    six = ends.where("__a6 <= __b6").withColumns({"__ah": _half(F.col("__a6"), 0), "__al": _half(F.col("__a6"), 1), "__bh": _half(F.col("__b6"), 0), "__bl": _half(F.col("__b6"), 1)})
    none = F.array().cast(_BLOCKS)
    same, ragged_a, ragged_b = F.col("__ah") == F.col("__bh"), F.col("__al") > 0, F.col("__bl") < top
    lo, hi = F.col("__ah") + ragged_a.cast("int"), F.col("__bh") - ragged_b.cast("int")
    six = six.withColumns(
        {
            "__head": F.when(same, cover(F.col("__al"), F.col("__bl"), 64)).when(ragged_a, cover(F.col("__al"), top, 64)).otherwise(none),
            "__tail": F.when(~same & ragged_b, cover(F.lit(0), F.col("__bl"), 64)).otherwise(none),
            "__mid": F.when(~same & (lo <= hi), cover(lo, hi, 64)).otherwise(none),
        }
    )
    low = lambda blocks, high: F.transform(blocks, lambda b: net(6, 128 - b["k"], F.concat(_hex(F.col(high)), _hex(b["at"]))))
    middle = F.transform("__mid", lambda b: net(6, 64 - b["k"], F.concat(_hex(b["at"]), F.lit("0" * 16))))
    six = six.withColumn("__net", F.explode(F.concat(low("__head", "__ah"), middle, low("__tail", "__bh"))))
    borrow = (F.col("__bl") < F.col("__al")).cast("int")
    narrow6 = F.struct((F.col("__ah") - F.col("__bh") + borrow).cast(_WIDE).alias("high"), (F.col("__al") - F.col("__bl") - borrow * F.lit(Decimal(2**64)).cast(_WIDE)).cast(_WIDE).alias("low"))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return four.select(*own, "__net.*", narrow4.alias("narrow")).unionByName(six.select(*own, "__net.*", narrow6.alias("narrow")))


def network_narrowness(version: Column, prefix_len: Column) -> Column:
    """What `narrow` of range_networks() is for a single network."""
    free = F.when(version == 4, 32 - prefix_len).otherwise(128 - prefix_len)
    power = lambda k: F.element_at(F.array(*(F.lit(Decimal(2**n)).cast(_WIDE) for n in range(65))), k + 1)
    high = F.when(free > 64, 1 - power(F.greatest(free - 64, F.lit(0)))).otherwise(F.lit(0).cast(_WIDE))
    low = 1 - power(F.least(free, F.lit(64)))
    return F.struct(high.cast(_WIDE).alias("high"), low.cast(_WIDE).alias("low"))
