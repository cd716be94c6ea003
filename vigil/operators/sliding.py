"""Sliding windows per key: the first one that reaches a count, and the busiest one.

A window reaches from an event over a fixed span, both ends included. Time is dealt into buckets of the span's length: a window that
starts in a bucket ends in it or in the next, so an event is sent to its own bucket and, as a follower, to the one before, and (key,
bucket) is the partition. One key's events thus spread over as many tasks as it has buckets.

Events of one time are counted together before the shuffle. Within a partition nothing is counted anew for each window: each event opens
and closes a stretch of starts whose windows hold it, and a running sum of what is open is each window's count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import micros


def _dealt(rows: DataFrame, keys: list[str], span: Column) -> DataFrame:
    """rows (keys, __t, __n, ...) in each bucket __b that a window with them may start in; __own: the bucket is the row's. __c: events of
    the bucket and those that follow, in all."""
    own = F.floor(F.col("__t") / span)
    both = F.array(F.struct(own.alias("__b"), F.lit(True).alias("__own")), F.struct((own - 1).alias("__b"), F.lit(False).alias("__own")))
    dealt = rows.withColumn("__in", F.explode(both)).select("*", "__in.*").drop("__in").repartition(*keys, "__b")
    return dealt.withColumn("__c", F.sum("__n").over(Window.partitionBy(*keys, "__b")))


def _point(at: Column, kind: int, n: Column | int) -> Column:
    return F.struct(at.alias("__at"), F.lit(kind).alias("__kind"), (n if isinstance(n, Column) else F.lit(n)).cast("long").alias("__m"))


def _swept(dealt: DataFrame, keys: list[str], span: Column, opens: Column, sparse: bool = False) -> DataFrame:
    """Points of the rows, with __sum. An event (or a value's time) is in the windows whose start lies from `opens` to its own time, so it
    opens (kind 0) and closes (kind 2) one stretch of starts, and at its own time (kind 1, own rows alone) the running sum of what is open
    is the count of the window that starts there. sparse: a bucket's only event needs no such points; its window counts itself."""
    alone = F.lit(sparse) & (F.col("__c") == F.col("__n"))
    none = F.array().cast("array<struct<__at:bigint,__kind:int,__m:bigint>>")
    stretch = F.when(alone, none).otherwise(F.array(_point(opens, 0, F.col("__n")), _point(F.col("__t"), 2, -F.col("__n"))))
    start = F.when(F.col("__own"), F.array(_point(F.col("__t"), 1, F.when(alone, F.col("__n")).otherwise(0)))).otherwise(none)
    along = Window.partitionBy(*keys, "__b").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("__p", F.explode(F.concat(stretch, start))).select("*", "__p.*").withColumn("__sum", F.sum("__m").over(along))


def first_windows(events: DataFrame, keys: list[str], span_s: Column, least: Column, distinct: Column, value: str, ts: str = "event_time") -> DataFrame:
    """keys, first_seen, last_seen, event_count and values of each key's first window over span_s seconds with `least` events or more,
    or where `distinct`, with as many distinct values, which come sorted as `values` (else null); event_count is the whole window's.

    span_s, least and distinct are expressions over the keys, so several rules are one sweep. Rows with a null time are left out, and so are
    null values where distinct; of tied events all count. Three exchanges: equal times (and values) are counted together before the
    first; (key, bucket) is the second, behind which buckets that can't reach their rule go, before anything is sorted by time; the
    third brings a row for each bucket with a hit together.
    """
    seen = events.where(F.col(ts).isNotNull() & (~distinct | F.col(value).isNotNull()))
    once = seen.groupBy(*keys, ts, F.when(distinct, F.col(value)).alias("__v")).agg(F.count("*").alias("__n"))
    span = span_s.cast("long") * 1_000_000
    once = once.withColumn("__t", micros(F.col(ts))).withColumn("__n", F.when(distinct, F.lit(1).cast("long")).otherwise(F.col("__n")))
    dealt = _dealt(once, keys, span).where(F.col("__c") >= least)
    last = F.lag("__t").over(Window.partitionBy(*keys, "__b", "__v").orderBy("__t"))
    begin = F.col("__t") - span
    opens = F.when(distinct, F.greatest(F.coalesce(last + 1, begin), begin)).otherwise(begin)
    swept = _swept(dealt.withColumn("__open", opens), keys, span, F.col("__open"))
    hit = F.min(F.when((F.col("__kind") == 1) & (F.col("__sum") >= least), F.col("__t"))).over(Window.partitionBy(*keys, "__b"))
    inside = swept.withColumn("__from", hit).where((F.col("__kind") == 2) & (F.col("__t") >= F.col("__from")) & (F.col("__t") <= F.col("__from") + span))
    values = F.array_sort(F.collect_set("__v"))
    found = inside.groupBy(*keys, "__b").agg(F.min("__from").alias("__from"), F.struct(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.sum("__n").alias("n"), values.alias("values")).alias("w"))
    best = found.groupBy(*keys).agg(F.min_by("w", "__from").alias("w"))
    count = F.when(distinct, F.size("w.values")).otherwise(F.col("w.n")).cast("int")
    return best.select(*keys, "w.first_seen", "w.last_seen", count.alias("event_count"), F.when(distinct, F.col("w.values")).alias("values"))


def first_count_window(events: DataFrame, keys: list[str], span_s: int, least: int, ts: str = "event_time") -> DataFrame:
    """first_windows() with one rule for all keys: keys, first_seen, last_seen, event_count."""
    return first_windows(events, keys, F.lit(span_s), F.lit(least), F.lit(False), ts, ts).drop("values")


def first_distinct_window(events: DataFrame, keys: list[str], value: str, span_s: int, least: int, ts: str = "event_time") -> DataFrame:
    """first_windows() of distinct values with one rule for all keys."""
    return first_windows(events, keys, F.lit(span_s), F.lit(least), F.lit(True), value, ts)


def busiest_window(events: DataFrame, keys: list[str], span_s: int, ts: str = "event_time") -> DataFrame:
    """keys and busiest: the most events in any window of the span."""
    span = F.lit(span_s * 1_000_000)
    once = events.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count("*").alias("__n")).withColumn("__t", micros(F.col(ts)))
    swept = _swept(_dealt(once, keys, span), keys, span, F.col("__t") - span, sparse=True)
    return swept.where("__kind = 1").groupBy(*keys).agg(F.max("__sum").alias("busiest"))


def tumbling_rule(events: DataFrame, keys: list[str], span_s: int, least: int, distinct: str | None = None, ts: str = "event_time") -> DataFrame:
    """Threshold rule over fixed windows from the epoch on: window_start, keys, and event_count, or value_count of distinct values,
    where it reaches `least`. Works on streams (without distinct) with a watermark."""
    bucket = F.window(ts, f"{span_s} seconds")
    value = F.count_distinct(distinct).alias("value_count") if distinct else F.count("*").alias("event_count")
    out = events.groupBy(bucket.alias("w"), *keys).agg(value)
    name = "value_count" if distinct else "event_count"
    return out.where(F.col(name) >= least).select(F.col("w.start").alias("window_start"), *keys, name)
