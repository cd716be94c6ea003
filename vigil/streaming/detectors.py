"""Streaming detection: first windows per source as state, fixed windows, repeats, and fan-out to sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vigil.config import RuleConfig
from vigil.functions.scalars import micros
from vigil.operators.detect import rate
from vigil.operators.sliding import tumbling_rule


class FirstWindow(StatefulProcessor):
    """Emits, for each source once, the earliest window with enough events (or distinct values), with its whole count. Rows are buckets
    (see _stream_rule) that are over: `low`, where the windows of the bucket start, and t, sorted, and v of the events they may hold.

    State is the end of the reported window, of sources that were reported. With `forget_us` they are forgotten so long after it, and a
    window that starts later is reported again: then state is bounded by the sources of that time. Without, the mark of each reported
    source stays. Stored incidents can be the initial state: their sources count as reported, by their windows.

    Each call on a state is an exchange with Spark; there are a few for a source and batch, none for an event."""

    def __init__(self, span_us: int, step_us: int, least: int, distinct: bool, forget_us: int | None = None):
        self.span, self.step, self.least, self.distinct, self.forget = span_us, step_us, least, distinct, forget_us

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "t long")

    def _forgotten(self, end: int) -> int:
        """When the last bucket with a start that is still known is over."""
        return end + self.forget + self.span + self.step

    def _reported(self, end: int) -> None:
        self.done.update((end,))
        if self.forget is not None:
            self.handle.registerTimer(self._forgotten(end) // 1000 + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._reported(int(initialState.t) + self.span)

    def _first(self, row: Row, low: int) -> Row | None:
        """The first window of a bucket that starts at `low` or later."""
        t, inside, last = row.t, {}, 0
        for first, start in enumerate(t):
            if start >= row.low + self.step:
                return None
            while last < len(t) and t[last] <= start + self.span:
                if self.distinct:
                    inside[row.v[last]] = inside.get(row.v[last], 0) + 1
                last += 1
            count = len(inside) if self.distinct else last - first
            if start >= low and count >= self.least:
                return Row(source_ip=row.source_ip, first=start, last=t[last - 1], event_count=count, ports=sorted(inside))
            if self.distinct:
                inside[row.v[first]] -= 1
                if not inside[row.v[first]]:
                    del inside[row.v[first]]
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        done = self.done.get()
        best = None
        if self.forget is None and done is None:
            for row in rows:
                if best is None or row.low < best.first:
                    best = self._first(row, row.low) or best
            if best is not None:
                yield best
        elif self.forget is not None:
            end = None if done is None else done[0]
            for row in sorted(rows, key=lambda row: row.low):
                found = self._first(row, row.low if end is None else max(row.low, end + self.forget + 1))
                if found is not None:
                    best, end = found, found.first + self.span
                    yield best
        if best is not None:
            self._reported(best.first + self.span)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        done = self.done.get()
        if done is not None and self._forgotten(done[0]) < timerValues.getCurrentWatermarkInMs() * 1000:
            self.done.clear()
        return iter([])

    def close(self) -> None:
        pass


def _stream_rule(events: DataFrame, kind: str, window_min: int, least: int, distinct: bool, delay: str, forget_minutes: int | None, stored: DataFrame | None, parts: int) -> DataFrame:
    """Starts of windows are dealt into buckets, `parts` to a window's length, and Spark's own aggregation gathers what a bucket's windows
    may hold until the watermark has passed it; buckets with too few events go, the others meet what is known of their source."""
    span, step = window_min * 60_000_000, window_min * 60_000_000 // parts
    seen = events.where(F.col("event_time").isNotNull()).withWatermark("event_time", delay)
    bucket = F.window("event_time", f"{span + step} microseconds", f"{step} microseconds").alias("bucket")
    t = micros(F.col("event_time"))
    gathered = F.collect_set(F.struct(t.alias("t"), F.col("port").cast("long").alias("v"))) if distinct else F.collect_list(F.struct(t.alias("t")))
    full = seen.groupBy("source_ip", bucket).agg(F.array_sort(gathered).alias("e"))
    values = F.col("e.v") if distinct else F.lit(None).cast("array<long>")
    rows = full.where(F.size(F.array_distinct("e.v") if distinct else "e") >= least).select("source_ip", "bucket", micros(F.col("bucket.start")).alias("low"), F.col("e.t").alias("t"), values.alias("v"))
    known = None
    if stored is not None:
        known = stored.where((F.col("incident_type") == kind) & F.col("first_seen").isNotNull()).groupBy("source_ip").agg(F.max(micros(F.col("first_seen"))).alias("t")).groupBy("source_ip")
    out = rows.groupBy("source_ip").transformWithState(
        FirstWindow(span, step, least, distinct, None if forget_minutes is None else forget_minutes * 60_000_000),
        outputStructType="source_ip string, first long, last long, event_count int, ports array<int>", outputMode="Append", timeMode="EventTime", initialState=known,
    )
    ports = F.col("ports") if distinct else F.lit(None).cast("array<int>")
    details = F.struct(F.lit(window_min).alias("window_minutes"), F.lit(least).alias("threshold"), ports.alias("unique_ports"))
    return rate(out.select(F.lit(kind).alias("incident_type"), "source_ip", F.timestamp_micros("first").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"), "event_count", details.alias("details")))


def stream_brute_force(events: DataFrame, cfg: RuleConfig = RuleConfig(), delay: str = "10 minutes", forget_minutes: int | None = None, stored: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """Streaming brute_force(). Needs the RocksDB state store provider. forget_minutes: how long after its window a reported source is
    remembered (always, if not given). stored: incidents (incident_type, source_ip, first_seen) that a new query starts from. A window
    is judged when the watermark has passed its end and, at most, one part of its length more; an event is held `parts` + 1 times."""
    rows = events.where((F.col("event_type") == "failed_login") & (F.length("source_ip") > 0))
    return _stream_rule(rows, "brute_force", cfg.brute_force_window, cfg.brute_force_count, False, delay, forget_minutes, stored, parts)


def stream_port_scan(events: DataFrame, cfg: RuleConfig = RuleConfig(), delay: str = "10 minutes", forget_minutes: int | None = None, stored: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """Streaming port_scan(); arguments as in stream_brute_force()."""
    rows = events.where((F.col("event_type") == "connection") & (F.length("source_ip") > 0) & (F.col("port") != 0))
    return _stream_rule(rows, "port_scan", cfg.port_scan_window, cfg.port_scan_count, True, delay, forget_minutes, stored, parts)


def stream_flood_404(events: DataFrame, cfg: RuleConfig = RuleConfig(), delay: str = "10 minutes", forget_minutes: int | None = None, stored: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """Streaming flood_404(); arguments as in stream_brute_force()."""
    rows = events.where((F.col("event_type") == "http_404") & (F.length("source_ip") > 0))
    return _stream_rule(rows, "flood_404", cfg.flood_404_window, cfg.flood_404_count, False, delay, forget_minutes, stored, parts)


def stream_tumbling(events: DataFrame, span_s: int, least: int, delay: str = "10 minutes") -> DataFrame:
    """Streaming tumbling_rule() of event counts by source, in append mode."""
    return tumbling_rule(events.withWatermark("event_time", delay), ["source_ip"], span_s, least)


def stream_without_repeats(incidents: DataFrame, minutes: int, ts: str = "first_seen") -> DataFrame:
    """Incidents whose type and source did not occur within the last minutes, in a batch or before it."""
    return incidents.withWatermark(ts, f"{minutes} minutes").dropDuplicatesWithinWatermark(["incident_type", "source_ip"])
