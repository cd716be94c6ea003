"""Aggregates and tables of reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.functions import scalars as X

#: Rows that values_at() sorts at once, on the driver, and parts that it counts in a pass.
SORT_ROWS = 10_000
PARTS = 200


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def top_failed_sources(events: DataFrame, n: int = 10) -> DataFrame:
    """Sources with the most failed logins; ties by address."""
    failed = events.where((F.col("event_type") == "failed_login") & (F.length("source_ip") > 0))
    return failed.groupBy("source_ip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_ip").limit(n)


def hourly_timeline(incidents: DataFrame) -> DataFrame:
    """hour, label, brute_force, port_scan for every hour from the first incident of any type to the last, empty hours too."""
    hour = F.date_trunc("hour", "first_seen")
    bounds = incidents.agg(F.min(hour).alias("a"), F.max(hour).alias("b")).where("a is not null")
    hours = bounds.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    count = lambda kind: F.count_if(F.col("incident_type") == kind).alias(kind)
    series = incidents.groupBy(hour.alias("hour")).agg(count("brute_force"), count("port_scan"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return hours.join(series, "hour", "left").select("hour", X.hour_label(F.col("hour")).alias("label"), zero("brute_force"), zero("port_scan"))


def technique_coverage(incidents: DataFrame) -> DataFrame:
    """technique_id, name, tactic, n of techniques with incidents."""
    return incidents.where("mitre.id <> ''").groupBy(F.col("mitre.id").alias("technique_id")).agg(F.first("mitre.name").alias("name"), F.first("mitre.tactic").alias("tactic"), F.count("*").alias("n"))


def technique_counts(incidents: DataFrame) -> DataFrame:
    """technique_id (unknown if there is none) and n, most frequent first."""
    key = F.coalesce(F.nullif(F.col("mitre.id"), F.lit("")), F.lit("unknown")).alias("technique_id")
    return incidents.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "technique_id")


def kpis(events: DataFrame, incidents: DataFrame, scores: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row: events, incidents, those of each type, attacking sources, techniques, anomalous sources."""
    of = lambda kind: F.count_if(F.col("incident_type") == kind).alias(kind)
    found = incidents.agg(F.count("*").alias("incidents"), *map(of, S.INCIDENT_TYPES), F.count_distinct("source_ip").alias("attackers"), F.count_distinct("mitre.id").alias("techniques"))
    out = events.agg(F.count("*").alias("events")).crossJoin(found)  # one row each
    anomalies = scores.agg(F.count_if(F.col("anomaly_score") >= threshold).alias("anomalies")) if scores is not None else None
    return out.crossJoin(anomalies) if anomalies is not None else out.withColumn("anomalies", F.lit(0).cast("long"))


def first_incident_per_source(incidents: DataFrame) -> DataFrame:
    """The first incident of each source, in the order of types brute_force, port_scan, flood_404."""
    rank = X.lookup(F.col("incident_type"), {k: i for i, k in enumerate(S.INCIDENT_TYPES)}, len(S.INCIDENT_TYPES))
    w = Window.partitionBy("source_ip").orderBy(rank, "first_seen")
    return incidents.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def enrichment_summary(incidents: DataFrame, n: int = 15) -> DataFrame:
    """The sources with the largest first incident."""
    return first_incident_per_source(incidents).orderBy(F.desc("event_count"), "source_ip").limit(n)


def country_counts(incidents: DataFrame) -> DataFrame:
    """One row: known_bad_count, scored, enriched, countries (a map of counts)."""
    by = incidents.groupBy("country").agg(F.count("*").alias("n"), F.count_if("known_bad").alias("bad"), F.count("anomaly_score").alias("scored"))
    return by.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("known_bad_count"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"), F.coalesce(F.sum("n"), F.lit(0)).alias("enriched"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("country", "n")))).alias("countries"))


def source_counts(events: DataFrame, incidents: DataFrame, key: str = "source_file") -> DataFrame:
    """Events and incidents of each source of logs, by type."""
    of = lambda kind: F.count_if(F.col("incident_type") == kind).alias(kind)
    found = incidents.groupBy(key).agg(F.count("*").alias("incidents"), *map(of, S.INCIDENT_TYPES))
    out = events.groupBy(key).agg(F.count("*").alias("events")).join(found, key, "left")
    return out.select(key, "events", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("incidents", *S.INCIDENT_TYPES)))


def incident_rows(incidents: DataFrame) -> DataFrame:
    """Incidents as the report's tables show them, largest first: times as text, duration, a sample of ports, colours and defaults."""
    score = F.coalesce("anomaly_score", F.lit(0.0)) if "anomaly_score" in incidents.columns else F.lit(0.0)
    or_ = lambda f, d: F.coalesce(f"mitre.{f}", F.lit(d)).alias(f"mitre_{f}")
    return incidents.select(
        "incident_type", "source_ip", "event_count", F.coalesce("severity", F.lit("LOW")).alias("severity"), X.timestamp_text(F.col("first_seen")).alias("first_seen"), X.timestamp_text(F.col("last_seen")).alias("last_seen"),
        X.duration(F.col("first_seen"), F.col("last_seen")).alias("duration"), X.port_sample(F.coalesce("details.unique_ports", F.array().cast("array<int>"))).alias("sample_ports"), score.alias("anomaly_score"), X.score_colour(score).alias("bar_color"),
        or_("id", "-"), or_("tactic", "-"), or_("url", "#"),
    ).orderBy(F.desc("event_count"), "incident_type", "source_ip")


def chart_series(incidents: DataFrame, n: int = 15) -> DataFrame:
    """rank, label, value of the n largest incidents of a chart; equal ones by type and address."""
    order = Window.orderBy(F.desc("event_count"), "incident_type", "source_ip")
    top = incidents.select("incident_type", "source_ip", "event_count").orderBy(F.desc("event_count"), "incident_type", "source_ip").limit(n)
    return top.select(F.row_number().over(order).alias("rank"), F.concat("source_ip", F.lit(" ("), "incident_type", F.lit(")")).alias("label"), F.col("event_count").alias("value"))  # n rows at most


def score_series(scores: DataFrame, n: int = 15) -> DataFrame:
    """rank, label, value, colour of the n highest anomaly scores (source_ip, anomaly_score) of a chart; equal ones by address."""
    order = Window.orderBy(F.desc("anomaly_score"), "source_ip")
    top = scores.select("source_ip", "anomaly_score").orderBy(F.desc("anomaly_score"), "source_ip").limit(n)
    return top.select(F.row_number().over(order).alias("rank"), F.col("source_ip").alias("label"), F.col("anomaly_score").alias("value"), X.score_colour(F.col("anomaly_score")).alias("colour"))  # n rows at most


def split_types(incidents: DataFrame) -> dict[str, DataFrame]:
    """The incidents of each known type."""
    return {kind: incidents.where(F.col("incident_type") == kind) for kind in S.INCIDENT_TYPES}


def by_severity(incidents: DataFrame, level: str) -> DataFrame:
    """Incidents of a severity, in any case, as four columns."""
    return incidents.where(F.upper("severity") == level.upper()).select("incident_type", "source_ip", "event_count", "severity")


def top_sources(incidents: DataFrame, limit: object = 5) -> DataFrame:
    """The largest incidents; a limit that is no number counts as 5, one below 1 as 1."""
    try:
        n = max(1, int(limit))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        n = 5
    return incidents.select("source_ip", "incident_type", "event_count", "severity").orderBy(F.desc("event_count"), "source_ip", "incident_type").limit(n)


def route(incidents: DataFrame) -> DataFrame:
    """One row: where a run goes on: no_incidents, critical, or normal."""
    a = incidents.agg(F.count("*").alias("incidents"), F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).alias("critical"))
    return a.withColumn("route", F.when(F.col("incidents") == 0, "no_incidents").when(F.col("critical"), "critical").otherwise("normal"))


def digest(incidents: DataFrame, keys: list[str]) -> DataFrame:
    """keys and digest: a line for each incident of a group. Groups are summaries that people or models read, so a digest is cut
    from the whole group's lines in order of type and address."""
    line = F.concat(F.lit("- "), F.col("incident_type"), F.lit(" from "), F.coalesce("source_ip", F.lit("None")), F.lit(", count="), F.col("event_count").cast("string"), F.lit(", MITRE="), F.coalesce("mitre.id", F.lit("?")))
    entry = F.struct("incident_type", "source_ip", "event_count", line.alias("line"))
    return incidents.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"]), "\n").alias("digest"))


def values_at(values: DataFrame, ranks: set[int], rows: int = SORT_ROWS) -> dict[int, float]:
    """The values at some ranks (from 0, in ascending order) of values (one column v, no nulls). Rows are counted between bounds, which
    quantile sketches give, and at each bound; only the parts that hold a wanted rank are looked at further, and none is sorted
    before it has at most `rows` rows."""
    if not ranks:
        return {}
    n = values.count()
    if n <= rows:
        ordered = sorted(r.v for r in values.collect())
        return {k: ordered[k] for k in ranks}
    shares = F.array(*(F.lit(i / PARTS) for i in range(PARTS + 1)))
    bounds = sorted(set(values.agg(F.percentile_approx("v", shares, 10_000).alias("b")).first().b))
    held = F.array(*map(F.lit, bounds))
    place = F.size(F.filter(held, lambda x: x < F.col("v"))) + F.size(F.filter(held, lambda x: x <= F.col("v")))  # odd: at a bound
    counts = {r.place: r["count"] for r in values.groupBy(place.alias("place")).count().collect()}
    out, before = {}, 0
    for at in sorted(counts):
        inside = {k for k in ranks if before <= k < before + counts[at]}
        if inside and at % 2:
            out |= dict.fromkeys(inside, bounds[at // 2])
        elif inside:
            low = values.where(F.col("v") > bounds[at // 2 - 1]) if at else values
            part = low.where(F.col("v") < bounds[at // 2]) if at // 2 < len(bounds) else low
            out |= {k + before: v for k, v in values_at(part, {k - before for k in inside}, rows).items()}
        before += counts[at]
    return out


def call_metrics(calls: DataFrame, sort_rows: int = SORT_ROWS) -> DataFrame:
    """One row over model calls (ok, retries, tokens_in, tokens_out, latency_ms): totals, cost, median and nearest-rank p95 of the
    latency of calls that succeeded. The two percentiles are exact, by values_at()."""
    good = F.col("ok")
    a = calls.agg(F.count("*").alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.sum("retries").alias("retries"), F.sum(F.when(good, F.col("tokens_in"))).alias("tokens_in"), F.sum(F.when(good, F.col("tokens_out"))).alias("tokens_out"))
    latency = calls.where(good).select(F.col("latency_ms").cast("double").alias("v"))
    count = latency.agg(F.count("*").alias("all"), F.count("v").alias("n")).first()
    n, p50, p95 = count["n"], None, 0.0
    if n:
        middle, high = 0.5 * (n - 1), max(0, round(0.95 * (count["all"] - 1)) - (count["all"] - n))  # calls without a latency rank first
        lo, hi = math.floor(middle), math.ceil(middle)
        v = values_at(latency.where("v is not null"), {lo, hi, high}, sort_rows)
        p50, p95 = v[lo] if lo == hi else (hi - middle) * v[lo] + (middle - lo) * v[hi], v[high]
    out = a.withColumns({"p50": F.lit(p50).cast("double"), "p95": F.lit(p95)})
    return out.withColumn("cost", X.token_cost(F.coalesce("tokens_in", F.lit(0)), F.coalesce("tokens_out", F.lit(0))))


def report(events: DataFrame, incidents: DataFrame, scores: DataFrame | None = None, features: DataFrame | None = None) -> dict[str, DataFrame]:
    """All datasets of a report, by name."""
    out = {
        "kpis": kpis(events, incidents, scores), "event_types": event_type_counts(events), "top_failed_sources": top_failed_sources(events), "timeline": hourly_timeline(incidents),
        "chart": chart_series(incidents), "techniques": technique_coverage(incidents), "incidents": incident_rows(incidents), "top_sources": top_sources(incidents), "enrichment": enrichment_summary(incidents),
    }
    if scores is not None and features is not None:
        from vigil.operators.enrich import label_anomalies

        out["anomalies"] = label_anomalies(scores, features, incidents).orderBy(F.desc("anomaly_score"), "source_ip")
    return out
