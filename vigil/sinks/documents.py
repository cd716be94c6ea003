"""Incidents as documents for other systems: search index, alerts, messages, technique layers, threshold rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.functions import scalars as X

#: Namespace of rule ids.
RULE_NAMESPACE = uuid.UUID("6f1d7a52-3c1e-4b0a-9d55-2a7c8e9b4f10")


def _or(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name.split(".")[0] in df.columns else F.lit(default)


def to_search_docs(incidents: DataFrame, log_file: str = "", indexed_at: Column | None = None) -> DataFrame:
    """Eleven flat fields with defaults."""
    fields = {"incident_type": "unknown", "source_ip": "", "country": "Unknown", "severity": "LOW", "event_count": 0, "known_bad": False}
    technique = {"technique_id": "id", "technique_name": "name", "tactic": "tactic"}
    return incidents.select(
        *(_or(incidents, k, d).alias(k) for k, d in fields.items()), *(_or(incidents, f"mitre.{f}", "").alias(k) for k, f in technique.items()),
        F.lit(log_file).alias("log_file"), (indexed_at if indexed_at is not None else F.current_timestamp()).alias("indexed_at"),
    )


def to_alerts(incidents: DataFrame, workflow_run_id: str | None = None, run_metadata: str | None = None, detection_version: str | None = None, nulls: str = "keep") -> DataFrame:
    """Alert payloads; provenance that isn't given is left out. With nulls `empty` missing values are empty strings, as a message
    with fixed fields needs."""
    kind, ip = F.coalesce("incident_type", F.lit("incident")), F.when(F.length("source_ip") > 0, F.col("source_ip")).otherwise("unknown")
    head = F.coalesce(X.lookup(kind, S.ALERT_TITLE), F.concat(X.title(kind), F.lit(" from ")))
    text = F.concat(_or(incidents, "event_count", 0).cast("string"), F.lit(" events; MITRE "), _or(incidents, "mitre.id", "-"), F.lit(" ("), _or(incidents, "mitre.tactic", "-"), F.lit(")."))
    extra = {"workflow_run_id": workflow_run_id, "run_metadata": run_metadata, "detection_version": detection_version}
    out = incidents.select(F.concat(head, ip).alias("title"), X.lookup(kind, S.ALERT_CATEGORY, "anomaly").alias("category"), _or(incidents, "severity", "LOW").alias("severity"), "source_ip", text.alias("description"), *(F.lit(v).alias(k) for k, v in extra.items() if v or nulls == "empty"))
    return out.select(*(F.coalesce(c, F.lit("")).alias(c) for c in out.columns)) if nulls == "empty" else out


def to_messages(df: DataFrame) -> DataFrame:
    """Rows as JSON messages (value) without keys, times in ISO form; for a Kafka sink or a file."""
    return df.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}).alias("value"))


def publish(messages: DataFrame, servers: str, topic: str = "incidents") -> None:
    """Write messages to Kafka; needs the connector on the session's class path. Spark retries tasks and fails the job on what can't
    be delivered; `deliver` counts both."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def deliver(messages: DataFrame, send: Callable[[DataFrame], None]) -> DataFrame:
    """Send messages (value), and return one row: delivered, errored. What has no value (such as rows that are no JSON) is never
    sent and counts as errored; so does everything if sending fails, as one write has one outcome. For an outcome of each row see
    streaming.delivery.deliver_rows()."""
    from pyspark.errors import PySparkException

    ok = F.col("value").isNotNull()
    counts = messages.agg(F.count_if(ok).alias("delivered"), F.count_if(~ok).alias("errored")).first()
    try:
        send(messages.where(ok))
    except PySparkException:
        counts = (0, sum(counts))
    return messages.sparkSession.createDataFrame([tuple(counts)], "delivered long, errored long")


def layer_techniques(incidents: DataFrame) -> DataFrame:
    """technique_id, score and comment: of each technique the incident with the highest severity; ties go to the earlier type, then
    the larger count, then the smaller address."""
    score = X.lookup(F.col("severity"), S.LAYER_SCORE, 25)
    rank = X.lookup(F.col("incident_type"), {k: i for i, k in enumerate(S.INCIDENT_TYPES)}, len(S.INCIDENT_TYPES))
    comment = F.concat(F.col("incident_type"), F.lit(": "), F.col("event_count").cast("string"), F.lit(" events, "), F.col("severity"))
    order = F.struct(-score, rank, -F.col("event_count"), F.col("source_ip"))
    best = incidents.where("mitre.id <> ''").groupBy(F.col("mitre.id").alias("technique_id")).agg(F.min_by(F.struct(score.alias("score"), comment.alias("comment")), order).alias("b"))
    return best.select("technique_id", "b.score", "b.comment")


def layer(incidents: DataFrame, name: str = "Detection run") -> DataFrame:
    """One row, value: the technique layer as JSON (a technique for each row of a bounded table)."""
    # Versions, colours and flags of the layer format.
    entries = F.array_sort(F.collect_list(F.struct(F.col("technique_id").alias("techniqueID"), "score", F.lit("").alias("color"), "comment", F.lit(True).alias("enabled"))))
    total = incidents.agg(F.count("*").alias("incidents"))
    one = layer_techniques(incidents).agg(entries.alias("techniques")).crossJoin(total)  # one row each
    colours = [("CRITICAL (100)", "#cc0000"), ("HIGH (75)", "#ff6600"), ("MEDIUM (50)", "#ffd700"), ("LOW (25)", "#33cc66")]
    legend = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("color")) for a, b in colours))
    text = F.concat(F.lit("Detected "), F.size("techniques").cast("string"), F.lit(" ATT&CK technique(s) across "), F.col("incidents").cast("string"), F.lit(" incident(s)."))
    versions = F.struct(F.lit("14").alias("attack"), F.lit("4.9").alias("navigator"), F.lit("4.5").alias("layer"))
    gradient = F.struct(F.array(*map(F.lit, ("#ffd700", "#ff6600", "#cc0000"))).alias("colors"), F.lit(0).alias("minValue"), F.lit(100).alias("maxValue"))
    flags = [F.lit(v).alias(k) for k, v in (("showTacticRowBackground", False), ("selectTechniquesAcrossTactics", True), ("selectSubtechniquesWithParent", True))]
    return one.select(F.to_json(F.struct(F.lit(name).alias("name"), versions.alias("versions"), F.lit("enterprise-attack").alias("domain"), text.alias("description"), "techniques", gradient.alias("gradient"), legend.alias("legendItems"), *flags)).alias("value"))


def detection_rules(incidents: DataFrame) -> DataFrame:
    """The rules of incident types that were observed, with ids that follow from the type."""
    rows = []
    for kind, rule in S.DETECTION_RULES.items():
        spec = S.RULE_SPECS[kind]
        times = "".join(map(str, spec["span"])), f"selection | {rule['counts']} by source_ip >= {spec['least']}"
        rows.append((kind, rule["title"], str(uuid.uuid5(RULE_NAMESPACE, kind)), rule["description"], rule["level"], rule["category"], rule["selection"], *times, list(rule["tags"])))
    rules = incidents.sparkSession.createDataFrame(rows, "incident_type string, title string, id string, description string, level string, category string, selection string, timeframe string, condition string, tags array<string>")
    return rules.join(incidents.select("incident_type").distinct(), "incident_type", "left_semi")


def threshold_queries(incidents: DataFrame) -> DataFrame:
    """incident_type, target, file, rule_id, query: each observed type's threshold rule in the language of each target."""
    spark = incidents.sparkSession
    specs = spark.createDataFrame([(k, s["event_type"], s["counts"], s["field"], s["least"], *s["span"]) for k, s in S.RULE_SPECS.items()], "incident_type string, event_type string, counts string, field string, least int, span int, unit string")
    targets = spark.createDataFrame([(k, t["ext"], t["source_ip"], t["port"]) for k, t in S.TARGETS.items()], "target string, ext string, ip string, port string")
    rows = specs.join(incidents.select("incident_type").distinct(), "incident_type", "left_semi").join(F.broadcast(targets))  # three by three constants
    c = {n: F.col(n).cast("string") for n in ("event_type", "counts", "ip", "port", "span", "least")}
    distinct = F.col("field").isNotNull()
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    splunk = text('event_type="', c["event_type"], '"\n\n| bin _time span=', c["span"], F.col("unit"), "\n| stats ", F.when(distinct, text("dc(", c["port"], ")")).otherwise("count"), " as ", c["counts"], " by _time ", c["ip"], "\n\n| search ", c["counts"], " >= ", c["least"])
    esql = text('from * metadata _id, _index, _version | where event_type=="', c["event_type"], '"\n| eval timebucket=date_trunc(', c["span"], "minutes, @timestamp) | stats ", c["counts"], "=", F.when(distinct, text("count_distinct(", c["port"], ")")).otherwise("count()"), " by timebucket, ", c["ip"], "\n| where ", c["counts"], " >= ", c["least"])
    kql = text('event_type =~ "', c["event_type"], '"\n| summarize ', c["counts"], " = ", F.when(distinct, text("dcount(", c["port"], ")")).otherwise("count()"), " by bin(TimeGenerated, ", c["span"], F.col("unit"), "), ", c["ip"], "\n| where ", c["counts"], " >= ", c["least"])
    query = F.when(F.col("target") == "splunk", splunk).when(F.col("target") == "esql", esql).otherwise(kql)
    return rows.select("incident_type", "target", F.concat("incident_type", F.lit("."), "ext").alias("file"), X.uuid5(RULE_NAMESPACE, F.concat("incident_type", F.lit(":corr"))).alias("rule_id"), query.alias("query"))
