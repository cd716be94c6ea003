"""The three detection rules, with severity and technique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.config import RuleConfig
from vigil.functions import scalars as X
from vigil.operators.sliding import first_windows

_TYPES = {"brute_force": "failed_login", "port_scan": "connection", "flood_404": "http_404"}


def _rules(events: DataFrame, cfg: RuleConfig, extra_keys: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """Incidents of some rules, in one sweep over the events."""
    windows = {k: getattr(cfg, f"{k}_window") for k in kinds}
    least = {k: getattr(cfg, f"{k}_count") for k in kinds}
    kind = X.lookup(F.col("event_type"), {_TYPES[k]: k for k in kinds})
    fits = (F.col("event_type") != _TYPES["port_scan"]) | (F.col("port") != 0) if "port_scan" in kinds else F.lit(True)
    tagged = events.where(F.col("event_type").isin([_TYPES[k] for k in kinds]) & (F.length("source_ip") > 0) & fits).withColumn("incident_type", kind)
    rule = F.col("incident_type")
    of = lambda table: X.lookup(rule, table)
    found = first_windows(tagged, ["incident_type", "source_ip", *extra_keys], of({k: w * 60 for k, w in windows.items()}), of(least), rule == "port_scan", "port")
    details = F.struct(of(windows).alias("window_minutes"), of(least).alias("threshold"), F.col("values").alias("unique_ports"))
    return found.select("incident_type", "source_ip", *extra_keys, "first_seen", "last_seen", "event_count", details.alias("details"))


def brute_force(events: DataFrame, cfg: RuleConfig = RuleConfig(), extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """First window with too many failed logins, for each source. extra_keys (such as a file) divide sources further."""
    return _rules(events, cfg, extra_keys, ("brute_force",))


def port_scan(events: DataFrame, cfg: RuleConfig = RuleConfig(), extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """First window with connections to too many distinct ports (not 0), for each source; event_count is the number of ports."""
    return _rules(events, cfg, extra_keys, ("port_scan",))


def flood_404(events: DataFrame, cfg: RuleConfig = RuleConfig(), extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """First window with too many missing pages, for each source."""
    return _rules(events, cfg, extra_keys, ("flood_404",))


def rate(incidents: DataFrame) -> DataFrame:
    """Incidents with severity and mitre."""
    return incidents.withColumn("severity", X.severity(F.col("incident_type"), F.col("event_count"))).withColumn("mitre", X.mitre(F.col("incident_type")))


def detect(events: DataFrame, cfg: RuleConfig = RuleConfig(), extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Incidents of all three rules."""
    return rate(_rules(events, cfg, extra_keys, tuple(_TYPES)))
