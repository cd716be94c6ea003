"""Whole jobs: from log files to incidents, reports and documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.config import Allowlist, RuleConfig
from vigil.functions.ip import networks
from vigil.functions.privacy import protect
from vigil.operators import anomaly, report
from vigil.operators.cidr import filter_allowlist
from vigil.operators.contract import assert_contract
from vigil.operators.detect import detect
from vigil.operators.enrich import enrich, suppress_repeats
from vigil.operators.features import behaviour
from vigil.sources.logs import load_logs


@dataclass
class Analysis:
    events: DataFrame
    incidents: DataFrame
    features: DataFrame | None
    scores: DataFrame | None

    def report(self) -> dict[str, DataFrame]:
        return report.report(self.events, self.incidents, self.scores, self.features)


def analyse(
    spark: SparkSession, paths: str | list[str], fmt: str = "auto", cfg: RuleConfig = RuleConfig(), allowlist: Allowlist = Allowlist(), stored: DataFrame | None = None, suppress_minutes: int = 0,
    intel: DataFrame | None = None, countries: DataFrame | None = None, privacy: dict | None = None, detector: str | None = "isolation_forest", year: int | None = None,
) -> Analysis:
    """Parse, filter, detect, leave out repeats, enrich, protect, then score, in this order: detection sees real addresses, scores and
    everything behind them the protected ones. Lazy but for small dimensions; events are read once if the caller persists them."""
    assert_contract(spark)
    events = load_logs(spark, paths, fmt, year)
    if allowlist != Allowlist():
        marked, keep = filter_allowlist(events, networks(spark, list(allowlist.networks)), allowlist.usernames, allowlist.hostnames)
        events = marked.where(keep).drop("suppressed")
    incidents = detect(events, cfg)
    if stored is not None:
        incidents = suppress_repeats(incidents, stored, F.current_timestamp(), suppress_minutes)
    incidents = enrich(incidents, intel, countries)
    if privacy:
        key = privacy.get("key")
        events, incidents = protect(events, **privacy), protect(incidents, pseudonymise=privacy.get("pseudonymise", False), key=key)
    features = behaviour(events) if detector else None
    scores = anomaly.DETECTORS[detector](features) if detector else None
    if scores is not None:
        incidents = incidents.drop("anomaly_score").join(scores, "source_ip", "left")
    return Analysis(events, incidents, features, scores)


def summarise_sources(spark: SparkSession, paths: list[str], cfg: RuleConfig = RuleConfig(), year: int | None = None) -> DataFrame:
    """Events and incidents of each file, mixed formats."""
    events = load_logs(spark, paths, "auto", year)
    return report.source_counts(events, detect(events, cfg, ("source_file",)))
