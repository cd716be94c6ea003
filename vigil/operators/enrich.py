"""Joins of incidents with dimensions: threat intelligence, countries, scores, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.privacy import decrypt
from vigil.operators.cidr import STRICT, Readers, flag_networks, longest_match


def enrich(incidents: DataFrame, intel: DataFrame | None = None, countries: DataFrame | None = None, scores: DataFrame | None = None, score_default: float | None = None, readers: Readers = STRICT) -> DataFrame:
    """Incidents with known_bad, country (Unknown by default) and anomaly_score (null by default, reports use 0.0). readers: how the
    search for countries reads addresses."""
    out = flag_networks(incidents, intel, "known_bad") if intel is not None else incidents.withColumn("known_bad", F.lit(False))
    out = longest_match(out, countries, "country", "Unknown", readers=readers) if countries is not None else out.withColumn("country", F.lit("Unknown"))
    if scores is not None:
        out = out.drop("anomaly_score").join(scores.select("source_ip", "anomaly_score"), "source_ip", "left")
    else:
        out = out.withColumn("anomaly_score", F.lit(None).cast("double"))
    return out.withColumn("anomaly_score", F.coalesce("anomaly_score", F.lit(score_default).cast("double")))


def label_anomalies(scores: DataFrame, features: DataFrame, incidents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Anomalous sources with their features, and whether a rule found them too."""
    ruled = incidents.select("source_ip").distinct().withColumn("__rule", F.lit(True))
    rows = scores.where(F.col("anomaly_score") >= threshold).join(features, "source_ip", "left").join(ruled, "source_ip", "left")
    return rows.withColumn("detection", F.when(F.col("__rule"), "Rule + ML").otherwise("ML Only")).drop("__rule")


def suppress_repeats(incidents: DataFrame, stored: DataFrame, now: Column, minutes: int, secret: str | None = None) -> DataFrame:
    """Incidents whose type and source were not stored within the last minutes; 0 or less suppresses nothing. stored: incident_type,
    source_ip (maybe encrypted), detected_at."""
    if minutes <= 0:
        return incidents
    recent = stored.where(F.col("detected_at") >= now - F.expr(f"INTERVAL {minutes} MINUTES")).select("incident_type", decrypt(F.col("source_ip"), secret).alias("source_ip")).distinct()
    return incidents.join(recent, ["incident_type", "source_ip"], "left_anti").select(*incidents.columns)
