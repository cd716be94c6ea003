"""Feeds and labels: threat intelligence, country tables, ground truth, technique bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.ip import network_text, networks, parsed_networks
from vigil.functions.ipranges import network_narrowness, range_networks


def load_threat_intel(spark: SparkSession, path: str | None) -> DataFrame:
    """version, prefix_len, net_key and net of a feed with an address or CIDR range in each line; comments, blanks and bad lines are left
    out, and so is a missing file. Lines are parsed where they are read."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path or []) if path else None
    except AnalysisException:
        lines = None
    if lines is None:
        return networks(spark, [])
    nets = lines.select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("net")).where("net <> ''")
    known = parsed_networks(nets, "net").select("version", "prefix_len", "net_key").distinct()
    return known.withColumn("net", network_text(F.col("version"), F.col("prefix_len"), F.col("net_key")))


def country_table(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    """version, prefix_len, net_key, country from CIDR ranges and their countries."""
    nets = networks(spark, list(entries))
    names = spark.createDataFrame(list(entries.items()), "net string, country string")
    return nets.join(names, "net").select("version", "prefix_len", "net_key", "country")


def load_countries(spark: SparkSession, path: str) -> DataFrame:
    """version, prefix_len, net_key, country and narrow of CSV files with the column country, and either network (a CIDR range) or start and
    end (the first and last address), of version 4 or 6. Lines that are neither are left out; count_bad_countries() counts them. Where
    ranges overlap, the narrowest counts: longest_match(..., prefer="narrow")."""
    nets, ranges = _country_rows(spark, path)
    one = nets.withColumn("narrow", network_narrowness(F.col("version"), F.col("prefix_len")))
    return one.select(*_COUNTRY).unionByName(ranges.select(*_COUNTRY)).distinct()


_COUNTRY = ("version", "prefix_len", "net_key", "country", "narrow")


def _country_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    col = lambda name: F.trim(F.col(name)) if name in rows.columns else F.lit(None).cast("string")
    return rows.select(*(col(c).alias(c) for c in ("network", "start", "end", "country")), F.monotonically_increasing_id().alias("line"))


def _country_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = _country_lines(spark, path).where("country <> ''")
    return parsed_networks(rows.where("network <> ''"), "network"), range_networks(rows.where("coalesce(network, '') = ''"), "start", "end")


def count_bad_countries(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many lines of load_countries() are left out."""
    good = _country_rows(spark, path)
    known = good[0].select("line").unionByName(good[1].select("line")).distinct()
    return _country_lines(spark, path).join(known, "line", "left_anti").agg(F.count("*").alias("bad_lines"))


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, source_ip, label (malicious or benign) of a CSV file; rows with a missing or unreadable part are left out."""
    rows = spark.read.option("header", True).csv(path)
    label = F.lower(F.trim("label"))
    out = rows.select(F.try_to_timestamp(F.trim("timestamp")).alias("timestamp"), F.trim("source_ip").alias("source_ip"), label.alias("label"))
    return out.where("timestamp is not null and source_ip <> '' and label in ('malicious', 'benign')")


_LABELS = "benign_default boolean, allowlist array<string>, labels map<string,struct<class:string,malicious:boolean,note:string>>"


def load_labels(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], bool]:
    """Labels by address (source_ip, malicious, class), the allowlist, and whether unlabelled addresses count as benign."""
    doc = spark.read.option("multiLine", True).schema(_LABELS).json(path)
    head = doc.select("allowlist", "benign_default").first()
    labels = doc.select(F.explode("labels").alias("source_ip", "l")).select("source_ip", F.coalesce("l.malicious", F.lit(False)).alias("malicious"), F.col("l.class").alias("class"))
    return labels, list(head.allowlist or []), bool(head.benign_default)


def load_techniques(spark: SparkSession, path: str) -> DataFrame:
    """technique_id, name, tactic, description of the attack patterns of a STIX bundle with a technique id."""
    schema = "objects array<struct<type:string,name:string,description:string,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"
    o = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("objects").alias("o")).where("o.type = 'attack-pattern'")
    ids = F.filter("o.external_references", lambda r: (r["source_name"] == "mitre-attack") & F.startswith(r["external_id"], F.lit("T")))
    phases = F.filter("o.kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack")
    tactic = F.initcap(F.replace(F.get(phases, 0)["phase_name"], F.lit("-"), F.lit(" ")))
    out = o.select(F.get(ids, 0)["external_id"].alias("technique_id"), F.col("o.name").alias("name"), F.coalesce(tactic, F.lit("Unknown")).alias("tactic"), F.coalesce("o.description", F.lit("")).alias("description"))
    return out.where("technique_id is not null")
