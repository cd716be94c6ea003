"""Stored events, incidents and techniques: tables, retention, upserts, and an alert sink."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from vigil.functions.privacy import encrypt


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Tables for events, incidents and techniques; does nothing where they exist."""
    incident = "incident_id STRING, incident_type STRING, source_ip STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, event_count INT, details STRING, detected_at TIMESTAMP, detected_date DATE"
    event = "log_type STRING, event_type STRING, event_time TIMESTAMP, source_ip STRING, username STRING, port INT, raw_line STRING, source_file STRING, ingested_at TIMESTAMP, event_date DATE"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.log_events ({event}) USING parquet PARTITIONED BY (event_date)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.incidents ({incident}) USING parquet PARTITIONED BY (detected_date)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.techniques (technique_id STRING, name STRING, tactic STRING, description STRING, embedding ARRAY<FLOAT>) USING parquet")


def stored_events(events: DataFrame, secret: str | None = None) -> DataFrame:
    """Events as they are stored: sensitive fields encrypted if there is a secret, with ingest time and date."""
    hide = lambda c: encrypt(F.col(c), secret).alias(c)
    return events.select("log_type", "event_type", "event_time", hide("source_ip"), hide("username"), "port", hide("raw_line"), "source_file", F.current_timestamp().alias("ingested_at"), F.to_date("event_time").alias("event_date"))


def stored_incidents(incidents: DataFrame, secret: str | None = None) -> DataFrame:
    """Incidents as they are stored: details as JSON, and an id that a repeated write repeats."""
    key = F.sha2(F.concat_ws("|", "incident_type", F.coalesce("source_ip", F.lit("")), F.col("first_seen").cast("string")), 256)
    return incidents.select(key.alias("incident_id"), "incident_type", encrypt(F.col("source_ip"), secret).alias("source_ip"), "first_seen", "last_seen", "event_count", F.to_json("details").alias("details"), F.current_timestamp().alias("detected_at"), F.current_date().alias("detected_date"))


def store(df: DataFrame, path: str, partition: str) -> None:
    """Append a frame to a partitioned Parquet folder."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def retained(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows not older than so many days; 0 or less keeps all."""
    return rows if days <= 0 else rows.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def purge(spark: SparkSession, path: str, ts: str, partition: str, now: str, days: int) -> int:
    """Delete rows older than so many days from a folder partitioned by date; returns how many. The day of the cutoff is replaced
    first, by one commit, then whole days are dropped; a run that breaks off loses nothing and can be repeated."""
    if days <= 0:
        return 0
    rows = spark.read.parquet(path)
    cutoff = F.expr(f"TIMESTAMP '{now}' - INTERVAL {days} DAYS")
    old = rows.where((F.col(partition) <= F.to_date(cutoff)) & (F.col(ts) < cutoff))
    deleted = old.count()
    if not deleted:
        return 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    edge = rows.where(F.col(partition) == F.to_date(cutoff)).where(F.col(ts) >= cutoff)
    moved = f"{path.rstrip('/')}.__edge"
    edge.write.mode("overwrite").parquet(moved)
    kept = spark.read.schema(edge.schema).parquet(moved)
    days = [r[0] for r in rows.select(partition).where(F.col(partition) < F.to_date(cutoff)).distinct().collect()]  # a row for each day
    if kept.isEmpty():
        days.append(spark.range(1).select(F.to_date(cutoff)).first()[0])
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for day in days:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={day}"), True)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(moved), True)
    return deleted


def retention_job(spark: SparkSession, tables: dict[str, tuple[str, str, int]], now: str) -> dict[str, int]:
    """purge() for each path: (time column, partition column, days to keep); returns how many rows each lost. Meant to be run on a
    schedule; what was purged once is not touched again."""
    return {path: purge(spark, path, ts, partition, now, days) for path, (ts, partition, days) in tables.items()}


def read_incidents(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Stored incidents that were detected from a time on; days before it are not read."""
    rows = spark.read.parquet(path)
    if since is None:
        return rows
    at = F.lit(since).cast("timestamp")
    return rows.where((F.col("detected_date") >= F.to_date(at)) & (F.col("detected_at") >= at))


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 500, **options: str) -> None:
    """Append rows to a database table in batches; needs the driver on the session's class path."""
    df.write.format("jdbc").options(**options).option("url", url).option("dbtable", table).option("batchsize", batch).mode("append").save()


def write_evaluation(metrics: DataFrame, path: str, run_id: str) -> None:
    """The row of an evaluation as JSON, in a folder of its run; a repeated write replaces it."""
    metrics.withColumn("run_id", F.lit(run_id)).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/run={run_id}")


def write_report(datasets: dict[str, DataFrame], path: str, fmt: str = "json") -> list[str]:
    """Each dataset of a report in a folder of its name, to any path the cluster can write (a bucket too). Returns the folders."""
    done = []
    for name, df in sorted(datasets.items()):
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")
        done.append(f"{path.rstrip('/')}/{name}")
    return done


def upsert(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: of stored and new rows the one of the highest version, new ones first."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(version), F.desc("__new"))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__new")


class _Pushed(WriterCommitMessage):
    def __init__(self, ok: int, failed: int):
        self.ok, self.failed = ok, failed


class _AlertWriter(DataSourceWriter):
    def __init__(self, options):
        self.url, self.token = options.get("url", ""), options.get("token")
        if not self.url.startswith(("http://", "https://")):
            raise ValueError("alerts go to http or https addresses only")

    def write(self, iterator):
        ok = failed = 0
        for row in iterator:
            body = {k: v for k, v in row.asDict(recursive=True).items()}
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body, default=str).encode(), headers), timeout=10):
                    ok += 1
            except OSError:
                failed += 1
        return _Pushed(ok, failed)

    def commit(self, messages):
        done = [m for m in messages if m is not None]
        print(f"alerts pushed: {sum(m.ok for m in done)}, failed: {sum(m.failed for m in done)}")


class AlertSink(DataSource):
    """Batch sink `alerts`: posts each row as JSON. Options: url, token."""

    @classmethod
    def name(cls):
        return "alerts"

    def writer(self, schema, overwrite):
        return _AlertWriter(self.options)
