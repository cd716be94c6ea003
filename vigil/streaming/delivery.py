"""Batches to several sinks, each row of a batch to each of them once, and rows to other systems with an outcome for each row."""

from __future__ import annotations

import inspect
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batches of a sink whose marks are kept; a query never goes back further than one.
KEPT_MARKS = 100


class Ledger:
    """Which sink has finished which batch: an empty file for each, in any folder that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.folder = folder.rstrip("/")
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def done(self, sink: str, batch: int) -> bool:
        return self.files.exists(self._path(f"{sink}/{batch}"))

    def mark(self, sink: str, batch: int) -> None:
        self.files.create(self._path(f"{sink}/{batch}"), True).close()
        self.files.delete(self._path(f"{sink}/{batch - KEPT_MARKS}"), False)


def batch_table(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its own, so that a batch that is written again replaces what a broken attempt left."""

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch={batch}")

    return sink


def give_to(sinks: dict[str, Callable], ledger: Ledger) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: computes a batch once and gives it to each sink (of the rows, or of the rows and the batch's number)
    that has not finished it yet. A sink that breaks in its midst gets the whole batch again: it should replace what it wrote under
    that number, as batch_table() does."""
    wide = {name: len(inspect.signature(sink).parameters) > 1 for name, sink in sinks.items()}

    def each(batch: DataFrame, number: int) -> None:
        left = [name for name in sinks if not ledger.done(name, number)]
        if not left:
            return
        batch.persist()
        try:
            for name in left:
                sinks[name](batch, number) if wide[name] else sinks[name](batch)
                ledger.mark(name, number)
        finally:
            batch.unpersist()

    return each


def fan_out(incidents: DataFrame, sinks: dict[str, Callable] | list[Callable], checkpoint: str, interval: str | None = None):
    """Start a query that gives each batch to several sinks by give_to(); sinks without names are named by their place, which then must
    not change. Marks are kept beside the query's checkpoint. Without an interval it ends when all that is there has been read."""
    named = sinks if isinstance(sinks, dict) else {str(k): s for k, s in enumerate(sinks)}
    each = give_to(named, Ledger(incidents.sparkSession, f"{checkpoint.rstrip('/')}/ledger"))
    w = incidents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


OUTCOME = "delivery_key string, body string, delivered boolean, error string"


def keyed_bodies(rows: DataFrame) -> DataFrame:
    """delivery_key and body: each row as JSON and the digest of that, which is the same whenever the row is sent again. A receiver that
    drops keys it has seen thus gets each distinct row once, also where a task is repeated."""
    body = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"})
    return rows.select(body.alias("body")).select(F.sha2("body", 256).alias("delivery_key"), "body")


def deliver_rows(rows: DataFrame, send: Callable[[str, str], None], outcomes: str, batch: int | str = 0) -> DataFrame:
    """Send each row by send(delivery_key, body), which raises what it can't deliver, from the tasks that hold them; keep the outcome of
    each in outcomes/batch=..., and return these: delivery_key, body, delivered, error. One row that fails stops no other one.

    rows may be of any columns, or delivery_key and body of an earlier attempt."""
    ready = rows.select("delivery_key", "body") if {"delivery_key", "body"} <= set(rows.columns) else keyed_bodies(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors: list[str | None] = []
            for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    send(key, body)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever the receiver's client raises is this row's outcome
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string())], names=["delivery_key", "body", "delivered", "error"])

    path = f"{outcomes.rstrip('/')}/batch={batch}"
    ready.mapInArrow(run, OUTCOME).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(T.StructType.fromDDL(OUTCOME)).parquet(path)


def delivery_sink(send: Callable[[str, str], None], outcomes: str) -> Callable[[DataFrame, int], None]:
    """deliver_rows() as a sink of fan_out()."""
    return lambda rows, batch: deliver_rows(rows, send, outcomes, batch) and None


def undelivered(spark: SparkSession, outcomes: str) -> DataFrame:
    """delivery_key, body and error of the rows that no attempt has delivered."""
    rows = spark.read.schema(T.StructType.fromDDL(OUTCOME + ", batch string")).parquet(outcomes)
    return rows.groupBy("delivery_key").agg(F.first("body").alias("body"), F.bool_or("delivered").alias("delivered"), F.max("error").alias("error")).where("not delivered").drop("delivered")


def http_sender(url: str, token: str | None = None, timeout: float = 10.0) -> Callable[[str, str], None]:
    """A send() that posts bodies as JSON, with their key in the Idempotency-Key header."""
    if not url.startswith(("http://", "https://")):
        raise ValueError("rows go to http or https addresses only")

    def send(key: str, body: str) -> None:
        headers = {"Content-Type": "application/json", "Idempotency-Key": key} | ({"Authorization": f"Bearer {token}"} if token else {})
        with urllib.request.urlopen(urllib.request.Request(url, body.encode(), headers), timeout=timeout):
            pass

    return send
