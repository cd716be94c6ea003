"""Helpers that the operators of this subpackage share.

Conventions of all operators: a null text counts as an empty one, extra input columns are ignored
(or kept, where an operator rewrites rows), repeated rows each get a result, and an empty table
gives an empty result with the same columns.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a vectorised step works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000
SLICE_ROWS = 2_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_OWN_DIRS: dict[str, str] = {}
_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


def bound_batches(spark: SparkSession) -> None:
    """Batches of texts that go to Python hold 16 MB at most, where the session has Spark's own limit of 64 MB: both sides hold some
    at once, twice as large while they grow. Another setting is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", "67108864b"):
        spark.conf.set(key, "16m")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Only in local mode, as in tests, may that be unset: then
    a temporary folder is made, one for each application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN_DIRS:
            _OWN_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        found = _OWN_DIRS[context.applicationId]
    return found.rstrip("/")


def cut(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and lost executors lose nothing. sweep: first let
    Spark delete the shuffle files of steps that are over, which it does when the driver's garbage is collected."""
    spark = df.sparkSession
    if sweep:
        gc.collect()
        spark._jvm.System.gc()
    bound_batches(spark)
    path = f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cuts_made() -> Iterator[list[str]]:
    """The paths that cut() writes to inside this context, and in this thread, in their order; an outer context gets them too."""
    made: list[str] = []
    before = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(before)
        if (outer := _MADE.get()) is not None:
            outer.extend(made)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that cut() wrote in this application, for callers whose results are all stored; returns how many. Results
    are lazy and read those tables, so no operator can delete them itself."""
    top = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, f"cut-{spark.sparkContext.applicationId}-*")) or []
    return sum(files.delete(f.getPath(), True) for f in found)


def with_fields(fields: list[T.StructField], more: str) -> T.StructType:
    """A schema of fields, whatever names there are inside them, and of more columns in text form."""
    return T.StructType([*fields, *T.StructType.fromDDL(more).fields])


def held(docs: DataFrame, **names: str) -> DataFrame:
    """docs with columns of fixed names, for operators whose own columns must not clash with any of docs: names maps a fixed name to a
    column of docs, and all other columns go into one struct, `held`."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names.values()]
    return docs.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items()), F.struct(*(rest or [F.lit(0)])).alias("held"))


def released(rows: DataFrame, columns: list[str], **names: str) -> DataFrame:
    """The columns that held() took, by their own names and in their order."""
    own = {c: n for n, c in names.items()}
    return rows.select(*((F.col(own[c]) if c in own else F.col("held").getField(c)).alias(c) for c in columns))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of rows of about limit bytes (SLICE_ROWS rows at most): first row, end row, UTF-8
    bytes, offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(end, first + 1), first + SLICE_ROWS)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ([^ \\t-\\r]+, never across rows) and, per row, the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    full = offsets[:-1] < offsets[1:]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = offsets[:-1][full]
    begin[heads] = solid[heads]
    close = solid.copy()
    close[:-1] &= ~solid[1:]
    tails = offsets[1:][full] - 1
    close[tails] = solid[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(kind: str, n: int) -> np.ndarray:
    """Powers modulo 2**64 of the hash base ("up") or of its inverse ("down")."""
    got = _POWERS.get(kind)
    if got is None or len(got) < n:
        base = _R if kind == "up" else pow(_R, -1, 2**64)
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        got = _POWERS[kind] = np.cumprod(out, dtype=np.uint64)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good diffusion."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand. Long data is hashed block by block."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > 2 * SLICE_BYTES:
        order = np.argsort(starts, kind="stable")
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(order):
            first = starts[order[i]]
            j = max(i + 1, int(np.searchsorted(starts, first + SLICE_BYTES, "left", sorter=order)))
            own = order[i:j]
            out[own] = _span_hashes(data[first : ends[own].max()], starts[own] - first, ends[own] - first)
            i = j
        return out
    return _span_hashes(data, starts, ends)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers("up", len(data))[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers("down", len(data) + 1)[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, one for each start that has k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)


def sample_ids(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most n distinct ids, those with the smallest hashes; a threshold on the hash keeps what is sorted near n rows."""
    ids = df.where(F.col(id_col).isNotNull()).select(id_col)
    share = 2 * n / max(1, ids.count())
    order = F.xxhash64(id_col)
    if share < 0.5:
        ids = ids.where(F.shiftrightunsigned(order, 33) < int(share * 2**31))
    return ids.distinct().orderBy(order, id_col).limit(n)
