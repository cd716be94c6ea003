"""CSV records whose quoted fields may hold line breaks, found in all splits of a file at once.

Whether a line begins inside quotes depends on all lines before it in its file. What one line does to that is one of four functions of
(outside, inside): it keeps both, it swaps them, or it leads to one of them from either. Such functions compose, so a first pass over the
lines gives one row for each split of a file, and running counts of swaps and the last fixed state over these give every split the state
that it begins in. A second pass gives each line its state where it is read; lines that begin outside quotes begin records. Only
pieces of records that reach over the end of a split are shuffled, two for each split at most; the lines themselves never are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a record of several lines beyond which it is left out: its opening quote is a mistake.
MAX_RECORD_CHARS = 1_000_000
#: Complete fields: quoted ones with what stands behind their closing quote, and others, in which quotes are plain signs.
_COMPLETE = r'"[^"]*+"[^,]*+|[^",][^,]*+'


def leaves_open(line: Column, inside: bool) -> Column:
    """Whether a line that begins outside (or inside) quotes ends inside. Doubled quotes stand for one sign wherever they may count, so
    they go first; then complete fields go, and what still has a quote is an open field."""
    rest = F.replace(line, F.lit('""'), F.lit(""))
    return F.contains(F.regexp_replace(F.concat(F.lit('"'), rest) if inside else rest, _COMPLETE, ""), F.lit('"'))


def csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file, record (text with its line breaks) and head (is it the file's first one) of CSV files.

    Fields are quoted as usual: a quote at a field's beginning opens it, two quotes are one, and a quote inside an unquoted field is a
    plain sign. Lines end with a line feed, before which a carriage return is dropped. Blank lines outside quotes are no records. A byte
    order mark at a file's beginning is dropped. A record of several lines that is longer than MAX_RECORD_CHARS is left out, and so
    is one that the file's end cuts off inside quotes with all its lines but the first, as nobody can tell what they are.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"))
    value = F.when((F.col("split") == 0) & F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    lines = lines.withColumn("value", value)
    step = lines.withColumns({"from_out": leaves_open(F.col("value"), False), "from_in": leaves_open(F.col("value"), True)})

    splits = step.select("source_file", "split", "from_out", "from_in").mapInArrow(_effects, "source_file string, split long, from_out boolean, from_in boolean")
    fixed = F.col("from_out") == F.col("from_in")
    by_split = Window.partitionBy("source_file").orderBy("split")
    earlier = by_split.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("swaps", F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(by_split))
    splits = splits.withColumn("fix", F.when(fixed, F.struct((F.col("from_out").cast("int") + F.col("swaps")).alias("state"))))  # to which the swaps up to any later split are added
    entry = F.coalesce(F.last("fix", ignorenulls=True).over(earlier)["state"], F.lit(0)) + F.coalesce(F.lag("swaps").over(by_split), F.lit(0))
    splits = splits.select("source_file", "split", (entry % 2 == 1).alias("entry"))

    known = step.join(F.broadcast(splits), ["source_file", "split"]).select("source_file", "split", "value", "from_out", "from_in", "entry")  # lines stay where they are
    limit = MAX_RECORD_CHARS

    def records(heads: bool) -> DataFrame:
        found = known.mapInArrow(lambda batches: _pieces(batches, limit, heads), "source_file string, split long, k long, record string, size long, inside boolean, ends_inside boolean")
        whole = found.where("not inside and not ends_inside").select("source_file", "split", "k", "record")
        joined = _joined(found.where("inside or ends_inside"))
        return whole.unionByName(joined).select("source_file", "split", "k", F.regexp_replace("record", r"\r$", "").alias("record")).where("record <> ''")

    first = records(True).groupBy("source_file").agg(F.min(F.struct("split", "k")).alias("at"))  # a row for each file
    head = (F.col("split") == F.col("at.split")) & (F.col("k") == F.col("at.k"))
    return records(False).join(F.broadcast(first), "source_file").select("source_file", "record", head.alias("head"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Batches, cut where the split (the first two columns) changes."""
    for b in batches:
        if not b.num_rows:
            continue
        files, splits = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1])) + 1).tolist(), b.num_rows]
        for x, y in pairwise(edges):
            yield (b.column(0)[x].as_py(), int(splits[x])), b.slice(x, y - x)


def _states(from_out: np.ndarray, from_in: np.ndarray, entry: bool) -> np.ndarray:
    """Whether each line ends inside quotes, if the first one begins in the state `entry`."""
    at = np.arange(len(from_out))
    last = np.maximum.accumulate(np.where(from_out == from_in, at, -1))
    swaps = np.cumsum(from_out & ~from_in)
    return (np.where(last >= 0, from_out[last] + swaps - swaps[last], int(entry) + swaps) % 2).astype(bool)


def _flags(b: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(b.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (first, first + 1))


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split the state behind it if it begins outside quotes, and if inside."""
    at, ends = None, (False, True)
    row = lambda: pa.record_batch([[at[0]], [at[1]], [ends[0]], [ends[1]]], schema=pa.schema([("source_file", pa.string()), ("split", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_())]))
    for split, b in _runs(batches):
        if split != at:
            if at is not None:
                yield row()
            at, ends = split, (False, True)
        ends = tuple(bool(_states(*_flags(b, 2), e)[-1]) for e in ends)
    if at is not None:
        yield row()


def _pieces(batches: Iterator[pa.RecordBatch], limit: int, heads: bool) -> Iterator[pa.RecordBatch]:
    """Records that begin and end in a split, and the pieces of others: what ends a record at the split's beginning and what begins one at
    its end (`inside` and `ends_inside` say which), with the number k of the first line in the split and the size, characters with line
    breaks. Records of several lines larger than the limit are left out, and pieces larger than that come without text. heads: of
    the records only each split's first one."""
    schema = pa.schema([("source_file", pa.string()), ("split", pa.int64()), ("k", pa.int64()), ("record", pa.string()), ("size", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_())])
    at, line, led = None, 0, False
    held, size, begin, inside = [], 0, 0, False  # lines of the open piece, its size, first line and whether it continues a record

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [r[0] for r in rows], [r[1] for r in rows]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip([*names, *([r[i] for r in rows] for i in range(2, 7))], schema, strict=True)], schema=schema)

    def rest() -> list[tuple]:
        return [(*at, begin, "\n".join(held) if size <= limit else None, size, inside, True)] if size else []

    for split, b in _runs(batches):
        out = []
        if split != at:
            out += rest() if at is not None else []
            at, line, led = split, 0, False
            held, size, begin, inside = [], 0, 0, bool(b.column(5)[0].as_py())
            state = inside
        ends = _states(*_flags(b, 3), state)
        begins = np.concatenate([[state], ends[:-1]])
        state = bool(ends[-1])
        for text, starts_inside, ends_inside in zip(b.column(2).to_pylist(), begins.tolist(), ends.tolist(), strict=True):
            if not starts_inside and not ends_inside:
                if not heads or not led and text not in ("", "\r"):
                    out.append((*at, line, text, len(text) + 1, False, False))
                    led = True
            else:
                if not starts_inside:
                    held, size, begin, inside = [], 0, line, False
                size += len(text) + 1
                if size <= limit:
                    held.append(text)
                else:
                    held = []
                if not ends_inside:
                    if inside or size <= limit and not (heads and led):
                        out.append((*at, begin, "\n".join(held) if size <= limit else None, size, inside, False))
                        led = led or not inside
                    held, size, inside = [], 0, False
            line += 1
        if out:
            yield batch(out)
    if at is not None and (out := rest()):
        yield batch(out)


def _joined(pieces: DataFrame) -> DataFrame:
    """Records of several splits, of pieces of which a split has two at most; one that begins outside begins a record.

    Sizes are summed before texts are put together, so no group grows beyond the limit."""
    begins = (~F.col("inside")).cast("int")
    along = Window.partitionBy("source_file").orderBy("split", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = pieces.withColumn("number", F.sum(begins).over(along))
    whole = Window.partitionBy("source_file", "number")
    sizes = numbered.withColumns({"all": F.sum("size").over(whole), "closed": F.max(~F.col("ends_inside")).over(whole)})
    lines = F.array_sort(F.collect_list(F.struct("split", "k", "record")))
    together = sizes.where((F.col("all") <= MAX_RECORD_CHARS) & F.col("closed")).groupBy("source_file", "number").agg(lines.alias("lines"))
    return together.select("source_file", F.get("lines", 0)["split"].alias("split"), F.get("lines", 0)["k"].alias("k"), F.array_join(F.transform("lines", lambda x: x["record"]), "\n").alias("record"))


def csv_rows(records: DataFrame, header: list[str]) -> DataFrame:
    """source_file and a text column for each name of the header (of equal names the last one counts) of records (source_file, record)."""
    names = [f"c{i}" for i in range(len(header))]
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\x00none", "maxCharsPerColumn": "-1"}
    fields = F.from_csv("record", ", ".join(f"{n} string" for n in names), options).alias("f")
    last = {name: n for name, n in zip(header, names, strict=True)}
    return records.select("source_file", fields).select("source_file", *(F.coalesce(F.col(f"f.{n}"), F.lit("")).alias(name) for name, n in last.items() if name))
