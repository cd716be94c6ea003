"""Substring deduplication: words covered by a window of 20 words that also starts earlier are removed.

Equal windows have the same least eight-word hash (minimizer), so only windows whose minimizer occurs twice can repeat. The stretches
of words around those are routed by minimizer to shards. A shard indexes the distinct stretches at their first places in a compressed
FM-index and streams them against it: backward search over the wavelet matrix gives matching statistics, and intervals of at least
20 words with an earlier place are what to remove. Copies of a stretch are put together before they are sent; those after its first
place share the answer for its last one. Minimizers around which too many distinct stretches stand are split by longer
minimizers inside those stretches, which go to shards of their own in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import SPACE, cut, cuts_made, drop_paths, gram_hashes, mix, read, span_hashes, text_slices, with_fields, word_bounds
from vigil.llm.fmindex import FMIndex

WINDOW = 20
#: Words of minimizers, and of those that split a minimizer with more than ROUTE_ROWS distinct stretches. The last is the window: its
#: stretches are single windows, one for each minimizer.
GRAMS = (8, 14, WINDOW)
#: Stretches in a shard, about.
SHARD_ROWS = 8_000
ROUTE_ROWS = 20_000
_LAST_ID = 2**63 - 1
_LOW = np.uint64(0xFFFFFF)


def minimizers(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes of texts (text k has words first[k] to first[k + 1]): runs of windows with one minimizer, as its hash, the
    run's first window, and the number of windows. Of equal hashes the leftmost place counts."""
    grams = gram_hashes(words, gram)
    span = window - gram + 1
    starts = len(words) - window + 1
    if starts <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)
    width = 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    at = np.arange(starts)
    place = at + (((low[:starts] & _LOW).astype(np.int64) - at) & int(_LOW))
    counts = np.diff(first)
    fits = np.repeat(first[1:], counts)[:starts] - at >= window
    s, place = at[fits], place[fits]
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(s) else np.zeros(0, np.int64)
    return grams[place[head]], s[head], np.diff(np.concatenate([head, [len(s)]]))


def _normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes with one space behind each word and no other, and where words start and end in them."""
    solid = ~SPACE[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    flat = data.copy()
    flat[~solid] = 0x20
    place = np.zeros(len(data) + 1, np.int32 if len(data) < 2**31 else np.int64)
    np.cumsum(keep, out=place[1:])
    return flat[keep].tobytes(), place[starts], place[ends]


def text_keys(texts: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes, which tell apart texts of one id."""
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """rid, tkey, h, a, n: the minimizer runs of each text (docs: rid, text)."""

    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_slices(b.column(1)):
                starts, ends, heads = word_bounds(data, offsets)
                h, a, n = minimizers(span_hashes(data, starts, ends), heads)
                if not len(h):
                    continue
                row = np.searchsorted(heads, a, "right") - 1
                raw = data.tobytes()
                tkey = text_keys(raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                rid = b.column(0).slice(first, end - first).to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(rid[row]), pa.array(tkey[row]), pa.array(h.view(np.int64)), pa.array((a - heads[row]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["rid", "tkey", "h", "a", "n"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, tkey long, h long, a int, n int")


def _packed(docs: DataFrame) -> DataFrame:
    """docs with tkey (a 64-bit hash of the text) and z (the compressed text) instead of text."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*others, "text")
    at = len(others)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [t.encode() for t in b.column(at).fill_null("").to_pylist()]
            yield pa.record_batch([*b.columns[:at], pa.array(text_keys(raw)), pa.array([pack.compress(t) for t in raw], pa.binary())], names=[*others, "tkey", "z"])

    return rows.mapInArrow(run, with_fields(rows.schema.fields[:at], "tkey long, z binary"))


def _unpacked(z: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x) for x in z.to_pylist()], pa.binary()).cast(pa.string())


def _flat(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs: the lengths of the lists (null: 0), and the fields of all their structs."""
    items = column.flatten()
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, [items.field(f).to_numpy(zero_copy_only=False) for f in fields]


def stretches(held: DataFrame, with_words: bool) -> DataFrame:
    """The stretches of words around repeated minimizers: route (the minimizer), k (a hash of the words), rid, tkey, a (first window),
    n (windows), and words, if asked for. held: rid, tkey, z, places (h, a, n)."""

    names = ["route", "k", "rid", "tkey", "a", "n", "words"][: 6 + with_words]

    def run(batches):
        for b in batches:
            rid, tkey = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            counts, (h, a, n) = _flat(b.column(3), ("h", "a", "n"))
            edges = np.concatenate([[0], np.cumsum(counts)])
            for first, end, data, offsets in text_slices(_unpacked(b.column(2))):
                starts, ends, heads = word_bounds(data, offsets)
                buf, x, y = _normal(data, starts, ends)
                own = slice(edges[first], edges[end])
                row = np.repeat(np.arange(first, end), counts[first:end])
                word = heads[row - first] + a[own]
                lo, hi = x[word], y[word + n[own] + WINDOW - 2]
                k = span_hashes(np.frombuffer(buf, np.uint8), lo, hi)
                out = [pa.array(h[own]), pa.array(k.view(np.int64)), pa.array(rid[row]), pa.array(tkey[row]), pa.array(a[own]), pa.array(n[own])]
                if with_words:
                    out.append(pa.array([buf[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()))
                yield pa.record_batch(out, names=names)

    return held.select("rid", "tkey", "z", "places").mapInArrow(run, "route long, k long, rid long, tkey long, a int, n int" + ", words binary" * with_words)


def search_shard(words: list[bytes], n: np.ndarray, rid: np.ndarray, a: np.ndarray, last_rid: np.ndarray, last_a: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Distinct stretches of n[k] windows, of which the first one in the corpus starts at word a[k] of text rid[k], the last one at
    word last_a[k] of text last_rid[k], are indexed at their first places. Then the stretches are streamed against the index at
    their first and, if that is another one, at their last place. Returns for both a mask of those windows (bit i: the i-th) that
    also start earlier; what holds at the last place holds at all between."""
    sizes = n + window - 1
    flat = b" ".join(words).split(b" ")
    known = {w: k + 1 for k, w in enumerate(dict.fromkeys(flat))}
    start = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(n), np.int64)
    within = np.arange(len(text)) - np.repeat(start, sizes + 1)
    text[within < np.repeat(sizes, sizes + 1)] = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))

    rids = np.unique(np.concatenate([rid, last_rid]))
    width = int(max(a.max(initial=0), last_a.max(initial=0))) + int(sizes.max(initial=0)) + 2
    first, last = (np.searchsorted(rids, r) * width + at for r, at in ((rid, a), (last_rid, last_a)))  # places, in their order
    place = np.repeat(first, sizes + 1) + within
    known_places = np.sort(place)
    order = np.searchsorted(known_places, place)
    index = FMIndex(text, order, int(sizes.max(initial=0)) + 1)

    stream = np.concatenate([text, text])
    own = np.concatenate([order, np.searchsorted(known_places, np.repeat(last, sizes + 1) + within)])
    # The words that all windows of a stretch share: if they aren't there earlier, no window is.
    alive = np.flatnonzero(index.occur(stream, own, start + n - 1, start + window))
    later = np.flatnonzero(first != last)
    who, begin = np.concatenate([alive, later]), np.concatenate([start[alive], start[later] + len(text)])
    k, lo, hi = index.matches(stream, own, begin, begin + sizes[who], window)
    masks = np.zeros((2, len(n)), np.int64)
    np.bitwise_or.at(masks, ((k >= len(alive)).astype(int), who[k]), ((np.int64(1) << (hi - lo - window + 1)) - 1) << (lo - begin[k]))
    return masks[0], masks[1]


def _distinct(seen: DataFrame) -> DataFrame:
    """Distinct stretches (route, k, n, words) with their first and last places. seen: those, first and last."""
    return cut(seen.groupBy("route", "k", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("words").alias("words")), sweep=True)


def _shorter(heavy: DataFrame, gram: int) -> DataFrame:
    """Each stretch by its minimizers of gram words: route, k, n, words, first, last of the parts, off (the first of a part's windows)
    and up (route, k, n of the whole)."""
    rows = heavy.select("words", F.struct("route", "k", "n").alias("up"), "first", "last")

    def run(batches):
        for b in batches:
            for at, end, data, offsets in text_slices(b.column(0).cast(pa.string())):
                starts, ends, heads = word_bounds(data, offsets)
                h, a, n = minimizers(span_hashes(data, starts, ends), heads, gram=gram)
                row = np.searchsorted(heads, a, "right") - 1
                lo, hi, raw = starts[a], ends[a + n + WINDOW - 2], data.tobytes()
                words = pa.array([raw[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                up = [c.slice(at, end - at).take(pa.array(row)) for c in b.columns[1:]]
                made = [h.view(np.int64), span_hashes(data, lo, hi).view(np.int64), n.astype(np.int32), (a - heads[row]).astype(np.int32)]
                yield pa.record_batch([*map(pa.array, made), words, *up], names=["route", "k", "n", "off", "words", "up", "first", "last"])

    place = "struct<rid: bigint, a: int>"
    parts = rows.mapInArrow(run, f"route long, k long, n int, off int, words binary, up struct<route: bigint, k: bigint, n: int>, first {place}, last {place}")
    moved = lambda c: F.struct(F.col(c).rid.alias("rid"), (F.col(c).a + F.col("off")).alias("a")).alias(c)
    return parts.select("route", "k", "n", "words", "off", "up", moved("first"), moved("last"))


def _mask_at(place: Column) -> Column:
    return F.when(place == F.col("at"), F.col("mask")).otherwise(F.col("later"))


def judged(known: DataFrame, level: int = 0) -> DataFrame:
    """route, k, n of distinct stretches, at (the first place), and masks of the windows that start earlier: mask for the first place,
    later for the others. known: what _distinct() gives."""
    crowd = cut(known.groupBy("route").count().where(F.col("count") > ROUTE_ROWS).select("route"), sweep=True)
    split = level + 1 < len(GRAMS) and not crowd.isEmpty()
    light = known.join(crowd, "route", "left_anti") if split else known
    shards = light.count() // SHARD_ROWS + 1

    def run(t: pa.Table) -> pa.Table:
        first, last = (t.column(c).combine_chunks() for c in ("first", "last"))
        rid, a, last_rid, last_a = (c.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for c in (first, last) for f in ("rid", "a"))
        mask, later = search_shard(t.column("words").to_pylist(), t.column("n").to_numpy().astype(np.int64), rid, a, last_rid, last_a)
        return pa.table([t.column("route"), t.column("k"), t.column("n"), first, pa.array(mask), pa.array(later)], names=["route", "k", "n", "at", "mask", "later"])

    shard = F.pmod(F.xxhash64("route"), F.lit(shards))
    found = light.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "route long, k long, n int, at struct<rid: bigint, a: int>, mask long, later long")
    if not split:
        return found
    parts = cut(_shorter(known.join(crowd, "route", "left_semi"), GRAMS[level + 1]), sweep=True)
    answers = parts.join(judged(_distinct(parts), level + 1), ["route", "k", "n"])
    whole = answers.select("up", "first", F.expr("shiftleft(later, off)").alias("later"), _mask_at(F.col("first")).alias("mask"), "off")
    whole = whole.groupBy("up").agg(F.min("first").alias("at"), F.bit_or(F.expr("shiftleft(mask, off)")).alias("mask"), F.bit_or("later").alias("later"))
    return found.unionByName(whole.select("up.route", "up.k", "up.n", "at", "mask", "later"))


def covers(held: DataFrame) -> DataFrame:
    """rid, tkey, windows: which windows (a: first of a run, mask: of those that follow) of each text start earlier elsewhere."""
    place = F.struct("rid", "a")
    with cuts_made() as made:
        found = cut(judged(_distinct(stretches(held, True).withColumn("first", place).withColumn("last", place))), sweep=True)
    drop_paths(held.sparkSession, made[:-1])  # the words of stretches, which the masks don't need
    hits = stretches(held, False).join(found.hint("shuffle_hash"), ["route", "k", "n"]).select("rid", "tkey", "a", _mask_at(place).alias("mask"))
    return cut(hits.where("mask <> 0").groupBy("rid", "tkey").agg(F.collect_set(F.struct("a", "mask")).alias("windows")), sweep=True)


def _finish(rows: DataFrame, text_out: bool) -> DataFrame:
    """Remove covered words: n_words, n_removed, kept_sha256, or the kept text (a text that loses nothing stays as it is)."""
    others = [c for c in rows.columns if c not in ("z", "windows")]
    at = len(others)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _unpacked(b.column(at))
            counts, (a, mask) = _flat(b.column(at + 1), ("a", "mask"))
            edges = np.concatenate([[0], np.cumsum(counts)])
            n_words, n_removed, kept_sha, kept_text = [], [], [], []
            for first, end, data, offsets in text_slices(texts):
                starts, ends, heads = word_bounds(data, offsets)
                buf, x, y = _normal(data, starts, ends)
                own = slice(edges[first], edges[end])
                base = np.repeat(heads[:-1], counts[first:end]) + a[own]
                turns = np.zeros(len(starts) + 1, np.int64)
                for i in range(int(mask[own].max(initial=0)).bit_length()):
                    begin = base[mask[own] >> i & 1 == 1] + i
                    np.add.at(turns, begin, 1)
                    np.add.at(turns, begin + WINDOW, -1)
                stay = np.cumsum(turns)[:-1] == 0
                for k in range(first, end):
                    lo, hi = int(heads[k - first]), int(heads[k - first + 1])
                    n_words.append(hi - lo)
                    gone = 0
                    if counts[k]:
                        kept_words = np.flatnonzero(stay[lo:hi]) + lo
                        gone = hi - lo - len(kept_words)
                    if gone:
                        kept = b" ".join([buf[i:j] for i, j in zip(x[kept_words].tolist(), y[kept_words].tolist(), strict=True)])
                    else:
                        kept = buf[x[lo] : y[hi - 1]] if hi > lo else b""
                    n_removed.append(gone)
                    if text_out:
                        kept_text.append(kept.decode() if gone else texts[k].as_py())
                    else:
                        kept_sha.append(hashlib.sha256(kept).hexdigest())
            made = [pa.array(kept_text, pa.string())] if text_out else [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_sha, pa.string())]
            yield pa.record_batch([*b.columns[:at], *made], names=[*others, *(["text"] if text_out else ["n_words", "n_removed", "kept_sha256"])])

    fields = [rows.schema[c] for c in others]
    return rows.select(*others, "z", "windows").mapInArrow(run, with_fields(fields, "text string" if text_out else "n_words long, n_removed long, kept_sha256 string"))


def _dedup(docs: DataFrame, text_out: bool) -> DataFrame:
    """docs: rid, text and columns to keep."""
    runs = anchors(docs)
    repeated = cut(runs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    places = runs.join(repeated.hint("shuffle_hash"), "h").groupBy("rid", "tkey").agg(F.collect_set(F.struct("h", "a", "n")).alias("places"))
    kept = cut(_packed(docs).join(places, ["rid", "tkey"], "left"), sweep=True)
    none = F.lit(None).cast("array<struct<a:int,mask:bigint>>")
    plain = kept.where("places is null").drop("places").withColumn("windows", none)
    held = kept.where("places is not null")
    found = held.drop("places").join(covers(held), ["rid", "tkey"], "left").select(*plain.columns)
    return _finish(plain.unionByName(found), text_out)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) for each row.

    A window is removed if its words also start earlier: in a row of a smaller id, or earlier in the same text. Null and empty
    texts have no words. Rows of one id count as one document: a repeated row removes nothing of its own copies. Null ids come after
    all others, as one document. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("rid"), F.col(text_col).alias("text"))
    return _dedup(rows, False).select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256")


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words that dedup_substrings removes taken out of text_col (kept words joined by one space); texts that lose
    nothing stay as they are, null ones become empty. Other columns stay."""
    others = [c for c in docs.columns if c != text_col]
    kept = F.struct(*(F.col(f"`{c}`") for c in others)).alias("others") if others else F.struct(F.lit(0)).alias("others")
    rows = docs.select(kept, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("rid"), F.col(text_col).alias("text"))
    out = _dedup(rows, True)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("others").getField(c).alias(c) for c in docs.columns))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_substrings() of all documents; odd rows as there."""
    return dedup_substrings(read(spark, sf_dir, "documents"))
