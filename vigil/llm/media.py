"""Media columns in a deduplicated chunk store.

A payload is stored as an 8-bit mono WAV. A rolling gear hash cuts media where their content says so; chunk digests are
deduplicated by Spark joins, each chunk is kept once, compressed, and the ordered chunk lists (the manifest) rebuild each
medium, whose digest is verified before its samples are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import cut, read, sample_ids, text_slices

BLOCK = 64
HEADER = 44
RATE = 8000
#: Chunk sizes in bytes; the mean lies near 1024 + 4096.
MIN_CHUNK, MAX_CHUNK = 1024, 16384
CUT_MASK, CUT_SHIFT = 0xFFF, 4
#: Documents whose beginnings train the compression dictionary (it only affects sizes).
DICT_ROWS = 1500
#: A chunk that more media share than this, or than a thousandth of all uses, is sent to every task; at most 1000 are.
HOT_USES = 5000

_GEAR = np.random.default_rng(64).integers(0, 2**32, 256, dtype=np.uint32)


def to_wav(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV made by to_wav."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack_from("<HHIIHH", media, 20) != (1, 1, RATE, RATE, 1, 8):
        raise ValueError("not an 8-bit mono WAV")
    (n,) = struct.unpack_from("<I", media, 40)
    if len(media) != HEADER + n:
        raise ValueError("truncated WAV")
    return media[HEADER:]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Positions behind bytes where the gear hash of the last 16 bytes asks for a cut: h = 2 h + gear[byte], seen through a mask."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        wide = h.copy()
        wide[step:] += h[:-step] << np.uint32(step)
        h = wide
    return np.flatnonzero((h >> np.uint32(CUT_SHIFT)) & np.uint32(CUT_MASK) == 0) + 1


def chunk_bounds(n: int, wanted: np.ndarray) -> list[int]:
    """Ends of chunks of n bytes, at wanted cuts that keep to the least and largest size."""
    ends, at = [], 0
    for c in wanted.tolist():
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if c - at >= MIN_CHUNK and n - c > 0:
            at = c
            ends.append(at)
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    return [*ends, n]


def _media(texts: pa.Array) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Of each text its bytes, and the chunks of its medium. Cuts depend on text bytes at least MIN_CHUNK behind the start."""
    for _, _, data, offsets in text_slices(texts):
        cuts = gear_cuts(data) if len(data) else np.zeros(0, np.int64)
        at = np.searchsorted(cuts, offsets, "right")
        raw = data.tobytes()
        for k in range(len(offsets) - 1):
            a, b = int(offsets[k]), int(offsets[k + 1])
            medium = to_wav(padded(raw[a:b]))
            ends = chunk_bounds(len(medium), cuts[at[k] : at[k + 1]] - a + HEADER)
            yield b - a, medium, [medium[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:20]


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (SHA-256 of the medium), chunks (digests in order) for each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(n, hashlib.sha256(m).digest(), [_digest(c) for c in chunks]) for n, m, chunks in _media(b.column(1))]
            n, media, chunks = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(chunks, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "chunks"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, chunks array<binary>")


def chunk_store(docs: DataFrame, dictionary: bytes, only: frozenset[bytes] | None = None) -> DataFrame:
    """digest and compressed chunk, each digest once; `only` those given, if any are."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        seen: set[bytes] = set()
        for b in batches:
            digests, chunks = [], []
            for _, _, parts in _media(b.column(0)):
                for part in parts:
                    d = _digest(part)
                    if d in seen or (only is not None and d not in only):
                        continue
                    if len(seen) < 200_000:  # copies in one task need no shuffle
                        seen.add(d)
                    digests.append(d)
                    chunks.append(pack.compress(part))
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], names=["digest", "chunk"])

    return docs.select("text").mapInArrow(run, "digest binary, chunk binary").dropDuplicates(["digest"])


def _features(samples: bytes) -> str:
    """Length, sum, sum of squares, crossings of the middle level and the most frequent level of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    hist = np.bincount(x, minlength=256)
    level = np.arange(256)
    return f"n={len(x)};sum={int(hist @ level)};squares={int(hist @ (level * level))};crossings={int(np.count_nonzero(np.diff(x >= 128)))};mode={int(hist.argmax())}"


_READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def rebuild(parts: DataFrame, dictionary: bytes) -> DataFrame:
    """Join the chunks of each medium (rows media, seq, n, chunk; a partition holds whole media, in order), verify its digest, and
    read its samples."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        key, held = None, []
        for b in batches:
            out = []
            for media, seq, n, chunk in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if media != key:
                    key, held = media, []
                if seq != len(held):
                    raise ValueError(f"chunk {len(held)} of {media.hex()} is missing")
                held.append(unpack.decompress(chunk))
                if len(held) == n:
                    medium = b"".join(held)
                    if hashlib.sha256(medium).digest() != media:
                        raise ValueError(f"medium {media.hex()} was not rebuilt")
                    samples = from_wav(medium)
                    out.append((media, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(medium), media.hex(), _features(samples)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    schema = pa.schema([("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    return parts.select("media", "seq", "n", "chunk").mapInArrow(run, _READ)


def _dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary from the beginnings of a bounded sample of texts; empty if there is too little to learn."""
    ids = F.broadcast(sample_ids(docs, "doc_id", DICT_ROWS))
    rows = docs.join(ids, "doc_id", "left_semi").select(F.substring("text", 1, 4096).alias("t")).limit(DICT_ROWS).collect()
    try:
        return zstandard.train_dictionary(65_536, [r.t.encode() for r in rows if r.t]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store whole texts as media in a chunk store, read them back, and describe what was read.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks for each
    input row; rows with equal texts have equal values and share one medium. Null and empty texts are 64 zero bytes; a medium that
    can't be rebuilt bit by bit fails the query; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = _dictionary(docs)
    listed = cut(manifest(docs))
    uses = cut(listed.groupBy("media").agg(F.first("chunks").alias("chunks")).select("media", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "digest")))
    limit = max(HOT_USES, uses.count() // 1000)
    hot = frozenset(bytes(r.digest) for r in uses.groupBy("digest").count().where(F.col("count") > limit).select("digest").collect())
    names = [F.lit(bytearray(d)) for d in sorted(hot)]
    common = F.col("digest").isin(*names) if names else F.lit(False)
    parts = uses.where(~common).join(chunk_store(docs, dictionary), "digest")
    if hot:
        parts = parts.union(uses.where(common).join(F.broadcast(chunk_store(docs, dictionary, hot)), "digest"))
    single = rebuild(parts.where("n = 1"), dictionary)
    many = rebuild(parts.where("n > 1").repartition("media").sortWithinPartitions("media", "seq"), dictionary)
    described = single.union(many)
    out = listed.select("doc_id", "n_bytes", "media", F.size("chunks").alias("n_chunks")).join(described, "media")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_columns() of all documents; odd rows as there."""
    return media_columns(read(spark, sf_dir, "documents"))
