"""Packing of tokenised documents into fixed windows.

Long documents are cut at multiples of the window; what remains of each is one piece shorter than the window. The counts
of pieces by length (a table of at most `window` rows) decide everything: combinations of two or three lengths that fill a
window get repeat counts by non-negative least squares, rounded down; leftover lengths are combined greedily where they fill a
window; the rest is laid end to end and cut at window ends, the last stretch at powers of two, so that nothing is padded. Ranks
of pieces among those of their length then turn the plan into sequence numbers on Spark.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import cut, read
from vigil.llm.tokens import tokenizer_path

WINDOW = 1024
#: Rows that share a rank counter, about; the counters of a length are numbered one behind the other.
RANK_ROWS = 200_000
LEAST_BUCKETS = 16
#: Word encodings that a worker remembers.
CACHE_WORDS = 400_000

SPECIAL = "<|endoftext|>"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_RARE = re.compile("[^\x00-\x7fÀ-ɏ]")


class _OddSpace(Exception):
    """A part between two spaces is empty or has white space at an end, so one of those spaces isn't a lone one."""


class _Words(dict):
    """Ids of words as little-endian 32-bit bytes, encoded when first asked for."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if not word or word.strip() != word:
            raise _OddSpace
        got = self.encode(self.prefix + word)
        if len(self) < CACHE_WORDS:
            self[word] = got
        return got


class Encoder:
    """Encodes as the tokenizers library does with byte_bpe_50k.json and add_special_tokens=False.

    A lone space between two other characters always begins a new pre-token, so texts are encoded word by word and words are
    remembered. Words come from the same vocabulary in its rank form, which is faster; words with rare characters and texts
    that hold the special string go through the tokenizers library itself.
    """

    def __init__(self):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._exact = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
        self._first, self._rest = _Words(self._word, ""), _Words(self._word, " ")

    def _whole(self, text: str) -> bytes:
        return array("I", self._exact.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii() and _RARE.search(word):
            return self._whole(word)
        return array("I", self._fast.encode_ordinary(word)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if SPECIAL in text:
            return self._whole(text)
        words = iter(text.split(" "))
        try:
            return self._first[next(words)] + b"".join(map(self._rest.__getitem__, words))
        except _OddSpace:
            first, *rest = _LONE_SPACE.split(text)
            return b"".join([self._word(first), *(self._word(" " + word) for word in rest)])


@cache
def encoder() -> Encoder:
    return Encoder()


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Cut each document's ids and a closing id 0 into pieces of `window` and a shorter last one, whose ids stay as bytes.
    ticket numbers a task's pieces. A null text gives the closing id alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "ticket"]

    def run(batches):
        enc, ticket, step = encoder(), 0, 4 * window
        for b in batches:
            at, start, length, crc, total, rest = [], [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = enc.encode(text or "") + b"\0\0\0\0"
                for i in range(0, len(ids), step):
                    part = ids[i : i + step]
                    at.append(k)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
                    rest.append(part if len(part) < step else None)
            tickets = np.arange(ticket, ticket + len(at), dtype=np.int64)
            ticket += len(at)
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(rest, pa.binary()), pa.array(tickets)], names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, ticket long")


def combinations(window: int) -> np.ndarray:
    """All ways to fill the window with two or three lengths, a row each, ascending; the first of a pair is 0."""
    pairs = [(0, a, window - a) for a in range(1, window // 2 + 1)]
    a, b = np.triu_indices(window // 2 + 1)
    c = window - a - b
    ok = (a >= 1) & (c >= b)
    return np.concatenate([np.array(pairs).reshape(-1, 3), np.stack([a, b, c], 1)[ok]])


def repeat_counts(hist: np.ndarray, combos: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: x >= 0 that minimises |A x - hist|, A the lengths of each combination, by accelerated
    projected gradient steps. Index 0 of hist (no piece) is free."""
    n = len(hist)

    def uses(x):
        out = np.bincount(combos.ravel(), np.repeat(x, 3), n)
        out[0] = 0
        return out

    v = np.random.default_rng(5).random(len(combos))
    for _ in range(20):
        v = (w := uses(v))[combos].sum(1)
        norm = np.linalg.norm(v)
        v /= norm or 1
    step = 0.9 / max(norm, 1e-9)
    target = hist.astype(float).copy()
    target[0] = 0
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        w = uses(y) - target
        new = np.maximum(0, y - step * w[combos].sum(1))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x


@dataclass(frozen=True)
class Plan:
    """slots: for each run of ranks of a length its first position, the sequence of its first rank, and the offset there; a run
    of sequence -1 belongs to the stretch laid end to end, and its offset is its place there. base: first position by length."""

    base: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    ends: np.ndarray  # of the sequences of the stretch
    stretch_sequence: int


def greedy(left: np.ndarray, window: int, most: int = 12) -> list[tuple[list[int], int]]:
    """Combine leftover lengths, the largest first and each time the largest that fits, where that fills the window exactly."""
    left, made = left.copy(), []
    for top in range(window, 0, -1):
        while left[top] > 0:
            parts, room, used = [top], window - top, {top: 1}
            while room and len(parts) < most:
                at = room
                while at and left[at] - used.get(at, 0) <= 0:
                    at -= 1
                if not at:
                    break
                parts.append(at)
                used[at] = used.get(at, 0) + 1
                room -= at
            if room:
                break
            n = min(int(left[k]) // v for k, v in used.items())
            for k, v in used.items():
                left[k] -= n * v
            made.append((parts, n))
    return made


def make_plan(hist: np.ndarray, window: int = WINDOW) -> Plan:
    """hist[l]: pieces of length l, for 0 <= l <= window."""
    hist = np.asarray(hist, np.int64)
    left, patterns = hist.copy(), []
    if left[window]:
        patterns.append(([window], int(left[window])))
        left[window] = 0
    combos = combinations(window)
    combos = combos[((left[combos] > 0) | (combos == 0)).all(1)]
    if len(combos):
        x = repeat_counts(left, combos)
        for k in np.argsort(-x, kind="stable"):
            want = int(x[k] + 1e-9)
            if not want:
                break
            parts = [int(p) for p in combos[k] if p]
            n = min(want, *(int(left[p]) // parts.count(p) for p in parts))
            if n:
                patterns.append((parts, n))
                for p in parts:
                    left[p] -= n
    for parts, n in greedy(left, window):
        patterns.append((parts, n))
        for p in parts:
            left[p] -= n
    base = np.concatenate([[0], np.cumsum(hist)])
    used = np.zeros(window + 1, np.int64)
    slots, sequence = [], 0
    for parts, n in patterns:
        offset = 0
        for p in parts:
            slots.append((base[p] + used[p], sequence, offset))
            used[p] += n
            offset += p
        sequence += n
    place = 0
    for p in range(window, 0, -1):
        if left[p]:
            slots.append((base[p] + used[p], -1, place))
            place += int(left[p]) * p
    ends = list(range(window, place + 1, window))
    rest, at = place % window, place - place % window
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            ends.append(at := at + (1 << bit))
    slots = np.array(sorted(slots), np.int64).reshape(-1, 3)
    return Plan(base, slots[:, 0], slots[:, 1], slots[:, 2], np.array(ends, np.int64), sequence)


def place_pieces(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Sequences and offsets of ranked pieces; pieces of the stretch are cut where its sequences end."""
    kind = ranked.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for b in batches:
            start, length, crc, total, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4, 6))
            at = plan.base[length] + rank
            slot = np.searchsorted(plan.first, at, "right") - 1
            ahead = at - plan.first[slot]
            sequence, offset = plan.sequence[slot] + ahead, plan.offset[slot].copy()
            whole = plan.sequence[slot] >= 0
            keep = np.flatnonzero(whole)
            out = [keep, start[keep], length[keep], crc[keep], sequence[keep], offset[keep]]
            extra = []
            for k in np.flatnonzero(~whole):
                place, done, ids = int(plan.offset[slot[k]] + ahead[k] * length[k]), 0, b.column(5)[k].as_py()
                while done < length[k]:
                    s = int(np.searchsorted(plan.ends, place, "right"))
                    n = int(min(length[k] - done, plan.ends[s] - place))
                    begin = int(plan.ends[s - 1]) if s else 0
                    extra.append((k, start[k] + done, n, zlib.crc32(ids[4 * done : 4 * (done + n)]), plan.stretch_sequence + s, place - begin))
                    place, done = place + n, done + n
            if extra:
                out = [np.concatenate([a, np.array(x, np.int64)]) for a, x in zip(out, zip(*extra, strict=True), strict=True)]
            yield pa.record_batch([b.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in (*out[1:4], total[out[0]], *out[4:]))], names=fields)

    rows = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank")
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{f} long" for f in fields[1:]))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pack whole documents into sequences of at most `window` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece. Rows with equal ids are documents
    of their own, a null id stays null, a null or empty text is the closing id alone. No sequence needs padding: each holds
    `window` tokens or a power of two. An empty table gives no pieces.
    """
    made = cut(pieces(docs, id_col, text_col, window))
    rows = made.count()
    buckets = rows // RANK_ROWS + LEAST_BUCKETS
    bucket = F.pmod(F.col("ticket"), F.lit(buckets))
    counts = made.groupBy("length", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        hist[r.length] = r.n
    in_bucket = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "ticket")
    ranked = made.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(in_bucket) - 1).join(ahead, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    return place_pieces(ranked, make_plan(hist, window))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents; odd rows as there."""
    return pack(read(spark, sf_dir, "documents"))
