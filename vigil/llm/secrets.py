"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The spans of the patterns are the labelled samples of random strings, all other words those of ordinary identifiers. One pass over
the texts counts character pairs of both and notes candidate tokens; a candidate is reported if its log-likelihood ratio says so.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import cut, read, text_slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Candidates: long tokens with a letter and a digit.
TOKEN_CHARS = 20
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}")
_CUES = ("passw", "secret", "token", "key")

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(_ALPHABET) + 1  # 0 stands for any other byte
_CODE = np.zeros(256, np.int64)
_CODE[list(_ALPHABET)] = np.arange(1, SYMBOLS)
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
#: Smoothing: pairs added to each symbol's row, spread evenly; a random string is near even by nature.
RANDOM_PAIRS, ORDINARY_PAIRS = 2000.0, 5.0
#: A candidate is reported if it is so many nats likelier as a random string: even odds of e**9 against, and as much a character.
MIN_RATIO, MIN_RATIO_PER_CHAR = 9.0, 0.35


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Valid spans (start, kind, end) of the patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if len(text) >= 24:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _long_runs(member: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """For each row, whether it has a run of `least` member bytes."""
    n = len(offsets) - 1
    gaps = np.concatenate([[-1], np.flatnonzero(~member), [len(member)]])
    long = np.flatnonzero(np.diff(gaps) > least)
    rows = np.zeros(n, bool)
    for k in long:  # a run can reach over the ends of rows
        a, b = gaps[k] + 1, gaps[k + 1]
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        rows[max(first, 0) : last] = True
    return rows


def _pairs(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Counts of neighbouring symbols of tokens where both bytes are inside."""
    code = _CODE[data]
    use = inside[:-1] & inside[1:] & (code[:-1] > 0) & (code[1:] > 0)
    return np.bincount((code[:-1] * SYMBOLS + code[1:])[use], minlength=SYMBOLS * SYMBOLS)


def _apart(spans: list[tuple[int, int, int]], others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of others (start, end, token) that overlap none of the spans (start, kind, end), which are sorted by start."""
    if not spans:
        return others
    starts = [a for a, _, _ in spans]
    reach = list(accumulate((b for _, _, b in spans), max))  # how far the spans up to each one go
    return [o for o in others if not (n := bisect_left(starts, o[1])) or reach[n - 1] <= o[0]]


def scan(texts: pa.Array) -> tuple[list[list], list[list], np.ndarray]:
    """Of each text its base spans and its candidates (start, end, token); and pair counts, random strings first, then ordinary."""
    spans, tokens = [], []
    counts = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    for first, end, data, offsets in text_slices(texts):
        if not len(data):
            spans += [[] for _ in range(end - first)]
            tokens += [[] for _ in range(end - first)]
            continue
        known = _CODE[data] > 0
        has_hex, has_token = _long_runs(_IS_HEX[data], offsets, 24), _long_runs(known, offsets, TOKEN_CHARS)
        ordinary = np.ones(len(data), bool)
        breaks = offsets[1:-1][offsets[1:-1] < len(data)]
        random = np.zeros(len(data), bool)
        for k in range(end - first):
            text = texts[first + k].as_py() or ""
            low = text.lower()
            cued = "AKIA" in text or any(c in low for c in _CUES)
            own = base_spans(text) if cued or has_hex[k] else []
            maybe = _apart(own, [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]) if has_token[k] else []
            spans.append(own)
            tokens.append(maybe)
            row = data[offsets[k] : offsets[k + 1]]
            at = None if text.isascii() or not (own or maybe) else np.append(np.flatnonzero((row & 0xC0) != 0x80), len(row))  # bytes before each character
            for a, b, value in [(a, b, kind) for a, kind, b in own] + maybe:
                x, y = (offsets[k] + (c if at is None else at[c]) for c in (a, b))
                ordinary[x:y] = False
                if value == 1 or value == 2:
                    random[x:y] = True
                elif value == 0:  # of an assignment the value alone is random, and only if it has a digit
                    m = _ASSIGN.match(text, a)
                    random[y - len(m[2]) : y] = any(c.isdigit() for c in m[2])
        for mask, row in ((random, 0), (ordinary, 1)):
            got = _pairs(data, mask)
            for b in breaks:  # pairs over the end of a row don't count
                if mask[b - 1] and mask[b] and known[b - 1] and known[b]:
                    got[_CODE[data[b - 1]] * SYMBOLS + _CODE[data[b]]] -= 1
            counts[row] += got
    return spans, tokens, counts


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """For each pair of symbols, by how much it is likelier in random strings than in ordinary identifiers."""
    pairs = counts.reshape(2, SYMBOLS, SYMBOLS).astype(float)
    out = []
    for n, extra in zip(pairs, (RANDOM_PAIRS, ORDINARY_PAIRS), strict=True):
        n = n + extra / (SYMBOLS - 1)
        out.append(np.log(n / n.sum(1, keepdims=True)))
    return out[0] - out[1]


def is_random(token: str, ratio: np.ndarray) -> bool:
    code = _CODE[np.frombuffer(token.encode(), np.uint8)]
    total = ratio[code[:-1], code[1:]].sum()
    return bool(total >= MIN_RATIO and total >= MIN_RATIO_PER_CHAR * len(token))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind; added ones are of kind random).

    A row for each input row; null and empty texts have no spans. Candidates that overlap a base span are not judged. With no
    secrets in the table the random model is even. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def first_pass(batches):
        for b in batches:
            spans, tokens, counts = scan(b.column(1))
            n = len(spans)
            base = [[f"{KINDS[k]}:{a}:{e}" for a, k, e in own] for own in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0), pa.nulls(1, b.column(0).type)]),
                    pa.array([*base, None], pa.list_(pa.string())),
                    pa.array([*([{"start": a, "end": e, "token": t} for a, e, t in own] for own in tokens), None], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))),
                    pa.array([*[None] * n, counts.ravel()], pa.list_(pa.int64())),
                ],
                names=["id", "base", "tokens", "counts"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = cut(rows.mapInArrow(first_pass, f"id {kind}, base array<string>, tokens array<struct<start:int,end:int,token:string>>, counts array<bigint>"))
    counts = np.zeros(2 * SYMBOLS * SYMBOLS, np.int64)
    for r in found.where("counts is not null").select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row for each pair of symbols
        counts[r.at] = r.n
    ratio = log_ratio(counts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for base, tokens in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for k, name in enumerate(KINDS):
                    out[k].append(sum(s.startswith(name) for s in base))
                out[3].append(hashlib.sha256(",".join(base).encode()).hexdigest())
                added = [f"random:{t['start']}:{t['end']}" for t in tokens if is_random(t["token"], ratio)]
                out[4].append(",".join(sorted(base + added, key=lambda s: int(s.split(":")[1]))))
            yield pa.record_batch([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:])], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    judged = found.where("counts is null").select("id", "base", "tokens").mapInArrow(judge, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return judged.withColumnRenamed("id", id_col)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_secrets() of all documents; odd rows as there."""
    return find_secrets(read(spark, sf_dir, "documents"))
