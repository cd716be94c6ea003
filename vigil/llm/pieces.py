"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position its outputs (the longest piece that ends there and,
over the output links, every shorter one) relax the best score of a segmentation that ends there. This is the unigram rule
applied to a model's pieces and scores: of a BPE model it gives the segmentation with the highest sum of scores, not
the merges. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import read, with_fields
from vigil.llm.tokens import piece_model, splits_at_spaces, tokenizer_path

SPACE_MARK = "▁"
#: How far an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Word segmentations that a worker remembers.
CACHE_WORDS = 300_000
#: Rows encoded at once.
STEP_ROWS = 200

_CHUNK = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+")


_INF = float("inf")


class _Words(dict):
    """Ids of words behind a space, as little-endian 32-bit bytes, segmented when first asked for."""

    def __init__(self, owner: PieceCodec):
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        got = array("I", self.owner.segment(SPACE_MARK + word)).tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = got
        return got


class PieceCodec:
    """Encodes and decodes with the pieces of a SentencePiece model whose normaliser is the identity with a leading space."""

    def __init__(self, path: str):
        sp = piece_model(path)
        n = sp.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.bytes_from, worst = {}, 0.0
        self.table: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_from[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                self.table.append(b"")
            elif sp.is_unknown(i):
                self.unknown = i
                self.table.append(" ⁇ ".encode())
            else:
                score = sp.get_score(i)
                worst = min(worst, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                if len(piece) == 1:
                    self.single.add(piece)
                self.table.append(piece.replace(SPACE_MARK, " ").encode())
        self.automaton.make_automaton()
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.by_words = splits_at_spaces(path)
        self._words = _Words(self)

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose spaces are marks; of equal scores the longer last piece wins."""
        n = len(text)
        best = [0.0] + [-_INF] * n
        back: list = [None] * (n + 1)
        if self.single.issuperset(text):
            for end, (size, score, i) in self.automaton.iter(text):
                start = end + 1 - size
                if (got := best[start] + score) > best[end + 1]:
                    best[end + 1] = got
                    back[end + 1] = start, i
        else:  # a character that is no piece scores as unknown; it comes behind the pieces that end with it
            done = 0
            for end, (size, score, i) in self.automaton.iter(text):
                done = self._unknown(text, best, back, done, end)
                start = end + 1 - size
                if (got := best[start] + score) > best[end + 1]:
                    best[end + 1] = got
                    back[end + 1] = start, i
            self._unknown(text, best, back, done, n)
        ids: list[int] = []
        at = n
        while at:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            elif self.bytes_from:
                ids += [self.bytes_from[b] for b in reversed(text[start:at].encode())]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1]

    def _unknown(self, text: str, best: list[float], back: list, done: int, to: int) -> int:
        for at in range(done, to):
            if text[at] not in self.single and (got := best[at] + self.unknown_score) > best[at + 1]:
                best[at + 1] = got
                back[at + 1] = at, -1
        return max(done, to)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. No piece reaches over the beginning of a run of marks, so words are segmented apart and remembered."""
        if not text:
            return np.zeros(0, "<u4")
        if not self.by_words:
            return np.array(self.segment(SPACE_MARK + text.replace(" ", SPACE_MARK)), "<u4")
        words = text.split(" ")
        if SPACE_MARK in text or "" in words:  # runs of marks
            marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
            return np.array([i for chunk in _CHUNK.findall(marked) for i in self.segment(chunk)], "<u4")
        return np.frombuffer(b"".join(map(self._words.__getitem__, words)), "<u4")

    def decode(self, ids) -> str:
        """The text of ids: marks are spaces, the first of which was added, and bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.table.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


@cache
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """docs with ids (array<int>) instead of text_col and of any column named ids. Null and empty texts have no ids; other columns
    and repeated rows stay as they are."""
    model = model or tokenizer_path("piece_bpe_32k.model")
    docs = docs.drop("ids") if text_col != "ids" else docs
    others = [c for c in docs.columns if c != text_col]
    at = len(others)

    def run(batches):
        enc = codec(model)
        for b in batches:
            for first in range(0, b.num_rows, STEP_ROWS):  # small steps: ids take more room than their text
                part = b.slice(first, STEP_ROWS)
                found = [enc.encode(t.as_py() or "") for t in part.column(at)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
                yield pa.record_batch([*part.columns[:at], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*others, "ids"])

    rows = docs.select(*others, text_col)
    return rows.mapInArrow(run, with_fields(rows.schema.fields[:at], "ids array<int>"))


def decode_pieces(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str | None = None) -> DataFrame:
    """rows with text_col behind the other columns (one of that name is replaced); ids_col is kept. Null ids give a null text."""
    model = model or tokenizer_path("piece_bpe_32k.model")
    rows = rows.drop(text_col)
    at = rows.columns.index(ids_col)

    def run(batches):
        dec = codec(model)
        for b in batches:
            texts = [dec.decode(ids.values.to_numpy(zero_copy_only=False).tolist()) if ids.is_valid else None for ids in b.column(at)]
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return rows.mapInArrow(run, with_fields(rows.schema.fields, f"`{text_col}` string"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document and decode it again: digests of ids and of the decoded text, and whether it is the one encoded (a
    text's own space marks come back as spaces)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.withColumn("before", F.sha2(F.replace("text", F.lit(SPACE_MARK), F.lit(" ")), 256))
    back = decode_pieces(encode_pieces(marked))
    decoded = F.sha2("text", 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), decoded.alias("decoded_sha256"), (decoded == F.col("before")).alias("round_trip"))
