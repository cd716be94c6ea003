"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import read

#: Bytes of text in one call of the encoder, and the length from which a text is split.
BATCH_BYTES = 256_000
SPLIT_BYTES = 64_000

#: One space between two ASCII letters or digits or closing signs: no piece reaches over it.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;!?]) (?=[A-Za-z0-9])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def splits_at_spaces(path: str) -> bool:
    """Whether a text may be cut before a lone space: no piece has the space mark after another character, and a cut part
    gets the mark that its dropped space would have been."""
    sp = piece_model(path)
    crossing = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    return not crossing and sp.encode("ab cd, ef") == sp.encode("ab") + sp.encode("cd,") + sp.encode("ef")


def safe_parts(text: str, size: int = SPLIT_BYTES) -> Iterator[str]:
    """Parts of about size characters, each cut at the first safe space; the space itself belongs to no part."""
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def count_batch(texts: list[str | None], path: str) -> list[int]:
    """Numbers of ids of each text; the encoder gets lists of parts balanced by bytes."""
    sp, split = piece_model(path), splits_at_spaces(path)
    counts = [0] * len(texts)
    parts: list[str] = []
    owners: list[int] = []
    load = 0

    def flush():
        for k, ids in zip(owners, sp.encode(parts, num_threads=1), strict=True):
            counts[k] += len(ids)
        parts.clear()
        owners.clear()

    for k, text in enumerate(texts):
        if not text:
            continue
        for part in safe_parts(text) if split else (text,):
            parts.append(part)
            owners.append(k)
            load += len(part) if part.isascii() else len(part.encode())
            if load >= BATCH_BYTES:
                flush()
                load = 0
    flush()
    return counts


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """Count tokens of whole texts, without begin, end or added special tokens.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), a row for each input row. A null text counts as
    empty (0 tokens), a null id stays null, repeated rows are counted each, very long texts are encoded in parts cut at lone
    spaces. The model file must be at the same path on every executor.
    """
    model = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(count_batch(b.column(2).to_pylist(), model), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of all documents; odd rows as there."""
    return token_counts(read(spark, sf_dir, "documents"))
