"""Corpus pipeline: from documents to packed token sequences. Part of the training-data operators and removed with them.

Each stage reads what the stage before it wrote, in full, and returns the columns of documents (the last one: packed pieces).
Each stage's share of the work is its operator; this module only applies their decisions.

All stages take documents with doc_id and text and any other columns, whatever their names, and keep these. An empty table gives an
empty one. Texts of any length are worked through whole; what each stage does with nulls, ties and repeated rows, it says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import packing, pii, quality, simhash, substrings
from vigil.llm.common import cut, cuts_made, drop_paths, held, read, released

#: Documents scored below this are rejected.
MIN_QUALITY = 0.3


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars after a change of the texts, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts: a score of MIN_QUALITY or more. Null and empty texts have the score of
    an empty text, documents with a null id are scored like others, repeated rows and equal texts share one fate. Rows and their
    columns stay as they are. Without labels every score is even and all documents stay."""
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_quality(held(docs, text="text"), model)
    return released(scored.where(F.col("score") >= MIN_QUALITY), docs.columns, text="text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id. Candidates are the components of op5's trie self-join of
    fingerprints, of five-word shingles, and what bands of least shingle hashes add beyond its three bits; links are checked exactly. Ids with several texts, repeated rows, null ids and texts
    without words are treated as keep_one() says."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of passages that start earlier. Texts that lose a word get single spaces, null ones become empty, others
    stay as they are, and so do rows, also those of null and of repeated ids. n_chars follows the text."""
    return _measured(substrings.remove_substrings(docs)).select(*(f"`{c}`" for c in docs.columns))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null texts stay null; every row stays, repeated ones are judged alike. n_chars
    follows the text."""
    return _measured(pii.redact(docs)).select(*(f"`{c}`" for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences without padding; a null or empty text is its closing id alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each_group),
    ("repeated passages", without_repeats),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: SQL can't train the classifier or tokenise; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted as soon as its result is stored."""
    docs = read(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        with cuts_made() as made:
            docs = cut(stage(spark, docs, sf_dir))
        drop_paths(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
