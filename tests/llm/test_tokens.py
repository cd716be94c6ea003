"""Token counts against the library on whole texts."""

from vigil.llm import tokens
from vigil.llm.common import read

MODEL = tokens.tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", " lead", "trail ", "é 漢字 😀", "<s> x </s>", "line\nbreak\t", "▁ a ▁", "x" * 200_000, "a " * 100_000, "one. two, three " * 30_000, ("ab " * 5 + "  cd\n") * 9000]


def test_counts_equal_the_library(spark, sf):
    texts = [r.text for r in read(spark, sf, "documents").select("text").collect()] + ODD + [None, "repeated", "repeated"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(5)
    got = {r.doc_id: r for r in tokens.token_counts(docs).collect()}
    sp = tokens.piece_model(MODEL)
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), (t or "")[:50]
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_parts_lose_nothing():
    sp = tokens.piece_model(MODEL)
    for t in ODD:
        for size in (10, 100):
            parts = list(tokens.safe_parts(t, size))
            assert " ".join(parts) == t and sum(map(len, sp.encode(parts))) == len(sp.encode(t))
