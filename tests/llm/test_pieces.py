"""Piece encoding against the library with the same pieces and scores as a unigram model, and against brute force."""

import random
import re
import struct

import sentencepiece
from vigil.llm import pieces
from vigil.llm.common import read
from vigil.llm.tokens import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def unigram(path):
    """The model as a unigram one. Scores of -1e9 become -40000, since the library adds in single precision."""
    raw = open(MODEL, "rb").read()
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")
    raw = raw[: at + 9] + b"\x01" + raw[at + 10 :]
    path.write_bytes(raw.replace(struct.pack("<f", -1e9), struct.pack("<f", -40000)))
    return str(path)


ODD = ["", " ", "a", "  two  spaces ", " lead", "trail ", "tab\tand\nline", "é ü ñ", "漢字かな交じり文", "😀 ok 😀😀", "▁ own mark", "\x00\x01", "a" * 300, "≪≫⟪⟫ 𝔘𝔫𝔦", "x" * 40 + "😀", "<s> </s> <unk> <0x41>"]


def test_ids_equal_the_library(spark, sf, tmp_path):
    path = unigram(tmp_path / "unigram.model")
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path)
    texts = [r.text for r in read(spark, sf, "documents").select("text").collect()]
    short = [s for t in texts for s in re.findall(r".{1,250}", t, re.S)[:4]]  # single precision sums are exact in these
    for t in short + ODD:
        assert enc.encode(t).tolist() == lib.encode(t), t


def test_best_score_by_brute_force():
    enc, sp = pieces.codec(MODEL), pieces.piece_model(MODEL)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    rng = random.Random(2)
    for _ in range(200):
        word = "▁" + "".join(rng.choice("theraoding") for _ in range(rng.randint(1, 9)))
        best = [0.0] + [-1e18] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                if word[i:j] in scores:
                    best[j] = max(best[j], best[i] + scores[word[i:j]])
        assert sum(sp.get_score(i) for i in enc.segment(word)) == best[-1]


def test_round_trip_and_odd_rows(spark, sf):
    long = "word " * 200_000 + "x" * 100_000
    rows = [(i, t, [1]) for i, t in enumerate([*ODD, None, long, long])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>").repartition(4)
    back = {r.doc_id: r for r in pieces.decode_pieces(pieces.encode_pieces(docs)).collect()}
    for i, t, _ in rows:
        assert back[i].text == (t or "").replace("▁", " "), t
    assert back[len(ODD)].ids == [] and pieces.encode_pieces(docs.limit(0)).count() == 0
    got = pieces.op1_sentencepiece(spark, sf)
    assert got.where("not round_trip").count() == 0 and got.count() == read(spark, sf, "documents").count()
