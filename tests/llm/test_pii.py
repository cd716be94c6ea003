"""Personal data: base spans against Python's own regular expressions, and what the classifier adds."""

import hashlib
import re
import time

from vigil.llm import pii
from vigil.llm.common import read

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


TRICKY = [
    None, "", "a@b.c..d@e.f", "x@y.com_z@w.org", "a@b@c.de", "@a.b", "a@b.", "a@b.c.", "a@.b.c", "é a.b+c@d-e.f-g.h😀 q@r.st",
    "1.2.3.4.5.6.7.8", "001.2.3.255 256.1.1.1 1.2.3 1.2.3.4", "1.2.3.x1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  1111 1111 1111",
    "4111111111111111-", "12 34", "+1 (017) 555-7713", "+1-", "++1 234 567 89 10 11 12 13 14", "+1 2 3", "+49.30.1234567 call", "😀😀 +1 (243) 555-5526 😀 mail a@b.cd",
    "a@" + "b." * 30000 + "c", "9" * 50000, "1." * 20000, "a" * 100000 + "@", "4 1-" * 9000, "+1" + " 2" * 20000,
]


def test_base_spans_equal_brute_force(spark, sf):
    texts = TRICKY + [r.text for r in read(spark, sf, "documents").select("text").collect()]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, n_email int").repartition(8)
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, (t or "")[:80], want[:5])
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        assert set(want) <= set(got[i].spans.split(",")) | {""} and (not want or want[0] in got[i].spans)


def test_classifier_adds_spans_it_has_learned(spark):
    lines = [f"please call +1 (243) 555-{i:04d} or mail me{i}@mail.example.com" for i in range(60)] + ["only words here"] * 40
    lines += ["please call (243) 555-7713 now", "part 123 456 7890123 of the list", "write to ann (at) mail.example.com"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert got[100] == "phone:12:26" and got[101] == "" and got[60] == "" and got[102].startswith("email:9:")


def test_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.com or +1 (243) 555-5526.", "en"), (2, None, "en"), (3, "", "fr"), (4, "none", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "é mail <email> or <phone>." and got[2].text is None and got[3].text == "" and got[4].text == "none" and got[1].lang == "en"
    assert pii.find_pii(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_text_of_many_spans(spark):
    lines = [f"write to user{i}@host{i % 7}.example.org or +49 151 {1000000 + i} from 10.0.{i % 256}.7, née (555) 123-4567" for i in range(5400)]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, text, "kept"), (2, "a@b.de", None)], "doc_id long, text string, __base string")
    began = time.time()
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert time.time() - began < 40, "work that doesn't grow with the square of the spans takes a few seconds"
    assert rows[1].n_email == rows[1].n_ip == rows[1].n_phone == 5400
    spans = rows[1].spans.split(",")
    assert set(brute(text)) <= set(spans)
    assert clean[1]["__base"] == "kept" and clean[2].text == "<email>"
    at, out = 0, []
    for a, b, kind in sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in spans)):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, -b)
    assert clean[1].text == "".join(out) + text[at:]
