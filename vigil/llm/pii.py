"""Personal data by weak supervision, in DataFrame functions alone.

Spans of the four base patterns are always reported. Looser candidates are judged: a pattern, a gazetteer, a form and a
context labeler vote on every span, expectation-maximisation over the table of vote patterns estimates how reliable each
labeler is, and a logistic span classifier trained on the resulting soft labels decides which candidates join the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import cut, read

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that Java's matcher takes linear time and never recurses on long texts: runs start where no run
# goes on to the left (or right after a match), and repeated groups are runs of one class that end where the group would.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?={_HOST}++\.{_HOST})[A-Za-z0-9.-]+?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]+?(?<=[0-9])(?![0-9]|[\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms: spelled-out at signs, IPv6 addresses, shorter card numbers, local phone numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{2,24}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9]{4}[ -]?[0-9]{4,6}[ -]?[0-9]{4,5}(?![0-9]|[ -][0-9])",
    "phone": r"(?<![0-9+.-])(?<![0-9] )\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
}
# Generic top-level domains, calling codes, issuer prefixes of cards, blocks of version 6 addresses.
GENERIC_DOMAINS = "com org net edu gov mil int info biz name pro aero coop museum mobi jobs travel tel cat asia post app dev xyz online site"
CALLING_CODES = "1 7 20 27 3[0-469] 4[013-9] 5[1-8] 6[0-6] 8[1246] 9[0-58] 21[0-9] 22[0-9] 23[0-9] 24[0-9] 25[0-8] 26[0-9] 29[0-9] 35[0-9] 37[0-9] 38[0-9] 42[0-9] 50[0-9] 59[0-9] 67[0-9] 68[0-9] 69[0-2] 85[0-9] 88[0-9] 96[0-8] 97[0-9] 99[2-8]"
CARD_ISSUERS = "4 5[0-8] 222[1-9] 22[3-9] 2[3-6] 27[01] 2720 3[47] 30[0-5] 3095 3[689] 35[2-8] 6011 6[2357] 64[4-9]"
V6_BLOCKS = "[23][0-9a-f]{3} f[cd][0-9a-f]{2} fe[89ab][0-9a-f]"


#: Words that tend to stand before a span of the kind.
CONTEXT = {
    "email": r"(?i)mail|contact|write|reach|send|address",
    "ip": r"(?i)\bips?\b|host|server|address|from|login|client",
    "card": r"(?i)card|visa|master|amex|credit|debit|payment|pay\b",
    "phone": r"(?i)phone|call|tel\b|mobile|cell|fax|dial|reach|contact",
}
CONTEXT_CHARS = 32
#: Elements that one fold takes up, and characters of a piece of text: what is done for each span doesn't grow with the text.
BLOCK = 128
CHUNK = 1024
LABELERS = ("pattern", "gazetteer", "form", "context")


def gazetteers(spark: SparkSession) -> dict[str, str]:
    """Patterns of what the text of a span of each kind tends to have; the country codes are those the JVM knows."""
    one_of = lambda words: "(?:" + "|".join(words.split()) + ")"
    countries = " ".join(sorted(c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()))
    return {
        "email": rf"(?i)(?:\.|dot[)\]] ?){one_of(f'{GENERIC_DOMAINS} eu uk {countries}')}$",
        "ip": rf"(?i)^(?:{one_of(V6_BLOCKS)}:|[0-9]{{1,3}}\.)",
        "card": rf"^{one_of(CARD_ISSUERS)}",
        "phone": rf"^(?:\+{one_of(CALLING_CODES)}|\(?[2-9][0-9]{{2}}\)?[ .-])",
    }


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """The array in arrays of BLOCK elements. A fold that appends copies what it has, so it is kept to a block."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of a text in chunks."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(F.greatest(end - 1, start) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, end - start)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(doubled(i), F.lit(0))) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & _luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:int,start:int,end:int,hit:string>>"
_JUDGED = "array<struct<kind:int,start:int,end:int,pattern:int,gazetteer:int,form:int,context:int,edge:int,size:int>>"


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches with code point positions: the texts between matches tell where each begins."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(between.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    span = lambda start, hit: F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"))

    def add(acc, pair):  # positions from the block's first character on
        start = acc["at"] + F.length(pair["gap"])
        return F.struct((start + F.length(pair["hit"])).alias("at"), F.concat(acc["out"], F.array(span(start, pair["hit"]))).alias("out"))

    def follow(acc, block):
        moved = F.transform(block["out"], lambda s: span(s["start"] + acc["at"], s["hit"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    start = lambda kind: F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    folded = lambda p: F.transform(_blocks(p), lambda block: F.aggregate(block, start(_SPAN), add))
    return _let(pairs, lambda p: F.aggregate(folded(p), start(f"array<{_SPAN}>"), follow, lambda acc: F.flatten(acc["out"])))


def _possible(text: Column, kind: str, loose: bool) -> Column:
    """A cheap test that texts with a match pass."""
    if kind == "email":
        return F.rlike(text, F.lit(r"[(\[]at[)\]]")) if loose else F.contains(text, F.lit("@"))
    if kind == "phone" and not loose:
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return F.rlike(text, F.lit("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")) if loose else F.rlike(text, F.lit(r"[0-9]\.[0-9]"))
    return F.rlike(text, F.lit("[0-9]{4}"))


def _found(text: Column, kind: str, loose: bool) -> Column:
    """Spans of a kind; a base card or phone number needs fewer than four digits in a row, so its test is wider."""
    test = F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9]")) if kind == "card" and not loose else _possible(text, kind, loose)
    return F.when(test, _spans(text, kind, (LOOSE if loose else BASE)[kind])).otherwise(F.array().cast(_SPAN))


def _touches(spans: Column, c: Column) -> Column:
    """Whether c overlaps one of the spans, which are sorted and apart: the last one that starts before c ends is found by halving."""
    size = F.size(spans)

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        ahead = F.get(spans, mid)["start"] < c["end"]
        done = acc["lo"] >= acc["hi"]
        return F.struct(F.when(~done & ahead, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(~done & ~ahead, mid).otherwise(acc["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(size + F.lit(2))).cast("int"))
    last = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve, lambda acc: acc["lo"] - 1)
    return F.coalesce(F.get(spans, last)["end"] > c["start"], F.lit(False))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __base (valid base spans, by kind and start) and __loose (candidates that touch no base span, with votes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lists = gazetteers(docs.sparkSession)
    valid = lambda k: F.filter(_found(text, k, False), lambda s: _valid(k, s["hit"]))
    out = docs.withColumn("__base", F.array(*map(valid, KINDS))).withColumn("__loose", F.concat(*(_found(text, k, True) for k in KINDS)))
    apart = F.filter("__loose", lambda c: ~_by_any(lambda k: _touches(F.get("__base", F.lit(k)), c)))
    judged = lambda spans, strict: F.when(F.size(spans) > 0, _let(_chunks(text), lambda ch: F.transform(spans, lambda s: _votes(ch, s, strict, lists)))).otherwise(F.array().cast(_JUDGED))
    return out.withColumn("__loose", apart).withColumn("__base", F.flatten("__base")).withColumn("__loose", judged(F.col("__loose"), 0)).withColumn("__base", judged(F.col("__base"), 1))


def _by_any(test) -> Column:
    out = test(0)
    for k in range(1, len(KINDS)):
        out = out | test(k)
    return out


def _by_kind(kind: Column, test) -> Column:
    out = F.lit(False)
    for k, name in enumerate(KINDS):
        out = F.when(kind == k, test(name)).otherwise(out)
    return out


def _votes(chunks: Column, s: Column, strict: int, lists: dict[str, str]) -> Column:
    """The span with a vote of each labeler (1 yes, 0 no; of the context, 0 is an abstention) and two features."""
    hit = s["hit"]
    ahead = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
    before = _piece(chunks, ahead, s["start"])
    form = {
        "email": F.length(hit).between(6, 100),
        "ip": ~F.rlike(hit, F.lit(r"^0|\.0\d")),
        "card": _luhn(_digits(hit)) & F.length(_digits(hit)).between(13, 19),
        "phone": F.length(_digits(hit)).between(10, 13),
    }
    vote = lambda c: c.cast("int")
    return F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.lit(strict).alias("pattern"),
        vote(_by_kind(s["kind"], lambda k: F.rlike(hit, F.lit(lists[k])))).alias("gazetteer"),
        vote(_by_kind(s["kind"], lambda k: form[k])).alias("form"),
        vote(_by_kind(s["kind"], lambda k: F.rlike(before, F.lit(CONTEXT[k])))).alias("context"),
        vote(F.rlike(before, F.lit(r"(?:^|[\s(\[<:,;])$"))).alias("edge"),
        F.least(F.floor(F.length(hit) / 8), F.lit(4)).cast("int").alias("size"),
    )


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier, and what expectation-maximisation found."""

    bias: dict[int, float]
    weights: dict[str, float]
    reliability: dict[str, tuple[float, float]]  # of each labeler: chance of a yes on personal data, and on other spans

    def accepts(self, s: Column) -> Column:
        z = F.lit(0.0)
        for k, b in self.bias.items():
            z = F.when(s["kind"] == k, F.lit(b)).otherwise(z)
        for name, w in self.weights.items():
            z = z + s[name].cast("double") * w
        return z >= 0


def fit_spans(table: list[tuple[dict[str, int], int]], rounds: int = 40) -> SpanModel:
    """table: features (kind, votes, edge, size) and how many spans have them; bounded by the number of their combinations."""
    yes = {name: (0.8, 0.3) for name in LABELERS}
    prior = {k: 0.5 for k in range(len(KINDS))}

    def posterior(x):
        p, q = prior[x["kind"]], 1 - prior[x["kind"]]
        for name in LABELERS:
            a, b = yes[name]
            if x[name]:
                p, q = p * a, q * b
            elif name != "context":
                p, q = p * (1 - a), q * (1 - b)
        return p / (p + q)

    for _ in range(rounds):
        soft = [(x, n, posterior(x)) for x, n in table]
        for k in prior:
            prior[k] = (1 + sum(n * p for x, n, p in soft if x["kind"] == k)) / (2 + sum(n for x, n, _ in soft if x["kind"] == k))
        for name in LABELERS:
            seen = [(x[name], n, p) for x, n, p in soft]
            sure, unsure = sum(n * p for _, n, p in seen), sum(n * (1 - p) for _, n, p in seen)
            yes[name] = (3.2 + sum(n * p for v, n, p in seen if v)) / (4 + sure), (0.8 + sum(n * (1 - p) for v, n, p in seen if v)) / (4 + unsure)
    soft = [(x, n, posterior(x)) for x, n in table]
    total = sum(n for _, n, _ in soft) or 1
    names = (*LABELERS, "edge", "size")
    w, bias = dict.fromkeys(names, 0.0), dict.fromkeys(range(len(KINDS)), 0.0)
    for _ in range(400):  # logistic regression on soft labels, weighted by counts
        g, gb = dict.fromkeys(names, 0.0), dict.fromkeys(bias, 0.0)
        for x, n, p in soft:
            z = bias[x["kind"]] + sum(w[f] * x[f] for f in names)
            d = (1 / (1 + math.exp(-max(-30, min(30, z)))) - p) * n / total
            gb[x["kind"]] += d
            for f in names:
                g[f] += d * x[f]
        for f in names:
            w[f] -= 0.5 * (g[f] + 1e-3 * w[f])
        for k in bias:
            bias[k] -= 0.5 * (gb[k] + 1e-3 * (bias[k] + 1))  # an unseen kind leans to no
    return SpanModel(bias, w, yes)


def vote_table(found: DataFrame) -> list[tuple[dict[str, int], int]]:
    """How many spans have each combination of kind, votes and features: 4 x 16 x 2 x 5 rows at most."""
    names = ["kind", *LABELERS, "edge", "size"]
    rows = found.select(F.explode(F.concat("__base", "__loose")).alias("s")).groupBy(*(F.col(f"s.{n}").alias(n) for n in names)).agg(F.count("*").alias("n"))
    return sorted((({n: r[n] for n in names}, r.n) for r in rows.collect()), key=lambda x: sorted(x[0].items()))


def _all_spans(model: SpanModel) -> Column:
    place = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return F.array_sort(F.transform(F.concat("__base", F.filter("__loose", model.accepts)), place))


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of whole texts: id_col, a count of base spans for each kind, base_sha256, spans (kind:start:end, code points).

    A row for each input row. Null and empty texts have no spans; repeated rows are judged alike; candidates that overlap a base
    span are dropped; an empty table gives no rows. Texts are read once: spans without texts are kept in the shared folder.
    """
    found = cut(with_candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).drop("text"))
    model = fit_spans(vote_table(found))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(F.col("id").alias(id_col), *map(count, range(len(KINDS))), F.sha2(_written(F.col("__base")), 256).alias("base_sha256"), _written(_all_spans(model)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in text_col replaced by its kind in angle brackets, such as <email>; of overlapping
    spans the first stays, the longer of two with one start. Null texts stay null, other columns stay as they are."""
    found = with_candidates(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text")))
    model = fit_spans(vote_table(with_candidates(docs.select(F.col(text_col).alias("text")))))
    by_start = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    kept = "array<struct<start:int,end:int,kind:int>>"  # text before a span that stays, and its kind

    def add(acc, s):
        one = F.struct(acc["at"].alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(one)))
        return F.struct(F.greatest(acc["at"], -s["less"]).alias("at"), out.alias("out"))

    def reach(acc, block):  # how far the spans before each block go
        return F.struct(F.greatest(acc["at"], -F.array_min(F.transform(block, lambda s: s["less"]))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def clean(text: Column, spans: Column) -> Column:
        start = lambda at, kind: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))
        whole = lambda blocks: F.aggregate(blocks, start(F.lit(0), "array<int>"), reach)
        parts = lambda blocks, seen: F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, start(F.get(seen["out"], i), kept), add, lambda acc: acc["out"])))
        name = lambda p: F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), p["kind"] + 1), F.lit(">"))
        joined = lambda ch, blocks, seen: F.concat(F.array_join(F.transform(parts(blocks, seen), lambda p: F.concat(_piece(ch, p["start"], p["end"]), name(p))), ""), _piece(ch, seen["at"], F.greatest(F.length(text), seen["at"])))
        return _let(_chunks(text), lambda ch: _let(_blocks(by_start(spans)), lambda blocks: _let(whole(blocks), lambda seen: joined(ch, blocks, seen))))

    spans = found.select("row", "text", _all_spans(model).alias("spans"))
    done = spans.select("row", F.when(F.size("spans") > 0, clean(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("text"))
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_pii() of all documents; odd rows as there."""
    return find_pii(read(spark, sf_dir, "documents"))
