"""HTML extraction: the main text of a page is the best contiguous run of its tokens, where words score positive and tags negative.

A page becomes a list of tokens: stretches of words, each with the place it stands in, and tags. Weights are log odds of being content,
counted over labelled pages, which are those that mark their article themselves (an article or main element). One linear scan finds the
run of the highest total. Whatever inside that run belongs to a menu, form, advert or the like is left out of the text; it costs the
run two tags and nothing more, so a long advert in mid-article can't split it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import read, with_fields

#: About how many pages are read to fit the weights, labelled ones among them; chosen by hash.
FIT_PAGES = 20_000
#: Prior counts (content, rest) of words, of linked words, of words beside a marked article; and the ranges of the weights.
PLAIN, LINKED, BESIDE = (30.0, 3.0), (3.0, 6.0), (0.1, 30.0)
WORD_RANGE, TAG_RANGE = 3.0, (-4.0, -0.05)
#: What opening or closing a left-out element costs.
LEFT_OUT_TAG = -0.3

_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_TEXTUAL = frozenset("p blockquote pre dd dt figcaption".split())
_LISTED = frozenset("li td th".split())
_BLOCKS = _HEADINGS | _TEXTUAL | _LISTED | frozenset("address article aside body caption center details dialog dir div dl fieldset figure footer form frameset head header hr html legend main menu nav ol optgroup option search section select summary table tbody template tfoot thead tr ul noscript".split())
#: Elements that are never content.
_OUT = _RAW | frozenset("head nav footer aside form button select option optgroup datalist dialog menu noscript template svg canvas object audio video map search".split())
#: An article or main element inside one of these is content all the same, as some pages wrap everything in a form.
_SOFT = frozenset(("form", "header"))
#: Words in class, id and role that mark an element as no content, and those that mark it also where it is the article element itself.
_HINTS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist complementary consent
    contentinfo cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menubar menus modal nav navbar navigation newsletter notice notices
    pager pagination popup promo promoted promotion recommendations recommended related replies reply search share sharing sidebar signup social sponsor sponsored
    subscribe subscription toolbar widget widgets""".split()
)
_ARTICLE_HINTS = frozenset("ad ads advert advertisement comment comments promo promoted recommended related reply replies sponsored".split())
_NOT_HINTS = frozenset("with without has no js is".split())
_HEADER_OF = frozenset("article entry post story content".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=>/"']++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW}


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, ""), in order. Comments, declarations and what script and
    the like hold are skipped. An unclosed comment or tag reaches to the end of the page."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        nxt = page[lt + 1 : lt + 2]
        named = nxt.isascii() and (nxt.isalpha() or (nxt == "/" and (after := page[lt + 2 : lt + 3]).isascii() and after.isalpha()))
        if not named and nxt not in ("!", "?", "/"):  # a plain sign
            if lt + 1 >= n:
                yield "text", page[at:], ""
                return
            yield "text", page[at : lt + 1], ""
            at = lt + 1
            continue
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                at = page.index(">", lt) + 1
                continue
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif not named:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        else:
            m = _TAG.match(page, lt)
            if m:
                closing, name, attributes, at = m[1], m[2].lower(), m[3], m.end()
            else:  # a quote stays open: the tag ends at the first sign that can end it
                end = page.find(">", lt)
                if end < 0:
                    return
                words = page[lt + 1 : end].split(None, 1)
                closing, name, attributes, at = "/" * (nxt == "/"), words[0].strip("/").lower(), (words[1] if len(words) > 1 else ""), end + 1
            if closing:
                yield "close", name, ""
                continue
            yield "open", name, attributes
            if name in _RAW and (end := _CLOSERS[name].search(page, at)) is not None:
                at = end.start()
            elif name in _RAW:
                return


def left_out(name: str, attributes: str) -> str:
    """Why an element is no content ("hard", or "soft" if an article inside it is content all the same), or ""."""
    if name in _OUT:
        return "soft" if name in _SOFT else "hard"
    if name == "header":
        return "soft"
    if not attributes or name in ("html", "body", "main"):
        return ""
    for m in _ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        if kind not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = m[2] or m[3] or m[4] or ""
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true") or (kind == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            return "hard"
        if kind in ("hidden", "aria-hidden", "style"):
            continue
        for word in value.split():
            parts = {p.lower() for p in _PART.findall(word)}
            if parts & _NOT_HINTS:
                continue
            if parts & (_ARTICLE_HINTS if name == "article" else _HINTS):
                return "hard"
            if "header" in parts and not parts & _HEADER_OF:
                return "soft"
    return ""


@dataclass(slots=True)
class Token:
    """words > 0: a stretch of text in block number block; else a tag. key: what its weight depends on; inside: article 2, main 1, else 0."""

    key: str
    words: int
    text: str
    block: int
    inside: int
    out: bool


def tokens(page: str) -> list[Token]:
    """The page's tokens. Text in left-out elements is not among them, and of such an element only its own two tags are."""
    found: list[Token] = []
    stack: list[tuple[str, int, str]] = []  # name, bits of what it changed, its block's kind before
    opened: Counter[str] = Counter()
    out, soft, links, block, kind = 0, 0, 0, 0, "other"
    articles = mains = 0

    def leave() -> str:
        nonlocal out, soft, links, kind, articles, mains
        name, bits, before = stack.pop()
        opened[name] -= 1
        out -= bits & 1
        soft -= bits >> 1 & 1
        links -= bits >> 2 & 1
        articles -= bits >> 3 & 1
        mains -= bits >> 4 & 1
        if name in _BLOCKS:
            kind = before
        if bits & 32:  # softly left-out elements around an article
            soft += bits >> 6
        if (bits & 3) and not out and not soft:
            found.append(Token("left out", 0, "", block, 2 if articles else 1 if mains else 0, True))
        return name

    for what, name, attributes in markup(page):
        if what == "text":
            if out or soft:
                continue
            text = entities.unescape(name) if "&" in name else name
            words = len(text.split())
            if words or text:
                found.append(Token(f"{kind}{'+link' * bool(links)}", words, text, block, 2 if articles else 1 if mains else 0, False))
            continue
        if name in _BLOCKS:
            block += 1
        if what == "open":
            if name == "br" and not (out or soft):
                found.append(Token("br", 0, " ", block, 2 if articles else 1 if mains else 0, False))
            if name in _VOID:
                continue
            if name == "p" and stack and stack[-1][0] == "p":  # an open paragraph ends where the next one begins
                leave()
            why = left_out(name, attributes)
            holds = name in ("article", "main") or (name in ("div", "section") and ("articleBody" in attributes or re.search(r"""role\s*=\s*["']?main\b""", attributes) is not None))
            if why == "soft" and (articles or mains) and name == "header":
                why = ""  # the heading of an article
            bits = 0
            if why == "hard":
                bits |= 1
            elif why == "soft":
                bits |= 2
            elif holds and not out:
                bits |= (8 if name != "main" and "main" not in attributes else 16) | 32 | soft << 6
                soft = 0
            if name == "a":
                bits |= 4
            if not (out or soft):
                found.append(Token("left out" if why else "<article" if holds else f"<{name}" if name in _BLOCKS else "<inline", 0, "", block, 2 if articles else 1 if mains else 0, bool(why)))
            out += bits & 1
            soft += bits >> 1 & 1
            links += bits >> 2 & 1
            articles += bits >> 3 & 1
            mains += bits >> 4 & 1
            stack.append((name, bits, kind))
            opened[name] += 1
            if name in _BLOCKS:
                kind = "heading" if name in _HEADINGS else "text" if name in _TEXTUAL else "listed" if name in _LISTED else "other"
        elif opened[name] > 0:
            while True:
                visible = not (out or soft)
                gone = leave()
                if visible:
                    found.append(Token("</article" if gone in ("article", "main") else f"</{gone}" if gone in _BLOCKS else "</inline", 0, "", block, 2 if articles else 1 if mains else 0, False))
                if gone == name:
                    break
    return found


def marked(found: list[Token]) -> int:
    """The level that holds the page's article: 2 if an article element has words, else 1 if a main element has, else 0."""
    return max((t.inside for t in found if t.words), default=0)


def keyed(found: list[Token], level: int) -> Iterator[tuple[str, int]]:
    """Key and number of units of each token, where the article is marked at that level (0: not at all)."""
    for t in found:
        yield (t.key + ("+beside" if level and t.inside < level else ""), t.words) if t.words else (t.key, int(not t.text))


def counts(found: list[Token]) -> Counter[tuple[str, bool]]:
    """Of a labelled page, how many words and tags of each key are content; counted as marked, and as if its marks were not there."""
    level, got = marked(found), Counter()
    if level:
        for seen in (level, 0):
            for t, (key, n) in zip(found, keyed(found, seen), strict=True):
                if n and not t.out and not (seen == 0 and key in ("<article", "</article")):
                    got[key, t.inside >= level and key not in ("<article", "</article")] += n
    return got


def weights(got: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each key, smoothed and bounded; tags below zero."""
    out = {}
    for key in {k for k, _ in got} | {f"{a}{b}{c}" for a in ("heading", "text", "listed", "other") for b in ("", "+link") for c in ("", "+beside")}:
        yes, no = got.get((key, True), 0), got.get((key, False), 0)
        if key.startswith("<"):
            out[key] = min(TAG_RANGE[1], max(TAG_RANGE[0], math.log((yes + 1.0) / (no + 1.0))))
        else:
            a, b = BESIDE if "+beside" in key else LINKED if "+link" in key else PLAIN
            out[key] = min(WORD_RANGE, max(-WORD_RANGE, math.log((yes + a) / (no + b))))
    return out | {"left out": LEFT_OUT_TAG, "br": TAG_RANGE[1]}


def scores(found: list[Token], weight: dict[str, float]) -> list[float]:
    return [n * weight.get(key, TAG_RANGE[1]) for key, n in keyed(found, marked(found))]


def best_run(values: list[float]) -> tuple[int, int]:
    """First and end of the contiguous run with the highest positive total, in one scan; of equal ones the first and shortest. (0, 0) if none."""
    best, first, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, v in enumerate(values):
        if total <= 0.0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, first, end = total, start, i + 1
    return first, end


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The main text: blocks of the best run, each with single spaces, joined by line breaks."""
    if not page:
        return ""
    found = tokens(page)
    first, end = best_run(scores(found, weight))
    blocks: list[str] = []
    parts: list[str] = []
    at = -1
    for t in found[first:end]:
        if t.block != at:
            blocks.append("".join(parts))
            parts, at = [], t.block
        parts.append(t.text)
    blocks.append("".join(parts))
    return "\n".join(line for b in blocks if (line := " ".join(b.split())))


def fit_weights(pages: DataFrame, html_col: str = "html", sample: int = FIT_PAGES) -> dict[str, float]:
    """Weights from about `sample` pages by hash, of which the labelled ones count. The driver gets one row for each key and label, some
    hundreds at most. Without labelled pages the priors stand alone."""

    def count(batches):
        for b in batches:
            got: Counter[tuple[str, bool]] = Counter()
            for page in b.column(0).to_pylist():
                got.update(counts(tokens(page)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([c for _, c in got], pa.bool_()), pa.array(list(got.values()), pa.int64())], names=["key", "content", "n"])

    rows = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).alias("html"))
    share = sample / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("html"), 33) < int(share * 2**31))
    found = rows.mapInArrow(count, "key string, content boolean, n long").groupBy("key", "content").agg(F.sum("n").alias("n"))
    return weights({(r.key, r.content): r.n for r in found.collect()})


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", weight: dict[str, float] | None = None) -> DataFrame:
    """pages without html_col, with text_col and n_chars (long, code points).

    A row for each input row. A null or empty page, and one without a run of positive score, gives an empty text. Very long pages are
    scanned in one go, in linear time. Repeated pages give repeated texts; of equal runs the first is taken. An empty table gives no
    rows. Columns of the input named text_col or n_chars are replaced; all others are kept.
    """
    if weight is None:
        weight = fit_weights(pages, html_col)
    keep = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    rest = [f"c{i}" for i in range(len(keep))]

    def run(batches):
        for b in batches:
            texts = [main_text(page, weight) for page in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*rest, "text", "n_chars"])

    rows = pages.select(*(F.col(f"`{c}`").alias(r) for c, r in zip(keep, rest, strict=True)), F.col(f"`{html_col}`").alias("html"))
    out = rows.mapInArrow(run, with_fields(rows.schema.fields[:-1], "text string, n_chars long"))
    return out.select(*(F.col(r).alias(c) for c, r in zip(keep, rest, strict=True)), F.col("text").alias(text_col), "n_chars")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_main_text() of all pages; odd rows as there."""
    return extract_main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
