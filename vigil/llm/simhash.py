"""Near-duplicates by SimHash: fingerprints, a binary trie self-join, and connected components.

Fingerprints that differ in at most three of their bits agree in one of four blocks of bits, so each distinct fingerprint goes to
four buckets and a pair within reach meets in one of them; buckets with too many are split by four blocks of their remaining
bits, and again, by the same argument. In a bucket the sorted fingerprints are a binary trie whose nodes are ranges; pairs of
nodes are traversed together from the root, differing bits add up, and a pair of nodes is dropped once they exceed the budget.
Buckets report a star for each local group, not its pairs.

Fingerprints can't hold all pairs whose shingle sets have a similarity of 0.8, which differ in about ten bits: blocks for so many
are too short to tell texts apart. near_copies() takes as candidates the components of the trie self-join of fingerprints, and for
pairs beyond its reach also texts that meet in a band of least shingle hashes; it compares the sets of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import SPACE, cut, gram_hashes, held, mix, read, released, span_hashes, text_slices, with_fields, word_bounds

SHINGLE = 3
SEED = 42
BUDGET = 3
#: Fingerprints in a bucket above which it is split, and about how many a task joins.
BUCKET_ROWS = 20_000
TASK_ROWS = 100_000
#: Node pairs held at once, and leaf pairs compared directly instead of being followed down.
FRONTIER = 400_000
SMALL = 16
#: Words of a shingle and least similarity (Jaccard, of shingle sets) of near copies.
COPY_SHINGLE = 5
SIMILARITY = 0.8
#: Bands of BAND least hashes each: a pair of similarity 0.8 meets in none with probability (1 - 0.8 ** 4) ** 20, 3 in 100,000.
BANDS, BAND = 20, 4
#: Different texts of a band, and shingles of theirs, that are compared in one group; larger ones are compared by blocks.
BLOCK_ROWS = 1_000
BLOCK_SHINGLES = 500_000
#: Bands whose links are found first, with those in components of fingerprints (which count as band TRIE); of all bands only texts that
#: these don't connect are compared then.
FIRST_BANDS = 4
TRIE = -1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _simhashes(data: np.ndarray, offsets: np.ndarray, k: int, seed: int, step: int = 300_000) -> np.ndarray:
    """Fingerprints (n rows of 8 bytes, high bits first) of texts; shingles are slices of the text with single spaces."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    solid = ~SPACE[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    flat = _LOWER[data]
    flat[~solid] = 0x20
    place = np.concatenate([[0], np.cumsum(keep)])
    buf = flat[keep].tobytes()
    words = np.diff(first)
    shingles = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(n), shingles)
    head = np.repeat(first[:-1], shingles) + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    tail = np.minimum(head + k, first[1:][owner]) - 1
    a, b = place[starts[head]] if len(head) else head, place[ends[tail]] if len(tail) else tail
    counts, digest = np.zeros((n, 64), np.int64), xxhash.xxh64_digest
    for i in range(0, len(owner), step):
        raw = b"".join([digest(buf[x:y], seed) for x, y in zip(a[i : i + step].tolist(), b[i : i + step].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        own = owner[i : i + step]
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > shingles[:, None], axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id_col and fp (the fingerprint as a signed long) of whole texts; null and empty texts have fp 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                fp = _simhashes(data, offsets, k, seed).view(">i8").ravel().astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(first, end - first), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


class Groups:
    """Union-find over positions, fed with arrays of pairs; a group's label is its smallest position."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
            self.label = label


def _pairs(lo1, hi1, lo2, hi2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions from pairs of ranges; a range with itself gives each pair once."""
    n1, n2 = hi1 - lo1, hi2 - lo2
    total = n1 * n2
    at = np.repeat(np.arange(len(total)), total)
    within = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
    u, v = lo1[at] + within // n2[at], lo2[at] + within % n2[at]
    keep = u < v
    yield u[keep], v[keep]


def trie_groups(keys: np.ndarray, fps: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Self-join of each bucket (equal keys) of distinct unsigned fingerprints. Returns sorted keys and fingerprints and the label
    (a position) of each one's group: those linked by chains of pairs that differ in at most budget bits."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    n = len(fps)
    ones = np.zeros((64, n + 1), np.int32)
    for d in range(64):
        np.cumsum((fps >> np.uint64(63 - d)) & np.uint64(1), out=ones[d, 1:])
    groups = Groups(n)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if n else np.zeros(1, np.int64)
    lo, hi = edges[:-1], edges[1:]
    stack = [(0, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while stack:
        depth, nodes = stack.pop()
        lo1, hi1, lo2, hi2, _ = nodes
        small = ((hi1 - lo1) * (hi2 - lo2) <= SMALL) | (depth == 64)
        for i in range(0, int(small.sum()), FRONTIER // SMALL):
            part = np.flatnonzero(small)[i : i + FRONTIER // SMALL]
            for u, v in _pairs(lo1[part], hi1[part], lo2[part], hi2[part]):
                near = np.bitwise_count(fps[u] ^ fps[v]) <= budget
                groups.add(u[near], v[near])
        nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        if nodes.shape[1] > FRONTIER:
            half = nodes.shape[1] // 2
            stack += [(depth, nodes[:, :half]), (depth, nodes[:, half:])]
            continue
        lo1, hi1, lo2, hi2, err = nodes
        at = ones[depth]
        mid1, mid2 = hi1 - (at[hi1] - at[lo1]), hi2 - (at[hi2] - at[lo2])
        own = lo1 == lo2  # ranges of one depth are equal or apart
        child = [np.stack([lo1, mid1, lo2, mid2, err]), np.stack([mid1, hi1, mid2, hi2, err]), np.stack([lo1, mid1, mid2, hi2, err + 1]), np.stack([mid1, hi1, lo2, mid2, err + 1])[:, ~own]]
        nodes = np.concatenate(child, axis=1)
        stack.append((depth + 1, nodes[:, (nodes[4] <= budget) & (nodes[0] < nodes[1]) & (nodes[2] < nodes[3])]))
    return keys, fps, groups.label


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """Each row (key, fp, rest of width bits) four times: a new key with one block of rest, and the other blocks as rest."""
    size = width // 4
    options = []
    for b in range(4):
        low = width - size * (b + 1)
        block = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << size) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", low + size), low) if b else F.lit(0).cast("long")
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("long")
        options.append(F.struct(F.xxhash64("key", F.lit(b), block).alias("key"), above.bitwiseOR(below).alias("rest")))
    return rows.select("fp", F.explode(F.array(*options)).alias("o")).select("o.key", "fp", "o.rest")


def near_links(nodes: DataFrame, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints (fp) within budget differing bits, up to connectivity: a star for each
    bucket and local group. Needs budget 3 or less."""
    rows, width, done = nodes.select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("rest")), 64, []
    while True:
        rows = cut(_blocks(rows, width))
        width -= width // 4
        hot = cut(rows.groupBy("key").count().where(F.col("count") > bucket_rows).select("key"))
        if width < 24 or hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, "key", "left_anti"))
        rows = rows.join(hot, "key", "left_semi")

    def run(table: pa.Table) -> pa.Table:
        keys, fps = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        _, fps, label = trie_groups(keys, fps, budget)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": fps[linked].view(np.int64), "v": fps[label[linked]].view(np.int64)})

    parts = []
    for part in done:
        tasks = max(1, nodes.sparkSession.sparkContext.defaultParallelism, part.count() // TASK_ROWS)
        grouped = part.select("key", "fp", F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task")).groupBy("task")
        parts.append(grouped.applyInArrow(run, "u long, v long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def components(links: DataFrame) -> DataFrame:
    """u and its component's smallest member v, for all u that have a link, except those smallest members, by large and small
    stars in turn until the links stay the same. links: u, v."""
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before, now = None, mark(edges)
    while now != before:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(down.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, mark(edges)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, seed: int = SEED, budget: int = BUDGET) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (the smallest id reachable over links) for each row.

    Repeated rows share a fingerprint and so a component. Null and empty texts have fingerprint zero and are linked like others. A
    null id never is a component's name; a component of null ids alone has a null name. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, id_col, text_col, k, seed))
    nodes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    linked = components(near_links(nodes, budget))
    rooted = cut(nodes.join(linked, nodes.fp == linked.u, "left").select("fp", "least", F.coalesce("v", "fp").alias("root")))
    names = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = cut(rooted.join(names, "root").select("fp", "component_id"))
    return marked.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents; odd rows as there."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = COPY_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of texts, sorted in each text, and the index of each text's first one (n + 1 values). A text
    of fewer than k words is one shingle."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    hashes, words = span_hashes(_LOWER[data], starts, ends), np.diff(first)
    owner, value = [], []
    for size in range(1, k + 1):
        rows = np.flatnonzero(words == size if size < k else words >= k)
        count = words[rows] - size + 1
        own = np.repeat(rows, count)
        grams = gram_hashes(hashes, size)
        owner.append(own)
        value.append(grams[first[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)] if len(own) else grams[:0])
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])[: len(value)]
    return value[new], np.searchsorted(owner[new], np.arange(n + 1))


def _bands(sets: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """BANDS keys for each text (none of them empty)."""
    rng = np.random.default_rng(SEED)
    keys = np.empty((len(heads), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(heads), b, np.uint64)
        for salt in rng.integers(1, 2**63, BAND, dtype=np.uint64):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(mix(sets ^ salt), heads))
        keys[:, b] = key
    return keys


def _noted(rows: DataFrame, columns: list[str], k: int, bands: bool = False) -> DataFrame:
    """columns of rows (which has `text`) with __node (a hash of the text's set of shingles) and, if asked for, __bands, __size (of that set) and __fp (the fingerprint)."""
    own = columns if "text" in columns else [*columns, "text"]
    rows = rows.select(*own)
    at, width = own.index("text"), len(columns)

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(at)):
                sets, heads = shingle_sets(data, offsets, k)
                raw, edges = sets.tobytes(), (heads * 8).tolist()
                node = np.array([xxhash.xxh64_intdigest(raw[x:y], SEED) for x, y in zip(edges, edges[1:], strict=False)], np.uint64)
                out = [*(c.slice(first, end - first) for c in batch.columns[:width]), pa.array(node.view(np.int64))]
                if bands:
                    full = heads[:-1] < heads[1:]
                    keys = _bands(sets, heads[:-1][full]) if full.any() else np.zeros(0, np.uint64)
                    out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32), keys.ravel().view(np.int64)))
                    out.append(pa.array(np.diff(heads)))
                    out.append(pa.array(_simhashes(data, offsets, k, SEED).view(">i8").ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "__node", "__bands", "__size", "__fp"][: len(out)])

    return rows.mapInArrow(run, with_fields(rows.schema.fields[:width], "__node long" + ", __bands array<long>, __size long, __fp long" * bands))


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that connect all sets of the similarity or more, up to connectivity. Sets of one root are connected already;
    where there are several sides, only pairs across them count."""
    size = np.array([len(s) for s in sets])
    order, both, label = np.argsort(size, kind="stable"), len(set(side.tolist())) > 1, np.unique(root, return_inverse=True)[1]
    sizes, found = size[order], []
    for x, i in enumerate(order):
        rest = order[x + 1 : np.searchsorted(sizes, size[i] / similarity + 1e-9, "right")]
        for j in rest[(label[rest] != label[i]) & ((side[rest] != side[i]) | (not both))]:
            if label[i] == label[j]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= similarity * (size[i] + size[j] - common) - 1e-9:
                found.append((i, j))
                label[label == label[j]] = label[i]
    u, v = np.array(found, np.int64).reshape(-1, 2).T
    return u, v


def _compared(met: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (u, v) of similar_pairs() in each group (key, kind, lo, hi) of met, which also has node, side and root."""

    def run(table: pa.Table) -> pa.Table:
        node, side, root = (table.column(c).to_numpy() for c in ("node", "side", "root"))
        sets = []
        for _, _, data, offsets in text_slices(table.column("text")):
            flat, heads = shingle_sets(data, offsets, k)
            sets += np.split(flat, heads[1:-1])
        u, v = similar_pairs(sets, side, root, similarity)
        return pa.table({"u": node[u], "v": node[v]})

    return met.join(texts, "node").groupBy("key", "kind", "lo", "hi").applyInArrow(run, "u long, v long")


def copy_links(docs: DataFrame, nodes: DataFrame, k: int, similarity: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (u, v) that connect the nodes (__node, __bands, __size, __fp) of the similarity or more: those that lie in one component
    of fingerprints or share a band, and whose sets of shingles, made from the `text` of docs, are so similar.

    Components of fingerprints, which near_links() finds, are treated like bands. First the texts of these and of FIRST_BANDS are
    compared; a band's many texts are dealt into blocks, twice, and only compared inside those.
    As the blocks of both deals and of several bands overlap, that connects a large group of copies in time in proportion to its size.
    Then each band's texts are compared that are not in one component yet: all others with the band's largest component and with
    each other, by blocks. So every pair of a band is compared or connected.
    """
    rows = nodes.select(F.col("__node").alias("node"), F.col("__size").alias("size"), F.posexplode("__bands").alias("pos", "key"))
    chains = components(near_links(cut(nodes.select(F.col("__fp").alias("fp")).distinct())))
    of_trie = nodes.join(chains, nodes["__fp"] == chains.u, "left").withColumn("key", F.xxhash64(F.lit(TRIE), F.coalesce("v", "__fp")))
    rows = rows.unionByName(of_trie.select(F.col("__node").alias("node"), F.col("__size").alias("size"), F.lit(TRIE).alias("pos"), "key"))
    bands = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.min("pos").alias("pos"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.min("node").alias("m"))
    bands = bands.where("n > 1").groupBy("n", "w", "s", "m").agg(F.min(F.struct("pos", "key")).alias("at"))  # bands of the same nodes once
    bands = cut(bands.select("at.pos", "at.key", "n", "w"))
    met = cut(rows.drop("pos").join(bands, "key"))
    texts = _noted(docs, ["text"], k).select(F.col("__node").alias("node"), "text")
    texts = cut(texts.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")))

    def blocks(n: str, w: str) -> Column:
        return F.expr(f"cast(ceil(greatest(({n}) / {block_rows}, ({w}) / {BLOCK_SHINGLES})) as int)")

    dealt = met.where(F.col("pos") < FIRST_BANDS).withColumn("b", blocks("n", "w")).withColumn("lo", F.expr("explode(if(b > 1, array(0, 1), array(0)))"))
    dealt = dealt.select("key", F.lit(0).alias("kind"), "lo", F.expr("cast(pmod(xxhash64(node, key, lo), b) as int)").alias("hi"), "node", F.lit(0).alias("side"), F.col("node").alias("root"))
    linked = components(_compared(dealt, texts, k, similarity))

    named = cut(met.join(linked, met.node == linked.u, "left").select("key", "node", "size", "n", "w", F.coalesce("v", "node").alias("root")))
    parts = named.groupBy("key", "root").agg(F.count("*").alias("top_n"), F.sum("size").alias("top_w"))
    tops = parts.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("top_n", "root", "top_w")).alias("t")).where("roots > 1")
    apart = named.join(tops.select("key", "t.top_n", "t.top_w", F.col("t.root").alias("top")), "key")
    apart = apart.withColumns({"b": blocks("n", "w"), "tb": blocks("top_n", "top_w"), "ob": blocks("n - top_n", "w - top_w")})
    apart = apart.withColumn("own", F.expr("cast(pmod(xxhash64(node), if(root = top, tb, ob)) as int)"))
    one = "array(named_struct('kind', 0, 'lo', 0, 'hi', 0, 'side', 0))"
    of_top = "transform(sequence(0, ob - 1), x -> named_struct('kind', 1, 'lo', own, 'hi', x, 'side', 0))"
    to_top = "transform(sequence(0, tb - 1), x -> named_struct('kind', 1, 'lo', x, 'hi', own, 'side', 1))"
    others = "transform(sequence(0, ob - 1), x -> named_struct('kind', 2, 'lo', least(own, x), 'hi', greatest(own, x), 'side', own))"
    apart = apart.withColumn("g", F.explode(F.expr(f"case when b = 1 then {one} when root = top then {of_top} else concat({to_top}, {others}) end")))
    rest = _compared(apart.select("key", "g.*", "node", "root"), texts, k, similarity)
    return linked.select("u", "v").unionByName(rest)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COPY_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """id_col, __node, root (a component's least node) and component_id (the smallest id reachable over pairs of the similarity or
    more) for each row; ids as in near_duplicates(). Texts without words are copies of each other."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = cut(_noted(rows, ["id"], k, bands=True))
    nodes = cut(marked.groupBy("__node").agg(F.min("id").alias("least"), F.first("__bands").alias("__bands"), F.first("__size").alias("__size"), F.min("__fp").alias("__fp")))
    linked = components(copy_links(rows, nodes, k, similarity))
    rooted = cut(nodes.join(linked, nodes["__node"] == linked.u, "left").select("__node", "least", F.coalesce("v", "__node").alias("root")))
    names = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_node = cut(rooted.join(names, "root").select("__node", "root", "component_id"))
    return marked.join(by_node, "__node").select(F.col("id").alias(id_col), "__node", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component of near copies, the one of the smallest id, whole and with all its columns, whatever
    their names. Candidates lie in one component of the trie self-join of fingerprints or meet in a band of least shingle hashes, and
    links are checked exactly.

    Where rows of that id have several texts in the component, that of the least hash stays; of repeated rows of both one stays. Rows
    with a null id can't stand for a component and all stay. Null and empty texts and texts of white space alone are copies of each
    other; a text of fewer than five words is one shingle; very long texts are one slice each. An empty table gives no rows.
    """
    names = {"id": id_col, "text": text_col}
    rows = held(docs, **names)
    groups = near_copies(rows, "id", "text")
    mine = groups.where(F.col("id") == F.col("component_id"))
    chosen = cut(mine.groupBy("root").agg(F.first("id").alias("id"), F.min("__node").alias("__node")).drop("root"))
    known = _noted(rows.where("id is not null"), ["id", "text", "held"], COPY_SHINGLE)
    kept = known.join(chosen, ["id", "__node"], "left_semi").dropDuplicates(["id", "__node"]).drop("__node")
    return released(kept.unionByName(rows.where("id is null")), docs.columns, **names)
