"""Phrase collocation mining by count streams: sorted streams of phrase counts, in prefix and in suffix order, merged in lockstep.

Words of each language are told by 63-bit keys. Three passes over the texts count words, pairs of frequent words, and runs of up to
four words whose neighbours are all frequent pairs, so a phrase below the threshold is seldom counted and none above it is missed.
All phrases with enough occurrences form one stream. In prefix order a phrase follows its first parts, in suffix order (words read
backwards) its last parts, so one scan of the sorted stream knows each phrase's parts and extensions from the path above it: nothing
is looked up by hash. Ranges cut the order anywhere, also inside all phrases of one very common word; what the path of a range lacks
lies before its first row, and these few seams are mended afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import cut, mix, read, span_hashes, text_slices

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one that holds it has so many hundredths of its occurrences.
ABSORBED = 80
#: Bits of the filters of frequent words and of frequent pairs (16 MB each). A fuller filter only lets more through, to be counted in vain.
FILTER_BITS = 27
#: Occurrences that a task counts together before it sends them on, and about how many phrases a range holds.
BUFFER, RANGE_ROWS = 1_000_000, 500_000
KEYS = ("k1", "k2", "k3", "k4")
#: Rows of a scan: complete, lacking something that lies in another range, or the report of such a part.
WHOLE, TORN, SEAM = 0, 1, 2
#: Groups of a language's candidates whose best are found first.
DEALT = 64

#: Keys are positive, so 0, which stands behind a phrase's last word, sorts before all words.
_KEY_BITS = 63

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def lang_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, starts and ends of words, and for each word whether the next one is in the same piece."""
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    head = np.zeros(len(low) + 1, bool)
    head[offsets] = True
    solid = ~_GAP[low]
    first = solid & (np.concatenate([[True], ~solid[:-1]]) | head[:-1])
    last = solid & (np.concatenate([~solid[1:], [True]]) | head[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.cumsum(_BREAK[low] | head[:-1])[starts]
    joined = np.zeros(len(starts), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    return low, starts, ends, joined


def keyed_words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each run of rows (lang, text): keys of its words, whether the next is in the same piece, bytes, starts, ends, codes of languages."""
    langs = batch.column(0).dictionary_encode()
    seeds = np.array([lang_key(n) for n in langs.dictionary.to_pylist()], np.uint64)
    codes = langs.indices.to_numpy()
    for first, end, data, offsets in text_slices(batch.column(1)):
        if not len(data):
            continue
        low, starts, ends, joined = split_words(data, offsets)
        if len(starts):
            lang = codes[first:end][np.searchsorted(offsets, starts, "right") - 1]
            yield mix(span_hashes(low, starts, ends) ^ seeds[lang]) >> np.uint64(64 - _KEY_BITS), joined, low, starts, ends, lang


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b) >> np.uint64(64 - _KEY_BITS)


def _known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(_KEY_BITS + 1 - (64 * len(bits)).bit_length())
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _filter(keys: DataFrame) -> Broadcast:
    """A bit for the first FILTER_BITS bits of each key (column key), broadcast; its size doesn't depend on the data."""
    slots = keys.select(F.shiftright("key", _KEY_BITS - FILTER_BITS).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _columns(arrays: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays]


def _counted(rows: DataFrame, name: str, width: int, runs: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Counts of runs of words: k1 to k{width} (0 after a run's end) and n. runs gives, from keys and joined of a slice, where runs start and how
    long they are. Each task counts equal runs of BUFFER words before it sends them on."""

    def combine(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys = np.concatenate([h[0] for h in held])
        at, size = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        words, code = np.unique(keys, return_inverse=True)
        code = np.concatenate([code.astype(np.int64) + 1, np.zeros(width, np.int64)])
        base = np.int64(len(words) + 1)
        ids = code[at]
        for j in range(1, width):
            step = np.where(size > j, code[at + j], 0)
            if j > 1:  # name what there is so far anew, so that names stay small
                ids = np.unique(ids, return_inverse=True)[1]
            ids = ids * base + step
        _, place, count = np.unique(ids, return_index=True, return_counts=True)
        out = [np.where(size[place] > j, np.append(words, np.zeros(1, np.uint64))[code[at[place] + j] - 1], np.uint64(0)) for j in range(width)]
        return pa.RecordBatch.from_arrays(_columns([*out, count]), names=[*KEYS[:width], "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, load, base = [], 0, 0
        for b in batches:
            for keys, joined, *_ in keyed_words(b):
                at, size = runs(keys, joined)
                if len(at):
                    held.append((keys, at + base, size))
                    base += len(keys)
                    load += len(keys)
                    if load >= buffer:
                        yield combine(held)
                        held, load, base = [], 0, 0
        if held:
            yield combine(held)

    keys, buffer = KEYS[:width], BUFFER
    found = rows.mapInArrow(count, "".join(f"{k} long, " for k in keys) + "n long")
    return found.groupBy(*keys).agg(F.sum("n").alias(name))


def word_counts(rows: DataFrame) -> DataFrame:
    """key, lang, word and n, of rows lang and text."""

    def combine(held: list[tuple[np.ndarray, ...]], langs: list[str]) -> pa.RecordBatch:
        keys, low, starts, ends, lang = (np.concatenate([h[i] for h in held]) for i in range(5))
        found, place, n = np.unique(keys, return_index=True, return_counts=True)
        size = ends[place] - starts[place]
        offsets = np.concatenate([[0], np.cumsum(size)])
        letters = low[np.repeat(starts[place] - offsets[:-1], size) + np.arange(offsets[-1])]
        words = pa.Array.from_buffers(pa.string(), len(place), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)])
        return pa.RecordBatch.from_arrays([*_columns([found]), pa.array(langs, pa.string()).take(pa.array(lang[place])), words, pa.array(n)], names=["key", "lang", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        langs: list[str] = []
        base = load = 0
        for b in batches:
            names = b.column(0).dictionary_encode().dictionary.to_pylist()
            langs += [n for n in names if n not in langs]
            code = np.array([langs.index(n) for n in names], np.int64)
            for keys, _, low, starts, ends, lang in keyed_words(b):
                held.append((keys, low, starts + base, ends + base, code[lang]))
                base += len(low)
                load += len(keys)
                if load >= buffer or base >= 8 * buffer:
                    yield combine(held, langs)
                    held, base, load = [], 0, 0
        if held:
            yield combine(held, langs)

    buffer = BUFFER
    found = rows.mapInArrow(count, "key long, lang string, word string, n long")
    return found.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def lockstep(stream: DataFrame, name: str, ranges: int) -> DataFrame:
    """Scan the stream (k1 to k4, 0 after the phrase's end; size; n; other columns are carried along) in the order of its keys, in which
    phrases follow their first parts. Adds {name}1 to {name}3, counts of the first one to three words (null from the phrase's own length on),
    and {name}_next, the largest count of a phrase with one word more (0: none).

    A part that lies before a range's first row is missing there. Each range reports its missing parts, three at most, and what
    it has seen of their extensions; with their counts they are broadcast. Only rows that lack a part, and those that a range ends in
    the midst of, are joined with them.
    """
    carried = [c for c in stream.columns if c not in (*KEYS, "size", "n")]
    parts = [f"{name}{j}" for j in range(1, LONGEST)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # a range, of about RANGE_ROWS
        if table is None or not table.num_rows:
            return
        table = table.combine_chunks()
        size, n = (table.column(c).to_numpy() for c in ("size", "n"))
        keys = [table.column(k).to_numpy() for k in KEYS]
        rows = np.arange(len(size))
        above, next_most, seams, torn = [], np.zeros(len(size), np.int64), [], np.zeros(len(size), bool)
        for j in range(1, LONGEST):
            last = np.maximum.accumulate(np.where(size == j, rows, -1))  # the latest phrase of j words: the first part of all longer ones since
            above.append(np.where((size > j) & (last >= 0), n[last], -1))
            child = size == j + 1
            inside = child & (last >= 0)
            np.maximum.at(next_most, last[inside], n[inside])
            lost = np.flatnonzero((size > j) & (last < 0))
            torn[lost] = True
            if size[-1] >= j and last[-1] >= 0:
                torn[last[-1]] = True
            if len(lost):
                seams.append(([int(keys[i][lost[0]]) if i < j else 0 for i in range(LONGEST)], j, int(n[child & (last < 0)].max(initial=0))))
        columns = [*(table.column(k) for k in KEYS), table.column("size"), table.column("n"), *(pa.array(a, pa.int64(), mask=a < 0) for a in above), pa.array(next_most), pa.array(np.where(torn, TORN, WHOLE)), *(table.column(c) for c in carried)]
        names = [*KEYS, "size", "n", *parts, f"{name}_next", "state", *carried]
        whole = pa.table(columns, names=names)
        yield from whole.to_batches(max_chunksize=50_000)
        if seams:
            m = len(seams)
            fixed = [*(pa.array([s[0][i] for s in seams], pa.int64()) for i in range(LONGEST)), pa.array([s[1] for s in seams], whole.schema.field("size").type), pa.nulls(m, pa.int64()), *(pa.nulls(m, pa.int64()) for _ in parts), pa.array([s[2] for s in seams], pa.int64()), pa.array([SEAM] * m, pa.int64())]
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.nulls(m, whole.schema.field(c).type) for c in carried)], names=names)

    ordered = stream.select(*KEYS, "size", "n", *carried).repartitionByRange(ranges, *KEYS).sortWithinPartitions(*KEYS)
    types = {f.name: f.dataType.simpleString() for f in ordered.schema}
    found = cut(ordered.mapInArrow(scan, ", ".join([*(f"{c} {types[c]}" for c in (*KEYS, "size", "n")), *(f"{p} long" for p in parts), f"{name}_next long, state long", *(f"{c} {types[c]}" for c in carried)])))
    whole, torn, seams = (found.where(F.col("state") == state).drop("state") for state in (WHOLE, TORN, SEAM))
    lost = seams.groupBy(*KEYS).agg(F.max(f"{name}_next").alias("lost_next"))
    lost = cut(torn.select(*KEYS, F.col("n").alias("lost_n")).join(F.broadcast(lost), [*KEYS]))  # three for each range at most
    for j in range(1, LONGEST):
        own = lost.where(F.col(KEYS[j]) == 0).where(F.col(KEYS[j - 1]) != 0).select(*(F.col(k).alias(f"s{k}") for k in KEYS[:j]), "lost_n")
        torn = torn.join(F.broadcast(own), [F.col(k) == F.col(f"s{k}") for k in KEYS[:j]], "left").withColumn(parts[j - 1], F.when(F.col("size") > j, F.coalesce(parts[j - 1], "lost_n"))).drop("lost_n", *(f"s{k}" for k in KEYS[:j]))
    torn = torn.join(F.broadcast(lost.drop("lost_n")), [*KEYS], "left")
    mended = torn.withColumn(f"{name}_next", F.greatest(f"{name}_next", F.coalesce("lost_next", F.lit(0)))).select(whole.columns)
    return whole.unionByName(mended)


def _turned(stream: DataFrame) -> DataFrame:
    """The stream with each phrase's words in opposite order."""
    back = [F.expr(f"CASE size {' '.join(f'WHEN {s} THEN {KEYS[s - 1 - j]}' for s in range(j + 1, LONGEST + 1))} ELSE 0L END").alias(KEYS[j]) for j in range(LONGEST)]
    return stream.select(*back, *(c for c in stream.columns if c not in KEYS))


def phrase_stream(rows: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """All phrases of one to four words with min_count occurrences: k1 to k4, size, n. rows: lang and text; words: of word_counts()."""
    singles = words.where(F.col("n") >= min_count)
    frequent = _filter(singles.select("key"))

    def pairs(keys: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = _known(frequent.value, keys)
        at = np.flatnonzero(joined[:-1] & known[:-1] & known[1:])
        return at, np.full(len(at), 2)

    two = cut(_counted(rows, "n", 2, pairs).where(F.col("n") >= min_count))

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(_columns([pair_key(a, c)]), names=["key"])

    often = _filter(two.select("k1", "k2").mapInArrow(pairs_of, "key long"))

    def longer(keys: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        link = joined.copy()
        link[:-1] &= _known(often.value, pair_key(keys[:-1], keys[1:]))
        link[-1] = False
        three = np.flatnonzero(link[:-1] & link[1:])
        four = np.append(link, [False, False])[three + 2]
        return three, np.where(four, 4, 3)

    runs = cut(_counted(rows, "n", LONGEST, longer))
    three = runs.groupBy("k1", "k2", "k3").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    four = runs.where((F.col("k4") != 0) & (F.col("n") >= min_count))
    no = F.lit(0).cast("long")
    streams = (singles.select(F.col("key").alias("k1"), no.alias("k2"), no.alias("k3"), no.alias("k4"), F.lit(1).alias("size"), "n"), two.select("k1", "k2", no.alias("k3"), no.alias("k4"), F.lit(2).alias("size"), "n"), three.select("k1", "k2", "k3", no.alias("k4"), F.lit(3).alias("size"), "n"), four.select(*KEYS, F.lit(4).alias("size"), "n"))
    return cut(streams[0].unionByName(streams[1]).unionByName(streams[2]).unionByName(streams[3]))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The highest-scoring phrases of each language: lang, rank, phrase, a (its occurrences), l and r (those of the first and last part at
    the cut that scores lowest), n (words of the language), score (floor of 2,000,000 a / (l + r)).

    Candidates are phrases of two to four words with a >= min_count, but for those that a longer one absorbs: as a phrase with one word
    more occurs at least as often as any longer one around it, extensions by one word on either side settle that.

    A null text counts as empty, a null language as `und`; repeated rows count each; empty texts have no words; very long ones are worked
    through in one slice. Ties go by a, then by phrase in byte order. Extra columns are ignored. An empty table, or one without frequent
    phrases, gives no rows. Two words with one 63-bit key (odds of one in two million where there are three million words) raise an
    error, unless they stand in the same few million words everywhere.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = cut(word_counts(rows))
    if words.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("two words have the same key")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    stream = phrase_stream(rows, words, min_count)
    ranges = max(2, stream.count() // RANGE_ROWS + 1)
    first = lockstep(stream, "p", ranges)
    both = lockstep(_turned(first), "q", ranges)
    both = _turned(both).where("size > 1")
    wide = "CAST({} AS DECIMAL(38,0))"
    cuts = []
    for k in range(1, LONGEST):
        rest = f"CASE size {' '.join(f'WHEN {s} THEN q{s - k}' for s in range(k + 1, LONGEST + 1))} END"
        score = F.expr(f"({wide.format(2_000_000)} * n) div ({wide.format(f'p{k}')} + {rest})")
        cuts.append(F.when(F.col("size") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"p{k}").alias("l"), F.expr(rest).alias("r"))))
    kept = both.where(F.expr(f"{wide.format(100)} * greatest(p_next, q_next) < {wide.format(ABSORBED)} * n")).withColumn("cut", F.least(*cuts))
    kept = kept.select(*KEYS, "size", F.col("n").alias("a"), "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    known = words.where(F.col("n") >= min_count).select("key", "lang", "word")
    named = kept.join(known.select(F.col("key").alias("k1"), "lang"), "k1")
    named = named.withColumn("dealt", F.pmod(F.xxhash64(*KEYS), F.lit(DEALT)))
    for group in (("lang", "dealt"), ("lang",)):  # no task sees more of a language than DEALT times its best
        named = named.withColumn("place", F.rank().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    best = cut(named.withColumn("id", F.monotonically_increasing_id()))
    spelt = best.select("id", F.posexplode(F.array(*KEYS)).alias("at", "key")).where("key != 0").join(known.select("key", "word"), "key")
    spelt = spelt.groupBy("id").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w.word)).alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelt, "id").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collocations() of all documents; odd rows as there."""
    return collocations(read(spark, sf_dir, "documents"))
