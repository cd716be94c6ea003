"""Conversation prefix trie: which conversations share their first turns, with totals of every subtree by parallel tree contraction.

Turns become digests before anything is sorted or joined, so texts are read once and never shuffled. A node is told by a 128-bit hash of
its turns and their places, built from running sums that are cut into blocks, so a conversation of any length is spread over tasks.

Totals: in each join round all leaves are raked into their parents, and of each unary chain nodes that don't touch are compressed, that
is spliced out between parent and only child. A third of all nodes under one parent are one partial sum; a chain as long as the table
takes a logarithm of rounds. Then the spliced nodes are re-expanded, by doubling along the records of what they were spliced on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import cut, read

#: Turns of one conversation that are summed in one group, and (as a power of two) the range of ids that are put into one string.
BLOCK = 4096
ID_BITS = 12
#: In so many rounds coins are bits of the depth, which halves even chains; after that they are bits of a hash.
DEPTH_ROUNDS = 10
#: Conversations share heads in groups of so many ids, of so many turns at most.
FAMILY, HEADS = 5, 8


def ranked_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, rank (from 1 by turn, null first; ties by role, then by digest), digest (of role and text), n_bytes (of the text).

    Ranks come from one sort over ranges, which cut inside a long conversation; what a conversation has in earlier ranges is added, at
    most one row for each range.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("place"),  # lets ranges cut inside a run of equal rows
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            at = np.arange(1, len(ids) + 1) - np.repeat(begin, np.diff(np.append(begin, len(ids))))
            if last is not None and ids[0] == last:
                at[: begin[1] if len(begin) > 1 else len(ids)] += seen
            last, seen = ids[-1], at[-1]
            yield pa.record_batch([b.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(at), b.column(1), b.column(2)], names=["conv_id", "part", "at", "digest", "n_bytes"])

    order = ("conv_id", "turn", "role", "digest", "place")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes")
    found = cut(sorted_rows.mapInArrow(rank, "conv_id long, part int, at long, digest binary, n_bytes long"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = found.groupBy("conv_id", "part").agg(F.max("at").alias("n")).select("conv_id", "part", earlier.alias("before")).where("before is not null")
    return found.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("rank"), "digest", "n_bytes")


def _head(conv: str = "conv_id") -> Column:
    return F.crc32(F.col(conv).cast("string")) % (HEADS + 1)


def rebuilt_turns(ranked: DataFrame) -> DataFrame:
    """Conversations that start with the head of their family's first one: conv_id, depth (from 1), digest, n_bytes and length (turns
    in all); a turnless one has one row of depth 0.

    The head of conversation c is the first h turns of conversation c - c % 5 (which may be absent), h = crc32(decimal c) % 9; its own
    turns after its first h follow. Remainders of negative ids are negative, as in SQL.
    """
    size = ranked.groupBy("conv_id").agg(F.max("rank").alias("own")).withColumn("h", _head()).withColumn("first", F.expr(f"conv_id - conv_id % {FAMILY}"))
    heads = ranked.where((F.col("conv_id") % FAMILY == 0) & (F.col("rank") <= HEADS)).groupBy(F.col("conv_id").alias("first")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest", "n_bytes"))).alias("turns"))
    whole = size.join(heads, "first", "left").withColumn("shared", F.least(F.coalesce(F.size("turns"), F.lit(0)).cast("long"), "h"))
    whole = whole.withColumn("shared", F.greatest("shared", F.lit(0))).withColumn("length", F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    taken = whole.select("conv_id", "length", F.explode_outer(F.expr("CASE WHEN shared > 0 THEN slice(turns, 1, CAST(shared AS INT)) END")).alias("t")).select("conv_id", F.coalesce("t.rank", F.lit(0)).alias("depth"), "t.digest", "t.n_bytes", "length")
    rest = ranked.join(whole.select("conv_id", "h", "shared", "length"), "conv_id").where(F.col("rank") > F.col("h")).select("conv_id", (F.col("rank") - F.col("h") + F.col("shared")).alias("depth"), "digest", "n_bytes", "length")
    return taken.where("depth > 0 or length = 0").unionByName(rest)


def own_turns(ranked: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of rebuilt_turns()."""
    size = ranked.groupBy("conv_id").agg(F.max("rank").alias("length"))
    return ranked.join(size, "conv_id").select("conv_id", F.col("rank").alias("depth"), "digest", "n_bytes", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, n_bytes, length, and the node of the turns up to this one (a, b) and of those before it (pa, pb). Depth 0 has the
    root, (0, 0). A node's hash is the exclusive-or of hashes of its (depth, digest) pairs."""
    turns = cut(turns)
    x, y = (F.when(F.col("depth") > 0, F.xxhash64(F.lit(s), "depth", "digest")).otherwise(F.lit(0)) for s in (1, 2))
    turns = turns.withColumn("x", x).withColumn("y", y).withColumn("block", F.expr(f"greatest(depth - 1, 0) div {BLOCK}"))
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = turns.withColumns({"a": F.bit_xor("x").over(running), "b": F.bit_xor("y").over(running)})
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.where(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    blocks = blocks.select("conv_id", "block", F.bit_xor("bx").over(before).alias("bx"), F.bit_xor("by").over(before).alias("by"))
    joined = inner.join(blocks, ["conv_id", "block"], "left")
    a, b = (F.col(n).bitwiseXOR(F.coalesce(o, F.lit(0))) for n, o in (("a", "bx"), ("b", "by")))
    return joined.select("conv_id", "depth", "n_bytes", "length", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"))


def _ends(prefixes: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of nodes where conversations end. Ids are first put together by ranges of 4,096, then each node's strings
    stream in order through its digest, which by its definition can't be split."""
    last = prefixes.where("depth = length")
    chunks = last.groupBy("a", "b", F.shiftright("conv_id", ID_BITS).alias("chunk")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            out: list[tuple] = []
            for key, ids in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True):
                if key == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield _digests(out)
        if node is not None:
            yield _digests([(*node, sha.hexdigest())])

    order = chunks.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").select("a", "b", "ids")
    return order.mapInArrow(digest, "a long, b long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], names=["a", "b", "ends_sha256"])


def contract(tree: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Totals of the values (long) over every node's subtree, itself included: id and the values, a row for each row of tree.

    tree: id (long, unique), parent (null: a root; else the id of a row), depth (a root's is 0, any other's is its parent's and one) and
    the values. Several roots may be given; an empty tree gives no rows. Each round works on what the round before it left.

    State: of each active node the number of its active children and the sum of their ids, which is the child's id if there is one.
    """
    names, values = values, tuple(f"v{i}" for i in range(len(values)))
    tree = tree.select("id", "parent", "depth", *(F.col(n).alias(v) for n, v in zip(names, values, strict=True)))
    kids = tree.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), F.sum(F.col("id").cast("decimal(38,0)")).alias("kid"))
    state = tree.join(kids.where("id is not null"), "id", "left")
    state = cut(state.select("id", "parent", "depth", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("kid", F.lit(0)).cast("decimal(38,0)").alias("kid"), *values))
    finished, spliced, rounds = [], [], 0
    while True:
        table = _round(state, values, rounds)
        finished.append(table.where("what = 1").select("id", *values))
        spliced.append(table.where("what = 2").select("id", F.col("kid").cast("long").alias("on"), *values))
        rounds += 1
        state = table.where("what = 0").drop("what")
        if not state.limit(1).count():
            break
    done = reduce(DataFrame.unionByName, finished)
    open_rows = reduce(DataFrame.unionByName, spliced)
    for _ in range((rounds - 1).bit_length()):  # a node is spliced on one that stays longer: no more steps than rounds
        open_rows = cut(open_rows)
        further = open_rows.select(F.col("id").alias("on"), F.col("on").alias("next"), *(F.col(v).alias(f"more_{v}") for v in values))
        open_rows = open_rows.join(further, "on", "left").select("id", F.coalesce("next", "on").alias("on"), *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values))
    ends = done.select(F.col("id").alias("on"), *(F.col(v).alias(f"more_{v}") for v in values))
    expanded = open_rows.join(ends, "on").select("id", *((F.col(v) + F.col(f"more_{v}")).alias(v) for v in values))
    return done.unionByName(expanded).select("id", *(F.col(v).alias(n) for n, v in zip(names, values, strict=True)))


def _round(state: DataFrame, values: tuple[str, ...], n: int) -> DataFrame:
    """One round. what: 0 still active, 1 raked (its values are totals), 2 spliced out (kid: its only child)."""
    coin = F.shiftright("depth", n) if n < DEPTH_ROUNDS else F.xxhash64(F.lit(n), "id")
    state = state.withColumn("coin", coin.bitwiseAND(F.lit(1)).cast("int"))
    leaf, unary = F.col("kids") == 0, (F.col("kids") == 1) & F.col("parent").isNotNull()
    # Leaves tell their parents, unary nodes tell their only child how their coin fell.
    none = F.lit(0).cast("long")
    up = state.where(leaf & F.col("parent").isNotNull()).select(F.col("parent").alias("id"), F.lit(1).alias("raked"), F.col("id").cast("decimal(38,0)").alias("gone"), *(F.col(v).alias(f"more_{v}") for v in values), F.lit(0).alias("above"))
    down = state.where(unary).select(F.col("kid").cast("long").alias("id"), F.lit(0).alias("raked"), F.lit(0).cast("decimal(38,0)").alias("gone"), *(none.alias(f"more_{v}") for v in values), F.col("coin").alias("above"))
    mail = up.unionByName(down).groupBy("id").agg(F.sum("raked").alias("raked"), F.sum("gone").alias("gone"), *(F.sum(f"more_{v}").alias(f"more_{v}") for v in values), F.max("above").alias("above"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    told = state.join(mail, "id", "left").select(
        "id", "parent", "depth", leaf.alias("is_leaf"),
        (unary & (F.col("coin") == 1) & (zero("above") == 0) & (zero("raked") == 0)).alias("goes"),
        (F.col("kids") - zero("raked")).alias("kids"), (F.col("kid") - zero("gone")).cast("decimal(38,0)").alias("kid"), *((F.col(v) + zero(f"more_{v}")).alias(v) for v in values),
    )
    # Nodes that go tell the child its new parent, and the parent its new child and what it gains.
    goes = told.where("goes")
    to_child = goes.select(F.col("kid").cast("long").alias("id"), F.col("parent").alias("new"), F.lit(0).cast("decimal(38,0)").alias("swap"), *(none.alias(f"more_{v}") for v in values))
    to_parent = goes.select(F.col("parent").alias("id"), F.lit(None).cast("long").alias("new"), (F.col("kid") - F.col("id")).cast("decimal(38,0)").alias("swap"), *(F.col(v).alias(f"more_{v}") for v in values))
    mail = to_child.unionByName(to_parent).groupBy("id").agg(F.max("new").alias("new"), F.sum("swap").alias("swap"), *(F.sum(f"more_{v}").alias(f"more_{v}") for v in values))
    after = told.join(mail, "id", "left")
    what = F.when(F.col("is_leaf"), 1).when(F.col("goes"), 2).otherwise(0)
    return cut(after.select(what.alias("what"), "id", F.coalesce("new", "parent").alias("parent"), "depth", "kids", (F.col("kid") + zero("swap")).cast("decimal(38,0)").alias("kid"), *((F.col(v) + zero(f"more_{v}")).alias(v) for v in values)))


def conversation_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """The trie of whole conversations (conv_id, turn, role, text), or with `rebuild` of those of rebuilt_turns(): a row for each node,
    that is each distinct sequence of first turns, from the turnless root. Returns conv_id (the smallest member; with the depth it
    names the node), depth, parent_conv_id, n_convs (members), n_children, n_leaves, saved_tokens (bytes of turns that members share
    with earlier ones, over the subtree), ends_sha256 (of the ascending ids that end here).

    A null role or text counts as empty, a null turn sorts first, rows without conv_id are left out. Repeated rows are repeated turns;
    turns of one number are ordered by role, then by digest. Extra columns are ignored, empty and very long texts are turns like
    others, an empty table has no root and gives no rows.
    """
    ranked = ranked_turns(conversations)
    turns = cut(_prefixes(rebuilt_turns(ranked) if rebuild else own_turns(ranked)))
    root = turns.groupBy("conv_id").agg(F.lit(1)).groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    others = turns.where("depth > 0").groupBy("a", "b", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = cut(others.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(above, ["pa", "pb"], "left").join(children, ["a", "b"], "left").join(_ends(turns), ["a", "b"], "left")
    nodes = cut(nodes.select("id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.col("n_children").isNull()).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    totals = contract(nodes.select("id", "parent", "depth", "leaf", "saved"), ("leaf", "saved"))
    totals = totals.select("id", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return nodes.join(totals, "id").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation_trie() of all rebuilt conversations; odd rows as there."""
    return conversation_trie(read(spark, sf_dir, "conversations"), rebuild=True)
