"""The prefix trie of conversations, peeled from its deepest turns."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from factlode.llm.mixing import word_count
from factlode.llm.rows import bound_batches, staged
from factlode.session import checkpoint_dir

#: A prefix is named by 128 bits: for each half the bits of its turns, each with its depth, are added without carry. Two different
#: prefixes share a name with a chance of 2**-128.
KEY = ["a", "b"]
CHUNK_BYTES = 1 << 15


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role_text hashes t1 and t2, words: turns ordered by turn (null first).

    A null role or text is empty; turns that repeat count each; rows without a conv_id belong to no conversation. Equal turns are ordered by
    role and a hash of the text, so that no text has to be moved.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "t_role", "t1", "t2")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("t_role"),
        F.xxhash64(F.lit("1"), role, text).alias("t1"), F.xxhash64(F.lit("2"), role, text).alias("t2"), word_count(text).alias("words"),
    )
    return turns.withColumn("place", F.row_number().over(order).cast("long")).drop("turn", "t_role")


def rebuilt_turns(conversations: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """Conversations c that begin with the first h turns of conversation c - c % group, h = crc32(c as text) % shared, then go on with
    their own turns after their first h. Turnless ones have one row of depth 0."""
    turns = staged(ordered_turns(conversations), "turns")
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % shared
    ids = turns.where("place = 1").select("conv_id").withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % group, "head": head(F.col("conv_id"))})
    start = turns.where(F.col("place") < shared).select(F.col("conv_id").alias("base"), "place", "t1", "t2", "words")
    # a base stands for at most 2 * group - 1 conversations and gives each of them fewer than `shared` turns
    lead = ids.join(start, "base").where("place <= head").select("conv_id", F.lit(0).alias("part"), "place", "t1", "t2", "words")
    own = turns.where(F.col("place") > head(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "place", "t1", "t2", "words")
    root = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("place"),
                      *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "words")])
    return lead.unionByName(own).unionByName(root)


def prefix_chain(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key (a, b), key of the parent (pa, pb), words of the last turn, last (does the conversation end here): one row for
    each prefix of each conversation, the empty one included. Windows run over sorted rows; no conversation is held as an array."""
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    numbered = turns.withColumn("depth", (F.row_number().over(order) - 1).cast("long"))
    mark = lambda t: F.when(F.col("depth") > 0, F.xxhash64("depth", t)).otherwise(F.lit(0).cast("long"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = numbered.withColumns({"m1": mark("t1"), "m2": mark("t2")})
    keyed = marked.withColumns({"a": F.expr("bit_xor(m1)").over(running), "b": F.expr("bit_xor(m2)").over(running)})
    return keyed.select(
        "conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("m1")).alias("pa"), F.col("b").bitwiseXOR(F.col("m2")).alias("pb"),
        "words", F.lead("depth").over(order).isNull().alias("last"))


def _alone(chain: DataFrame) -> DataFrame:
    """conv_id, cut: the smallest depth that is a power of two at which a conversation shares its prefix with no other one.

    Below that depth nothing can merge with it, so its tail is peeled at once. Each conversation sends one narrow row for each doubling of
    its length, combined by prefix before it is sent.
    """
    probes = chain.where("depth > 0 AND (depth & (depth - 1)) = 0")
    single = probes.groupBy("depth", *KEY).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
    return single.groupBy("conv_id").agg(F.min("depth").alias("cut"))


def _sorted_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task as pieces of text: the ids of a prefix joined by commas, at most about CHUNK_BYTES in a piece."""
    names = ["depth", "a", "b", "first", "ids"]
    key, first, parts, size = None, None, [], 0
    for batch in batches:
        ids = pc.cast(batch.column("conv_id"), pa.string()).to_pylist()
        rows: dict[str, list] = {n: [] for n in names}

        def emit():
            for name, value in zip(names, (*key, first, ",".join(parts))):
                rows[name].append(value)

        for now, number, text in zip(zip(*(batch.column(c).to_pylist() for c in ("depth", *KEY))), batch.column("conv_id").to_pylist(), ids):
            if now != key or size > CHUNK_BYTES:
                if parts:
                    emit()
                key, first, parts, size = now, number, [], 0
            parts.append(text)
            size += len(text) + 1
        if rows["ids"]:
            yield pa.RecordBatch.from_pydict(rows, schema=_CHUNKS)
    if parts:
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, (*key, first, ",".join(parts)))}, schema=_CHUNKS)


_CHUNKS = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])


def _chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each prefix, one after the other; only the hash's state is held."""
    key, state = None, None
    for batch in batches:
        done: dict[str, list] = {n: [] for n in _DIGESTS.names}
        for now, text in zip(zip(*(batch.column(c).to_pylist() for c in ("depth", *KEY))), batch.column("ids").to_pylist()):
            if now != key:
                if state:
                    for name, value in zip(_DIGESTS.names, (*key, state.hexdigest())):
                        done[name].append(value)
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_pydict(done, schema=_DIGESTS)
    if state:
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(_DIGESTS.names, (*key, state.hexdigest()))}, schema=_DIGESTS)


def ends_digests(ended: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the conversations that end at each prefix.

    Ids are sorted over all tasks by range, so one prefix may hold any share of them; what one task then reads in a row is text in large
    pieces, as the hash has to.
    """
    columns = ["depth", *KEY, "conv_id"]
    ordered = ended.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns)
    chunks = ordered.mapInArrow(_sorted_chunks, "depth long, a long, b long, first long, ids string")
    together = chunks.repartition("depth", *KEY).sortWithinPartitions("depth", *KEY, "first")
    return together.mapInArrow(_chunk_digests, "depth long, a long, b long, ends_sha256 string")


def _peel(chain: DataFrame, tails: DataFrame, folder: str) -> DataFrame:
    """Nodes from the deepest level at which conversations can share a prefix up to the root.

    Each round merges the conversations whose peeling starts at that depth with the surviving nodes, whose last turn was stripped, by one
    aggregate, and looks up the last turn of each new node at its smallest member.
    """
    spark = chain.sparkSession
    deepest = tails.agg(F.max("depth")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], "conv_id long, depth long, a long, b long, pa long, pb long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    survivors = None
    for depth in range(deepest, -1, -1):
        fresh = tails.where(F.col("depth") == depth).select(
            *KEY, "conv_id", F.lit(1).cast("long").alias("n_convs"), "n_children", F.col("n_children").alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"))
        live = fresh if survivors is None else fresh.unionByName(survivors)
        nodes = live.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
        last = chain.where(F.col("depth") == depth).select("conv_id", "pa", "pb", "words")
        nodes.join(last, "conv_id").select(
            "conv_id", *KEY, "pa", "pb", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ).write.parquet(f"{folder}/depth={depth}")
        survivors = spark.read.parquet(f"{folder}/depth={depth}").select(
            F.col("pa").alias("a"), F.col("pb").alias("b"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    return spark.read.parquet(folder).withColumn("depth", F.col("depth").cast("long"))


def conversation_trie(conversations: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node of the prefix trie of
    the rebuilt conversations (see rebuilt_turns); a node is named by its smallest member and its depth.

    Truncation peeling: from the deepest level up, conversations that end there join the nodes that survive from below, the last turn of
    each is stripped and they are grouped again, which finds the next level and adds up its counts. Where a conversation shares its
    prefix with no other one, its tail is peeled at once, so the rounds are at most twice the longest shared prefix, not the longest
    conversation. n_leaves counts childless nodes of a subtree, saved_tokens adds (n_convs - 1) times the words of each node's last turn.

    Null ids are left out, null roles and texts are empty, equal turn numbers are ordered by role and a hash of the text, repeated rows are turns of
    their own, further columns are ignored; a table without conversations has no nodes, not even a root.
    """
    bound_batches(conversations.sparkSession)
    columns = conversations.select("conv_id", "turn", "role", "text")
    # sorted by depth, so that each round reads the pages of its level only
    chain = staged(prefix_chain(rebuilt_turns(columns, group, shared)).sortWithinPartitions("depth"), "prefix-chain")
    cut = staged(_alone(chain), "prefix-cuts")
    whole = F.coalesce(F.col("cut"), F.lit(2**62))
    placed = staged(chain.join(cut, "conv_id", "left").where(F.col("last") | (F.col("depth") >= whole)).select(
        "conv_id", "depth", *KEY, "last", (F.col("depth") > whole).alias("tail"), (F.col("depth") == whole).alias("at_cut")), "prefix-tails")
    begins = placed.where("NOT tail").select("conv_id", "depth", *KEY, (~F.col("last")).cast("long").alias("n_children"))
    nodes = _peel(chain, begins, f"{checkpoint_dir(chain.sparkSession)}/trie-{uuid.uuid4().hex}")
    parents = nodes.select(F.col("depth").alias("up"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(
        parents, (F.col("depth") - 1 == F.col("up")) & (F.col("pa") == F.col("ua")) & (F.col("pb") == F.col("ub")), "left")
    ends = placed.where("last AND NOT tail")
    named = linked.join(ends_digests(ends), ["depth", *KEY], "left")
    none, alone = F.sha2(F.lit("").cast("binary"), 256), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared_nodes = named.select("conv_id", "depth", "parent_conv_id", *counts, F.coalesce("ends_sha256", none).alias("ends_sha256"))
    tails = placed.where("tail").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), alone).otherwise(none).alias("ends_sha256"))
    return shared_nodes.unionByName(tails)
