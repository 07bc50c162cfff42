"""A prefix trie of conversations from partial tries that merge.

Each partition walks its conversations and combines the nodes it meets in a
table of its own: members are counted, their ends listed. The tables are merged
by the hash of a node's path, first in groups of partitions and then as a whole,
which adds up members and ends. A node belongs to its smallest member, so the
trie falls into chains, one a conversation; totals go up a chain by a running
sum and from chain to chain by doubling the way to the root, so the bottom-up
rollup takes as many rounds as the logarithm of the number of chains on the
longest way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, in_batches, with_groups

#: Nodes that a partition combines before it emits them.
HELD_NODES = 100_000
#: Groups of partitions whose tables are merged first.
FIRST_MERGE = 32
#: Ends of a node that are packed into one row before they are hashed in order.
PACKED_ENDS = 4_096
#: Path of the root.
ROOT = b"\0" * 16

NODES = "key binary, parent binary, depth long, bytes long, members long, conv_id long, part int, ends array<long>"


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of every conversation as its family shares them: columns conv_id, depth, digest (of role and text), bytes.

    Conversation c takes the first h turns of conversation c - c % 5, then its
    own behind its first h, with h = crc32(c as decimal) % 9. Turns are ordered
    by number, null first, then by their digest. A row of depth 0 stands for
    each conversation, also one without a turn.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(part(role_col)).cast("string"), F.lit(":"), part(role_col), part(text_col))))
    light = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(part(text_col)).cast("long").alias("bytes")
    )
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    numbered = checkpointed(light.select("conv_id", at.cast("long").alias("at"), "digest", "bytes"))
    shared = F.crc32(F.col("conv_id").cast("string")) % 9
    convs = light.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("first"), shared.alias("h"))
    # a conversation has 9 relatives at most and gives each 8 turns at most
    heads = numbered.filter("at <= 8").withColumnRenamed("conv_id", "first").join(convs, "first").filter("at <= h")
    heads = heads.select("conv_id", F.col("at").alias("depth"), "digest", "bytes")
    given = numbered.filter("at <= 8").groupBy(F.col("conv_id").alias("first")).agg(F.max("at").alias("given"))
    tails = numbered.join(convs, "conv_id").filter("at > h").join(given, "first", "left")
    depth = F.col("at") - F.col("h") + F.least(F.col("h"), F.coalesce("given", F.lit(0)))
    tails = tails.select("conv_id", depth.alias("depth"), "digest", "bytes")
    none = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return none.unionByName(heads).unionByName(tails)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the conversations of a partition, which come one after another in order of depth."""
    import pyspark

    context = pyspark.TaskContext.get()
    number = context.partitionId() if context else 0
    held: dict[bytes, list] = {}
    conv, key = None, ROOT

    def table() -> pa.RecordBatch:
        columns = [list(held), *[[n[k] for n in held.values()] for k in range(5)], [number] * len(held), [n[5] for n in held.values()]]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "parent", "depth", "bytes", "members", "conv_id", "part", "ends"])

    def ended() -> None:
        if conv is not None:
            held[key][5].append(conv)

    for b in batches:
        for c, depth, digest, size in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if depth == 0:
                ended()
                if len(held) > HELD_NODES:
                    yield table()
                    held.clear()
                conv, key, parent = c, ROOT, None
            else:
                parent = key
                key = hashlib.blake2b(parent + digest, digest_size=16).digest()
            node = held.get(key)
            if node is None:
                held[key] = [parent, depth, size, 1, c, []]
            else:
                node[3] += 1
                node[4] = min(node[4], c)
            if len(held) > 2 * HELD_NODES:  # one very long conversation: its end is still to come
                kept = held.pop(key)
                if held:
                    yield table()
                held.clear()
                held[key] = kept
    ended()
    if held:
        yield table()


def _ends_hashed(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ends, ascending, as decimals joined by commas: columns key and ends_sha256.

    Ends are sorted over all partitions, whatever node they belong to, and
    packed there, so that a node with very many ends is read as few rows, in order.
    """
    cut = PACKED_ENDS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, done = None, [], []
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key or len(ids) >= cut:
                    if ids:
                        done.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = k, []
                ids.append(c)
            yield pa.RecordBatch.from_pylist([{"key": k, "low": low, "packed": t} for k, low, t in done], pa.schema([("key", pa.binary()), ("low", pa.int64()), ("packed", pa.string())]))
            done = []
        if ids:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "low": pa.array([ids[0]], pa.int64()), "packed": pa.array([",".join(map(str, ids))])})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            keys, found = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    keys.append(key)
                    found.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(found, pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

    sorted_ = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    packed = in_batches(sorted_).mapInArrow(pack, "key binary, low long, packed string")
    return packed.repartition("key").sortWithinPartitions("key", "low").mapInArrow(digest, "key binary, ends_sha256 string")


def _to_root(chains: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Chains (chain, above, leaves, saved) with the sums over all chains that hang on them, themselves included.

    Each round doubles the stretch of the way to the root over which sums have
    been carried: what lies twice as far below is what lies as far below of those as far below.
    """
    now = checkpointed(chains)
    for _ in range(max_rounds):
        added = now.filter("above is not null").groupBy(F.col("above").alias("chain")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("n"))
        added = checkpointed(added.join(now.select("chain", F.col("above").alias("next")), "chain"))
        if added.isEmpty():
            return now.select("chain", "leaves", "saved")
        sums = now.join(added.drop("next", "n"), "chain", "left")
        ways = added.select(F.col("chain").alias("above"), "next", "n")
        moved = with_groups(sums, ways, ["above"], "n", "left")
        now = checkpointed(moved.select("chain", F.col("next").alias("above"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
    raise RuntimeError(f"sums did not reach the root in {max_rounds} rounds")


def trie(sequences: DataFrame) -> DataFrame:
    """The prefix trie of ``sequences``: conv_id, depth (0, then 1 and on without a gap), digest of the turn, bytes of its text.

    One row a node: conv_id (smallest member), depth, parent_conv_id (the
    parent's conv_id, null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in its subtree, itself included), saved_tokens
    (summed over its subtree, bytes times members beyond the first),
    ends_sha256 (of the members that end here). A conversation's light rows
    (a digest and two numbers a turn) go through one task in order, without being gathered.
    """
    ordered = sequences.select("conv_id", "depth", "digest", "bytes").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    partial = checkpointed(in_batches(ordered).mapInArrow(_partial, NODES))

    def merged(tables: DataFrame, *group: Column) -> DataFrame:
        return tables.groupBy("key", *group).agg(*[F.first(c, True).alias(c) for c in ("parent", "depth", "bytes")], F.sum("members").alias("members"), F.min("conv_id").alias("conv_id"))

    first = merged(partial.drop("ends"), (F.col("part") % FIRST_MERGE).alias("part"))
    nodes = checkpointed(merged(first))
    ends = _ends_hashed(partial.select("key", F.explode("ends").alias("conv_id")))

    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    inner = checkpointed(nodes.join(children, "key").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
    known = nodes.join(inner.select(F.col("parent").alias("key"), "n_children"), "key", "left").join(ends, "key", "left")
    own = known.select(
        "conv_id", "depth", "parent", F.col("members").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("members") - 1) * F.col("bytes")).alias("saves"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    placed = with_groups(own, inner.withColumnRenamed("n_children", "siblings"), ["parent"], "siblings", "left").drop("parent", "siblings")
    placed = checkpointed(placed.withColumn("leaf", (F.col("n_children") == 0).cast("long")))

    # a chain begins where its owner becomes the smallest member, and hangs on the node above that
    tops = F.min_by(F.struct("depth", "parent_conv_id"), "depth").alias("top")
    chains = placed.groupBy(F.col("conv_id").alias("chain")).agg(tops, F.sum("leaf").alias("leaves"), F.sum("saves").alias("saved"))
    hung = checkpointed(chains.select("chain", F.col("top.parent_conv_id").alias("above"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved"))
    sums = _to_root(hung.drop("at"))
    below = sums.join(hung.select("chain", "above", "at"), "chain").filter("above is not null").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth"))
    below = below.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda own, more: F.sum(F.col(own) + F.coalesce(more, F.lit(0))).over(up)
    return placed.join(below, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("leaf", "more_leaves").alias("n_leaves"), total("saves", "more_saved").alias("saved_tokens"), "ends_sha256"
    )


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``trie`` of the conversations as ``rebuilt`` makes them.

    Null roles and texts are empty; turns are ordered by number, null first,
    and turns of one number by a digest of role and text, so repeated rows are
    turns of their own. Rows without a conversation's id belong to none and are
    left out. Texts of any length count as a whole. An empty table gives an
    empty table, without a root; other columns are not read.
    """
    return trie(rebuilt(turns, conv_col, turn_col, role_col, text_col))
