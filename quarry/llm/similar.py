"""SimHash near-dedup for a similarity of word shingles, without loss.

A text is the set of its shingles of five words. Two texts are linked if their
sets' Jaccard similarity is 0.8 or more. Texts whose SimHash fingerprints are
few bits apart are found by pigeonring filtering and checked by their sets; this
joins what is nearly equal. Similar texts that differ in more bits than these
filters serve are found by shingles: these have one order for all texts, in
which those known to be common come last, and of two linked texts at least one
shingle is among the first fifth of each. Only texts that aren't connected yet
meet so. What sizes and parities of the sets don't rule out, inside the join
already, is checked by the sets themselves. Which shingles count as common
changes the work only, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import simhash
from quarry.llm.common import MAX_SENT_ROWS, checkpointed, draw, if_small, in_batches
from quarry.llm.components import components
from quarry.llm.simhash import fingerprint

#: Words of a shingle; the least similarity of linked texts, as a fraction.
WORDS = 5
SIMILAR, OF = 4, 5
#: Texts that tell which shingles are common, about, and how many of them must have one.
TEXTS_FOR_ORDER, COMMON_FROM = 5_000, 5
#: One of so many candidate pairs is checked first where those that it leaves connected needn't be. It changes the work only.
FIRST = 4
#: Words of 64 bits in the short sketch of a set's parities, which the join itself looks at.
SKETCH_WORDS = 8
SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
#: Rows of keys or sets that leave Python at once, about.
KEYS_AT_ONCE = 1 << 18


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles in order; none of a text without a word.

    A-Z are lower-cased; words are split at space and the controls 9 to 13. A
    text of fewer words is one shingle.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, 42)] if parts else [], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.append(0, stops[: len(parts) - words]).tolist()
    return np.unique(np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, (stops[words - 1 :] - 1).tolist(), strict=True)), np.uint64))


def _node(own: np.ndarray) -> int:
    """A number for a set, as a signed long. Equal sets have the same, and similar ones mostly lie close together: the smallest hash gives the first 16 bits."""
    if not len(own):
        return 0
    return (int(own[0]) * 0x9E3779B97F4A7C15 & 0xFFFF000000000000 | xxhash.xxh64_intdigest(own.tobytes(), 42) >> 16) - (1 << 63)


def _odd(own: np.ndarray, places: int) -> np.ndarray:
    """For each of so many places (a power of two), whether an odd number of a set's shingles fall there."""
    return np.packbits(np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1)


def _parities(own: np.ndarray) -> bytes:
    """Parities at twice as many places as a set has shingles, or more."""
    return _odd(own, 64 << max(0, (len(own) // 32).bit_length())).tobytes()


def _may_link(n: int, m: int, x: bytes, y: bytes) -> bool:
    """False only for two sets that are not similar, by their sizes and parities: each differing place takes a shingle that one set has alone."""
    if n * OF < m * SIMILAR or m * OF < n * SIMILAR:
        return False
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    differ = np.bitwise_xor.reduce(p.reshape(-1, size), axis=0) ^ np.bitwise_xor.reduce(q.reshape(-1, size), axis=0)
    return int(np.bitwise_count(differ).sum()) * (OF + SIMILAR) <= (n + m) * (OF - SIMILAR)


def _first(own: np.ndarray, common: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The shingles of which a linked set has at least one among its own: the least common ones, a fifth of all."""
    if not len(own):
        return own
    rank = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, texts[at], 0)
    return own[np.argsort(rank, kind="stable")][: len(own) + 1 - -(-SIMILAR * len(own) // OF)]


def _common(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts have, by a seeded draw of texts, and how many of these."""
    total = docs.count()
    drawn = docs.select(F.col(text_col).alias("text")).filter(draw(8, F.col("text")) < TEXTS_FOR_ORDER / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for x in b.column(0):
                held.append(shingle_set(x.as_py()))
                size += len(held[-1])
                if size >= KEYS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["key"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["key"])

    counts = in_batches(drawn).mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON_FROM)
    top = counts.orderBy(F.desc("n"), "key").limit(MAX_SENT_ROWS).toArrow()
    keys, texts = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], texts[order]


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's id, the number of its set (node), the set's size n, its parities, their short sketch and the fingerprint fp."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                text = x.as_py()
                own = shingle_set(text)
                rows.append((_node(own), len(own), _parities(own), *_odd(own, 64 * SKETCH_WORDS).view(np.int64).tolist(), fingerprint(text, WORDS) - (1 << 63)))
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * (SKETCH_WORDS + 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["id", *names])

    names = ["node", "n", "parities", *SKETCH, "fp"]
    return in_batches(docs).mapInArrow(run, T.StructType([docs.schema["id"], *(T.StructField(x, T.BinaryType() if x == "parities" else T.LongType()) for x in names)]))


def _keys(docs: DataFrame, text_col: str, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The keys by which each row's set is found: node and key."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(nodes: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
            repeated = np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
            return pa.RecordBatch.from_arrays([pa.array(repeated), pa.array(np.concatenate(keys).view(np.int64))], names=["node", "key"])

        for b in batches:
            nodes, keys, size = [], [], 0
            for x in b.column(0):
                own = shingle_set(x.as_py())
                nodes.append(_node(own))
                keys.append(_first(own, *shared.value))
                size += len(keys[-1])
                if size >= KEYS_AT_ONCE:
                    yield packed(nodes, keys)
                    nodes, keys, size = [], [], 0
            if nodes:
                yield packed(nodes, keys)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "node long, key long")


def _sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """The sets with the numbers ``wanted`` (node), once each: node and its shingles as bytes."""
    few = wanted.count() <= MAX_SENT_ROWS
    known = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["node"].to_numpy())) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sets, size = [], [], 0
            for x in b.column(0):
                own = shingle_set(x.as_py())
                node = _node(own)
                if known is not None:
                    at = np.searchsorted(known.value, node)
                    if at == len(known.value) or known.value[at] != node:
                        continue
                nodes.append(node)
                sets.append(own.tobytes())
                size += len(own)
                if size >= KEYS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "own"])
                    nodes, sets, size = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "own"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "node long, own binary")
    return (found if few else found.join(wanted, "node", "left_semi")).dropDuplicates(["node"])


def _linked(docs: DataFrame, text_col: str, light: DataFrame, pairs: DataFrame, known: DataFrame | None = None, rounds: int = 1) -> DataFrame:
    """``known`` with links among the candidate pairs (a, b), enough of them to connect what all of them would.

    In two rounds, a part of the pairs is checked first; those that are connected then are left out of the rest.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [_may_link(n.as_py(), m.as_py(), x.as_buffer(), y.as_buffer()) for n, m, x, y in zip(*(b.column(k) for k in range(2, 6)), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                own, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(own, other, assume_unique=True))
                kept.append(both * OF >= SIMILAR * (len(own) + len(other) - both))
            yield b.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    side = lambda rows, x, *names: rows.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in names])
    both = pairs.join(side(light, "a", "n", "parities"), "a").join(side(light, "b", "n", "parities"), "b")
    pairs = checkpointed(both.select("a", "b", "a_n", "b_n", "a_parities", "b_parities").mapInArrow(possible, "a long, b long"))
    sets = checkpointed(_sets(docs, text_col, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(FIRST)) == 0
    for k in range(rounds):
        some = pairs if rounds == 1 else pairs.filter(turn if k == 0 else ~turn)
        if k:
            some = _apart(some, if_small(checkpointed(components(known))))
        both = some.join(side(sets, "a", "own"), "a").join(side(sets, "b", "own"), "b")
        found = checkpointed(both.select("a", "b", "a_own", "b_own").mapInArrow(similar, "a long, b long"))
        known = found if known is None else known.unionByName(found)
    return known


def _apart(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are not in one component of ``near``."""
    for x in ("a", "b"):
        pairs = pairs.join(near.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), x, "left")
    return pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def links(docs: DataFrame, light: DataFrame, text_col: str = "text") -> DataFrame:
    """Links (a, b) between numbers of sets, enough of them that linked texts are connected: a pair is left out only if others connect it.

    ``light`` has each set's node, n, parities, sketch and fp once.
    """
    # fingerprints first: they join what is nearly equal; sets with one fingerprint meet the smallest of them
    prints = checkpointed(light.groupBy("fp").agg(F.min("node").alias("a")))
    equal = light.select("fp", F.col("node").alias("b")).join(prints, "fp").filter("a <> b").select("a", "b")
    near = simhash.links(prints).withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(prints.select(F.col("fp").alias("x"), "a"), "x").join(prints.select(F.col("fp").alias("y"), F.col("a").alias("b")), "y").select("a", "b")
    first = _linked(docs, text_col, light, equal.unionByName(near))
    # then shingles; most keys occur once, so all are shuffled once, as two numbers, and only what is shared is kept
    of_key = Window.partitionBy("key")
    posts = _keys(docs, text_col, _common(docs, text_col)).withColumns({"low": F.min("node").over(of_key), "high": F.max("node").over(of_key)})
    posts = checkpointed(posts.filter("low <> high").select("key", "node").distinct())
    # the sets that share a key meet one of them, another each time, which joins what is left of large groups in a number of checks
    # that grows with their size only
    hub = F.min(F.struct(F.xxhash64("key", "node").alias("order"), "node", "n", "group", *SKETCH)).over(of_key)
    posts = _unconnected(posts, first)
    hubs = _sketched(posts, light).withColumn("hub", hub).select(*_named("a"), *_named("b", "hub."))
    first = _linked(docs, text_col, light, hubs.filter(_like()).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), first, 2)
    # then every pair that isn't connected yet
    posts = _sketched(_unconnected(posts.drop("group"), first), light)
    rest = posts.select("key", *_named("a")).join(posts.select("key", *_named("b")), "key").filter(_like() & (F.col("a_node") < F.col("b_node")))
    return _linked(docs, text_col, light, rest.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), first)


def _unconnected(posts: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``posts`` (key and node) whose key is shared by sets that ``known`` doesn't connect, with the group of each set."""
    near = if_small(checkpointed(components(known)))
    posts = posts.join(near, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    of_key = Window.partitionBy("key")
    posts = posts.withColumns({"low": F.min("group").over(of_key), "high": F.max("group").over(of_key)})
    return checkpointed(posts.filter("low <> high").drop("low", "high"))


def _sketched(posts: DataFrame, light: DataFrame) -> DataFrame:
    """``posts`` with each set's size and sketch."""
    return posts.join(light.select("node", "n", *SKETCH), "node")


def _named(x: str, of: str = "") -> list[Column]:
    """What ``_like`` looks at, of one side."""
    return [F.col(f"{of}{c}").alias(f"{x}_{c}") for c in ("n", "node", "group", *SKETCH)]


def _like() -> Column:
    """True for two unconnected sets that aren't ruled out by sizes and sketches."""
    like = (F.col("a_n") * OF >= F.col("b_n") * SIMILAR) & (F.col("b_n") * OF >= F.col("a_n") * SIMILAR) & (F.col("a_group") != F.col("b_group"))
    differ = F.lit(0)
    for c in SKETCH:
        differ = differ + F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))
    return like & (differ * (OF + SIMILAR) <= (F.col("a_n") + F.col("b_n")) * (OF - SIMILAR))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and component_id: the smallest id reachable over links, its own included.

    Equal sets are linked, also those of texts without a word. A null id reaches
    null only if no other id is reachable. An empty table gives an empty table.
    """
    prints = checkpointed(_prints(docs, id_col, text_col))
    light = checkpointed(prints.drop("id").dropDuplicates(["node"]))
    near = checkpointed(components(links(docs, light, text_col)))
    rows = prints.select("id", "node").join(if_small(near), "node", "left").select("id", F.coalesce("component", "node").alias("node"))
    lowest = rows.groupBy("node").agg(F.min("id").alias("component_id"))
    return rows.join(lowest, "node").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one whose id names it; columns and values stay as they are.

    Of rows that repeat that id, each stays. Rows with a null id stay, too.
    """
    gone = near_classes(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    gone = if_small(checkpointed(gone))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
