"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has 64 bits, each the majority of that bit among the
hashes of its word shingles. Two fingerprints at most 3 bits apart are linked.
The bits form a ring of four segments. By the pigeonring principle a linked
pair has a segment from which every chain of l consecutive segments differs in
at most l * 3 / 4 bits: 0, 1, 2 and 3. Candidates share the first segment of
such a chain; those whose cumulative differences leave the budgets are pruned
inside the join, and what is left of them is the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpointed, if_small, in_batches, with_groups
from quarry.llm.components import components

SEGMENTS, SEGMENT_BITS = 4, 16
#: From so many distinct fingerprints on, the join's key takes the chain's second segment in too, with up to one bit of it flipped on one side.
LONG_KEYS_FROM = 1 << 24
#: Hashes whose bits are spread at once.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text, as an unsigned number; 0 if it has no word.

    A-Z are lower-cased; words are split at space and the controls 9 to 13.
    Shingles of ``words`` words count as often as they occur; a text of fewer
    words is one shingle.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = np.append(0, stops[: len(parts) - words]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts, (stops[words - 1 :] - 1).tolist(), strict=True)]
    packed = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(packed), HASHES_AT_ONCE):
        ones += np.unpackbits(packed[at : at + HASHES_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(packed)).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``keys`` of every row and its fingerprint as a signed long, fp. Null and empty texts get 0."""
    docs = docs.select(*keys, F.col(text_col).alias("__text"))
    fields = [f for f in docs.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x.as_py(), words, seed) for x in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found.view(np.int64))], names=[*(f.name for f in fields), "fp"])

    return in_batches(docs).mapInArrow(run, T.StructType([*fields, T.StructField("fp", T.LongType())]))


def _turned(x: Column, segment: int) -> Column:
    """``x`` with the ring turned so that ``segment`` comes lowest."""
    by = segment * SEGMENT_BITS
    return x if not by else F.shiftrightunsigned(x, by).bitwiseOR(F.shiftleft(x, 64 - by))


def _viable(difference: Column, segment: int, within: int) -> Column:
    """True if every chain of segments from ``segment`` on stays within its share of the budget."""
    turned, ok = _turned(difference, segment), F.lit(True)
    for length in range(1, SEGMENTS + 1):
        low = turned if length == SEGMENTS else turned.bitwiseAND(F.lit((1 << length * SEGMENT_BITS) - 1))
        ok = ok & (F.bit_count(low) <= length * within // SEGMENTS)
    return ok


def links(prints: DataFrame, within: int = 3, long_keys: bool | None = None) -> DataFrame:
    """All pairs (a < b) of the distinct longs fp of ``prints`` that differ in 1 to ``within`` bits (3 at most), each once.

    A pair is found from the first segment that begins a viable chain and
    pruned from the others. With ``long_keys`` (by default from
    ``LONG_KEYS_FROM`` fingerprints on) the same pairs come from longer keys,
    which keeps the candidates few on very large tables.
    """
    if not 1 <= within < SEGMENTS:
        raise ValueError(f"within is {within}; {SEGMENTS} segments serve 1 to {SEGMENTS - 1} bits")
    prints = prints.select("fp").distinct()
    if long_keys is None:
        long_keys = prints.count() >= LONG_KEYS_FROM
    width = SEGMENT_BITS * (2 if long_keys else 1)
    mask = F.lit((1 << width) - 1)
    keys = lambda flips: [
        F.struct(F.lit(i).alias("segment"), _turned(F.col("fp"), i).bitwiseAND(mask).bitwiseXOR(F.lit(flip)).alias("key")) for i in range(SEGMENTS) for flip in flips
    ]
    flips = [0, *(1 << (SEGMENT_BITS + k) for k in range(SEGMENT_BITS))] if long_keys else [0]
    left = prints.select(F.col("fp").alias("a"), F.inline(F.array(*keys([0]))))
    right = prints.select(F.col("fp").alias("b"), F.inline(F.array(*keys(flips))).alias("segment", "key"))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    viable = [_viable(difference, i, within) for i in range(SEGMENTS)]
    found = F.lit(False)
    for i in reversed(range(SEGMENTS)):
        found = F.when(viable[i], F.col("segment") == i).otherwise(found)
    left, right = left.withColumnsRenamed({"segment": "segment", "key": "key"}), right
    return left.join(right, ["segment", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(difference) <= within) & found).select("a", "b")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, within: int = 3, extra: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its fingerprint and component.

    Columns: ``id_col``, fp long, component_id: the smallest id reachable over
    links, its own included; and those named in ``extra``. Equal fingerprints
    are linked, also those of texts without a word. Ids that are null reach
    nothing but null only if no other id is reachable. An empty table gives an
    empty table; rows that repeat an id are rows of one document each.
    """
    prints = checkpointed(fingerprints(docs, [id_col, *(extra or [])], text_col, words))
    own = checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n_equal")))
    near = components(links(prints, within)).withColumnRenamed("node", "fp")
    linked = near.join(own, "fp")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_low"))
    reached = own.join(near, "fp", "left").join(lowest, "component", "left").select("fp", "n_equal", F.coalesce(F.least("component_low", "low"), "low").alias("component_id"))
    return with_groups(prints, checkpointed(reached), ["fp"], "n_equal").select(id_col, *(extra or []), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one whose id names it; columns and values stay as they are.

    Of rows that repeat that id, each stays. Rows with a null id stay, too.
    """
    gone = near_classes(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    gone = if_small(checkpointed(gone))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
