"""Exact dedup through counting quotient filters.

Texts are compared without white space. Each partition packs the 64-bit
fingerprints of its texts into counting quotient filters, one for each range of
quotients; filters of one range merge without loss by their sorted remainders.
Only fingerprints that count more than one are routed to the comparison of
bytes, which groups their texts, and merges copies before it shuffles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, if_small, in_batches, with_groups, without_space

#: Fingerprints that one range of quotients is meant to hold over the whole table.
RANGE_FINGERPRINTS = 400_000
#: Repeated fingerprints (8 bytes each) that are sent to all executors at most; with more, texts meet them in a shuffled join.
MAX_SENT_FINGERPRINTS = 2_000_000
#: Bits of the remainder in a slot; the other 32 bits of a fingerprint are its quotient.
REMAINDER_BITS = 32


class QuotientFilter:
    """A compact map from 64-bit fingerprints to counts.

    Slots hold 32-bit remainders in order of fingerprint. Bit q of ``occupied``
    says that the q-th quotient of the range has a run, ``run_end`` marks each
    run's last slot, and slots with the bit ``repeated`` own an entry of
    ``extra`` with their count. Occupied bits are kept as the gaps between
    them, as few of the 2**32 quotients occur in one partition.
    """

    def __init__(self, gaps: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, repeated: np.ndarray, extra: np.ndarray):
        self.gaps, self.run_end, self.remainders, self.repeated, self.extra = gaps, run_end, remainders, repeated, extra

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From distinct sorted unsigned fingerprints and their counts."""
        quotients = (fingerprints >> np.uint64(REMAINDER_BITS)).astype(np.uint32)
        last = np.append(quotients[1:] != quotients[:-1], True) if len(quotients) else np.zeros(0, bool)
        return cls(np.diff(quotients[last], prepend=np.uint32(0)), last, fingerprints.astype(np.uint32), counts > 1, counts[counts > 1].astype(np.int64))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order, and their counts."""
        runs = np.cumsum(self.gaps.astype(np.uint64), dtype=np.uint64)
        run = np.cumsum(self.run_end) - self.run_end
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.repeated] = self.extra
        return (runs[run] << np.uint64(REMAINDER_BITS) if len(run) else np.zeros(0, np.uint64)) | self.remainders, counts

    def to_bytes(self) -> bytes:
        head = np.array([len(self.gaps), len(self.remainders), len(self.extra)], "<i8")
        return b"".join([head.tobytes(), self.gaps.tobytes(), self.remainders.tobytes(), self.extra.tobytes(), np.packbits(self.run_end).tobytes(), np.packbits(self.repeated).tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        runs, slots, extra = np.frombuffer(data, "<i8", 3).tolist()
        at, parts = 24, []
        for kind, n in ((np.uint32, runs), (np.uint32, slots), (np.int64, extra)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        bits = [np.unpackbits(np.frombuffer(data, np.uint8, -(-slots // 8), at + k * -(-slots // 8)), count=slots).astype(bool) for k in range(2)]
        return cls(parts[0], bits[0], parts[1], bits[1], parts[2])

    @staticmethod
    def merged(filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter for all, with counts added up."""
        entries = [f.entries() for f in filters]
        return QuotientFilter.of(*_added(np.concatenate([e[0] for e in entries]), np.concatenate([e[1] for e in entries])))


def _added(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1])) if len(order) else np.zeros(0, np.int64)
    return fingerprints[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_fingerprints(prints: DataFrame, col: str = "fp") -> DataFrame:
    """Distinct values of a long column that occur in two rows or more; nulls never do.

    Filters are built in the partitions that hold the rows; what is shuffled is
    one packed filter for each partition and range. A range's filters are
    merged in one task, whose size follows the number of distinct fingerprints
    in a range and not how often one occurs.
    """
    prints = prints.select(F.col(col).alias("fp")).filter("fp is not null")
    ranges = min(max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() // RANGE_FINGERPRINTS)), 1 << 20)
    shift = np.uint64(64 - 20)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def settle():
            new = np.concatenate(waiting)
            return _added(np.concatenate([held, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))

        for b in batches:
            waiting.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(waiting[-1])
            if size > 1 << 18:
                held, counts = settle()
                waiting, size = [], 0
        if waiting:
            held, counts = settle()
        part = ((held >> shift) * np.uint64(ranges) >> np.uint64(20)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(ranges + 1))
        kept = [(r, QuotientFilter.of(held[i:j], counts[i:j]).to_bytes()) for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        yield pa.RecordBatch.from_pydict({"part": pa.array([r for r, _ in kept], pa.int32()), "packed": pa.array([x for _, x in kept], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[QuotientFilter]] = {}
        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                open_.setdefault(r, []).append(QuotientFilter.from_bytes(x))
                if len(open_[r]) >= 16:
                    open_[r] = [QuotientFilter.merged(open_[r])]
        for filters in open_.values():
            found, counts = QuotientFilter.merged(filters).entries()
            yield pa.RecordBatch.from_pydict({"fp": pa.array(found[counts > 1].view(np.int64))})

    return in_batches(prints).mapInArrow(build, "part int, packed binary").repartitionById(ranges, F.col("part")).mapInArrow(merge, "fp long")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), without_space(text).alias("bare"), F.char_length(text).alias("n_cp"))
    light = checkpointed(rows.select("id", F.xxhash64("bare").alias("fp"), F.unhex(F.sha2("bare", 256)).alias("sha"), "n_cp", F.monotonically_increasing_id().alias("row")))
    again = checkpointed(repeated_fingerprints(light))
    again = F.broadcast(again) if again.count() <= MAX_SENT_FINGERPRINTS else again
    # bytes: where a fingerprint counts more than one, the text itself is the key, and copies merge before they are shuffled
    equal = (
        rows.withColumn("fp", F.xxhash64("bare"))
        .join(again, "fp", "left_semi")
        .groupBy("fp", "bare")
        .agg(F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("fp", F.unhex(F.sha2("bare", 256)).alias("sha"), "group_size")
    )
    first = F.struct(-F.col("n_cp"), F.col("id").isNull(), F.col("id").alias("id"), F.col("row").alias("row"))
    # copies merge before the join, so that a large group is one row there
    best = light.groupBy("fp", "sha").agg(F.count(F.lit(1)).alias("rows"), F.min(first).alias("best")).filter("rows > 1").join(equal, ["fp", "sha"])
    alone = F.col("group_size").isNull()
    return with_groups(light, checkpointed(best.drop("rows")), ["fp", "sha"], "group_size", "left").select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "sha",
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the class of equal texts that it belongs to.

    Columns: ``id_col``, keep_id, group_size long, kept boolean, text_sha256 (of
    the text without white space, in UTF-8). Of equal texts, the row with the
    most code points in the original stays, then the smallest id. A null text
    counts as empty; empty texts are equal. Of rows that repeat both id and
    text one stays. A null id sorts after the others. An empty table gives an
    empty table; other columns are not read.
    """
    return _classified(docs, id_col, text_col).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts, the one that ``classes`` keeps; columns and values stay as they are."""
    state = (
        _classified(docs, id_col, text_col)
        .filter("group_size > 1")
        .groupBy(F.col("id").alias("__id"), F.col("sha").alias("__sha"))
        .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows"))
        .filter("not __kept or __rows > 1")
    )
    state = checkpointed(state)
    columns = docs.columns
    docs = docs.withColumn("__bare_sha", F.unhex(F.sha2(without_space(F.coalesce(F.col(text_col), F.lit(""))), 256)))
    same = docs[id_col].eqNullSafe(state["__id"]) & (docs["__bare_sha"] == state["__sha"])
    out = docs.join(if_small(state), same, "left_anti").select(columns)
    repeats = state.filter("__kept")
    if repeats.isEmpty():
        return out
    # rows that repeat id and text: of each the longest, one row
    again = docs.join(repeats, same)
    return out.unionByName(
        again.groupBy("__id", "__sha").agg(F.max_by(F.struct(*columns), F.char_length(F.coalesce(F.col(text_col), F.lit("")))).alias("r")).select("r.*")
    )
