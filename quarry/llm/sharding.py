"""Sharding by a two-pass external shuffle, in DataFrame operations alone.

The first pass scatters records by a seeded hash into buckets of a size that
fits in memory. The second gathers each bucket in one task, orders it, shuffles
it (Spark's ``shuffle`` is a seeded Fisher-Yates) and writes it. Buckets behind
one another are a random order of the whole table, which is cut into shards
whose counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import id_text

#: Bytes of text that a bucket is meant to hold.
BUCKET_BYTES = 16 << 20
#: Buckets whose offsets (two numbers each) are sent to all executors at most; with more, the offsets are joined.
MAX_SENT_BUCKETS = 1 << 20


def text_size(text: Column) -> Column:
    """Bytes of a text in UTF-8, none for null, and 8 for its record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_crc(text: Column) -> Column:
    """crc32 of a text in UTF-8, unsigned; that of no bytes for null."""
    return F.crc32(F.coalesce(text, F.lit("")))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 5, bucket_bytes: int = BUCKET_BYTES, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``docs`` in ``shards`` shards, in random order; the law is ``rows``: counts at most one apart.

    Adds ``shard_col`` int and ``slot_col`` long, gapless from 0 in each shard;
    columns of these names are replaced, all others stay as they are. The
    bucket of a record depends on the seed, its id and its text, so a repeated
    id is scattered as long as its texts differ. Null ids and texts count as
    empty. A run with the same seed and rows gives the same order. An empty
    table gives an empty table; with more shards than rows, some are empty.
    """
    if shards < 1:
        raise ValueError(f"{shards} shards")
    docs = docs.drop(shard_col, slot_col)
    total_bytes, rows = docs.agg(F.sum(text_size(F.col(text_col))), F.count(F.lit(1))).first()
    buckets = max(1, -(-(total_bytes or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), id_text(id_col), F.coalesce(text_col, F.lit(""))), F.lit(buckets)).cast("int")
    counts = docs.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__bucket", before.alias("__offset"))

    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # rows that tie differ in maps alone
    order = F.struct(id_text(id_col).alias("k1"), text_crc(F.col(text_col)).alias("k2"), F.xxhash64(*hashable).alias("k3"))
    scattered = docs.select(bucket.alias("__bucket"), order.alias("__order"), F.struct(*docs.columns).alias("__row"))
    # partition i holds bucket i and nothing else, so its seed is the bucket's
    scattered = scattered.repartitionById(buckets, F.col("__bucket")).sortWithinPartitions("__bucket", "__order")
    gathered = scattered.groupBy("__bucket").agg(F.collect_list("__row").alias("__rows"))
    gathered = gathered.join(F.broadcast(offsets) if buckets <= MAX_SENT_BUCKETS else offsets, "__bucket")
    placed = gathered.select((F.col("__offset")).alias("__offset"), F.posexplode(F.shuffle("__rows", seed)).alias("__at", "__row"))
    position, each, longer = F.col("__offset") + F.col("__at"), rows // shards, rows % shards
    cut = longer * (each + 1)  # up to here shards have one row more
    number = F.when(position < cut, F.floor(position / (each + 1))).otherwise(longer + F.floor((position - cut) / max(each, 1)))
    slot = F.when(position < cut, position % (each + 1)).otherwise((position - cut) % max(each, 1))
    return placed.select("__row.*", number.cast("int").alias(shard_col), slot.cast("long").alias(slot_col))


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard") -> None:
    """Writes one folder of Parquet files a shard; a bucket's rows go to one or two of them."""
    sharded.write.partitionBy(shard_col).parquet(path)
