"""Blocks and entities dealt into the same shards by block id, so that they meet without a shuffle.

A shard is a bucket: shard k of the entities holds the entities of shard k's
blocks, sorted by block id. Spark keeps the number of buckets in its catalog of
tables; here it also lies in a mark beside the files, written last, so any
session can open the shards, and files without the mark are those of a write
that failed.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession

#: Each table with the column that holds the block's id.
KEYS = {"blocks": "id", "entities": "block_id"}
#: Bytes of both tables' files for each shard, where no number is given.
SHARD_BYTES = 256 << 20


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def number_for(spark: SparkSession, paths: list[str], shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards the files below some folders need; at least one."""
    total = 0
    for path in paths:
        folder, fs = _at(spark, path)
        total += fs.getContentSummary(folder).getLength() if fs.exists(folder) else 0
    return max(1, math.ceil(total / shard_bytes))


def _table(path: str, name: str) -> str:
    """The name in Spark's catalog, the same for the same folder."""
    return f"shards_{hashlib.sha256(path.encode()).hexdigest()[:20]}_{name}"


def write(blocks: DataFrame, entities: DataFrame, path: str, shards: int) -> None:
    """Writes both tables below a new folder in ``shards`` shards, by one shuffle each.

    Other columns stay as they are. Null ids share a shard and meet nothing. An
    empty table has shards without files. A block with very many entities has
    them in one shard, written in order by one task, which spills; they are not
    gathered.
    """
    if shards < 1:
        raise ValueError(f"{shards} shards")
    spark = blocks.sparkSession
    for name, rows in (("blocks", blocks), ("entities", entities)):
        key = KEYS[name]
        dealt = rows.repartition(shards, key).write.bucketBy(shards, key).sortBy(key)
        dealt.format("parquet").option("path", f"{path}/{name}").saveAsTable(_table(path, name))
    folder, fs = _at(spark, f"{path}/_shards/{shards}")
    fs.create(folder, False).close()


def number(spark: SparkSession, path: str) -> int | None:
    """Into how many shards a folder is dealt, None if it isn't or not to its end."""
    folder, fs = _at(spark, f"{path}/_shards")
    found = [int(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return found[0] if found else None


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and entities of a folder, which joins and groups by block id take as they lie."""
    shards = number(spark, path)
    if shards is None:
        raise FileNotFoundError(f"no shards in {path}")
    out = []
    for name, key in KEYS.items():
        known = _table(path, name)
        if not spark.catalog.tableExists(known):
            where = f"{path}/{name}"
            columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in spark.read.parquet(where).schema)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {shards} BUCKETS LOCATION '{where}'")
        out.append(spark.table(known))
    return out[0], out[1]


def forget(spark: SparkSession, path: str) -> None:
    """Removes a folder's files and its names in Spark's catalog."""
    for name in KEYS:
        spark.sql(f"DROP TABLE IF EXISTS {_table(path, name)}")
    folder, fs = _at(spark, path)
    fs.delete(folder, True)
