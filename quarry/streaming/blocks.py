"""Blocks that arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.catalog import latest


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_into(source: DataFrame, table: str, checkpoint: str, key: str = "id", version: str = "version", once: bool = True) -> StreamingQuery:
    """Keeps in the Parquet table ``table`` the newest row of each key that the stream has brought.

    Batches write versions of the table side by side, named by their number; a
    batch that is repeated after a failure writes the same one again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changes = latest(batch, key, version)
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = sorted(int(n.split("-")[1]) for s in (fs.listStatus(path) if fs.exists(path) else []) if (n := s.getPath().getName()).startswith("v-"))
        done = [n for n in done if n < number]
        current = spark.read.parquet(f"{table}/v-{done[-1]}") if done else changes.limit(0)
        newer = latest(current.unionByName(changes), key, version) if done else changes
        newer.write.mode("overwrite").parquet(f"{table}/v-{number}")
        for n in done[:-1]:  # the one before stays, for readers and for a repeated batch
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v-{n}"), True)

    writer = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of the table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = max(int(s.getPath().getName().split("-")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v-"))
    return spark.read.parquet(f"{table}/v-{newest}")


__all__ = ["current", "stream", "upsert_into"]
