"""Keyed upserts by copy-on-write into a folder of sorted Parquet files.

A file's place is known by the smallest and largest key in its footer. Deletes
are held against these fences and against a Bloom filter of each file first,
which drops most of those whose key is absent; what remains is joined with the
files exactly, and only where a row then differs its file is read, merged and
written again. Files, like shards of a sorted list, are numbered by ranks over
all partitions, so no step needs rows in one task; only lists with one short
row a file are sent to executors, and none of them beyond ``MAX_SENT_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpointed, if_small, in_batches

#: Bits of a Bloom filter for each row that a file may have, in words of 64; a key has ``MARKS`` bits in one word.
BITS_A_ROW = 12
MARKS = 4
#: Column of files' names, <generation>-<number>, in the names of their folders.
FILE = "quarry_file"


def ranked(rows: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """``rows`` with their rank from 0 in order of ``keys``, over all partitions: sorted by ranges, then counted by partition."""
    parts = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys))
    place = parts.withColumn("__place", F.monotonically_increasing_id())  # the partition, and 33 bits of the place in it
    place = place.withColumn("__part", F.shiftright("__place", 33))
    before = _before(place.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")))
    return place.join(F.broadcast(before), "__part").withColumn(at, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__place", "__before")


def _before(counts: DataFrame) -> DataFrame:
    """Sums of ``__n`` over the partitions before each: one row a partition."""
    window = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("__part", F.coalesce(F.sum("__n").over(window), F.lit(0)).alias("__before"))


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(rows: DataFrame, folder: str, key: str, columns: list[str]) -> None:
    """One Parquet file for each value of ``FILE``, written by one task, sorted."""
    rows.select(*columns, FILE, "__tie").repartition(FILE).sortWithinPartitions(FILE, key, "__tie").drop("__tie").write.mode("append").partitionBy(FILE).parquet(folder)


def _tie(columns: list[str], kinds: dict[str, str]) -> Column:
    """Orders rows of one key; rows that tie again differ in maps alone."""
    return F.xxhash64(*[c for c in columns if "map<" not in kinds[c] and "variant" not in kinds[c]])


def write_files(rows: DataFrame, folder: str, key: str, max_rows: int) -> None:
    """Writes ``rows`` below ``folder``, sorted by ``key``, as files of ``max_rows`` rows, the last with the rest.

    Rows that repeat a key stay, in an order that their values decide; rows
    without a key are left out. No row writes no file.
    """
    if FILE in rows.columns:
        raise ValueError(f"a column named {FILE}")
    columns = rows.columns
    placed = ranked(rows.filter(F.col(key).isNotNull()).withColumn("__tie", _tie(columns, dict(rows.dtypes))), [key, "__tie"], "__at")
    _write(placed.withColumn(FILE, F.format_string("0-%012d", F.floor(F.col("__at") / max_rows))), folder, key, columns)


def read_files(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All rows below ``folder``, with the file's name in ``FILE``."""
    return spark.read.schema(T.StructType([*schema.fields]).add(FILE, "string")).parquet(folder)


def fences(spark: SparkSession, folder: str, schema, key: str) -> DataFrame:
    """Smallest and largest key and number of rows of every file, from footers: columns FILE, low, high, n.

    Spark answers these aggregates from footers if Parquet is read by its newer
    reader; the session's settings are put back afterwards.
    """
    wanted = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        found = read_files(spark, folder, schema).groupBy(FILE).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))
        return checkpointed(found)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _homes(changes: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``changes`` with the number of their home: the last file that begins at or below the key, else the first.

    Changes and files are sorted together by ranges; the home is a running
    count of files, within a partition and over those before it.
    """
    both = changes.withColumn("__fence", F.lit(0).cast("long")).unionByName(files.select(F.col("__low").alias(key), F.lit(1).cast("long").alias("__fence")), allowMissingColumns=True)
    both = both.withColumn("__later", -F.col("__fence"))  # a file comes before changes of its first key
    parts = checkpointed(both.repartitionByRange(key, "__later").sortWithinPartitions(key, "__later")).withColumn("__part", F.spark_partition_id())
    before = _before(parts.groupBy("__part").agg(F.sum("__fence").alias("__n")))
    names = parts.columns
    at = names.index("__fence")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            running = np.cumsum(b.column(at).to_numpy()) + seen
            if len(running):
                seen = int(running[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(running, pa.int64())], names=[*names, "__seen"])

    counted = in_batches(parts).mapInArrow(count, T.StructType([*parts.schema.fields]).add("__seen", "long")).filter("__fence = 0")
    home = F.greatest(F.col("__seen") + F.col("__before") - 1, F.lit(0))
    return counted.join(F.broadcast(before), "__part").withColumn("__home", home).drop("__fence", "__later", "__part", "__seen", "__before")


def _marked(rows: DataFrame, key: str, words: int) -> DataFrame:
    """``rows`` with the word of their key in its file's Bloom filter, and its bits there."""
    word, bits = F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(words)), F.xxhash64(F.lit(2), F.col(key))
    mask = " | ".join(f"shiftleft(1L, CAST(shiftright(__bits, {6 * k}) & 63 AS INT))" for k in range(MARKS))
    return rows.withColumn("__word", word).withColumn("__bits", bits).withColumn("__mask", F.expr(mask)).drop("__bits")


def bloom_filters(rows: DataFrame, key: str, max_rows: int) -> DataFrame:
    """A Bloom filter for each file, as its words that hold any bit: columns FILE, __word, bits."""
    words = -(-max_rows * BITS_A_ROW // 64)
    return _marked(rows.select(FILE, key), key, words).groupBy(FILE, "__word").agg(F.bit_or("__mask").alias("bits"))


def maybe_there(rows: DataFrame, filters: DataFrame, key: str, max_rows: int) -> DataFrame:
    """``rows`` (with FILE) whose key may be in their file; none that is there is lost."""
    found = _marked(rows, key, -(-max_rows * BITS_A_ROW // 64)).join(filters, [FILE, "__word"])
    return found.filter(F.col("bits").bitwiseAND(F.col("__mask")) == F.col("__mask")).select(rows.columns)


def _joined_files(sizes: DataFrame, max_rows: int) -> DataFrame:
    """Written files (run, home, piece, size) in order: each joins its grown left neighbour of the same run if both have ``max_rows`` rows at most; adds the leader's home and piece."""

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total, leader = None, 0, (0, 0)
        for b in batches:
            rows, leaders = b.to_pylist(), []
            for r in rows:
                if r["__run"] == run and total + r["__size"] <= max_rows:
                    total += r["__size"]
                else:
                    run, total, leader = r["__run"], r["__size"], (r["__home"], r["__piece"])
                leaders.append(leader)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *(pa.array([x[k] for x in leaders], pa.int64()) for k in range(2))], names=["__home", "__piece", "__leader_home", "__leader_piece"])

    ordered = sizes.select("__run", "__home", "__piece", "__size").repartition("__run").sortWithinPartitions("__run", "__home", "__piece")
    return ordered.mapInArrow(greedy, "__home long, __piece long, __leader_home long, __leader_piece long")


def apply_changes(spark: SparkSession, folder: str, schema, changes: DataFrame, key: str, max_rows: int, sets: list[str], action: Callable[[Column], Column]) -> None:
    """Applies ``changes``, one a key, to the files below ``folder``, and rewrites those in which a row then differs.

    ``action`` gives from the first key of a change's home what it does: "D"
    deletes, "S" sets the columns ``sets`` (also to null) or inserts a row with
    those alone, null does nothing. Nulls are equal. A rewritten file becomes
    the fewest files of ``max_rows`` rows at most, sizes at most one apart, the
    larger first, perhaps none; then each joins its left neighbour if both were
    written and fit into one. Of a key that repeats, the rows in its home
    change. Changes without a key do nothing, as do all if there is no file.
    New files are written before the old ones go, so a reader of the folder
    has to wait for the end.
    """
    columns, kinds = [f.name for f in schema.fields], {f.name: f.dataType.simpleString() for f in schema.fields}
    files = ranked(fences(spark, folder, schema, key), ["low", "high", FILE], "__home")
    files = checkpointed(files.withColumnsRenamed({"low": "__low", "high": "__high"}).drop("n"))
    if files.isEmpty():
        return
    # one short row a file
    placed = _homes(changes.filter(F.col(key).isNotNull()), files, key).join(if_small(files), "__home")
    decided = checkpointed(placed.withColumn("__does", action(F.col("__low"))).filter("__does is not null").select("__home", FILE, "__low", "__high", key, *sets, "__does"))

    # absent deletes: by fences, then by Bloom filters of the files that are asked
    asked = decided.filter((F.col("__does") == "D") & F.col(key).between(F.col("__low"), F.col("__high")))
    stored = read_files(spark, folder, schema)
    of_asked = stored.select(FILE, key).join(if_small(checkpointed(asked.select(FILE).distinct())), FILE, "left_semi")
    deletes = maybe_there(asked, bloom_filters(of_asked, key, max_rows), key, max_rows)
    remaining = checkpointed(decided.filter("__does = 'S'").unionByName(deletes))

    # exactly: which of the rest make a row differ
    touched = if_small(checkpointed(remaining.select(FILE).distinct()))
    base = stored.select(FILE, key, F.struct(*sets).alias("__old"), F.lit(True).alias("__there")).join(touched, FILE, "left_semi")
    held = F.coalesce("__there", F.lit(False))
    differs = F.when(F.col("__does") == "D", held).otherwise(~held | ~F.struct(*sets).eqNullSafe(F.col("__old")))
    differing = remaining.join(base, [FILE, key], "left").filter(differs).dropDuplicates([FILE, key]).select("__home", FILE, key, F.struct(*sets).alias("__new"), "__does")
    differing = checkpointed(differing)

    # read, merge, write: the files that differ
    rewritten = checkpointed(differing.select(FILE, "__home").distinct())
    old = stored.join(if_small(rewritten), FILE, "left_semi")
    merged = old.withColumn("__there", F.lit(True)).join(differing.drop("__home"), [FILE, key], "full").filter("__does is null or __does = 'S'")
    value = lambda c: F.when(F.col("__does") == "S", F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)
    merged = merged.join(if_small(rewritten), FILE).select("__home", *[value(c) for c in columns])
    rows = ranked(merged.withColumn("__tie", _tie(columns, kinds)), ["__home", key, "__tie"], "__at")
    rows = checkpointed(rows)

    runs = ranked(rewritten.select("__home"), ["__home"], "__nth").select("__home", (F.col("__home") - F.col("__nth")).alias("__run"))  # of neighbours that are all rewritten
    sizes = checkpointed(rows.groupBy("__home").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__begin")))
    pieces, each = F.ceil(F.col("__n") / max_rows).cast("long"), F.floor(F.col("__n") / F.col("__pieces")).cast("long")
    sizes = sizes.withColumn("__pieces", pieces).withColumn("__each", each).withColumn("__longer", F.col("__n") - F.col("__each") * F.col("__pieces"))
    listed = sizes.join(runs, "__home").select("__run", "__home", "__each", "__longer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1)).alias("__piece"))
    leaders = checkpointed(_joined_files(listed.withColumn("__size", F.col("__each") + (F.col("__piece") < F.col("__longer")).cast("long")), max_rows))

    there, cut = F.col("__at") - F.col("__begin"), F.col("__longer") * (F.col("__each") + 1)
    piece = F.when(there < cut, F.floor(there / (F.col("__each") + 1))).otherwise(F.col("__longer") + F.floor((there - cut) / F.greatest("__each", F.lit(1))))
    cutted = rows.join(if_small(checkpointed(sizes)), "__home").withColumn("__piece", piece.cast("long"))
    generation = files.agg(F.max(F.split(FILE, "-")[0].cast("long"))).first()[0] + 1
    named = cutted.join(if_small(leaders), ["__home", "__piece"]).withColumn(FILE, F.format_string(f"{generation}-%012d-%06d", "__leader_home", "__leader_piece"))
    _write(named, folder, key, columns)
    for r in rewritten.select(FILE).toLocalIterator():  # a name a rewritten file
        path, fs = _folder(spark, f"{folder}/{FILE}={r[FILE]}")
        fs.delete(path, True)


def upserted(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows below ``folder`` with the path of their file in ``path`` and whether it was rewritten in ``rewritten``."""
    rows = read_files(spark, folder, schema)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), (~F.col(FILE).startswith("0-")).alias("rewritten"))


def newest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the changes of each key that with the largest values of ``order``; a null is smallest, of rows that tie the largest in all columns. A hot key is one row a partition."""
    return changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), F.struct(*order, *[c for c in sorted(changes.columns) if c != key])).alias("r")).select(key, "r.*")


def file_digests(rows: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Of rows with path and rewritten: first_id, n_rows, ids_sha256 (keys in order, joined by commas) and sums of long columns, one row a file; files are streamed, not gathered."""
    import hashlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None

        def closed() -> list[dict]:
            return [{"path": open_[0], "rewritten": open_[1], "first_id": open_[2], "n_rows": open_[3], "ids_sha256": open_[4].hexdigest()} | dict(zip(sums, open_[5], strict=True))]

        schema = pa.schema([("path", pa.string()), ("rewritten", pa.bool_()), ("first_id", pa.int64()), ("n_rows", pa.int64()), ("ids_sha256", pa.string()), *((c, pa.int64()) for c in sums)])
        for b in batches:
            done, columns = [], [c.to_pylist() for c in b.columns]
            for path, rewritten, k, *values in zip(*columns, strict=True):
                if open_ is None or open_[0] != path:
                    if open_:
                        done += closed()
                    open_ = [path, rewritten, k, 1, hashlib.sha256(str(k).encode()), values]
                else:
                    open_[3] += 1
                    open_[4].update(f",{k}".encode())
                    open_[5] = [x + y for x, y in zip(open_[5], values, strict=True)]
            yield pa.RecordBatch.from_pylist(done, schema)
        if open_:
            yield pa.RecordBatch.from_pylist(closed(), schema)

    ordered = rows.select("path", "rewritten", key, *sums).repartition("path").sortWithinPartitions("path", key)
    return in_batches(ordered).mapInArrow(digest, "path string, rewritten boolean, first_id long, n_rows long, ids_sha256 string, " + ", ".join(f"{c} long" for c in sums))
