"""What the operators of this subpackage share: tables, checkpoints, seeded draws."""

from __future__ import annotations

import re
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quarry.llm

# what runs on executors travels with the job, so they need no copy of this package
cloudpickle.register_pickle_by_value(quarry.llm)

#: The white space of all word patterns here: space and the six ASCII controls 9 to 13 (fixed values).
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word, as Java's and DuckDB's regular expressions write it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, in whatever store Spark reads it from."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where the session names none, it is one below the warehouse, or of this
    machine if that runs everything.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="quarry-checkpoints-")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.quarry-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Bytes of a batch of rows that goes to a Python worker at once, about; Spark's own bound is 64 MB. Each side of the pipe holds two to four times as much.
BATCH_BYTES = 2 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, after batches for Python workers are bound to ``BATCH_BYTES`` in its session; a lower bound stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name, "64m")).strip().lower()
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def id_text(id_col: str) -> Column:
    """The id as text, empty for null, for seeded draws and folds."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that no model learns from: crc32 of the id as text divides by 5."""
    return F.crc32(id_text(id_col)) % 5 == 0


def draw(seed: int, *cols: Column) -> Column:
    """A seeded draw from [0, 1) that depends on nothing but the values of ``cols``."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def without_space(text: Column) -> Column:
    """``text`` with every character of ``SPACE_CHARS`` deleted; null stays null."""
    for c in SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


#: Rows of a table of keys that ``if_small`` sends to all executors, at most: some tens of bytes each.
MAX_SENT_ROWS = 200_000


def if_small(keys: DataFrame) -> DataFrame:
    """A checkpointed table of keys, marked to be sent to all executors if it is small; else it is joined by shuffling."""
    return F.broadcast(keys) if keys.count() <= MAX_SENT_ROWS else keys


#: Rows of one group that are shuffled to one task, at most, until groups are so many that more must be.
MAX_ROWS_OF_A_KEY = 1_000


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``groups``, checkpointed and one for each value of ``keys``, that count their rows in ``size``.

    Few groups are sent to all executors. Of many, those so large that there
    can't be more than ``MAX_SENT_ROWS`` of them are: their rows stay where they
    are, and the others meet their groups by shuffling, a bounded number a key.
    """
    if groups.count() <= MAX_SENT_ROWS:
        return rows.join(F.broadcast(groups), keys, how)
    large = F.col(size) > max(MAX_ROWS_OF_A_KEY, rows.count() // MAX_SENT_ROWS)
    sent = F.broadcast(groups.filter(large))
    rest = rows.join(sent.select(keys), keys, "left_anti").join(groups.filter(~large), keys, how)
    return rows.join(sent, keys).unionByName(rest)
