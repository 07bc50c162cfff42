"""Lookups by id: blocks, entities and what they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.compiler import Corpus

#: Rows that one task tells apart, about: what it holds of them stays the same however many there are.
ROWS_OF_A_TASK = 500_000


def distinct_in_parts(rows: DataFrame, number: int) -> DataFrame:
    """The distinct rows of about ``number``, dealt by all their columns before any are held, into parts that grow in number and not in size."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-number // ROWS_OF_A_TASK))
    return rows.repartition(parts, *rows.columns).distinct()


def block_of(corpus: Corpus, id_: object) -> DataFrame:
    """The block with an id, or else the one that holds an entity with it; two rows if that is ambiguous."""
    own = corpus.blocks.filter(F.col("id") == F.lit(id_)).limit(2)
    holders = corpus.entities.filter(F.col("id") == F.lit(id_)).select(F.col("block_id").alias("__b")).distinct()
    other = corpus.blocks.join(holders, F.col("id") == F.col("__b"), "left_semi").limit(2)
    none = own.limit(1).agg((F.count(F.lit(1)) == 0).alias("__none"))
    return own.unionByName(other.crossJoin(F.broadcast(none)).filter("__none").drop("__none"))


def resolved(corpus: Corpus, entities: DataFrame) -> DataFrame:
    """Entities with what they use as an array of (id, kind, name), in order of id; ids that nothing has are left out."""
    edges = entities.select("id", F.explode("uses").alias("__used")).distinct()
    # only what is used is shuffled, not every entity
    wanted = edges.select(F.col("__used").alias("__wanted")).distinct()
    short = corpus.entities.select("id", "kind", "name").join(wanted, F.col("id") == F.col("__wanted"), "left_semi").dropDuplicates(["id"])
    used = edges.join(short.select(F.col("id").alias("__id"), F.struct("id", "kind", "name").alias("__short")), F.col("__used") == F.col("__id"))
    lists = used.groupBy(F.col("id").alias("__owner")).agg(F.array_sort(F.collect_list("__short")).alias("__uses"))
    joined = entities.join(lists, F.col("id") == F.col("__owner"), "left")
    return joined.withColumn("uses", F.coalesce("__uses", F.array().cast(lists.schema["__uses"].dataType))).drop("__owner", "__uses")


def resolve_edges(entities: DataFrame, targets: DataFrame, id_: str = "id") -> DataFrame:
    """One row for each entity and existing target that it uses: columns id and used."""
    uses = F.array_distinct("uses")
    n = entities.agg(F.sum(F.greatest(F.size("uses"), F.lit(0)).cast("long")).alias("n")).first().n or 0
    edges = distinct_in_parts(entities.select(F.col(id_).alias("id"), F.explode(uses).alias("used")), n)
    return edges.join(targets.select(F.col("id").alias("__t")).distinct(), F.col("used") == F.col("__t"), "left_semi")


def summary(entities: DataFrame, kinds: tuple[str, ...] = ("Type", "Constant", "Fact")) -> DataFrame:
    """Entities of each block by kind: block_id and a column for each kind, null where there is none."""
    return entities.groupBy("block_id").agg(*[F.nullif(F.count(F.when(F.col("kind") == k, 1)), F.lit(0)).alias(k) for k in kinds])


def kind_order(kind: Column) -> Column:
    """Number by which kinds are listed: constants, types, facts."""
    return F.when(kind == "Constant", 0).when(kind == "Type", 1).otherwise(2)


def theory_listing(corpus: Corpus, theory: str, limit: int = 10_000) -> DataFrame:
    """Blocks of a theory in order of their first line."""
    return corpus.blocks.filter(F.col("theory") == theory).orderBy("start_line", "id").limit(limit)
