"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source is clamped where it would
be read more than a maximum number of epochs, and the excess goes to the others
by weight until none is above. A source's target is met by whole repetitions of
all its documents and a seeded sample, read once more, for the fraction.

The sample is the beginning of a seeded order. Documents fall into buckets by
their draw; whole buckets are taken until the one where the target ends, and
only in that bucket single documents are chosen.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, draw, if_small, word_count

#: Documents that a bucket of the seeded order is meant to hold.
BUCKET_ROWS = 4_096


def targets(sources: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """Adds weight and target to a table of source and source_size.

    Weights are dealt in turn to the sources in order of code points, null
    last. All sources share ``share`` times the sum of all sizes; no target
    exceeds ``max_epochs`` times its source's size. A source of size 0 gets 0.

    When the sources stand in order of cap / weight, the clamped ones come
    first. The water level with the first k clamped is what is left of the
    budget per weight that is left, and it is highest where exactly the right
    ones are clamped. The table holds one row a source, so one task orders it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * float(max_epochs)
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    rows = sources.withColumn("weight", dealt).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    clamped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * float(share) - clamped) / others)
    return rows.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everything))).drop("level", "cap")


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """In seeded order, takes what still fits into ``left``; then the smallest of the rest if that comes nearer."""
    pdf = pdf.sort_values(["u", "id", "size"], kind="stable", na_position="last").reset_index(drop=True)
    left, chosen = float(pdf["left"].iloc[0]), []
    sizes = (pdf["size"] * pdf["copies"]).tolist()
    for k, size in enumerate(sizes):
        if size <= left:
            left -= size
            chosen.append(k)
    rest = [(s, k) for k, s in enumerate(sizes) if s and k not in set(chosen)]
    if rest and min(rest)[0] - left < left:
        chosen.append(min(rest)[1])
    return pdf.loc[chosen, ["source", "u", "id", "size"]]


class Mix:
    """What a mix takes of each document; see ``plan``."""

    def __init__(self, light: DataFrame, sources: DataFrame, chosen: DataFrame, seed: int):
        self.light, self.sources, self.chosen, self.seed = light, sources, chosen, seed

    def repetitions(self, rows: DataFrame) -> DataFrame:
        """``rows`` with source, u, id and size gets source_size, target and ``copies``, how often the mix reads each."""
        s = self.sources.withColumnRenamed("source", "s_source")
        c = self.chosen.select(*[F.col(x).alias(f"c_{x}") for x in ("source", "u", "id", "size")], F.lit(1).alias("c"))
        rows = rows.join(s, rows["source"].eqNullSafe(s["s_source"]), "left")
        same = F.lit(True)
        for x in ("source", "u", "id", "size"):
            same = same & rows[x].eqNullSafe(c[f"c_{x}"])
        rows = rows.join(c, same, "left")
        bucket = F.floor(F.col("u") * F.col("buckets"))
        once_more = F.when(~F.col("partly"), 0).when(bucket < F.col("edge"), 1).when(bucket == F.col("edge"), F.coalesce("c", F.lit(0))).otherwise(0)
        return rows.withColumn("copies", (F.col("whole") + once_more).cast("int")).drop("s_source", *c.columns, "buckets", "edge", "partly", "whole", "left", "weight", "n")


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11) -> Mix:
    """Decides how often each document is read.

    A document's size is its number of words; null texts have none. Null is a
    source of its own. Repeated rows (same id, source and size) are taken
    alike. No row is read more than ``max_epochs`` times, those without a word included. Reruns agree, whatever the partitions. An empty table gives an
    empty mix.
    """
    light = checkpointed(_light(docs, id_col, source_col, word_count(F.col(text_col)), seed))
    sources = targets(light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), list(weights), share, max_epochs)
    size = F.col("source_size")
    sources = sources.withColumn("whole", F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(int(max_epochs)))).otherwise(0).cast("long"))
    sources = sources.withColumn("left", F.col("target") - F.col("whole") * size).withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
    # the bucket where each source's fraction ends
    keyed = light.join(sources.select(F.col("source").alias("s"), "buckets", "left"), F.col("source").eqNullSafe(F.col("s")))
    sums = keyed.withColumn("bucket", F.floor(F.col("u") * F.col("buckets"))).groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    edges = (
        sums.withColumn("upto", upto)
        .filter("upto > left")
        .groupBy("source")
        .agg(F.min("bucket").alias("edge"), F.min_by(F.col("left") - (F.col("upto") - F.col("words")), "bucket").alias("left_in_edge"))
    )
    edges = checkpointed(edges.select(F.col("source").alias("e"), "edge", "left_in_edge"))
    sources = checkpointed(
        sources.join(edges, F.col("source").eqNullSafe(F.col("e")), "left").select("source", "source_size", "target", "whole", "buckets", F.coalesce("edge", F.col("buckets")).alias("edge"), "left_in_edge", (F.col("left") > 0).alias("partly"))
    )
    inside = (
        light.join(sources.select(F.col("source").alias("s"), "buckets", "edge", F.col("left_in_edge").alias("left")), F.col("source").eqNullSafe(F.col("s")))
        .filter(F.floor(F.col("u") * F.col("buckets")) == F.col("edge"))
        .groupBy("source", "u", "id", "size")
        .agg(F.first("left").alias("left"), F.count(F.lit(1)).alias("copies"))
    )
    kinds = dict(light.dtypes)
    chosen = checkpointed(inside.groupBy("source").applyInPandas(_greedy, f"source {kinds['source']}, u double, id {kinds['id']}, size long"))
    return Mix(light, if_small(sources.drop("left_in_edge")), if_small(chosen), seed)


def _light(docs: DataFrame, id_col: str, source_col: str, size: Column, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), draw(seed, F.col(id_col)).alias("u"))


def takes(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """What the mix takes of every document, those that it leaves out included.

    Columns: ``id_col``, size, source_size long, target double (of the
    document's source), taken long (words, repeats counted), copies int.
    """
    mix = plan(docs, id_col=id_col, **options)
    return mix.repetitions(mix.light).select(F.col("id").alias(id_col), "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix: rows of ``docs``, each as often as it is read; columns and values stay as they are."""
    mix = plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(mix.seed, F.col(id_col)).alias("u"))
    return mix.repetitions(packed).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
