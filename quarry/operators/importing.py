"""An import as a whole: spans and exports become an index's blocks and entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.analysis import facet_copy
from quarry.functions.trees import flatten, pretty
from quarry.operators import ingest
from quarry.sources import dump
from quarry.sources.catalog import Catalog


@dataclass
class Exports:
    """Tables of exported theories; every table has theory. Trees are (root, tree as JSON)."""

    spans: DataFrame
    positions: DataFrame  # kind, name, offset, end_offset
    consts: DataFrame  # name, typ, abbrev
    types: DataFrame  # name, abbrev
    axioms: DataFrame  # name, prop
    thms: DataFrame  # name, prop, proof, deps
    constdefs: DataFrame  # name, axiom_name
    typedefs: DataFrame  # name, axiom_name
    trees: DataFrame  # root, tree


def spans_of(spark: SparkSession, root: str, symbols: dict[str, str] | None = None, sessions: list[str] | None = None) -> DataFrame:
    """The spans of a dump's theories, for ``Exports.spans``."""
    return dump.read_markup(spark, root, symbols, sessions)


def extract(exports: Exports) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, entities and errors of all theories at once."""
    e = exports
    nodes = flatten(e.trees)
    blocks, errors = ingest.extract_blocks(ingest.segment(e.spans, length=dump.symbol_length(F.col("text"))))
    consts, const_errors = ingest.extract_constants(e.consts, e.constdefs, e.axioms, nodes)
    types, type_errors = ingest.extract_types(e.types, e.typedefs, e.axioms, nodes)
    facts = ingest.extract_facts(e.axioms, e.constdefs, e.typedefs, e.thms, nodes)
    text = pretty(F.col("tree"))
    own = e.trees.join(e.consts.select(F.col("typ").alias("root")).distinct(), "root", "left_semi")
    printed = own.select(F.col("root").alias("typ"), text.alias("type"))
    consts = consts.join(printed, "typ", "left").withColumn("type_facet", facet_copy(F.col("type")))
    columns = ["theory", "id", "full_name", "kind", "name", "name_facet", "type", "type_facet", "uses"]
    none = {"type": F.lit(None).cast("string"), "type_facet": F.lit(None).cast("string")}
    entities = consts.select(columns).unionByName(types.withColumns(none).select(columns)).unionByName(facts.withColumns(none).select(columns))
    at = e.positions.withColumnRenamed("name", "full_name")
    placed, join_errors = ingest.join_entities(entities.join(at, ["theory", "kind", "full_name"]), blocks)
    return blocks, placed, ingest.all_errors(errors, const_errors, type_errors, join_errors, ingest.sanity(entities))


def import_session(catalog: Catalog, index: str, exports: Exports) -> DataFrame:
    """Writes all theories of an export into an index, new or not, and returns the errors."""
    catalog.create(index)
    blocks, entities, errors = extract(exports)
    catalog.write(index, blocks, entities)
    return errors
