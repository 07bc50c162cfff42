"""From exported theories to blocks with their entities.

Every step is a plan from tables to a table and a table of errors; none stops
the others.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.analysis import block_id, command_kind, entity_id, facet_copy, without_first_component, without_pure
from quarry.functions.trees import referring
from quarry.operators.lookup import distinct_in_parts

#: What a span begins with that continues the block before it; an @ may stand before it (fixed values).
CONTINUATIONS = (
    "also and apply assume back by case } consider defer define done . .. finally fix focus from guess have hence let moreover next nitpick note obtain oops prefer presume proof "
    "qed quickcheck refute schematic_goal show sledgehammer sorry subgoal supply termination then thus try0 ultimately unfolding using where with"
).split()
#: Lines of the blocks before and after that a block keeps.
CONTEXT_LINES = 5
#: Places by which blocks and positions are brought together.
STRIDE = 4_096

ERRORS = "step string, entity string, message string"


def continues(text: Column) -> Column:
    """True for a span that never opens a block unless it is the first: blank, or beginning with a continuation."""
    starts = "^@?(" + "|".join(map(re.escape, CONTINUATIONS)) + ")"
    t = F.regexp_replace(text, r"^\s+", "")
    return (t == "") | t.rlike(starts)


def segment(spans: DataFrame, by: list[str] = ("theory",), opens: Column | None = None, length: Column | None = None, shown: Column | None = None) -> DataFrame:
    """Blocks from ordered spans (by, n, text): start, stop (from 1, stop not included), start_line, src.

    A span that opens a block begins an island; the island's number is a running
    count. Offsets and lines are running sums, so theories are independent.
    ``length`` is how many places a span takes, its characters if not given;
    ``shown`` what src keeps of it, else its text.
    """
    by = list(by)
    order = Window.partitionBy(*by).orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    newlines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    length = F.char_length("text") if length is None else length
    first = F.row_number().over(order) == 1
    opens = ~continues(F.col("text")) if opens is None else opens
    rows = spans.select(
        *by, "n", (F.col("text") if shown is None else shown).alias("text"), length.alias("length"),
        F.sum(F.when(first | opens, 1).otherwise(0)).over(order).alias("island"),
        (1 + F.coalesce(F.sum(length).over(before), F.lit(0))).alias("start"),
        (1 + F.coalesce(F.sum(newlines).over(before), F.lit(0))).alias("start_line"),
    )
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), "")
    return rows.groupBy(*by, "island").agg(
        F.min("start").cast("long").alias("start"), F.max(F.col("start") + F.col("length")).cast("long").alias("stop"), F.min("start_line").cast("int").alias("start_line"), texts.alias("src")
    )


def not_adjacent(blocks: DataFrame, by: list[str] = ("theory",)) -> DataFrame:
    """Blocks that don't begin where the one before them ends; there should be none."""
    order = Window.partitionBy(*by).orderBy("start")
    return blocks.withColumn("expected", F.lag("stop").over(order)).filter("expected is not null and expected <> start")


def _lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))


def with_context(blocks: DataFrame, by: list[str] = ("theory",), text: str = "src", order: str = "start", lines: int = CONTEXT_LINES) -> DataFrame:
    """Adds src_before and src_after: the last lines of the block before, the first of the one after, with their line ends."""
    window = Window.partitionBy(*by).orderBy(order)
    before, after = _lines(F.coalesce(F.lag(text).over(window), F.lit(""))), _lines(F.coalesce(F.lead(text).over(window), F.lit("")))
    last = F.slice(before, F.greatest(F.size(before) - (lines - 1), F.lit(1)), F.lit(lines))
    return blocks.withColumn("src_before", F.array_join(last, "")).withColumn("src_after", F.array_join(F.slice(after, 1, lines), ""))


def extract_blocks(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with id, command and context; a blank one is an error."""
    rows = with_context(segments).withColumn("id", block_id(F.col("theory"), F.col("start"), F.col("stop")))
    blank = ~F.col("src").rlike(r"\S")
    errors = rows.filter(blank).select(F.lit("extract-blocks").alias("step"), F.col("id").alias("entity"), F.lit("blank block").alias("message"))
    kept = rows.filter(~blank).withColumn("command", command_kind(F.col("src"))).withColumn("theory_facet", facet_copy(F.col("theory")))
    return kept, errors


def contained(positions: DataFrame, blocks: DataFrame, by: list[str] = ("theory",), offset: str = "offset", end: str = "end_offset", stride: int = STRIDE) -> DataFrame:
    """Every position with ``__block``, the id of the block that contains it, null if none does.

    Blocks (by, start, stop, id) don't overlap, as those of a segmentation
    don't; of blocks that begin alike the last by id counts. An as-of join
    without a join: positions and blocks are sorted together, and each position
    takes the block that began last before it. Blocks are listed under each
    stretch of places that they touch, so even one long theory is spread out,
    and rows are shuffled once.
    """
    by = list(by)
    own = positions.columns
    place = lambda c: F.floor(F.col(c) / stride)
    points = positions.select(*by, place(offset).alias("__stretch"), F.col(offset).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.struct(*own).alias("__row"))
    begun = F.struct(F.col("stop").alias("stop"), F.col("id").alias("id"))
    touched = F.sequence(place("start"), F.greatest(F.floor((F.col("stop") - 1) / stride), place("start")))
    listed = blocks.select(*by, F.explode(touched).alias("__stretch"), F.col("start").cast("long").alias("__at"), F.lit(0).alias("__kind"), begun.alias("__begun"))
    before = Window.partitionBy(*by, "__stretch").orderBy("__at", "__kind", "__begun").rowsBetween(Window.unboundedPreceding, 0)
    met = points.unionByName(listed, allowMissingColumns=True).withColumn("__last", F.last("__begun", True).over(before)).filter("__kind = 1")
    return met.select("__row.*", F.when(F.col(f"__row.{end}") <= F.col("__last.stop"), F.col("__last.id")).alias("__block"))


def join_entities(entities: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with the block_id of the block around them; those outside all blocks, and repeated block ids, are errors."""
    twice = blocks.groupBy("id").count().filter("count > 1")
    found = contained(entities, blocks.dropDuplicates(["id"]))
    errors = found.filter("__block is null").select(F.lit("join-entities").alias("step"), F.col("id").alias("entity"), F.lit("no block around it").alias("message"))
    errors = errors.unionByName(twice.select(F.lit("join-entities").alias("step"), F.col("id").alias("entity"), F.lit("block id repeats").alias("message")))
    return found.filter("__block is not null").withColumnRenamed("__block", "block_id"), errors


def definitions(named: DataFrame, defs: DataFrame, axioms: DataFrame, step: str) -> tuple[DataFrame, DataFrame]:
    """The axioms that define each name (theory, name, prop root); a missing one and a repeated one are errors, of the latter the first counts."""
    wanted = named.select("theory", "name").join(defs.select("theory", "name", "axiom_name"), ["theory", "name"])
    counted = axioms.groupBy("theory", F.col("name").alias("axiom_name")).agg(F.min("prop").alias("prop"), F.count(F.lit(1)).alias("n"))
    found = wanted.join(counted, ["theory", "axiom_name"], "left")
    missing = found.filter("prop is null").select(F.lit(step).alias("step"), F.col("name").alias("entity"), F.concat(F.lit("no axiom "), F.col("axiom_name")).alias("message"))
    twice = found.filter("n > 1").select(F.lit(step).alias("step"), F.col("name").alias("entity"), F.concat(F.lit("axiom repeats: "), F.col("axiom_name")).alias("message"))
    return found.filter("prop is not null").select("theory", "name", "prop"), missing.unionByName(twice)


def other_axioms(axioms: DataFrame, constdefs: DataFrame, typedefs: DataFrame) -> DataFrame:
    """Axioms that define neither a constant nor a type."""
    names = constdefs.select("theory", "axiom_name").unionByName(typedefs.select("theory", "axiom_name")).distinct()
    return axioms.join(names.withColumnRenamed("axiom_name", "name"), ["theory", "name"], "left_anti")


def _uses(rows: DataFrame, roots: DataFrame, nodes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Adds uses: ids of what the roots of a row refer to, those of the logic and the row's own name (where ``own`` says so) left out.

    ``more`` has further uses of a key in arrays: columns key and found.
    """
    refs = roots.join(referring(nodes), "root").filter(~F.col("own") | (F.col("ref_self") != F.col("name")) | (F.col("kind") != F.col("ref_kind")))
    found = refs.select("key", F.array(F.struct("kind", "name")).alias("found"))
    if more is not None:
        found = found.unionByName(more)
    # repeats go where a key's references meet, so nothing is shuffled only to drop them
    ids = found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("found"))
    rows = rows.join(ids, "key", "left")
    names = F.filter(F.coalesce("found", F.array().cast(ids.schema["found"].dataType)), lambda s: F.size(without_pure(F.array(s["name"]))) > 0)
    return rows.withColumn("uses", F.transform(names, lambda s: entity_id(s["kind"], s["name"]))).drop("found")


def _roots(rows: DataFrame, column: str, kind: str, own: bool) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).select("key", F.col(column).alias("root"), F.lit(own).alias("own"), F.col("name").alias("ref_self"), F.lit(kind).alias("ref_kind"))


def _entities(rows: DataFrame, kind: str) -> DataFrame:
    short = without_first_component(F.col("name"))
    return rows.withColumn("full_name", F.col("name")).withColumn("id", entity_id(F.lit(kind), F.col("full_name"))).withColumn("kind", F.lit(kind)).withColumn("name", short).withColumn("name_facet", facet_copy(short)).drop("key")


def extract_constants(consts: DataFrame, constdefs: DataFrame, axioms: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Constants (theory, name, typ and abbrev: roots) with what their type, definitions and abbreviation refer to."""
    rows = consts.withColumn("key", entity_id(F.col("theory"), F.col("name")))
    props, errors = definitions(consts, constdefs, axioms, "extract-constants")
    props = props.withColumn("key", entity_id(F.col("theory"), F.col("name")))
    roots = _roots(rows, "typ", "Constant", False).unionByName(_roots(props, "prop", "Constant", True)).unionByName(_roots(rows, "abbrev", "Constant", False))
    return _entities(_uses(rows, roots, nodes), "Constant"), errors


def extract_types(types: DataFrame, typedefs: DataFrame, axioms: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types (theory, name, abbrev: root) with what their definitions and abbreviation refer to."""
    rows = types.withColumn("key", entity_id(F.col("theory"), F.col("name")))
    props, errors = definitions(types, typedefs, axioms, "extract-types")
    props = props.withColumn("key", entity_id(F.col("theory"), F.col("name")))
    roots = _roots(props, "prop", "Type", True).unionByName(_roots(rows, "abbrev", "Type", False))
    return _entities(_uses(rows, roots, nodes), "Type"), errors


def extract_facts(axioms: DataFrame, constdefs: DataFrame, typedefs: DataFrame, thms: DataFrame, nodes: DataFrame) -> DataFrame:
    """Facts: axioms that define nothing, and theorems (theory, name, prop and proof: roots, deps: names).

    A theorem leaves itself out of what its proof refers to, not of its deps.
    """
    free = other_axioms(axioms, constdefs, typedefs).withColumn("key", entity_id(F.lit("a"), entity_id(F.col("theory"), F.col("name"))))
    rows = thms.withColumn("key", entity_id(F.lit("t"), entity_id(F.col("theory"), F.col("name"))))
    deps = rows.filter(F.size("deps") > 0).select("key", F.transform("deps", lambda name: F.struct(F.lit("Fact").alias("kind"), name.alias("name"))).alias("found"))
    theorems = _uses(rows, _roots(rows, "prop", "Fact", False).unionByName(_roots(rows, "proof", "Fact", True)), nodes, deps)
    return _entities(_uses(free, _roots(free, "prop", "Fact", False), nodes), "Fact").unionByName(_entities(theorems.drop("deps", "proof"), "Fact"), allowMissingColumns=True)


def repeated_ids(entities: DataFrame, id_: str = "id") -> DataFrame:
    """Ids that different entities share, and how many."""
    return distinct_in_parts(entities, entities.count()).groupBy(id_).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def repeated_uses(entities: DataFrame, id_: str = "id") -> DataFrame:
    """Entities that list something twice."""
    return entities.filter(F.size(F.array_distinct("uses")) != F.size("uses")).select(id_)


def sanity(entities: DataFrame) -> DataFrame:
    """Warnings about entities, as errors."""
    ids = repeated_ids(entities.select("id", "kind", "name", "uses")).select(F.lit("sanity").alias("step"), F.col("id").alias("entity"), F.lit("id repeats").alias("message"))
    return ids.unionByName(repeated_uses(entities).select(F.lit("sanity").alias("step"), F.col("id").alias("entity"), F.lit("uses repeat").alias("message")))


def all_errors(*errors: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, errors)
