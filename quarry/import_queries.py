"""Registered queries of imports, catalogs and lookups: parts, customers and orders play types, constants and facts.

Their SQL is in ``oracle.py`` with that of the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import analysis, trees
from quarry.operators import ingest
from quarry.sources import catalog, dump, reader


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(ctor: str, name: Column, *args: Column, sorts: Column | None = None, index: Column | None = None) -> Column:
    """A tree as JSON text, its children given as such."""
    more = F.lit("")
    if index is not None:
        more = F.concat(more, F.lit(', "index": '), index.cast("string"))
    if sorts is not None:
        more = F.concat(more, F.lit(', "sorts": ["'), sorts, F.lit('"]'))
    return F.concat(F.lit(f'{{"ctor": "{ctor}", "name": "'), name, F.lit('"'), more, F.lit(', "args": ['), F.concat_ws(", ", *args) if args else F.lit(""), F.lit("]}"))


def _named(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def tree_references(spark: SparkSession, d: str) -> DataFrame:
    """What terms over parts refer to: constants, types and sorts, each once."""
    p = table(spark, d, "part")
    variable = _node("TFree", F.lit("'a"), sorts=_named("size", "p_size"))
    tree = _node("App", F.lit("app"), _node("Const", F.col("p_brand"), _node("TypeTyp", F.col("p_type"), variable)), _node("Const", F.col("p_brand")))
    return trees.references(trees.flatten(p.select(F.col("p_partkey").alias("root"), tree.alias("tree"))))


def proof_references(spark: SparkSession, d: str) -> DataFrame:
    """What proofs over orders refer to: theorems, axioms and oracles as facts, their arguments as types."""
    o = table(spark, d, "orders")
    proof = _node("AppP", F.lit("x"), _node("PThm", _named("clerk", "o_custkey"), _node("TypeTyp", F.col("o_orderstatus"))), _node("PAxm", F.col("o_orderpriority")), _node("Oracle", F.lit("trusted")), _node("MinProof", F.lit("none")))
    return trees.references(trees.flatten(o.select(F.col("o_orderkey").alias("root"), proof.alias("tree")))).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def type_printer(spark: SparkSession, d: str) -> DataFrame:
    """Types over customers as people write them: functions, arguments, a numbered variable with its sort."""
    c = table(spark, d, "customer")
    inner = _node("TypeTyp", F.lit("fun"), _node("TVar", F.lit("?a"), sorts=F.col("c_mktsegment"), index=F.col("c_nationkey")), _node("TypeTyp", F.lit("nat")))
    tree = _node("TypeTyp", F.lit("fun"), inner, _node("TypeTyp", F.lit("list"), _node("TypeTyp", _named("t", "c_nationkey"))))
    return c.select("c_custkey", trees.pretty(tree).alias("printed"))


def pure_names(spark: SparkSession, d: str) -> DataFrame:
    """References of line items without names of the logic."""
    li = table(spark, d, "lineitem")
    names = F.array(F.when(F.col("l_returnflag") == "R", "Pure.eq").otherwise(F.col("l_returnflag")), F.when(F.col("l_linestatus") == "O", "fun").otherwise(F.lit("funs")), F.lit("prop"))
    return li.select(F.explode(analysis.without_pure(names)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def last_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts with blank lines behind them, which go."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n  \n\n "))
    return table(spark, d, "documents").select("doc_id", F.md5(analysis.without_last_blank_lines(text)).alias("h"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("theory"), F.col("turn").alias("n"), F.lower("text").alias("text"))


def segment_continuations(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of conversations' turns, by what a turn begins with."""
    return ingest.segment(_spans(spark, d)).select("theory", "start", "stop", "start_line", F.md5("src").alias("h"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer that don't begin where the one before them ends."""
    o = table(spark, d, "orders")
    blocks = o.select(F.col("o_custkey").alias("theory"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "O", 1).otherwise(9)).alias("stop"))
    return ingest.not_adjacent(blocks).select("theory", "start", "expected")


def extract_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of turns, of which those of users are left blank: ids, commands and errors."""
    turns = table(spark, d, "conversations")
    text = F.when(F.col("role") == "user", F.lit(" \n")).otherwise(F.col("text"))
    spans = turns.select(F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("theory"), F.col("turn").alias("n"), text.alias("text"))
    kept, errors = ingest.extract_blocks(ingest.segment(spans, opens=F.lit(True)))
    return kept.select("id", "command", F.lit(None).cast("string").alias("message")).unionByName(errors.select(F.col("entity").alias("id"), F.lit(None).cast("string").alias("command"), "message"))


def _theory(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(F.lit("T").alias("theory"), *[c.alias(name) for name, c in columns.items()])


def _listed(entities: DataFrame) -> DataFrame:
    return entities.select("id", "name", F.concat_ws(",", "uses").alias("uses"))


def extract_types(spark: SparkSession, d: str) -> DataFrame:
    """Nations as types, defined by axioms that name them, their region and a constant."""
    n = table(spark, d, "nation")
    prop = _node("Const", _named("C.", "n_regionkey"), _node("TypeTyp", _named("T.", "n_nationkey")), _node("TypeTyp", _named("R.", "n_regionkey")), _node("Const", F.lit("Pure.eq")))
    forest = n.select(_named("prop", "n_nationkey").alias("root"), prop.alias("tree")).unionByName(n.select(_named("abbrev", "n_nationkey").alias("root"), _node("TypeTyp", _named("A.", "n_regionkey")).alias("tree")))
    axiom = _named("T.def", "n_nationkey")
    types = _theory(n, name=_named("T.", "n_nationkey"), abbrev=_named("abbrev", "n_nationkey"))
    found, _ = ingest.extract_types(types, _theory(n, name=_named("T.", "n_nationkey"), axiom_name=axiom), _theory(n, name=axiom, prop=_named("prop", "n_nationkey")), trees.flatten(forest))
    return _listed(found)


def extract_constants(spark: SparkSession, d: str) -> DataFrame:
    """Customers as constants, whose type and definition name their segment and nation."""
    c = table(spark, d, "customer")
    own = _named("T.", "c_custkey")
    typ = _node("TypeTyp", F.lit("fun"), _node("TypeTyp", F.col("c_mktsegment")), _node("TypeTyp", _named("N.", "c_nationkey")))
    prop = _node("Const", own, _node("Const", _named("C.", "c_nationkey")), _node("Const", F.lit("Pure.imp")))
    forest = c.select(_named("type", "c_custkey").alias("root"), typ.alias("tree")).unionByName(c.select(_named("prop", "c_custkey").alias("root"), prop.alias("tree")))
    axiom = _named("T.def", "c_custkey")
    consts = _theory(c, name=own, typ=_named("type", "c_custkey"), abbrev=F.lit(None).cast("string"))
    found, _ = ingest.extract_constants(consts, _theory(c, name=own, axiom_name=axiom), _theory(c, name=axiom, prop=_named("prop", "c_custkey")), trees.flatten(forest))
    return _listed(found)


def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as theorems that depend on what their customer and items stand for, suppliers as axioms of which some define a constant."""
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    own = _named("T.", "o_orderkey")
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(_named("part", "l_partkey")).alias("deps"))
    proof = _node("AppP", F.lit("x"), _node("PThm", own), _node("PAxm", _named("cust", "o_custkey")))
    forest = (
        o.select(_named("prop", "o_orderkey").alias("root"), _node("Const", F.col("o_orderstatus")).alias("tree"))
        .unionByName(o.select(_named("proof", "o_orderkey").alias("root"), proof.alias("tree")))
        .unionByName(s.select(_named("axiom", "s_suppkey").alias("root"), _node("TypeTyp", _named("N.", "s_nationkey")).alias("tree")))
    )
    rows = o.join(items, "o_orderkey", "left")
    thms = _theory(rows, name=own, prop=_named("prop", "o_orderkey"), proof=_named("proof", "o_orderkey"), deps=F.coalesce("deps", F.array().cast("array<string>")))
    axioms = _theory(s, name=_named("S.", "s_suppkey"), prop=_named("axiom", "s_suppkey"))
    constdefs = _theory(s.filter("s_acctbal < 0"), name=_named("c", "s_suppkey"), axiom_name=_named("S.", "s_suppkey"))
    typedefs = _theory(s.filter("s_nationkey = 3"), name=_named("t", "s_suppkey"), axiom_name=_named("S.", "s_suppkey"))
    return _listed(ingest.extract_facts(axioms, constdefs, typedefs, thms, trees.flatten(forest)))


def sanity_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings about line items as entities: ids and uses that repeat."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_partkey").cast("string").alias("id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("name"), F.array(F.col("l_suppkey"), F.col("l_linenumber").cast("long")).alias("uses"))
    return ingest.sanity(rows).groupBy("entity", "message").agg(F.count(F.lit(1)).alias("n"))


def symbol_rules(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms from a table of symbols made of nations; abbreviations that several share don't count."""
    n = table(spark, d, "nation")
    code = F.lpad(F.hex(8704 + F.col("n_nationkey").cast("long")), 6, "0")
    line = F.concat(F.lit(r"\<"), _named("n", "n_nationkey"), F.lit("> code: 0x"), code, F.lit(" group: x abbrev: "), _named("/", "n_nationkey"), F.lit(" abbrev: "), _named("&", "n_regionkey"))
    return catalog.symbol_synonyms(n.select(line.alias("value")))


def scratch(spark: SparkSession) -> str:
    """A new folder in the store that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/indexes-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    blocks = c.select(_named("b", "c_custkey").alias("id"), _named("T", "c_nationkey").alias("theory"), F.col("c_mktsegment").alias("command"), F.lit(1).alias("start_line"), F.col("c_name").alias("src"))
    return blocks, o.select(_named("e", "o_orderkey").alias("id"), _named("b", "o_custkey").alias("block_id"), F.lit("Fact").alias("kind"), F.col("o_orderstatus").alias("name"), F.array().cast("array<string>").alias("uses"))


def _left(store: catalog.Catalog) -> DataFrame:
    """What an index holds, by theory: blocks and entities."""
    blocks = store.table("x", "blocks").groupBy("theory").agg(F.count(F.lit(1)).alias("blocks"), F.min("src").alias("first"))
    entities = store.table("x", "entities").groupBy("theory").agg(F.count(F.lit(1)).alias("entities"))
    return blocks.join(entities, "theory", "left").select("theory", "blocks", "first", F.coalesce("entities", F.lit(0)).alias("entities"))


def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An index of customers by nation, of which one nation is imported again, renamed and without its orders."""
    store = catalog.Catalog(spark, scratch(spark))
    blocks, entities = _customers(spark, d)
    store.create("x")
    store.write("x", blocks, entities)
    again = blocks.filter("theory = 'T3'").withColumn("src", F.concat(F.lit("again "), F.col("src")))
    store.write("x", again, entities.limit(0))
    return _left(store)


def catalog_delete(spark: SparkSession, d: str) -> DataFrame:
    """An index of customers by nation after those of a segment are deleted with their orders."""
    store = catalog.Catalog(spark, scratch(spark))
    store.create("x")
    store.write("x", *_customers(spark, d))
    store.delete("x", F.col("command") == "BUILDING")
    return _left(store)


def _stored_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as stored documents: the flags of their finished lines must be one, their priority's digits a number, comments of lines may be any."""
    done = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("order")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("kind"))
    line = F.array(F.expr("substring(o_orderpriority, 1, CAST(o_orderkey % 2 AS INT) + 1)"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), line.alias("start_line"), F.array("o_orderstatus", "o_orderpriority").alias("uses"))
    rows = rows.join(done, F.col("id") == F.col("order"), "left").drop("order")
    return reader.read(rows, {"kind": reader.Need(), "start_line": reader.Need("int"), "uses": reader.Need(many=True), "type": reader.Need(required=False)})


def read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with stored documents, by field and problem."""
    _, errors = _stored_orders(spark, sf_dir)
    return errors.groupBy("field", "problem").agg(F.count(F.lit(1)).alias("documents"), F.sum("found").alias("found"))


def read_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored documents that hold what they must, typed."""
    good, _ = _stored_orders(spark, sf_dir)
    return good.select("id", "kind", "start_line", F.array_join("uses", ",").alias("uses"), "type")


def dump_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns, written as a dump of nested folders with markup, read as spans of two sessions and of what lies below them."""
    number = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(40))
    folder = F.concat(F.lit("S"), (number % 3).cast("string"), F.lit(".T"), number.cast("string"))
    turns = table(spark, sf_dir, "conversations").select(folder.alias("dir"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.concat(F.lit('<turn role="'), dump.escaped(F.col("role")), F.lit('" mark="1 > 0"><name>\\&lt;role></name> \\&lt;and> <!-- a note -->'), dump.escaped(F.col("text")), F.lit("</turn>"))
    path = scratch(spark)
    turns.repartition("dir").sortWithinPartitions("dir", "conv_id", "turn", "role", "text").select("dir", node.alias("value")).write.partitionBy("dir").text(path)
    found = dump.read_markup(spark, path, {r"\<and>": "∧"}, ["S0", "S2"], "part-*", "dir=([^/]+)/")
    return found.select("session", "theory", "n", F.md5("text").alias("h"))


QUERIES = {
    f.__name__: f
    for f in (
        tree_references, proof_references, type_printer, pure_names, last_blank_lines, segment_continuations, adjacency, extract_blocks, extract_types, extract_constants, extract_facts,
        sanity_warnings, symbol_rules, catalog_upsert, catalog_delete, read_errors, read_valid, dump_spans,
    )
}
