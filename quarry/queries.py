"""Registered queries of the engine on the star-schema tables, with the SQL that says what each must return.

Orders play blocks, line items their entities; documents play blocks with source text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import import_queries
from quarry.functions import analysis
from quarry.import_queries import table
from quarry.operators import ingest, lookup, paging
from quarry.plans import compiler, terms
from quarry.plans.compiler import Corpus
from quarry.plans.query import And, Exact, FieldFilter, InRange, InResult, Not, Or, Term, form_filters, matched, used_by
from quarry.sources import catalog, shards


def orders(spark: SparkSession, sf_dir: str) -> Corpus:
    """Orders as blocks, line items as entities."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    blocks = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("command"), F.col("o_orderstatus").alias("theory_facet"), F.col("o_totalprice").cast("int").alias("start_line"))
    entities = li.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("block_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("name_facet"),
        F.col("l_quantity").cast("int").alias("start_line"), F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("uses"),
    )
    return Corpus(blocks, entities)


def texts(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents as blocks of source text, labels as entities."""
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    blocks = d.select(F.col("doc_id").alias("id"), F.col("source").alias("theory_facet"), F.col("lang").alias("command"), F.col("n_chars").cast("int").alias("start_line"), F.col("text").alias("src"))
    return Corpus(blocks, la.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("block_id"), F.when(F.col("toxic") == 1, "Fact").otherwise("Constant").alias("kind")))


#: Where the texts of a folder's documents have been imported, by session and by the files that they were read from.
_IMPORTED: dict[tuple, str] = {}


def searchable(spark: SparkSession, sf_dir: str) -> Corpus:
    """``texts`` with a stored index of them, imported by the first query that asks for it and found again as long as the files are the same."""
    corpus = texts(spark, sf_dir)
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    made = tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(files)))
    key = (spark.sparkContext.applicationId, made)
    if key not in _IMPORTED:
        path = import_queries.scratch(spark)
        columns = {"src": "source_text"}
        terms.write_terms(terms.postings_of(corpus.blocks, columns), terms.lengths_of(corpus.blocks, columns), path)
        _IMPORTED[key] = path
    return Corpus(corpus.blocks, corpus.entities, block_terms=terms.read_terms(spark, _IMPORTED[key]))


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select("id")


def _blocks(*filters: tuple, corpus=orders):
    return lambda spark, d: _ids(compiler.blocks(corpus(spark, d), tuple(FieldFilter(a, b) for a, b in filters)))


def _facet(name: str, *filters: tuple, limit: int = 100, corpus=orders):
    return lambda spark, d: compiler.facet(corpus(spark, d), tuple(FieldFilter(a, b) for a, b in filters), name, limit)


def minimum_slice(spark: SparkSession, d: str) -> DataFrame:
    """A page of ten and the number of all: a filter of blocks and one of entities."""
    found = compiler.blocks(orders(spark, d), (FieldFilter("Kind", Exact("R")), FieldFilter("Command", Exact("1-URGENT"))))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return paging.page(found, 10).select("id").crossJoin(F.broadcast(total))


def filter_id_list(spark: SparkSession, d: str) -> DataFrame:
    c = orders(spark, d)
    as_text = Corpus(c.blocks.withColumn("id", F.col("id").cast("string")), c.entities)
    return _ids(compiler.matching(as_text, as_text.blocks, [FieldFilter("Id", matched(["1", "7", "32", "none"]))]))


def filter_wildcard(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("block_id"), F.col("p_name").alias("name_facet"))
    return _ids(compiler.matching(Corpus(p, p), p, [FieldFilter("NameFacet", Term("small*"))]))


def filter_not_exists(spark: SparkSession, d: str) -> DataFrame:
    c = orders(spark, d)
    rows = c.entities.withColumn("kind", F.nullif("kind", F.lit("N")))
    return compiler.matching(c, rows, [FieldFilter("Kind", Not(Exact("A")))]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def filter_not_multivalued(spark: SparkSession, d: str) -> DataFrame:
    c = orders(spark, d)
    found = compiler.matching(c, c.entities, [FieldFilter("Uses", Not(Term("1?")))])
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("block_id").alias("s"))


def block_join_two_filters_vs_any(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose entities satisfy two filters, but no single one does both."""
    c = orders(spark, d)
    one = compiler.blocks(c, (FieldFilter("Kind", Exact("R")),)).select("id")
    two = compiler.blocks(c, (FieldFilter("NameFacet", Exact("O")),)).select("id")
    same = compiler.blocks(c, (FieldFilter("Kind", Exact("R")), FieldFilter("NameFacet", Exact("O")))).select("id")
    return one.join(two, "id", "left_semi").join(same, "id", "left_anti")


def block_join_colocated(spark: SparkSession, d: str) -> DataFrame:
    """The block join on blocks and entities that are written in the same shards first."""
    c, path = orders(spark, d), import_queries.scratch(spark)
    shards.write(c.blocks, c.entities, path, shards.number_for(spark, [f"{d}/orders.parquet", f"{d}/lineitem.parquet"]))
    return _ids(compiler.blocks(Corpus(*shards.read(spark, path)), (FieldFilter("Kind", Exact("R")), FieldFilter("NameFacet", Exact("F")), FieldFilter("Command", Exact("3-MEDIUM")))))


def children_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The join from blocks to their entities, by kind."""
    c = orders(spark, d)
    parents = compiler.matching(c, c.blocks, [FieldFilter("Command", Exact("5-LOW"))]).select(F.col("id").alias("b"))
    return c.entities.join(parents, F.col("block_id") == F.col("b"), "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def block_childless(spark: SparkSession, d: str) -> DataFrame:
    c = orders(spark, d)
    nested = compiler.with_children(Corpus(c.blocks, c.entities.select("id", "block_id")), c.blocks)
    return nested.filter(F.size("entities") == 0).select("id")


def child_expansion(spark: SparkSession, d: str) -> DataFrame:
    """A page of blocks found by one entity, with all entities of each."""
    c = orders(spark, d)
    page = paging.page(compiler.blocks(c, (FieldFilter("Kind", Exact("A")), FieldFilter("StartLine", InRange(1000, 90000)))), 20)
    return compiler.with_children(Corpus(c.blocks, c.entities.select("id", "block_id", "kind")), page).select("id", F.size("entities").cast("long").alias("n_entities"), F.size(F.filter("entities", lambda e: e["kind"] == "A")).cast("long").alias("n_a"))


def in_result_capped(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose parts are used by the first 1000 documents of an inner query."""
    c = orders(spark, d)
    f = FieldFilter("Uses", InResult("Uses", (FieldFilter("Kind", Exact("R")),)))
    return compiler.matching(c, c.entities, [f]).agg(F.count(F.lit(1)).alias("n"), F.sum("block_id").alias("s"))


def used_by_parts(spark: SparkSession, d: str) -> DataFrame:
    return _ids(compiler.blocks(orders(spark, d), (used_by(["1", "2", "17"]),)))


def _parts_as_entities(spark: SparkSession, d: str) -> Corpus:
    """Line items and the parts that they use, both as entities."""
    o = orders(spark, d)
    p = table(spark, d, "part").select((-F.col("p_partkey")).alias("id"), F.col("p_size").cast("long").alias("block_id"), F.lit("Type").alias("kind"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("uses"))
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("block_id"), F.lit("Fact").alias("kind"), F.lit(None).cast("string").alias("name"), F.array((-F.col("l_partkey")).cast("string")).alias("uses"))
    return Corpus(o.blocks, p.unionByName(li))


def uses_of_entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts that the first order's items use, through an inner query."""
    c = _parts_as_entities(spark, d)
    f = FieldFilter("ChildId", InResult("Uses", (FieldFilter("Id", InRange(11, 40)),)))
    return compiler.matching(c, c.entities, [f]).select("id").distinct()


def facet_overflow(spark: SparkSession, d: str) -> DataFrame:
    """A field with 25 values is left out at a limit of 25 and kept at 26."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("command"), F.col("p_partkey").alias("block_id"))
    c = Corpus(p, p.select("id", "block_id"))
    at = lambda n: compiler.facet(c, (), "Command", n).select(F.lit(n).alias("max_facets"), "value", "count")
    return at(25).unionByName(at(26))


def facet_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by token of a name."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("theory"))
    return compiler.facet(Corpus(p, p.select("id", F.col("id").alias("block_id"))), (), "SourceTheory", 100_000)


def facet_merge_selection(spark: SparkSession, d: str) -> DataFrame:
    counts = compiler.facet(orders(spark, d), (FieldFilter("StartLine", InRange(0, 50000)),), "Command")
    chosen = spark.createDataFrame([("Command", "1-URGENT"), ("Command", "9-NONE")], "field string, value string")
    return compiler.facets_with_selection(counts, chosen)


def facets_drill_down(spark: SparkSession, d: str) -> DataFrame:
    """Several facets of one search, as a form asks for them."""
    filters = form_filters(searches=[("NameFacet", ["F"], "OneOf")], selected={"Command": ["1-URGENT", "5-LOW"], "Kind": ["R"]})
    return compiler.facets(orders(spark, d), filters, ("Command", "SourceTheoryFacet", "Kind"), 10)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    b = orders(spark, d).blocks
    return b.withColumn("score", F.col("start_line").cast("double"))


def page_1(spark: SparkSession, d: str) -> DataFrame:
    return paging.page(_ranked(spark, d), 10).select("id", "score")


def page_2_keyset(spark: SparkSession, d: str) -> DataFrame:
    last = paging.page(_ranked(spark, d), 10).collect()[-1]
    return paging.page(_ranked(spark, d), 10, paging.cursor_of(last["score"], last["id"])).select("id", "score")


def total_count(spark: SparkSession, d: str) -> DataFrame:
    return compiler.blocks(orders(spark, d), (FieldFilter("Command", matched(["1-URGENT", "2-HIGH"])),)).agg(F.count(F.lit(1)).alias("total"))


def lookup_block(spark: SparkSession, d: str) -> DataFrame:
    return lookup.block_of(orders(spark, d), 7).select("id", "command")


def lookup_by_child(spark: SparkSession, d: str) -> DataFrame:
    """An id that only an entity has leads to its block."""
    c = orders(spark, d)
    moved = Corpus(c.blocks, c.entities.withColumn("id", -F.col("block_id") * 10 - 1))
    return lookup.block_of(moved, -71).select("id", "command")


def resolve_uses(spark: SparkSession, d: str) -> DataFrame:
    """What orders use that exists; parts of odd number are made to dangle."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.array("l_partkey").alias("uses"))
    return lookup.resolve_edges(li, table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"))).groupBy("used").agg(F.count(F.lit(1)).alias("n"))


def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    return lookup.summary(orders(spark, d).entities, ("A", "N", "R"))


def kind_ordering(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).entities
    return rows.select("id", lookup.kind_order(F.col("kind")).alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def theory_listing(spark: SparkSession, d: str) -> DataFrame:
    c = texts(spark, d)
    return lookup.theory_listing(Corpus(c.blocks.withColumn("theory", F.col("theory_facet")), c.entities), "src3", 25).select("id", "start_line")


def tokenize_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.explode(analysis.base_tokens(F.col("text"), "source_text")).alias("t"))
    return rows.groupBy(F.lower("t").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def tokenize_name_wdg(spark: SparkSession, d: str) -> DataFrame:
    name = F.replace("p_type", F.lit(" "), F.lit("_"))
    rows = table(spark, d, "part").select(F.explode(analysis.index_tokens(F.concat(name, F.lit(" "), F.col("p_brand")), "name_text")).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def tokenize_type(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("'a::"), F.col("p_brand"), F.lit(" => ("), F.replace("p_type", F.lit(" "), F.lit(",")), F.lit(")"))
    rows = table(spark, d, "part").select(F.explode(analysis.query_tokens(text, "type_text")).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def ascii_folding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.explode(analysis.base_tokens(F.col("text"), "name_text")).alias("t"))
    return rows.groupBy(analysis.folded(F.lower("t")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(analysis.html_stripped(F.col("html"))).alias("h"))


def query_replacements(spark: SparkSession, d: str) -> DataFrame:
    """Replacements, synonyms and arrows on queries made of documents' languages and sources."""
    text = F.concat(F.col("lang"), F.lit(r" \<and> x ==> (|y|) ... "), F.col("source"))
    rows = table(spark, d, "documents").select(F.explode(analysis.query_tokens(text, "source_text", {r"\<and>": "∧"})).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def command_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(analysis.command_kind(F.col("text")).alias("command")).agg(F.count(F.lit(1)).alias("n"))


def drop_first_component(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]+)", 1)
    return table(spark, d, "pages").select("page_id", analysis.without_first_component(host).alias("name"), analysis.entity_id(F.lit("Fact"), host).alias("id"))


def term_any_token(spark: SparkSession, d: str) -> DataFrame:
    return _ids(compiler.blocks(searchable(spark, d), (FieldFilter("SourceCode", Term("idiot scum")),)))


def term_wildcard_token(spark: SparkSession, d: str) -> DataFrame:
    return _ids(compiler.blocks(searchable(spark, d), (FieldFilter("SourceCode", Term("path?t*")),)))


def phrase_slop(spark: SparkSession, d: str) -> DataFrame:
    return _ids(compiler.blocks(searchable(spark, d), (FieldFilter("SourceCode", Exact("than with")),)))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = compiler.blocks(searchable(spark, d), (FieldFilter("SourceCode", Term("pathetic clown")),))
    return paging.page(found, 10).select("id", "score")


def unresolved_documents(spark: SparkSession, d: str) -> DataFrame:
    """A search over blocks and entities alike, by kind of document."""
    found = compiler.documents(orders(spark, d), (FieldFilter("StartLine", InRange(10, 40)),))
    return found.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"))


def full_scan(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).documents().groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def form_search(spark: SparkSession, d: str) -> DataFrame:
    """A whole search form: two field searches in different modes and chosen facet values."""
    filters = form_filters(searches=[("Command", ["1-URGENT", "2-HIGH"], "Neither"), ("NameFacet", ["F"], "OneOf")], selected={"Kind": ["R", "A"]})
    return _ids(compiler.blocks(orders(spark, d), filters))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "conversations").select(F.col("conv_id").alias("theory"), F.col("turn").alias("n"), "text", "role")
    return ingest.segment(spans, ["theory"], F.col("role") == "user")


def segment_spans(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("theory", "start", "stop", "start_line", F.md5("src").alias("h"))


def context_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.with_context(_segments(spark, d))
    return rows.select("theory", "start", F.md5("src_before").alias("before"), F.md5("src_after").alias("after"))


def range_join_containment(spark: SparkSession, d: str) -> DataFrame:
    """The segment around the middle of every turn."""
    turns = table(spark, d, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    at = 1 + F.coalesce(F.sum(F.char_length("text")).over(before), F.lit(0)) + F.floor(F.char_length("text") / 2)
    points = turns.select(F.col("conv_id").alias("theory"), "turn", at.alias("offset"), at.alias("end_offset"))
    blocks = _segments(spark, d).withColumn("id", F.col("start"))
    return ingest.contained(points, blocks).select("theory", "turn", F.col("__block").alias("start"))


def dup_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"), "l_partkey", "l_suppkey")
    return ingest.repeated_ids(rows)


def dup_uses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("uses"))
    return ingest.repeated_uses(rows)


def anti_join_axioms(spark: SparkSession, d: str) -> DataFrame:
    """Names that define nothing: orders without line items, and not those of one customer."""
    o = table(spark, d, "orders")
    axioms = o.select(F.lit("t").alias("theory"), F.col("o_orderkey").cast("string").alias("name"))
    defs = table(spark, d, "lineitem").select(F.lit("t").alias("theory"), F.col("l_orderkey").cast("string").alias("axiom_name"))
    more = o.filter("o_custkey = 1").select(F.lit("t").alias("theory"), F.col("o_orderkey").cast("string").alias("axiom_name"))
    return ingest.other_axioms(axioms, defs, more).select(F.col("name").alias("id"))


def definition_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations by key, some missing: errors by message."""
    c = table(spark, d, "customer").select(F.lit("t").alias("theory"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("axiom_name"))
    axioms = table(spark, d, "nation").filter("n_nationkey < 20").select(F.lit("t").alias("theory"), F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("prop"))
    _, errors = ingest.definitions(c.select("theory", "name"), c, axioms, "s")
    return errors.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def copy_field_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(analysis.facet_copy(F.col("text"))).alias("h"))


def list_indexes(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 10 == 7, F.concat(F.lit("default_"), F.col("n_name"))).otherwise(F.col("n_name")).alias("name"), F.col("n_nationkey").alias("ordinal"))
    return catalog.default_first_table(names).select("name", F.col("rank").cast("long").alias("rank"))


def index_name_parts(spark: SparkSession, d: str) -> DataFrame:
    plain = F.replace("n_name", F.lit("_"), F.lit("-"))
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws("_", plain, F.lit("2020"), F.lit("ARCHIVE"))).otherwise(plain)
    return table(spark, d, "nation").select("n_nationkey", catalog.name_parts(name).alias("p")).select("n_nationkey", "p.name", "p.release", "p.archive")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of users: the newest of each."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return catalog.latest(e, "user_id", "event_id")


def session_selection(spark: SparkSession, d: str) -> DataFrame:
    dirs = table(spark, d, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("dir"))
    return catalog.sessions(dirs)


def delete_by_query(spark: SparkSession, d: str) -> DataFrame:
    """What is left after deleting by a filter."""
    c = orders(spark, d)
    gone = compiler.matching(c, c.blocks, [FieldFilter("Command", Exact("1-URGENT"))]).select("id")
    return c.blocks.join(gone, "id", "left_anti").groupBy("command").agg(F.count(F.lit(1)).alias("n"))


def resolve_all_uses(spark: SparkSession, d: str) -> DataFrame:
    """What orders use among all parts."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.array("l_partkey", "l_suppkey").alias("uses"))
    return lookup.resolve_edges(li, table(spark, d, "part").select(F.col("p_partkey").alias("id"))).groupBy("used").agg(F.count(F.lit(1)).alias("n"))


def theory_listing_whole(spark: SparkSession, d: str) -> DataFrame:
    """The listing of a source at its own limit."""
    c = texts(spark, d)
    return lookup.theory_listing(Corpus(c.blocks.withColumn("theory", F.col("theory_facet")), c.entities), "src3").select("id", "start_line")


def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Line items with the parts that they use in short."""
    c = _parts_as_entities(spark, d)
    items = orders(spark, d).entities.withColumn("uses", F.array((-F.col("uses")[0].cast("long")).cast("string"), F.lit("7")))
    return lookup.resolved(Corpus(c.blocks, c.entities.filter("kind = 'Type'")), items).select("id", F.size("uses").cast("long").alias("n_uses"), F.get("uses", F.lit(0))["name"].alias("name"))


def best_child_score(spark: SparkSession, d: str) -> DataFrame:
    """Sizes by the best rank of their parts' names."""
    p = table(spark, d, "part")
    c = Corpus(p.select(F.col("p_size").cast("long").alias("id")).distinct(), p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("block_id"), F.col("p_name").alias("name")))
    return compiler.blocks(c, (FieldFilter("Name", Term("small bolt")),)).select("id", "score")


def or_ranks_both_first(spark: SparkSession, d: str) -> DataFrame:
    """Documents with both of two words rank before those with one."""
    found = compiler.blocks(searchable(spark, d), (FieldFilter("SourceCode", Or(Exact("idiot"), Exact("scum"))),))
    return paging.page(found, 10).select("id", "score")


def facet_other_field(spark: SparkSession, d: str) -> DataFrame:
    """A filter on a name's text restricts the facet of the whole name, as they are different fields."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("theory"), F.col("p_name").alias("theory_facet"))
    return compiler.facet(Corpus(p, p.select("id", F.col("id").alias("block_id"))), (FieldFilter("SourceTheory", Term("small")), FieldFilter("SourceTheoryFacet", Exact("small bolt"))), "SourceTheoryFacet")


def facet_without_values(spark: SparkSession, d: str) -> DataFrame:
    """Only values that occur are counted; a field without any gives no row."""
    filters = (FieldFilter("StartLine", InRange(0, 1500)),)
    return compiler.facets(orders(spark, d), filters, ("Command", "ConstantTypeFacet"))


def inner_query_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name shares a word with what an inner query finds."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("block_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("name_facet"))
    c = Corpus(p.limit(0).select("id"), p)
    return _ids(compiler.matching(c, p, [FieldFilter("Name", InResult("Name", (FieldFilter("Id", Exact("7")),)))]))


QUERIES = import_queries.QUERIES | {
    "minimum_slice": minimum_slice,
    "filter_exact_parent": _blocks(("Command", Exact("1-URGENT"))),
    "filter_exact_int": _blocks(("StartLine", Exact("1234"))),
    "filter_range": _blocks(("StartLine", InRange(1000, 20000))),
    "filter_wildcard": filter_wildcard,
    "filter_not_exists": filter_not_exists,
    "filter_not_multivalued": filter_not_multivalued,
    "filter_and_or_nested": _blocks(("Command", And(Not(Exact("5-LOW")), Or(Term("1*"), Term("?-HIGH")))), ("StartLine", Or(InRange(0, 5000), InRange(100000, 200000)))),
    "filter_id_list": filter_id_list,
    "block_join_same_child": _blocks(("Kind", Exact("R")), ("NameFacet", Exact("F")), ("Command", Exact("3-MEDIUM"))),
    "block_join_colocated": block_join_colocated,
    "block_join_two_filters_vs_any": block_join_two_filters_vs_any,
    "children_of_blocks": children_of_blocks,
    "block_childless": block_childless,
    "child_expansion": child_expansion,
    "in_result_capped": in_result_capped,
    "used_by": used_by_parts,
    "uses_of": uses_of_entities,
    "facet_parent_multiselect": _facet("Command", ("Command", Exact("1-URGENT")), ("SourceTheoryFacet", Exact("F")), ("Kind", Exact("R"))),
    "facet_child_distinct_blocks": _facet("Kind", ("Kind", Exact("R")), ("NameFacet", Exact("F")), ("Command", Exact("1-URGENT"))),
    "facet_int_as_text": _facet("StartLine", ("StartLine", InRange(0, 10)), ("Command", Exact("en")), limit=100_000, corpus=texts),
    "facet_overflow": facet_overflow,
    "facet_tokens": facet_tokens,
    "facet_merge_selection": facet_merge_selection,
    "facets_drill_down": facets_drill_down,
    "page_1": page_1,
    "page_2_keyset": page_2_keyset,
    "total_count": total_count,
    "lookup_block": lookup_block,
    "lookup_by_child": lookup_by_child,
    "resolve_uses": resolve_uses,
    "entity_summary": entity_summary,
    "kind_ordering": kind_ordering,
    "theory_listing": theory_listing,
    "tokenize_source": tokenize_source,
    "tokenize_name_wdg": tokenize_name_wdg,
    "tokenize_type": tokenize_type,
    "ascii_folding": ascii_folding,
    "html_strip": html_strip,
    "query_replacements": query_replacements,
    "command_kinds": command_kinds,
    "drop_first_component": drop_first_component,
    "resolve_all_uses": resolve_all_uses,
    "theory_listing_whole": theory_listing_whole,
    "resolved_entities": resolved_entities,
    "best_child_score": best_child_score,
    "or_ranks_both_first": or_ranks_both_first,
    "facet_other_field": facet_other_field,
    "facet_without_values": facet_without_values,
    "inner_query_of_texts": inner_query_of_texts,
    "filter_int_values": _blocks(("StartLine", Or(Exact("36901"), Exact("173665"), InRange(90000, 91000)))),
    "term_blank": _blocks(("SourceCode", Or(Term("  "), Term("idiot"))), corpus=searchable),
    "term_any_token": term_any_token,
    "term_wildcard_token": term_wildcard_token,
    "phrase_slop": phrase_slop,
    "bm25_topk": bm25_topk,
    "unresolved_documents": unresolved_documents,
    "full_scan": full_scan,
    "form_search": form_search,
    "segment_spans": segment_spans,
    "context_lines": context_lines,
    "range_join_containment": range_join_containment,
    "dup_ids": dup_ids,
    "dup_uses": dup_uses,
    "anti_join_axioms": anti_join_axioms,
    "definition_lookup": definition_lookup,
    "copy_field_truncate": copy_field_truncate,
    "list_indexes": list_indexes,
    "index_name_parts": index_name_parts,
    "upsert_latest": upsert_latest,
    "session_selection": session_selection,
    "delete_by_query": delete_by_query,
}
