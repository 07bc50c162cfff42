"""Stored indexes against the analysis of texts, and versions of an index: what a failed or running write leaves to readers."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis
from quarry.plans import compiler, terms
from quarry.plans.compiler import Corpus, glob_pattern
from quarry.plans.query import And, Exact, FieldFilter, InResult, Not, Or, Term
from quarry.service import Engine
from quarry.sources.catalog import Catalog

TEXTS = [
    "lemma add_comm: a + b = b + a", "theorem Foo.bar [simp]", "fun naïve_sum xs = Straße", "", None, "a a a b", "b a", "one two three four five six seven eight nine ten eleven twelve thirteen",
    "λx. x ∧ y", "path2tree pathXt", "Pa<b>th</b>ways &amp; more", "thirteen twelve one", "x" * 3000 + " lemma",
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """The same blocks and entities, searched by analysis and by stored indexes."""
    blocks = spark.createDataFrame([(f"b{k}", f"T.th{k % 3}", t) for k, t in enumerate(TEXTS)], "id string, theory string, src string")
    entities = spark.createDataFrame([(f"e{k}", f"b{k}", f"T.some_name{k % 4}", "'a => nat list" if k % 2 else None, [f"e{k - 1}"]) for k in range(len(TEXTS))], "id string, block_id string, name string, type string, uses array<string>")
    made = {}
    for rows, columns, name in ((blocks, {"src": "source_text", "theory": "name_text"}, "blocks"), (entities, {"name": "name_text", "type": "type_text"}, "entities")):
        path = str(tmp_path_factory.mktemp("terms") / name)
        terms.write_terms(terms.postings_of(rows, columns), terms.lengths_of(rows, columns), path)
        made[name] = terms.read_terms(spark, path)
    return Corpus(blocks, entities), Corpus(blocks, entities, block_terms=made["blocks"], entity_terms=made["entities"])


FILTERS = [
    [("SourceCode", Term("lemma"))], [("SourceCode", Term("A theorem"))], [("SourceCode", Term("strasse"))], [("SourceCode", Term("path*"))], [("SourceCode", Term("p?th*t*"))], [("SourceCode", Term("*x"))], [("SourceCode", Term("*"))], [("SourceCode", Term("??"))],
    [("SourceCode", Term(" "))], [("SourceCode", Exact("a b"))], [("SourceCode", Exact("a a a"))], [("SourceCode", Exact("one twelve"))], [("SourceCode", Exact("one thirteen"))], [("SourceCode", Exact("∧ y"))], [("SourceCode", Exact("  "))],
    [("SourceCode", Or(Exact("a"), Exact("b"), Term("lem*")))], [("SourceCode", And(Term("a"), Not(Term("lemma"))))], [("SourceTheory", Term("th1"))], [("Name", Term("some_name2"))], [("Name", Term("*name3")), ("SourceCode", Not(Term("b")))],
    [("ConstantType", Exact("nat list"))], [("Name", InResult("Name", (FieldFilter("Id", Exact("e1")),)))], [("Uses", InResult("Id", (FieldFilter("Name", Term("some_name1")),)))],
]


@pytest.mark.parametrize("filters", FILTERS, ids=str)
def test_same_as_analysis(both, filters):
    asked = tuple(FieldFilter(a, b) for a, b in filters)
    plain, stored = ({(r.id, r.score) for r in compiler.blocks(c, asked).select("id", "score").collect()} for c in both)
    assert stored == plain


def test_plans(both):
    """A stored index is read by folder; no text is analysed, and wildcards look at tokens alone."""
    for inner in (Term("lemma"), Exact("a b"), Term("path*")):
        plan = compiler.blocks(both[1], (FieldFilter("SourceCode", inner),)).select("id")._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan
    found = both[1].block_terms.any_of("src", ["lemma"])
    assert len(found.inputFiles()) > 1 and "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()
    tokens = both[1].block_terms.tokens_like("src", "path?t*", glob_pattern)
    assert {r.token for r in tokens.collect()} == {"path2tree", "pathxt"} and "positions" not in tokens._jdf.queryExecution().executedPlan().toString()


def test_postings_stay_in_their_text(spark, both):
    """A text's postings are made inside its row: one shuffle of the texts, nothing grouped, and lengths without a shuffle of texts."""
    found = terms.postings_of(both[0].blocks, {"src": "source_text"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    assert "REPARTITION" not in terms.lengths_of(both[0].blocks, {"src": "source_text"})._jdf.queryExecution().executedPlan().toString()
    expected = {}
    for r in both[0].blocks.select("id", analysis.index_positions(F.col("src"), "source_text").alias("p")).collect():
        for at, forms in enumerate(r.p or []):
            for form in set(forms):
                expected.setdefault((r.id, form, len(r.p)), []).append(at)
    assert {(r.id, r.token, r.length): r.positions for r in found.collect()} == expected and found.count() == len(expected)


def test_small_texts_are_dealt_out(spark, both):
    """Texts are cut in as many tasks as the session has, however few bytes they are."""
    assert terms.postings_of(both[0].blocks, {"src": "source_text"}).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def tables(spark, theories, text, used="Fact"):
    blocks = spark.createDataFrame([(f"{t}.{k}", t, k, f"{text} number{k}") for t in theories for k in range(3)], "id string, theory string, start_line int, src string")
    entities = spark.createDataFrame([(f"{used}.{t}.{k}", f"{t}.{k}", "Fact", f"{t}.{text}") for t in theories for k in range(2)], "id string, block_id string, kind string, name string")
    return blocks, entities


def search(catalog, text, version=None):
    corpus = catalog.corpus("x", version=version)
    return sorted(r.id for r in compiler.blocks(corpus, (FieldFilter("SourceCode", Term(text)),)).collect())


def test_versions(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.create("x") and not catalog.create("x") and catalog.version("x") == 0
    assert catalog.table("x", "blocks").count() == 0 and search(catalog, "old") == []
    first = catalog.write("x", *tables(spark, ["A", "B"], "old"))
    assert search(catalog, "old") == ["A.0", "A.1", "A.2", "B.0", "B.1", "B.2"]
    pinned = catalog.corpus("x")
    catalog.write("x", *tables(spark, ["B", "a/b c"], "new"))
    # a reader of the first version still sees it whole; a new one sees both tables and the index change together
    assert pinned.entities.count() == 4 and search(catalog, "old", first) == ["A.0", "A.1", "A.2", "B.0", "B.1", "B.2"] and search(catalog, "new", first) == []
    assert search(catalog, "old") == ["A.0", "A.1", "A.2"] and search(catalog, "new") == ["B.0", "B.1", "B.2", "a/b c.0", "a/b c.1", "a/b c.2"]
    assert {r.name for r in catalog.table("x", "entities").collect()} == {"A.old", "B.new", "a/b c.new"}
    assert sorted(r.id for r in compiler.blocks(catalog.corpus("x"), (FieldFilter("Name", Term("a/b")),)).collect()) == ["a/b c.0", "a/b c.1"]
    catalog.delete("x", (F.col("theory") == "A") | (F.col("id") == "B.1"))
    assert search(catalog, "number1") == ["a/b c.1"] and search(catalog, "new") == ["B.0", "B.2", "a/b c.0", "a/b c.1", "a/b c.2"]
    assert sorted(r.block_id for r in catalog.table("x", "entities").collect()) == ["B.0", "a/b c.0", "a/b c.1"]
    catalog.vacuum("x")
    assert search(catalog, "new") == ["B.0", "B.2", "a/b c.0", "a/b c.1", "a/b c.2"]
    assert Engine(spark, catalog).get_block("x", "B.2").theory == "B"


def test_failed_write(spark, tmp_path):
    """A write that fails between its tables leaves the old index as it was, and the next write succeeds."""
    catalog = Catalog(spark, str(tmp_path))
    catalog.create("x")
    catalog.write("x", *tables(spark, ["A"], "old"))
    blocks, entities = tables(spark, ["A"], "new")
    with pytest.raises(Exception, match="broken"):
        catalog.write("x", blocks, entities.withColumn("name", F.raise_error(F.lit("broken"))))
    assert catalog.version("x") == 1 and search(catalog, "old") == ["A.0", "A.1", "A.2"] and search(catalog, "new") == []
    assert {r.name for r in catalog.table("x", "entities").collect()} == {"A.old"}
    catalog.write("x", blocks, entities)
    assert search(catalog, "new") == ["A.0", "A.1", "A.2"] and search(catalog, "old") == []
    before = catalog.table("x", "blocks").count()
    catalog.write("x", blocks.limit(0), entities.limit(0))
    assert catalog.table("x", "blocks").count() == before
