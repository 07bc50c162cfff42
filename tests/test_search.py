"""Searches, facets, lookups and requests on a corpus of three blocks and four entities."""

import pytest

from quarry.errors import InvalidQuery, NotFound, UnknownIndex
from quarry.operators.paging import pages
from quarry.plans import compiler
from quarry.plans.compiler import Corpus
from quarry.plans.query import And, Exact, FacetQuery, FieldFilter, FilterQuery, InRange, InResult, Not, Or, Term, form_filters, matched, next_mode, query_from_json, query_to_json, typed, used_by, uses_of
from quarry.service import Engine

RIPE, SOFT, JAR = "Orchard.40.95", "Orchard.95.160", "Cellar.1.30"


@pytest.fixture(scope="module")
def corpus(spark):
    blocks = spark.createDataFrame(
        [
            (RIPE, "Orchard", "Orchard", 4, "definition", "begin\n", "definition ripe where ripe = sweet + mellow", "\n"),
            (SOFT, "Orchard", "Orchard", 9, "corollary", "\n", "corollary ripe_soft: soft apples are sweet", "(* so are pears *)"),
            (JAR, "Cellar", "Cellar", 2, "datatype", "", "datatype jar = Empty | Full fruit", "end"),
        ],
        "id string, theory string, theory_facet string, start_line int, command string, src_before string, src string, src_after string",
    )
    entities = spark.createDataFrame(
        [
            ("Type.jar", JAR, "Type", "jar", "jar", None, None, []),
            ("Constant.Full", JAR, "Constant", "Full", "Full", "fruit => jar", "fruit => jar", ["Type.jar"]),
            ("Constant.ripe", RIPE, "Constant", "ripe", "ripe", "'f => bool", "'f => bool", ["Type.jar", "Type.gone"]),
            ("Fact.ripe_soft", SOFT, "Fact", "ripe_soft", "ripe_soft", None, None, ["Constant.ripe"]),
        ],
        "id string, block_id string, kind string, name string, name_facet string, type string, type_facet string, uses array<string>",
    )
    return Corpus(blocks, entities)


@pytest.fixture(scope="module")
def engine(spark, corpus):
    return Engine(spark, corpora={"fruit": corpus, "my_default_x": corpus})


def found(engine, *filters):
    return [r.id for r in engine.search("fruit", FilterQuery(tuple(FieldFilter(a, b) for a, b in filters))).values]


def test_lookups(engine):
    assert engine.get_resolved("fruit", "Type.jar").uses == []
    assert [u.name for u in engine.get_resolved("fruit", "Constant.ripe").uses] == ["jar"]
    assert engine.get_short_block("fruit", "Constant.Full").id == JAR
    assert [e.id for e in engine.get_block("fruit", JAR).entities] == ["Constant.Full", "Type.jar"]
    for call in (engine.get_block, engine.get_resolved):
        with pytest.raises(NotFound):
            call("fruit", "Type.gone")
    with pytest.raises(NotFound):
        engine.get_resolved("fruit", JAR)


def test_wildcards_and_blank_terms(engine):
    assert found(engine, ("Command", Term("*or*"))) == [SOFT]
    assert found(engine, ("Name", Term("ful?"))) == [JAR]
    assert found(engine, ("Name", Term("ripe* x"))) == []
    assert found(engine, ("SourceCode", Term("\t "))) == []
    assert sorted(found(engine, ("SourceCode", Term("FRUIT mellow")))) == sorted([JAR, RIPE])


def test_facets(engine, spark, corpus):
    q = lambda *fields, n=100, **f: FacetQuery(tuple(FieldFilter(a, Exact(b)) for a, b in f.items()), fields, n)
    commands = {"definition": 1, "corollary": 1, "datatype": 1}
    assert engine.facet("fruit", q("Command", Command="datatype")) == {"Command": commands}
    assert engine.facet("fruit", q("Kind", Command="datatype")) == {"Kind": {"Constant": 1, "Type": 1}}
    assert engine.facet("fruit", q("Command", n=3)) == {}
    assert engine.facet("fruit", q("Command", n=4)) == {"Command": commands}
    assert engine.facet("fruit", q("StartLine", Kind="Constant")) == {"StartLine": {"2": 1, "4": 1}}
    assert engine.facet("fruit", q("Command", Name="nothing")) == {"Command": {}}
    assert engine.facet("fruit", FacetQuery()) == {}
    assert engine.facet("fruit", q("SourceTheory")) == {"SourceTheory": {"orchard": 2, "cellar": 1}}
    assert engine.facet("fruit", q("DocKind")) == {"DocKind": {"Child": 3}}
    for bad in ("Id", "Uses", "SourceCode"):
        with pytest.raises(InvalidQuery):
            engine.facet("fruit", q(bad))
    counts = compiler.facet(corpus, (), "Command")
    chosen = spark.createDataFrame([("Command", "gone")], "field string, value string")
    merged = {(r.value, r["count"], r.selected) for r in compiler.facets_with_selection(counts, chosen).collect()}
    assert merged == {(c, 1, False) for c in commands} | {("gone", 0, True)}


def test_block_join_in_a_range_of_lines(engine):
    r = engine.search("fruit", FilterQuery((FieldFilter("StartLine", InRange(3, 5)), FieldFilter("Kind", Exact("Constant")))))
    assert r.count == 1 and r.values[0].id == RIPE and [(e.kind, e.name) for e in r.values[0].entities] == [("Constant", "ripe")]
    assert sorted(found(engine, ("Kind", Exact("Constant")))) == [JAR, RIPE]
    assert found(engine, ("Kind", Exact("Type")), ("NameFacet", Exact("Full"))) == []


def test_ranking(engine):
    assert found(engine, ("SourceCode", Or(Exact("sweet"), Exact("apples")))) == [SOFT, RIPE]


def test_inner_queries(engine):
    assert found(engine, ("Uses", InResult("Id", (FieldFilter("Kind", Exact("Constant")),)))) == [SOFT]
    assert found(engine, ("Uses", Term("Constant.ripe"))) == [SOFT]
    f = uses_of(["Fact.ripe_soft"])
    assert found(engine, (f.field, f.filter)) == [RIPE]
    assert used_by(["a", "b"]).filter == Or(Term("a"), Term("b"))
    assert found(engine, ("Name", InResult("Name", (FieldFilter("Kind", Exact("Fact")),)))) == [SOFT]
    assert found(engine, ("Id", InResult("Uses", (FieldFilter("Kind", Exact("Type")),)))) == []
    with pytest.raises(InvalidQuery):
        found(engine, ("Id", InResult("Children", (FieldFilter("Kind", Exact("Type")),))))
    with pytest.raises(Exception, match="has no ConstantType"):
        found(engine, ("NameFacet", InResult("ConstantType", (FieldFilter("Kind", Exact("Fact")),))))


def test_connectives(engine):
    assert found(engine, ("Kind", Not(Or(Exact("Constant"), Exact("Type"))))) == [SOFT]
    assert sorted(found(engine, ("ConstantType", Not(Term("bool"))))) == [JAR]
    assert found(engine, ("Uses", And(Term("Type.gone"), Not(Term("x"))))) == [RIPE]


def test_pages(engine):
    first = engine.search("fruit", FilterQuery((), 2))
    second = engine.search("fruit", FilterQuery((), 2, first.next_cursor))
    third = engine.search("fruit", FilterQuery((), 2, second.next_cursor))
    assert [r.id for r in first.values] == [JAR, RIPE] and [r.id for r in second.values] == [SOFT] and first.count == 3
    assert third.values == [] and third.next_cursor == second.next_cursor
    assert engine.search("fruit", FilterQuery((), 0)).count == 3 and engine.search_documents("fruit", FilterQuery()).count == 7
    assert pages(21, 10) == 3


def test_requests(engine):
    assert engine.list_indexes() == ["my_default_x", "fruit"]
    with pytest.raises(UnknownIndex):
        engine.get_block("none", RIPE)
    for bad in (lambda: engine.get_block("fruit", " "), lambda: engine.search("fruit", FilterQuery((), -1)), lambda: engine.search("fruit", FilterQuery((), 1, " ")), lambda: engine.facet("fruit", FacetQuery((), (), 0)), lambda: engine.search("fruit", FilterQuery((), 1, "###"))):
        with pytest.raises(InvalidQuery):
            bad()
    assert engine.last_ms >= 0


def test_json():
    q = FilterQuery((FieldFilter("Name", And(Term("*a*"), Or(Not(Exact("b")), Exact("c")), Exact("d"))), FieldFilter("StartLine", InRange(1, 2)), FieldFilter("Uses", InResult("Id", (FieldFilter("Kind", Exact("Fact")),)))), 5, "x")
    assert query_from_json(query_to_json(q)) == q
    f = FacetQuery((FieldFilter("Name", Term("*pear*")),), ("Kind", "NameFacet"), 10)
    assert query_from_json(query_to_json(f)) == f
    assert query_from_json('{"filters": []}') == FilterQuery()
    for bad in ("{", "{}", '{"filters": [{"field": "X", "filter": {"Term": {"inner": "a"}}}]}', '{"filters": [{"field": "Name", "filter": {"Foo": {}}}]}', '{"filters": [{"field": "Name", "filter": {"Term": {}}}]}'):
        with pytest.raises(InvalidQuery):
            query_from_json(bad)


def test_form():
    assert typed("") is None and typed('"a b"') == Exact("a b") and typed("a") == Term("a")
    assert matched(["a"], "OneOf") == Exact("a") and matched(["a", "b"], "AllOf") == And(Exact("a"), Exact("b")) and matched(["a", "b"], "Neither") == Not(Or(Exact("a"), Exact("b"))) and matched([], "Neither") is None
    assert [next_mode(m) for m in ("OneOf", "AllOf", "Neither")] == ["AllOf", "Neither", "OneOf"]
    assert [f.field for f in form_filters("x", [("Name", ["a"], "OneOf"), ("Command", [], "OneOf")], {"Kind": ["Fact"]}, ["i"], ["j"])] == ["SourceCode", "Name", "Kind", "Uses", "ChildId"]


def test_facets_read_each_table_once(spark, corpus):
    """Several fields with filters on both sides give what they give one by one, from one scan of each table."""
    from quarry.plans.query import Exact, FieldFilter, InRange
    from quarry.queries import QUERIES

    filters = (FieldFilter("Command", Exact("datatype")), FieldFilter("StartLine", InRange(0, 100)), FieldFilter("Kind", Exact("Constant")))
    names = ("Command", "Kind", "SourceTheory", "DocKind")
    for chosen in (filters, filters[2:]):
        together = {tuple(r) for r in compiler.facets(corpus, chosen, names).collect()}
        assert together == {tuple(r) for n in names for r in compiler.facet(corpus, chosen, n).collect()}
        for n in names:  # by hand: filters of other columns hold, and a block counts once
            others = tuple(x for x in chosen if compiler.field(x.field).column != compiler.field(n).column)
            of_entities = compiler.field(n).child
            blocks, entities = compiler.route(others if of_entities else chosen)
            blocks = [x for x in blocks if x in others]
            own = {r.id for r in compiler.matching(corpus, corpus.blocks, blocks).collect()}
            met = {(r.block_id, r.id) for r in compiler.matching(corpus, corpus.entities, entities).collect()}
            count = sum(r["count"] for r in compiler.facet(corpus, chosen, n).collect())
            if of_entities and n == "DocKind":
                assert count == len({b for b, _ in met if b in own or not blocks})
            if n == "Command":
                assert count == len(own & {b for b, _ in met} if entities else own)
    found = QUERIES["facets_drill_down"](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    assert final.count("FileScan") == 2, final
