"""Analysis, import, catalog and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.errors import UnknownIndex
from quarry.functions import analysis, trees
from quarry.operators import importing, ingest, lookup
from quarry.plans.query import Exact, FieldFilter, FilterQuery
from quarry.service import Engine
from quarry.sources import catalog
from quarry.streaming import blocks as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def typ(name, *args):
    return {"ctor": "TypeTyp", "name": name, "args": list(args)}


A, B = {"ctor": "TFree", "name": "'a"}, {"ctor": "TFree", "name": "'b"}


@pytest.mark.parametrize(
    ("tree", "text"),
    [
        (typ("fun", A, typ("fun", B, {"ctor": "TFree", "name": "'c"})), "'a ⇒ 'b ⇒ 'c"),
        (typ("fun", typ("fun", A, B), {"ctor": "TFree", "name": "'c"}), "('a ⇒ 'b) ⇒ 'c"),
        (typ("Set", typ("Map", typ("Bool"))), "(Bool Map) Set"),
        (typ("Tree", A, B | {"sorts": ["Trait"]}), "('a, 'b :: Trait) Tree"),
        (typ("fun"), "()"),
        (typ("fun", A), "() ⇒ 'a"),
        (typ("list", A), "'a list"),
        (typ("list", A | {"sorts": ["x"]}), "('a :: x) list"),
        ({"ctor": "TVar", "name": "?a", "index": 2, "sorts": ["x", "y"]}, "?a2 :: {x, y}"),
    ],
)
def test_printed(tree, text):
    assert trees.printed(tree) == text


def test_tokens(spark):
    positions = lambda s, kind: one(spark, analysis.index_positions(F.lit(s), kind))
    assert positions("li.N rev_app x2y", "source_text") == [["li"], ["."], ["n"], ["rev_app", "rev", "app"], ["x2y", "x", "2", "y"]]
    assert positions("é⇒a::nat", "source_text") == [["é", "e"], ["⇒"], ["a"], ["::"], ["nat"]]
    assert positions("<b>Straße</b> a&amp;b", "source_text") == [["stra"], ["ß", "ss"], ["e"], ["a&b", "a", "b"]]
    assert positions("HOL.List_ex  n1", "name_text") == [["hol.list_ex", "hol", "list", "ex"], ["n1", "n", "1"]]
    assert positions("'a => (nat, b)", "type_text")[0][0] == "'a"
    q = lambda s, kind, syn=None: one(spark, analysis.query_tokens(F.lit(s), kind, syn))
    assert q(r"A \<and> B ==> x => (|y|)", "source_text", {r"\<and>": "∧"}) == ["a", "∧", "b", "⟹", "x", "⇒", "⦇", "y", "⦈"]
    assert q("a::b ~:", "source_text") == ["a", "∈", "∈", "b", "~", "∈"]
    assert q("'a => nat", "type_text") == ["'a", "⇒", "nat"]


def test_folding_and_references(spark):
    """Strokes, ligatures and dotless letters fold as accents do; references are decoded once, and what is none stays."""
    folds = {"Øre": "Ore", "łódź": "lodz", "đak": "dak", "ænima Œuvre": "aenima OEuvre", "þing Þ": "thing TH", "ısı": "isi", "Straße ﬁn": "Strasse fin", "日本 x²": "日本 x2", "": ""}
    assert {k: one(spark, analysis.folded(F.lit(k))) for k in folds} == folds
    decoded = {
        "a &lt;b&gt; &amp;lt; &eacute;&#233;&#xE9; &rarr;&nbsp;x": "a <b> &lt; ééé → x", "&#128512;&#x1F600;": "😀😀", "a & b &unknown; &#; &#xD800; &#0; &lt": "a & b &unknown; &#; &#xD800; &#0; &lt",
        "<p title='x'>y</p>&": " y &", "&&lt;&": "&<&", "": "",
    }
    assert {k: one(spark, analysis.html_stripped(F.lit(k))) for k in decoded} == decoded
    assert one(spark, analysis.html_stripped(F.lit(None).cast("string"))) is None and one(spark, analysis.folded(F.lit(None).cast("string"))) is None


def test_small_functions(spark):
    assert one(spark, analysis.without_last_blank_lines(F.lit("a\n b\n \n\n"))) == "a\n b"
    kinds = {"  fun f": "fun", "(* x *)": "(*", "{x": "{", "lemma(in x)": "lemma", 'text"a"': "text", "by.": "by"}
    assert {k: one(spark, analysis.command_kind(F.lit(k))) for k in kinds} == kinds
    assert [one(spark, analysis.without_first_component(F.lit(x))) for x in ("a.b.c", "a")] == ["b.c", ""]
    assert one(spark, analysis.without_pure(F.lit(["fun", "Pure.eq", "x"]))) == ["x"]
    assert one(spark, analysis.block_id(F.lit("T"), F.lit(1), F.lit(11))) == "T.1.11"
    assert one(spark, F.size(F.split(analysis.facet_copy(F.lit("x" * 5000)), ""))) in (3276, 3277)


def spans(spark, *texts, theory="T"):
    return spark.createDataFrame([("S", theory, n, t) for n, t in enumerate(texts)], "session string, theory string, n int, text string")


def test_segments(spark):
    rows = spans(spark, "by first", " \n", "fun f\n", "  where x\n", "@proof\n", "lemma a\n", "notepad\n", "  ", "definition d")
    out = [(r.start, r.stop, r.start_line, r.src) for r in ingest.segment(rows).orderBy("start").collect()]
    assert [r[3] for r in out] == ["by first \n", "fun f\n  where x\n@proof\n", "lemma a\nnotepad\n  ", "definition d"]
    assert [r[2] for r in out] == [1, 2, 5, 7] and all(a[1] == b[0] for a, b in zip(out, out[1:], strict=False)) and out[0][0] == 1
    assert ingest.not_adjacent(ingest.segment(rows)).count() == 0
    blank = spans(spark, "  \n", "fun x", "lemma y", theory="U")
    kept, errors = ingest.extract_blocks(ingest.segment(rows.unionByName(blank)))
    assert errors.count() == 1 and kept.filter("theory = 'U'").count() == 2
    first = kept.filter("src like 'fun f%'").first()
    assert first.src_before == "by first \n" and first.src_after == "lemma a\nnotepad\n  " and first.command == "fun" and first.id == f"T.{first.start}.{first.stop}"


def test_context_keeps_five_lines(spark):
    rows = spans(spark, "".join(f"a{k}\n" for k in range(7)), "".join(f"fun{k}\n" for k in range(7)))
    out = ingest.with_context(ingest.segment(rows)).orderBy("start").collect()
    assert out[1].src_before == "a2\na3\na4\na5\na6\n" and out[0].src_after == "fun0\nfun1\nfun2\nfun3\nfun4\n" and out[0].src_before == ""


def test_containment(spark):
    blocks = spark.createDataFrame([("T", "b1", 1, 9000), ("T", "b2", 9000, 9010), ("U", "b3", 1, 5)], "theory string, id string, start long, stop long")
    at = spark.createDataFrame([("e1", "T", 2, 7), ("e2", "T", 8990, 9000), ("e3", "T", 8999, 9001), ("e4", "U", 2, 3), ("e5", "V", 1, 2)], "id string, theory string, offset int, end_offset int")
    found, errors = ingest.join_entities(at, blocks.unionByName(blocks.filter("id = 'b3'")))
    assert {r.id: r.block_id for r in found.collect()} == {"e1": "b1", "e2": "b1", "e4": "b3"}
    assert sorted(r.entity for r in errors.collect()) == ["b3", "e3", "e5"]


def exports(spark):
    const = lambda n, *t: {"ctor": "Const", "name": n, "args": list(t)}
    forest = {
        "typ_f": typ("fun", typ("Nat.nat"), typ("Nat.nat")), "ax_f": {"ctor": "App", "args": [const("T.f"), const("T.g", typ("L.list"))]}, "ax_other": const("T.f"),
        "thm": {"ctor": "App", "args": [const("T.f"), const("Pure.eq")]}, "proof": {"ctor": "AppP", "args": [{"ctor": "PThm", "name": "T.thm"}, {"ctor": "PAxm", "name": "T.f_def", "args": [typ("Bool.bool")]}]},
    }
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return importing.Exports(
        spans=spans(spark, "fun f\n", "lemma thm\n", "by x"),
        positions=frame([("T", "Constant", "T.f", 2, 4), ("T", "Fact", "T.thm", 8, 12), ("T", "Fact", "T.other", 500, 501), ("T", "Type", "T.t", 3, 4)], "theory string, kind string, name string, offset int, end_offset int"),
        consts=frame([("T", "T.f", "typ_f", None)], "theory string, name string, typ string, abbrev string"),
        types=frame([("T", "T.t", None)], "theory string, name string, abbrev string"),
        axioms=frame([("T", "T.f_def", "ax_f"), ("T", "T.other", "ax_other")], "theory string, name string, prop string"),
        thms=frame([("T", "T.thm", "thm", "proof", ["T.thm", "T.dep"])], "theory string, name string, prop string, proof string, deps array<string>"),
        constdefs=frame([("T", "T.f", "T.f_def")], "theory string, name string, axiom_name string"),
        typedefs=frame([("T", "T.t", "T.missing")], "theory string, name string, axiom_name string"),
        trees=frame([(k, json.dumps(v)) for k, v in forest.items()], "root string, tree string"),
    )


def test_import(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "indexes"))
    errors = importing.import_session(store, "default_T_2020", exports(spark))
    assert sorted((r.step, r.entity) for r in errors.collect()) == [("extract-types", "T.t"), ("join-entities", "Fact.T.other")]
    engine = Engine(spark, store)
    assert engine.list_indexes() == ["default_T_2020"]
    entities = {r.id: r for r in store.table("default_T_2020", "entities").collect()}
    assert entities["Constant.T.f"].uses == ["Constant.T.g", "Type.L.list", "Type.Nat.nat"] and entities["Constant.T.f"].type == "Nat.nat ⇒ Nat.nat" and entities["Constant.T.f"].name == "f"
    assert entities["Fact.T.thm"].uses == ["Constant.T.f", "Fact.T.dep", "Fact.T.f_def", "Fact.T.thm", "Type.Bool.bool"]
    found = engine.search("default_T_2020", FilterQuery((FieldFilter("Kind", Exact("Fact")),)))
    assert [r.command for r in found.values] == ["lemma"] and found.values[0].src == "lemma thm\nby x"
    importing.import_session(store, "default_T_2020", exports(spark))
    assert store.table("default_T_2020", "blocks").count() == 2
    store.delete("default_T_2020", F.col("command") == "fun")
    assert [r.command for r in store.table("default_T_2020", "blocks").collect()] == ["lemma"] and store.table("default_T_2020", "entities").count() == 1
    assert not store.create("default_T_2020") and store.create("another") and engine.list_indexes() == ["default_T_2020", "another"]
    with pytest.raises(UnknownIndex):
        store.corpus("none")


def test_reimport_without_entities(spark, tmp_path):
    """A theory that is written again without entities loses those it had; other theories keep theirs."""
    store = catalog.Catalog(spark, str(tmp_path / "indexes"))
    store.create("default_R_2020")
    blocks = spark.createDataFrame([(f"{t}.1.2", t, 1, "fun", "x") for t in ("A b", "C")], "id string, theory string, start_line int, command string, src string")
    entities = spark.createDataFrame([(f"Const.{t}.c", f"{t}.1.2", "Constant", "c", []) for t in ("A b", "C")], "id string, block_id string, kind string, name string, uses array<string>")
    store.write("default_R_2020", blocks, entities)
    assert store.table("default_R_2020", "entities").count() == 2
    store.write("default_R_2020", blocks.filter("theory = 'A b'"), entities.limit(0))
    assert [r.block_id for r in store.table("default_R_2020", "entities").collect()] == ["C.1.2"]
    assert store.table("default_R_2020", "blocks").count() == 2


def test_sanity(spark):
    rows = spark.createDataFrame([("a", "Fact", "x", ["u", "u"]), ("b", "Fact", "y", []), ("b", "Fact", "z", [])], "id string, kind string, name string, uses array<string>")
    assert sorted((r.entity, r.message) for r in ingest.sanity(rows).collect()) == [("a", "uses repeat"), ("b", "id repeats")]
    summary = lookup.summary(rows.withColumn("block_id", F.lit("k"))).first()
    assert (summary.Type, summary.Fact) == (None, 3)


def test_symbols(spark, tmp_path):
    lines = [r"\<and> code: 0x002227 group: logic abbrev: /\ abbrev: &", r"\<zero> code: 0x01d7ec group: digit", r"\<or> code: 0x002228 abbrev: \/ abbrev: &", r"\<x> code: 0x2208 abbrev: : abbrev: ==>", "# nothing"]
    found = {(r.word, r.replacement) for r in catalog.symbol_synonyms(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert found == {(r"\<and>", "∧"), ("/\\", "∧"), (r"\<zero>", "\U0001d7ec"), (r"\<or>", "∨"), ("\\/", "∨"), (r"\<x>", "∈")}
    (tmp_path / "syn.txt").write_text("# c\n\\\\<and>,/\\\\ => ∧\n")
    assert catalog.read_synonyms(spark, str(tmp_path / "syn.txt")) == {"\\<and>": "∧", "/\\": "∧"}


def test_catalog_functions(spark):
    assert catalog.default_first(["a", "x_default", "default"]) == ["x_default", "a", "default"] and catalog.default_first(["b"]) == ["b"]
    dirs = spark.createDataFrame([("HOL.A",), ("HOL",), ("HOLX.B",)], "dir string")
    assert sorted(r.dir for r in catalog.of_sessions(dirs, ["HOL"]).collect()) == ["HOL", "HOL.A"]
    assert sorted(r.session for r in catalog.sessions(dirs).collect()) == ["HOL", "HOLX"]
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    assert sorted(map(tuple, catalog.upsert(rows, spark.createDataFrame([("b", 2), ("c", 3)], "id string, v int")).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_dump(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"session": "S", "theory": "T", "n": 0, "text": "fun f"}\n')
    assert catalog.read_dump(spark, str(tmp_path)).first().text == "fun f"


def test_stream(spark, tmp_path):
    schema = "id string, version int, src string"
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    for batch in ([("a", 1, "x"), ("b", 1, "x")], [("a", 3, "z"), ("a", 2, "y"), ("c", 1, "x")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        streaming.upsert_into(streaming.stream(spark, source, schema), table, state).awaitTermination()
    assert sorted(map(tuple, streaming.current(spark, table).collect())) == [("a", 3, "z"), ("b", 1, "x"), ("c", 1, "x")]


def test_containment_shuffles_once(spark):
    """The block around each position, also where a block lies over many stretches; rows are dealt out once."""
    blocks = spark.createDataFrame([("t", 1, 50, "a"), ("t", 50, 51, "b"), ("t", 60, 9000, "c"), ("u", 1, 9, "d")], "theory string, start long, stop long, id string")
    rows = [("t", 1, 3), ("t", 49, 50), ("t", 49, 51), ("t", 50, 51), ("t", 55, 56), ("t", 8999, 9000), ("t", 4100, 4100), ("u", 8, 9), ("u", 9, 10), ("v", 1, 2), ("t", 1, 3)]
    points = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "theory string, offset int, end_offset int, __at int")
    found = ingest.contained(points, blocks)
    assert [r["__block"] for r in sorted(found.collect(), key=lambda r: r["__at"])] == ["a", "a", None, "b", None, "c", "c", "d", None, None, "a"]
    planned = ingest.contained(points, blocks)._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange hashpartitioning") == 1 and "Join" not in planned


def test_reader(spark):
    from quarry.sources.reader import Need, read

    rows = spark.createDataFrame(
        [(1, ["a"], ["7"], None, "x"), (2, [], ["7", "8"], ["u", None], None), (3, ["a", "b"], ["seven"], [], "y"), (4, [None], None, ["v"], "z"), (4, [None], None, ["v"], "z")],
        "id int, kind array<string>, line array<string>, uses array<string>, other string",
    )
    good, errors = read(rows, {"kind": Need(), "line": Need("int", required=False), "uses": Need(required=False, many=True), "none": Need(required=False), "other": Need(required=False)})
    assert [tuple(r) for r in good.collect()] == [(1, "a", 7, [], None, "x")]
    wrong = [(2, "kind", "missing", 0), (2, "line", "multiple", 2), (3, "kind", "multiple", 2), (3, "line", "malformed", 1), (4, "kind", "missing", 0), (4, "kind", "missing", 0)]
    assert sorted(tuple(r) for r in errors.collect()) == wrong
    good, errors = read(rows.limit(0), {"kind": Need()})
    assert good.count() == errors.count() == 0
