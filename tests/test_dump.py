"""Dumps of nested folders."""

from pyspark.sql import functions as F

from quarry.operators import importing, ingest
from quarry.sources import catalog, dump

SYMBOLS = {r"\<and>": "∧", r"\<^sub>": "⇩"}


def put(root, folder, text, name="markup.xml"):
    (root / folder).mkdir(parents=True, exist_ok=True)
    (root / folder / name).write_text(text, encoding="utf-8", newline="")


def spans(df):
    return {(r.session, r.theory): [x for _, x in sorted(r.x)] for r in df.groupBy("session", "theory").agg(F.collect_list(F.struct("n", "text")).alias("x")).collect()}


def test_nested_folders(spark, tmp_path):
    put(tmp_path, "S.A/x/y z+%", '<command name="a>b"><kw k=\'c/>\'>fun</kw> f \\&lt;and> \\&lt;odd&gt;</command>\n<e/><!-- it\'s no > end --><cmd/>tail &amp;lt; &#955;<c><d>by<e/> </d>\\x</c>')
    put(tmp_path, "S", "<?xml version='1.0'?>lead<a>one</a><a></a><b>two\r\n</b>")
    put(tmp_path, "SX.B/d", "<a>other</a>")
    put(tmp_path, "S.A/x", "<a>not markup</a>", "other.xml")
    put(tmp_path, "S.Empty", "")
    found = spans(dump.read_markup(spark, str(tmp_path), SYMBOLS))
    a = ["fun f ∧ \\<odd>", "\n", "tail &lt; λ", "by \\x"]
    assert found[("S", "S.A")] == a and found[("SX", "SX.B")] == ["other"]
    assert found[("S", "S")] == ["lead", "one", "two\r\n"]
    assert set(spans(dump.read_markup(spark, str(tmp_path), chosen=["S"]))) == {("S", "S"), ("S", "S.A")}
    assert set(spans(dump.read_markup(spark, str(tmp_path), chosen=["S", "S.A"]))) == {("S", "S"), ("S.A", "S.A")}
    assert spans(dump.read_markup(spark, str(tmp_path), files="none")) == {}


def test_large_files_are_split(spark, tmp_path):
    """Pieces of a file that several tasks read come together in order."""
    texts = [f"word{k} " + "<b>é</b>" * (k % 3) for k in range(3000)]
    put(tmp_path, "S.T", "".join(f"<a>{t}</a>\n" for t in texts))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        df = dump.read_markup(spark, str(tmp_path))
        found = spans(df)[("S", "S.T")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == [x for t in texts for x in (t.replace("<b>", "").replace("</b>", ""), "\n")]


def test_lengths_and_escapes(spark):
    rows = spark.createDataFrame([(r"\<and> \<odd>x",), ("",), (None,), (r"\<",), ("a<&>\"'",)], "t string")
    out = rows.select(dump.decoded(F.col("t"), SYMBOLS).alias("d"), dump.symbol_length(F.col("t")).alias("n"), dump.escaped(F.col("t")).alias("e")).collect()
    assert [r.d for r in out] == [r"∧ \<odd>x", "", None, r"\<", "a<&>\"'"]
    assert [r.n for r in out] == [4, 0, None, 2, 6] and out[4].e == "a&lt;&amp;&gt;&quot;&#39;"
    rules = catalog.symbol_synonyms(spark.createDataFrame([(r"\<and> code: 0x002227 group: logic abbrev: /\ ",), (r"\<^sub> code: 0x0021e9 x",)], "value string"))
    assert dump.symbols_of(rules) == SYMBOLS


def test_dump_to_blocks(spark, tmp_path):
    """Places count symbols, stored source is HTML."""
    put(tmp_path, "S.T", r"<a>fun f \&lt;odd> &lt; \&lt;and></a><a>lemma</a>")
    read = dump.read_markup(spark, str(tmp_path), SYMBOLS)
    rows = ingest.segment(read, length=dump.symbol_length(F.col("text")), shown=dump.escaped(F.col("text"))).orderBy("start").collect()
    assert [(r.start, r.stop, r.src) for r in rows] == [(1, 12, r"fun f \&lt;odd&gt; &lt; ∧"), (12, 17, "lemma")]
    assert importing.spans_of(spark, str(tmp_path), SYMBOLS).count() == 2
