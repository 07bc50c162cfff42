"""Blocks and entities in the same shards."""

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.plans import compiler
from quarry.plans.compiler import Corpus
from quarry.plans.query import Exact, FieldFilter
from quarry.sources import shards
from quarry.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"
FILTERS = (FieldFilter("Kind", Exact("R")), FieldFilter("Command", Exact("3-MEDIUM")))


def test_join_without_shuffle(spark, tmp_path):
    c, path = queries.orders(spark, SF), str(tmp_path / "dealt")
    shards.write(c.blocks, c.entities, path, 5)
    expected = sorted(r.id for r in compiler.blocks(c, FILTERS).select("id").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large to be sent
        for again in (False, True):
            if again:  # a session that doesn't know the tables opens them by their folder
                for name in shards.KEYS:
                    spark.sql(f"DROP TABLE {shards._table(path, name)}")
            found = compiler.blocks(Corpus(*shards.read(spark, path)), FILTERS).select("id")
            assert sorted(r.id for r in found.collect()) == expected
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_odd_tables(spark, tmp_path):
    blocks = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y"), ("b", None)], "id string, `odd name` string")
    entities = spark.createDataFrame([("e1", "a", "R"), ("e1", "a", "R"), ("e2", None, "R"), ("e3", "c", "R")], "id string, block_id string, kind string")
    path = str(tmp_path / "odd")
    shards.write(blocks, entities, path, 3)
    got = shards.read(spark, path)
    assert got[0].count() == 4 and got[1].count() == 4 and got[0].columns == blocks.columns
    assert [r.id for r in compiler.blocks(Corpus(*got), FILTERS[:1]).collect()] == ["a", "a"]
    shards.write(blocks.limit(0), entities.limit(0), str(tmp_path / "none"), 2)
    assert shards.read(spark, str(tmp_path / "none"))[0].count() == 0
    with pytest.raises(ValueError):
        shards.write(blocks, entities, str(tmp_path / "bad"), 0)
    with pytest.raises(FileNotFoundError):
        shards.read(spark, str(tmp_path / "bad"))


def test_catalog_deals_a_version(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "indexes"))
    store.create("x")
    blocks = spark.createDataFrame([(f"b{k}", f"T{k % 2}", 1, "fun", f"src {k}") for k in range(6)], "id string, theory string, start_line int, command string, src string")
    entities = spark.createDataFrame([(f"e{k}", f"b{k % 3}", "Fact", f"n{k}", []) for k in range(9)], "id string, block_id string, kind string, name string, uses array<string>")
    store.write("x", blocks, entities)
    assert store.deal("x", 3) == 3 and store.deal("x", 7) == 3
    find = lambda version=None: sorted(r.id for r in compiler.blocks(store.corpus("x", version=version), (FieldFilter("Kind", Exact("Fact")),)).collect())
    assert find() == ["b0", "b1", "b2"]
    store.write("x", blocks.filter("theory = 'T1'"), entities.limit(0))  # a version of its own, not dealt
    assert find() == ["b0", "b2"] and find(1) == ["b0", "b1", "b2"]
    assert store.deal("x") == 1 and find() == ["b0", "b2"]
    store.delete("x", F.col("id") == "b0")
    assert find() == ["b2"]
    store.vacuum("x")
    assert find() == ["b2"] and shards.number(spark, store._dealt("x", 1)) is None
