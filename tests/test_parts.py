"""Rows are told apart in parts whose number grows with the rows, and whose size doesn't."""

from pyspark.sql import functions as F

from quarry.operators import ingest, lookup


def parts_before_aggregate(rows) -> bool:
    """True if no rows are held (aggregated) before they are dealt by number."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return "REPARTITION_BY_NUM" in plan and "Aggregate" not in plan.split("REPARTITION_BY_NUM")[-1].split("Scan")[0].split("LocalTable")[0]


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lookup, "ROWS_OF_A_TASK", 10)
    entities = spark.range(30).select((F.col("id") % 20).alias("id"), F.array(F.col("id") % 3, F.lit(1), F.lit(7)).alias("uses"))
    entities = entities.unionByName(spark.sql("SELECT 99L AS id, CAST(NULL AS array<bigint>) AS uses UNION ALL SELECT NULL, array(1L, NULL, 1L)"))
    found = lookup.resolve_edges(entities, spark.range(5))
    expected = {(k % 20, u) for k in range(30) for u in {k % 3, 1}} | {(None, 1)}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert parts_before_aggregate(found)
    assert lookup.distinct_in_parts(spark.range(100), 100).rdd.getNumPartitions() >= 10
    assert lookup.resolve_edges(entities.limit(0), spark.range(5)).count() == 0


def test_repeated_ids(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 1, array('x')), ('a', 1, array('x')), ('b', 1, NULL), ('b', 2, NULL), (NULL, 1, NULL), (NULL, 2, array('y')), ('c', 1, array()) AS t(id, n, uses)")
    found = ingest.repeated_ids(rows)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("b", 2), (None, 2)], key=str)
    assert parts_before_aggregate(found) and ingest.repeated_ids(rows.limit(0)).count() == 0


def test_uses_drop_repeats_where_they_meet(spark):
    """Repeated references and deps count once, deps are not unfolded, and a theorem leaves itself out of its proof's."""
    thms = spark.sql("SELECT 't' AS theory, 'T.a' AS name, 'p' AS prop, 'q' AS proof, array('T.a', 'D.x', 'D.x', NULL) AS deps UNION ALL SELECT 't', 'T.b', 'r', NULL, NULL")
    nodes = spark.sql("SELECT * FROM VALUES ('p', 0, NULL, 'Const', 'C'), ('p', 1, 0, 'Const', 'C'), ('q', 0, NULL, 'PThm', 'T.a'), ('q', 1, 0, 'PAxm', 'D.x') AS n(root, node, parent, ctor, name)")
    axioms = spark.sql("SELECT 't' AS theory, 'A' AS name, 'p' AS prop")
    none = spark.sql("SELECT 't' AS theory, 'x' AS name, 'none' AS axiom_name")
    found = ingest.extract_facts(axioms, none, none, thms, nodes)
    assert {r.id: r.uses for r in found.collect()} == {"Fact.A": ["Constant.C"], "Fact.T.a": ["Constant.C", "Fact.D.x", "Fact.T.a"], "Fact.T.b": []}
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
