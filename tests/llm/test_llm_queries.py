"""The registered queries: SQL where there is any, and columns, types and rows of all on odd tables in many nearly empty partitions."""

import os

import duckdb
import pytest

from quarry.llm.oracle import ORACLE_SQL
from quarry.llm.queries import QUERIES

COLUMNS = {
    "op1_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_linededup": {"doc_id": "bigint", "at": "int", "n_links": "bigint", "class_size": "bigint", "class_doc_id": "bigint", "class_at": "int", "kept": "boolean"},
    "op4_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op13_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.fixture(scope="module")
def folder(spark, odd, labels, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    odd.repartition(64).write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    pages = [(1, "http://a.org/1", "<html><body><article><p title=it's>One</p></article></body></html>"), (2, None, None), (3, "http://a.org/2", ""), (4, "", "<div>" * 3000 + "deep"), (4, "x", "a &amp; b")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def rows(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    said = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert rows(got, names) == sorted(said.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, folder, odd_rows, name):
    """One row for each row (op3: each line with a word), whatever it holds, also where most partitions are empty."""
    found = QUERIES[name](spark, folder)
    types = dict(found.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    out = found.collect()
    held = sum(bool(x.strip(" \t\x0b\x0c\r")) for r in odd_rows for x in (r[1] or "").split("\n"))
    assert len(out) == {"op10_html": 5, "op3_linededup": held}.get(name, len(odd_rows))
    if name == "op1_sharding":
        slots = {}
        for r in out:
            assert r.law == "rows" and 0 <= r.shard < 24
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    if name == "op4_mixing":
        assert all(r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size for r in out)
    if name == "op6_exact_dedup":
        assert sum(r.kept for r in out) == len({r.text_sha256 for r in out}) and all(len(r.text_sha256) == 64 for r in out)
    if name in ("op2_langid", "op7_toxicity"):
        assert all(0 <= r.score <= 1 for r in out)
    if name == "op7_toxicity":
        assert all(r.predicted == int(r.score >= 0.5) for r in out)
    if name == "op8_simhash":
        assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in out)
    if name == "op10_html":
        assert all(r.n_chars == len(r.text) for r in out) and {r.text for r in out} >= {"One", "deep", "a & b", ""}
