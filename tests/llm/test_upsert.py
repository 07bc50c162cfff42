"""Copy-on-write upserts against a plain one in memory, the files that are left, and the parts that prune."""

import hashlib
import os
import random
import zlib
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import upsert
from quarry.llm.queries import op12_upsert

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp, name string, email string, city string, nation_id int, segment string, balance double, home string, __x string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double, at string"
crc = lambda x: zlib.crc32(str(x).encode())


def expected(clients, changes):
    """Lists of rows by file, with whether it was rewritten, straight from the contract."""
    m = 1 + len(clients) // 1000
    rows = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [rows[k : k + m] for k in range(0, len(rows), m)]
    newest = {}
    rank = lambda c: [(c[k] is not None, c[k]) if c[k] is not None else (False,) for k in ("seq", "change_id", *sorted(c.keys() - {"client_id"}))]
    for c in changes:
        if c["client_id"] is not None and (c["client_id"] not in newest or rank(c) > rank(newest[c["client_id"]])):
            newest[c["client_id"]] = c
    after = [{r["client_id"]: dict(r) for r in f} for f in files]
    for i, c in newest.items() if files else []:
        home = max((k for k, f in enumerate(files) if f[0]["client_id"] <= i), default=0)
        h = crc(files[home][0]["client_id"]) % 16
        if h > 7:
            continue
        if c["op"] == "D" or crc("" if c["change_id"] is None else c["change_id"]) % 8 < h:
            after[home].pop(i, None)
        else:
            row = after[home].setdefault(i, dict.fromkeys(clients[0]) | {"client_id": i})
            row |= {k: c[k] for k in ("source", "segment", "city", "balance")}
    out = []
    for f, a in zip(files, after, strict=True):
        now = [a[i] for i in sorted(a)]
        if now == f:
            out.append((f, False))
            continue
        pieces = -(-len(now) // m)
        at = 0
        for k in range(pieces):
            size = len(now) // pieces + (k < len(now) % pieces)
            piece, at = now[at : at + size], at + size
            if out and out[-1][1] and len(out[-1][0]) + size <= m:
                out[-1] = (out[-1][0] + piece, True)
            else:
                out.append((piece, True))
    return out


def digest(rows, rewritten, columns):
    text = lambda r: "|".join(r[k] or "" for k in ("source", "segment", "city"))
    cents = sum(int((100 * r["balance"] + 0.5) // 1) for r in rows if r["balance"] is not None)
    ids = ",".join(str(r["client_id"]) for r in rows)
    return (rows[0]["client_id"], len(rows), cents, sum(zlib.crc32(text(r).encode()) for r in rows), hashlib.sha256(ids.encode()).hexdigest(), ",".join(columns), rewritten)


def check(spark, folder):
    clients, changes = ([r.asDict() for r in spark.read.parquet(f"{folder}/{t}.parquet").collect()] for t in ("clients", "client_changes"))
    columns = spark.read.parquet(f"{folder}/clients.parquet").columns
    found = op12_upsert(spark, folder).collect()
    want = expected(clients, changes)
    names = "first_id n_rows cents rows_crc ids_sha256 columns rewritten".split()
    assert sorted(tuple(r[c] for c in names) for r in found) == sorted(digest(rows, again, columns) for rows, again in want)
    rows = {(f[0]["client_id"], len(f)): f for f, _ in want}
    roots = set()
    for r in found:  # the files themselves: order, columns, values
        path = unquote(urlparse(r.path).path)
        roots.add(os.path.dirname(os.path.dirname(path)))
        held = pq.ParquetFile(path).read()
        assert held.column_names == columns and held.to_pylist() == rows[r.first_id, r.n_rows]
    assert len(roots) <= 1
    for root in roots:  # and no others
        left = {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if not f.startswith((".", "_"))}
        assert left == {unquote(urlparse(r.path).path) for r in found}
    return found


def test_given_tables(spark, sf):
    assert any(r.rewritten for r in check(spark, sf)) and check(spark, "/root/testdata/sf0.01")


def tables(spark, at, n, seed, ids=None):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", None, ""])
    money = lambda: rng.choice([None, -12.345, 0.005, round(rng.uniform(-1e4, 1e4), 2)])
    ids = rng.sample(range(-n, 3 * n), n) if ids is None else ids
    clients = [(i, 1, word(), None, word(), word(), word(), 3, word(), money(), "clash", None) for i in [*ids, None]]
    changes = []
    for k in range(4 * n):
        i = rng.choice([*ids, *(rng.randrange(-2 * n, 4 * n) for _ in range(3)), None])
        changes.append((rng.choice([k, None]), i, rng.choice([rng.randrange(9), None]), rng.choice(["I", "U", "D", None]), None, word(), word(), word(), money(), "clash"))
    changes += [(9 * n + k, 7 * n + k, 1, "I", None, "new", None, "end", 1.0, None) for k in range(2 * n)]  # a hot home: all behind the last file
    changes += changes[:5]
    spark.createDataFrame(clients, CLIENTS).repartition(3).write.parquet(f"{at}/clients.parquet")
    spark.createDataFrame(changes, CHANGES).repartition(3).write.parquet(f"{at}/client_changes.parquet")


@pytest.mark.parametrize("n,seed", [(0, 1), (1, 2), (40, 3), (2100, 4)])
def test_odd_tables(spark, tmp_path, n, seed):
    tables(spark, str(tmp_path), n, seed)
    check(spark, str(tmp_path))


def test_repeated_keys(spark, tmp_path):
    """Rows that share a key stay together where their home is; nothing is lost and nothing fails."""
    rows = [(i // 3, f"v{i % 3}", 1.0) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, v string, w double")
    folder = str(tmp_path / "files")
    upsert.write_files(table, folder, "id", 10)
    changes = spark.createDataFrame([(4, "new", "S"), (7, None, "D"), (99, "far", "S"), (-9, "low", "D"), (5, "v", None)], "id long, v string, does string")
    upsert.apply_changes(spark, folder, table.schema, changes, "id", 10, ["v"], lambda low: F.col("does"))
    left = sorted((r.id, r.v) for r in upsert.read_files(spark, folder, table.schema).collect())
    assert left == sorted([(i, "new" if i == 4 else v) for i, v, _ in rows if i != 7] + [(99, "far")])


def test_filters(spark):
    """A Bloom filter loses no key and rules out most others; fences come from footers."""
    rows = spark.range(20_000).select(F.format_string("f%d", F.floor(F.col("id") / 1000)).alias(upsert.FILE), (F.col("id") * 7).alias("id"))
    filters = upsert.bloom_filters(rows, "id", 1000)
    assert upsert.maybe_there(rows, filters, "id", 1000).count() == 20_000
    absent = rows.withColumn("id", F.col("id") + 1)
    assert upsert.maybe_there(absent, filters, "id", 1000).count() < 1_000


def test_ranks(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(500)], "a long, b long").repartition(6)
    assert [(r.a, r.b) for r in sorted(upsert.ranked(rows, ["a", "b"]).collect(), key=lambda r: r["at"])] == sorted((k % 7, k) for k in range(500))
