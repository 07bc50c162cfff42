"""Sharding, mixing, exact dedup and line dedup against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, exactdedup, linededup, mixing, sharding
from quarry.llm.components import components
from quarry.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return repr(sorted(r.asDict().items()))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: top(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shard_law_and_rows(odd, odd_rows):
    out = sharding.shard(odd, 7, bucket_bytes=2000).collect()
    again = sharding.shard(odd.repartition(5), 7, bucket_bytes=2000).collect()
    assert Counter(key(r) for r in out) == Counter(key(r) for r in again)
    assert sorted((repr((r.doc_id, r.text)) for r in out)) == sorted(repr((r[0], r[1])) for r in odd_rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r.slot)
    sizes = [len(by[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    ids = [r.doc_id for r in sorted(out, key=lambda r: (r["shard"], r.slot)) if r.doc_id]
    assert ids != sorted(ids)


def test_shard_sizes(spark, none):
    rows = spark.createDataFrame([(1, "é"), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: (r.s, r.c) for r in rows.select("doc_id", sharding.text_size(F.col("text")).alias("s"), sharding.text_crc(F.col("text")).alias("c")).collect()}
    assert out == {1: (10, zlib.crc32("é".encode())), 2: (8, 0), 3: (8, 0)}
    assert sharding.shard(none, 5).count() == 0
    assert sorted(r["shard"] for r in sharding.shard(rows, 5).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        sharding.shard(rows, 0)


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(sharding.shard(odd.select("doc_id", "text"), 3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


def filled(sizes, weights, share, most):
    """Water-filling by rounds."""
    left, open_, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        per = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if per * weights[k] >= most * sizes[k]}
        if not over:
            for k in open_:
                target[k] = per * weights[k]
            break
        for k in over:
            target[k] = most * sizes[k]
            left -= target[k]
        open_ -= over
    return target


def test_targets(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 20):
        sizes = [rng.choice([0, 5, 100, 3000]) + rng.randrange(50) for _ in range(n)]
        names = sorted({f"s{rng.random()}" for _ in range(n - 1)}) + [None]
        rows = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        found = {r.source: r.target for r in mixing.targets(rows, [5, 2, 1], 1.5, 2).collect()}
        want = filled(sizes, [[5, 2, 1][k % 3] for k in range(n)], 1.5, 2)
        assert np.allclose([found[x] for x in names], want)


def test_mix(odd, odd_rows, none):
    out = mixing.takes(odd).collect()
    assert len(out) == len(odd_rows)
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], size(r[1])) for r in odd_rows)
    assert all(r.copies <= 2 and r.taken == r.copies * r["size"] for r in out)
    names = sorted({r[3] for r in odd_rows if r[3]}) + [None]
    sizes = [sum(size(r[1]) for r in odd_rows if r[3] == s) for s in names]
    want = dict(zip(sizes, filled(sizes, [5, 2, 1, 5], 1.5, 2), strict=True))
    taken = Counter()
    for r in out:
        assert abs(r.target - want[r.source_size]) < 1e-6
        taken[r.source_size] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(12, 0.02 * s) for s in sizes if s != max(sizes))
    assert Counter(map(key, out)) == Counter(map(key, mixing.takes(odd.repartition(7)).collect()))
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in out)
    assert mixing.takes(none).count() == 0 and mixing.mixed(none).count() == 0


def test_quotient_filter():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)
    values = np.concatenate([values, values[:200], values[:50], (values[:20] & np.uint64(0xFFFFFFFF00000000)) | np.uint64(7), np.array([0, 0, 2**64 - 1], np.uint64)])
    parts = [exactdedup.QuotientFilter.from_bytes(exactdedup.QuotientFilter.of(*np.unique(p, return_counts=True)).to_bytes()) for p in np.array_split(values, 5)]
    found, counts = exactdedup.QuotientFilter.merged(parts).entries()
    want, n = np.unique(values, return_counts=True)
    assert (found == want).all() and (counts == n).all()
    empty = exactdedup.QuotientFilter.of(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert len(exactdedup.QuotientFilter.from_bytes(empty.to_bytes()).entries()[0]) == 0


@pytest.mark.parametrize("sent", [None, 3, 0])
def test_exact_dedup(odd, odd_rows, none, monkeypatch, sent):
    """Few groups, groups of which the large ones are sent to executors, and groups of which none is."""
    import hashlib

    if sent is not None:
        monkeypatch.setattr(common, "MAX_SENT_ROWS", max(1, sent))
        monkeypatch.setattr(common, "MAX_ROWS_OF_A_KEY", 2 if sent else 1_000)
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in odd_rows:
        groups[bare(r[1])].append(r)
    best = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for k, v in groups.items()}
    out = exactdedup.classes(odd).collect()
    want = Counter((r[0], best[bare(r[1])][0], len(groups[bare(r[1])]), hashlib.sha256(bare(r[1]).encode()).hexdigest()) for r in odd_rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = [r.text_sha256 for r in out if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)
    rest = exactdedup.keep_first(odd)
    assert rest.columns == odd.columns
    assert sorted(repr((r.doc_id, r.text)) for r in rest.collect()) == sorted(repr((b[0], b[1])) for b in best.values())
    assert exactdedup.classes(none).count() == 0 and exactdedup.keep_first(none).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, x, letters):
    x = list(x)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(x) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            x.insert(at, rng.choice(letters))
        elif x and kind == 1:
            x.pop(min(at, len(x) - 1))
        elif x:
            x[min(at, len(x) - 1)] = rng.choice(letters)
    return "".join(x)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_distance(spark, threshold):
    rng = random.Random(4)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(12)))
        pairs.append((a, edited(rng, a, "abé😀")))
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("d", linededup.edit_distance_within(F.col("a"), F.col("b"), threshold)).collect()
    assert all((distance(r.a, r.b) if distance(r.a, r.b) <= threshold else None) == r.d for r in rows)


@pytest.mark.parametrize(("threshold", "edit_chars"), [(linededup.THRESHOLD, linededup.EDIT_CHARS), (1, 4), (2, 4), (3, 5)])
def test_line_links(spark, threshold, edit_chars):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(2, 32))).strip() or "x" for _ in range(30)]
    lines = [x for _ in range(220) if (x := edited(rng, rng.choice(base), "abcx").strip())]
    docs = spark.createDataFrame([(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(-(-len(lines) // 4))], "doc_id long, text string")
    found = linededup.links(docs, threshold=threshold, edit_chars=edit_chars)
    text = {(r.k1, r.k2): r.line for r in linededup.lines(docs).collect()}
    got = Counter((frozenset((text[tuple(r.a)], text[tuple(r.b)])), r.distance) for r in found.collect())
    own = sorted(set(lines))
    most = lambda x, y: min(threshold, min(len(x), len(y)) // edit_chars)
    want = {(frozenset((x, y)), d) for i, x in enumerate(own) for y in own[i + 1 :] if (d := distance(x, y)) <= most(x, y)}
    assert {d for _, d in want} >= set(range(1, threshold))
    assert set(got) == want and set(got.values()) <= {1}


def test_line_classes(spark, none, odd):
    near = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, f"{near}\nonly here"), (2, f"  {near}\n{near}!\n\nshort"), (3, f"{near}!!\nshort\n{near} and then much more"), (4, None), (5, "")], "doc_id long, text string")
    out = linededup.classes(docs).collect()
    assert Counter((r.n_copies, r.n_links, r.class_doc_id) for r in out) == Counter([(2, 2, 1), (1, 2, 1), (1, 2, 1), (1, 0, 1), (2, 0, 2), (1, 0, 3)])
    clean = {r.doc_id: r.text for r in linededup.without_repeats(docs).collect()}
    assert clean == {1: f"{near}\nonly here", 2: "\nshort", 3: f"{near} and then much more", 4: None, 5: ""}
    assert linededup.classes(none).count() == 0
    assert linededup.without_repeats(odd).columns == odd.columns


def test_line_occurrences(spark, none, tmp_path):
    """The registered query names every document that holds a line, and where."""
    near = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, f"{near}\nonly here"), (2, f"  {near}\n{near}!\n\nhold it!!"), (3, f"{near}!!\nhold it!!"), (None, near), (5, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op3_linededup"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.at, r.n_links, r.class_size, r.class_doc_id, r.class_at, r.kept) for r in out) == Counter([
        (1, 0, 2, 5, 1, 0, True), (1, 1, 0, 1, 1, 1, True), (2, 0, 2, 5, 1, 0, False), (2, 1, 2, 5, 1, 0, False), (2, 3, 0, 2, 2, 3, True),
        (3, 0, 2, 5, 1, 0, False), (3, 1, 0, 2, 2, 3, False), (None, 0, 2, 5, 1, 0, False),
    ])
    assert len({(r.k1, r.k2) for r in out}) == 5 and len({(r.class_k1, r.class_k2) for r in out}) == 3
    assert linededup.occurrences(none).count() == 0


def test_short_line_links(spark):
    """Ten code points allow an edit, twenty two; shorter lines are linked to none."""
    docs = spark.createDataFrame([(1, "Page 1 of 20\nLe.\nabc"), (2, "Page 17 of 20\nAs.\nxbc\nno"), (3, "Page 177 of 20"), (4, "Page 1 of 20 on paper"), (5, "Page 177 of 20 on paper")], "doc_id long, text string")
    assert sorted(r.distance for r in linededup.links(docs).collect()) == [1, 1, 2]


def test_line_candidates(spark, monkeypatch):
    """A pair is made once, whatever its lines share, and only if their letters' counts are near."""
    made, met = [], linededup._met

    def counted(*args):
        made.append(met(*args))
        return made[0]

    monkeypatch.setattr(linededup, "_met", counted)
    alike = [f"the quick brown fox jumps over {x} lazy dogs" for x in "qwzxvkjy"]
    apart = [f"every letter comes twice in what follows {x * 2} {y * 2} {z * 2}" for x, y, z in ("abc", "def", "ghi", "jkl", "mno")]
    docs = spark.createDataFrame(list(enumerate(alike + apart)), "doc_id long, text string")
    assert linededup.links(docs).count() == 28
    assert made[0].count() == made[0].distinct().count() == 28
