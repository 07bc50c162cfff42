"""Removal of repeated passages against brute force: the order of suffixes, texts of every kind, hot anchors, tables of any shape."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import suffixes
from quarry.llm.common import table
from quarry.llm.queries import op13_suffix_dedup


def expected(rows, window=50):
    """Bytes kept and runs removed of (id, text) rows, by looking at every string."""
    rows = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in rows:
        for k in range(len(t) - window + 1):
            w = t[k : k + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if first[t[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((None if i == float("inf") else i, len(t), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [1, 2, 3, 7, 50])
def test_order(most):
    rng = np.random.default_rng(most)
    for _ in range(300):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(0, 70))
        order = suffixes.suffix_order(s, most)
        prefixes = [tuple(s[i : i + most]) for i in order]
        assert sorted(order) == list(range(len(s))) and prefixes == sorted(prefixes)


def test_anchors_of_equal_windows(monkeypatch):
    """Every window has one anchor, which its bytes alone decide, wherever stretches end."""
    rng = random.Random(1)
    passage = bytes(rng.choices(b"abc", k=90))
    text = rng.randbytes(333) + passage + rng.randbytes(77) + passage
    found = [x for x in zip(*map(np.concatenate, zip(*suffixes.anchors(text), strict=True)), strict=True)]
    assert [k for _, i, j in found for k in range(i, j + 1)] == list(range(len(text) - 49))
    of = {k: h for h, i, j in found for k in range(i, j + 1)}
    assert all(of[333 + k] == of[333 + 90 + 77 + k] for k in range(41))
    monkeypatch.setattr(suffixes, "STRETCH", 64)
    again = [x for x in zip(*map(np.concatenate, zip(*suffixes.anchors(text), strict=True)), strict=True)]
    assert {k: h for h, i, j in again for k in range(i, j + 1)} == of


def texts(seed):
    """Texts that share passages at random places, copies, runs of one letter, texts around the window's length."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [noise(n) for n in (30, 49, 50, 51, 80, 300)]
    out = [(i, noise(rng.randrange(80)) + "".join(p + noise(rng.randrange(0, 40)) for p in rng.sample(passages, rng.randrange(4)))) for i in range(120)]
    out += [(200 + i, passages[-1]) for i in range(5)] + [(300, "a" * 500), (301, "b" + "a" * 120), (302, "ab" * 100), (None, passages[-1] + "x"), (None, passages[4]), (303, None), (304, ""), (305, passages[2]), (305, passages[2] + "y")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [100_000, 3])
def test_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "SORTED_BYTES", 2_000)
    monkeypatch.setattr(suffixes, "HELD_ANCHORS", 50)
    rows = texts(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tk", F.lit("clash")).repartition(5)
    assert got(suffixes.without_repeats(docs, hot_texts=hot)) == expected(rows)


def test_odd_rows(spark, odd, odd_rows, none):
    assert got(suffixes.without_repeats(odd)) == expected([(r[0], r[1]) for r in odd_rows])
    assert suffixes.without_repeats(none).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = [(i, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest()) for i, n, runs, kept in expected(rows)]
    assert sorted((tuple(r) for r in op13_suffix_dedup(spark, sf).collect()), key=repr) == sorted(want, key=repr) and any(w[2] for w in want)


def test_packed_keys():
    rng = np.random.default_rng(3)
    for n, most in ((1, 1 << 40), (9, 4), (5_000, 1 << 40), (5_000, 1 << 26)):
        keys = np.sort(rng.integers(0, most, n).astype(np.uint64))
        assert (suffixes._unpacked(suffixes._packed(keys)) == keys).all()
    numbers = rng.integers(-(1 << 62), 1 << 62, 99)
    assert (suffixes._longs([suffixes._planes(numbers[:40]), suffixes._planes(numbers[40:])]) == numbers).all()


def test_ranges_are_even():
    rng = random.Random(6)
    text = rng.randbytes(200_000)
    for k in (0, 3, 4):  # anchors and their keys
        found = suffixes._anchored(text, np.array([0, len(text) + 1]), 50)[k]
        found = np.sort(found[found != suffixes._NO_KEY])
        assert [at.stop - at.start > len(found) // 12 for _, at in suffixes._parts(found, 8)] == [True] * 8


def test_equal_windows_share_a_key():
    """Wherever a window stands, its anchor there has a key that it has elsewhere; windows lie within one text."""
    rng = random.Random(2)
    passage = bytes(rng.choices(b"abc", k=50))
    parts = [rng.randbytes(k) + passage + rng.randbytes(91 - k) for k in range(0, 91, 7)] + [passage, rng.randbytes(50)]
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    _, first, last, *keys = suffixes._anchored(b"\0".join(parts), begins, 50)
    assert [k for i, j in zip(first, last, strict=True) for k in range(i, j + 1)] == [b + k for b, p in zip(begins, parts, strict=False) for k in range(len(p) - 49)]
    here = [np.flatnonzero((first <= b + p.find(passage)) & (last >= b + p.find(passage)))[0] for b, p in zip(begins, parts[:-1], strict=False)]
    assert any(len({x[k] for k in here}) == 1 and x[here[0]] != suffixes._NO_KEY for x in keys)


@pytest.mark.parametrize("window", [16, 33, 47, 64])
def test_other_windows(spark, window, monkeypatch):
    monkeypatch.setattr(suffixes, "STRETCH", 128)
    monkeypatch.setattr(suffixes, "HELD_ANCHORS", 200)
    rows = texts(window)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(suffixes.without_repeats(docs, window=window)) == expected(rows, window)


def test_rows_that_repeat_id_and_text(spark):
    """They don't take from one another; other documents take from them, and they from others."""
    rng = random.Random(4)
    passage, one, two = ("".join(rng.choices("abcdef ", k=n)) for n in (70, 200, 90))
    rows = [(1, "x" + passage)] + [(5, one + passage)] * 40 + [(None, two)] * 60 + [(7, one[:80]), (None, two + "y"), (5, two[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(suffixes.without_repeats(docs)) == expected(rows)


def test_shuffled_bytes(spark):
    """Texts are shuffled once, and all else takes less than they do: anchors go as packed keys, pieces as digests."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        executors = sc.statusStore().executorList(True)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    before, n_bytes = written(), docs.agg(F.sum(F.octet_length("text"))).first()[0]
    suffixes.without_repeats(docs).write.format("noop").mode("overwrite").save()
    assert written() - before < 1.7 * n_bytes
