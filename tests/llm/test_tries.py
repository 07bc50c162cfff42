"""The trie of conversations against one built in memory: families, ties, nulls, conversations without turns, long and equal ones."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest

from quarry.llm import tries
from quarry.llm.tries import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(family, [])[:h] + v[h:])
    nodes = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == path)))
        children = sum(1 for q in nodes if q and q[:-1] == path)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def conversations(seed):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["é", "b", "c c", None, ""]))
    convs = {c: [turn() for _ in range(rng.randrange(12))] for c in [*range(60), *range(100, 130, 3), -7, -5, -1]}
    for c in range(200, 220):
        convs[c] = [("user", "hello")] * 3
    for c in range(300, 330):  # each goes one turn further than the one before
        convs[c] = [("user", f"t{k}") for k in range(c - 299)]
    rows = [(c, k, role, text) for c, v in convs.items() for k, (role, text) in enumerate(v)]
    rows += [(400, 1, "user", "tie"), (400, 1, "user", "other"), (400, 1, "user", "tie"), (400, None, None, None), (None, 1, "user", "nobody's"), (401, 5, "user", "x" * 50_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("held", [100_000, 5])
def test_brute_force(spark, held, monkeypatch):
    monkeypatch.setattr(tries, "HELD_NODES", held)
    monkeypatch.setattr(tries, "PACKED_ENDS", 3)
    rows = conversations(3)
    turns = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    assert got(conversation_trie(turns)) == expected(rows)


def test_small_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(none).count() == 0
    one = spark.createDataFrame([(1, 0, None, "a", None, None)], SCHEMA)
    assert got(conversation_trie(one)) == expected([(1, 0, None, "a")])


def test_long_way_to_the_root(spark):
    """Sums over a way of many chains, in rounds of doubling."""
    chains = spark.createDataFrame([(c, c - 1 if c else None, 1, c) for c in range(100)], "chain long, above long, leaves long, saved long")
    assert {r.chain: (r.leaves, r.saved) for r in tries._to_root(chains).collect()} == {c: (100 - c, sum(range(c, 100))) for c in range(100)}
