"""The pipeline as a whole, and what its stages keep."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from quarry.llm import similar
from quarry.llm.queries import QUERIES


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, rows = rows, stage(spark, rows, sf)
        if k < 4:
            assert rows.columns == docs.columns
            rows = rows.cache()
        if k in (0, 1, 2):
            assert rows.join(before, "doc_id", "left_anti").count() == 0 and rows.count() <= before.count()
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == rows.count()
    assert out.agg(F.bit_xor(F.xxhash64("doc_id", "ids_sha256"))).first() == rows.agg(F.bit_xor(F.xxhash64("doc_id", "ids_sha256"))).first()


def test_near_copies(spark):
    """The near-copy stage against brute force over all pairs of five-word shingle sets."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    common = rng.choices(vocabulary, k=12)
    texts = []
    for size in (4, 30, 60, 120, 240):
        for _ in range(6):
            base = rng.choices(vocabulary, k=size) + (common if rng.random() < 0.7 else [])
            texts.append(base)
            for _ in range(3):
                near = list(base)
                for _ in range(rng.randrange(1, 3)):
                    near[rng.randrange(len(near))] = rng.choice(vocabulary)
                texts.append(near + rng.choices(vocabulary, k=rng.randrange(4)))
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts] + ["", None]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and low[i] != low[j]:
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low))
    assert len(set(low)) < len(texts) - 20
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_keys_are_not_kept(spark, monkeypatch):
    """Keys that only one text has are never written, whatever the texts are."""
    kept = []

    def counted(df):
        out = checkpointed(df)
        if "key" in out.columns:
            kept.append(out.count())
        return out

    checkpointed = similar.checkpointed
    monkeypatch.setattr(similar, "checkpointed", counted)
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(60))) for k in range(20)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in similar.near_classes(docs).collect()} == {(k, k) for k in range(20)}
    assert kept and max(kept) == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Sets that share keys meet one of them first, so few pairs of a large group are left for the last step, which makes all pairs."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(60):
        near = list(base)
        for _ in range(rng.choice((2, 3))):
            near[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    pairs = []
    linked = similar._linked

    def counted(docs, text_col, light, candidates, *more):
        pairs.append(candidates.count())
        return linked(docs, text_col, light, candidates, *more)

    monkeypatch.setattr(similar, "_linked", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {r.component_id for r in similar.near_classes(docs).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(196)} for w in map(str.split, texts)]
    low = list(range(60))
    for i in range(60):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and low[i] != low[j]:
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    assert classes == set(low)
    assert pairs[-1] < len(texts)
