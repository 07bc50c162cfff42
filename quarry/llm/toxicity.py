"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of its words and of how they begin; the document's is their noisy-or,
1 minus the product of (1 - p). Only documents carry labels: the weights come
from the gradient of the document's likelihood, and afterwards the sentence
probabilities locate what offends.

The features are those words and beginnings that more toxic training documents
hold than their share; a sentence with none of them only has the background's
probability, which counts once a document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpointed, draw, held_out, in_batches

#: Labelled documents of each label that a model is fitted on, at most.
MAX_TRAINING_DOCS = 2_500
#: Characters of training texts that go to the driver, at most; a document that doesn't fit any more is left out of the sample as a whole.
MAX_TRAINING_CHARS = 12_000_000
#: Features of a model, at most, so that its size is bounded wherever it is sent.
MAX_FEATURES = 1_500
#: Lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6)
#: Logit of a sentence that holds no feature.
BACKGROUND = -9.0
#: A weight's greatest size: no single feature makes a sentence toxic, but a word and its beginnings do.
HEAVIEST = 4.0
#: Words whose weight a worker remembers; past this it forgets them all, which changes no result.
REMEMBERED = 400_000

_SENTENCE_END = re.compile(r"[.!?\n]+")
_WORDS = re.compile(r"\w+").findall


def lowered(text: str) -> str:
    """``text`` in lower case, or as it is where that would move its characters."""
    low = text.lower()
    return low if len(low) == len(text) else text


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end, in code points, of each part between full stops, question or exclamation marks and line ends."""
    out, begin = [], 0
    for m in _SENTENCE_END.finditer(text):
        if m.start() > begin:
            out.append((begin, m.start()))
        begin = m.end()
    if begin < len(text):
        out.append((begin, len(text)))
    return out


def word_features(word: str) -> list[str]:
    """A lower-case word and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


class Model:
    """Weights of features. ``constant`` stands for all scores where there was nothing to learn from."""

    def __init__(self, weights: dict[str, float], bias: float = BACKGROUND, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        """Sum of the weights of a word's features, 0 if it has none."""
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            value = self.known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return value

    def logits(self, text: str) -> list[tuple[int, int, float]]:
        """Span and logit of each sentence with a feature; each of its words counts once."""
        low, word = lowered(text), self.word
        telling = {w for w in {*_WORDS(low)} if word(w)}
        out = []
        if telling:
            for i, j in sentences(low):
                found = telling.intersection(_WORDS(low[i:j]))
                if found:
                    out.append((i, j, self.bias + sum(map(word, sorted(found)))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over the sentences, and the spans of sentences that are likelier toxic than not."""
        if self.constant is not None:
            return self.constant, []
        found = self.logits(text)
        z = np.array([self.bias, *(x[2] for x in found)])
        clean = -np.logaddexp(0, z)  # log of 1 - p
        spans = [(i, j, float(p)) for (i, j, _), p in zip(found, -np.expm1(clean[1:]), strict=True) if p >= 0.5]
        return float(min(1.0, max(0.0, -np.expm1(clean.sum())))), spans


def informative(texts: list[str], y: np.ndarray, max_features: int = MAX_FEATURES) -> list[str]:
    """Features that at least 3 toxic documents hold, and 3 times their share of all that hold it; the ``max_features`` most telling, these first."""
    counts = (Counter(), Counter())
    known: dict[str, list[str]] = {}
    for text, label in zip(texts, y, strict=True):
        found = set()
        for w in {*_WORDS(lowered(text))}:
            if w not in known:
                known[w] = word_features(w)
            found.update(known[w])
        counts[int(label)].update(found)
    toxic = y.sum()
    odds = (toxic + 1) / (len(y) - toxic + 1)
    telling = {f: (n - 3 * odds * (counts[0][f] + 2)) / np.sqrt(n) for f, n in counts[1].items() if n >= 3}
    return sorted((f for f, x in telling.items() if x > 0), key=lambda f: (-telling[f], f))[:max_features]


def fit(texts: list[str], labels: list[int], steps: int = 300, rate: float = 0.1, l1: float = 1e-3, max_features: int = MAX_FEATURES) -> Model:
    """Fits by proximal Adam steps on the likelihood of the documents' labels; all documents take part in every step.

    With labels of one kind only, the model is constant: that label.
    """
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, constant=float(y[0]) if len(y) else 0.0)
    names = informative(texts, y, max_features)
    if not names:
        return Model({}, constant=float(y.mean() >= 0.5))
    number = {f: k for k, f in enumerate(names)}
    trial = Model(dict.fromkeys(names, 1.0))
    column, row, doc = [], [], []
    for d, text in enumerate(texts):
        low = lowered(text)
        for i, j, _ in trial.logits(text):
            for w in sorted({*_WORDS(low[i:j])}):
                found = [number[f] for f in word_features(w) if f in number]
                column += found
                row += [len(doc)] * len(found)
            doc.append(d)
    column, row, doc = np.array(column, np.int64), np.array(row, np.int64), np.array(doc, np.int64)
    n_docs, n_rows = len(y), len(doc)
    w = np.zeros(len(names))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n_docs - y.sum()))  # both labels weigh the same
    m, v = np.zeros_like(w), np.zeros_like(w)
    base = np.log1p(np.exp(BACKGROUND))
    for step in range(1, steps + 1):
        z = BACKGROUND + np.bincount(row, w[column], n_rows)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        some = -np.expm1(-base - np.bincount(doc, np.logaddexp(0, z), n_docs))
        pull = np.where(y == 1, -(1 - some) / np.maximum(some, 1e-9), 1.0) * share
        g = np.bincount(column, (pull[doc] * p)[row], len(w))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        scale = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        w = w - scale * m / (1 - 0.9**step)
        w = np.clip(np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale * l1 * share.min(), rate / 2), 0), -HEAVIEST, HEAVIEST)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x})


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_docs: int = MAX_TRAINING_DOCS,
    seed: int = 7,
    max_chars: int = MAX_TRAINING_CHARS,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Fits on labelled documents outside the held-out fold, drawn by a seed.

    The sample holds at most ``max_docs`` documents of each label and
    ``max_chars`` characters of whole texts, which are counted before any text
    leaves its executor; the model has at most ``max_features`` weights. Null
    labels and ids count as none; of an id with several labels, any 1 counts. Of
    rows that repeat an id, the one with the smallest text (by its hash, then
    itself) is drawn. Null texts are empty. Without labels of both kinds, as in
    empty tables, the model is constant.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg((F.max(label_col) == 1).cast("int").alias("y"))
    drawn = None
    for y in (0, 1):
        part = marked.filter(F.col("y") == y).orderBy(draw(seed, F.col(id_col)), id_col).limit(max_docs)
        drawn = part if drawn is None else drawn.unionByName(part)
    # at most 2 * max_docs rows of two numbers, whatever the size of the tables
    drawn = checkpointed(drawn.withColumnsRenamed({id_col: "__id"}))
    text = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    light = text.join(F.broadcast(drawn), "__id").groupBy("__id", "y").agg(F.min(F.struct("h", F.char_length("t").alias("n"))).alias("first"))
    light = light.select("__id", "y", "first.*").orderBy(draw(seed, F.col("__id")), "__id")
    chosen, chars = [], 0
    for r in light.collect():
        if chars + r.n <= max_chars:
            chars += r.n
            chosen.append((r["__id"], r.h, len(chosen), r.y))
    if not chosen:
        return fit([], [])
    # as Arrow: rows of Python objects would go through workers of a second kind, which stay in each executor's memory
    schema = T.StructType([T.StructField("__id", light.schema["__id"].dataType), T.StructField("h", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("y", T.IntegerType())])
    wanted = docs.sparkSession.createDataFrame(pa.table([list(x) for x in zip(*chosen, strict=True)], names=schema.names), schema)
    texts = text.join(F.broadcast(wanted), ["__id", "h"]).groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")).orderBy("k").collect()
    return fit([r.t for r in texts], [r.y for r in texts], max_features=max_features)


def score(docs: DataFrame, model: Model, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` of each row, its score and the sentences that offend.

    Columns: ``keys``, score double from 0 to 1, offending array of (begin, end,
    p) in code points of the text. A null or empty text scores what
    the background does.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.constant))
    docs = docs.select(*keys, F.col(text_col).alias("__text"))
    fields = [f for f in docs.schema.fields if f.name != "__text"]
    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for pdf in batches:
            found = [model.score(x or "") for x in pdf["__text"]]
            yield pdf[keys].assign(score=[s for s, _ in found], offending=[[{"begin": i, "end": j, "p": p} for i, j, p in spans] for _, spans in found])

    return in_batches(docs).mapInPandas(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))]))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns and values stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.constant))
    schema = docs.schema

    def run(batches):
        model = Model(*shared.value)
        k = schema.names.index(text_col)
        for b in batches:
            yield b.filter([model.score(x.as_py() or "")[0] < threshold for x in b.column(k)]) if b.num_rows else b

    return in_batches(docs).mapInArrow(run, schema)
