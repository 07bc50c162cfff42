"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds
(multiplies) its letters' vectors, each permuted (rotated) by its place. A
document bundles (adds) the vectors of its n-grams. A language's prototype
bundles those of its documents, and the prototype with the largest cosine names
a document's language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpointed, draw, held_out, if_small, in_batches

DIMENSIONS = 1_024
NGRAM = 3
#: Documents of each language that a prototype is learned from, about.
TRAINING_DOCS = 3_000
#: n-grams that are bundled at once.
NGRAMS_AT_ONCE = 120_000
#: Distinct n-grams whose vectors are made at once.
VECTORS_AT_ONCE = 8_192
#: What predictions say of a text without a letter.
UNDETERMINED = "und"


class Profiles:
    """Turns texts into hypervectors. The vectors depend on the seed and the letters only, so all workers agree."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = NGRAM, seed: int = 3):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.number = np.full(0x110000, -1, np.int32)
        #: By place in the n-gram: vectors by letter, rotated; 0 is all that lies between words.
        self.vectors = [np.zeros((0, dimensions), np.int8) for _ in range(n)]
        self._add([0])

    def _add(self, code_points: list[int]) -> None:
        fresh = []
        for cp in code_points:
            self.number[cp] = len(self.vectors[0]) + len(fresh)
            fresh.append(np.random.Generator(np.random.Philox(key=[self.seed, cp])).integers(0, 2, self.dimensions, np.int8) * 2 - 1)
        rows = np.array(fresh, np.int8)
        self.vectors = [np.concatenate([v, np.roll(rows, self.n - 1 - k, axis=1)]) for k, v in enumerate(self.vectors)]

    def letters(self, text: str) -> np.ndarray:
        """Numbers of a text's letters in lower case, each stretch of other characters as one 0; empty if there is no letter."""
        cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        numbers = self.number[cps]
        if (numbers < 0).any():
            unknown = np.unique(cps[numbers < 0]).tolist()
            self.number[[cp for cp in unknown if not chr(cp).isalpha()]] = 0
            if letters := [cp for cp in unknown if chr(cp).isalpha()]:
                self._add(letters)
            numbers = self.number[cps]
        numbers = np.concatenate([[0], numbers, [0]]).astype(np.int64)
        numbers = numbers[np.append(True, (numbers[1:] != 0) | (numbers[:-1] != 0))]
        return numbers if len(numbers) > 1 else numbers[:0]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One row a text: the sum of its n-grams' vectors; zeros if it has no letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        group, of, size = [], [], 0
        for k, text in enumerate(texts):
            x = self.letters(text)
            while len(x):
                part = x[: NGRAMS_AT_ONCE + self.n - 1]
                x = x[NGRAMS_AT_ONCE:] if len(x) > NGRAMS_AT_ONCE + self.n - 1 else x[:0]
                part = np.concatenate([part, np.zeros(max(0, self.n - len(part)), np.int64)])
                if size and size + len(part) > NGRAMS_AT_ONCE:
                    self._bundle(group, of, out)
                    group, of, size = [], [], 0
                group.append(part)
                of.append(k)
                size += len(part)
        if group:
            self._bundle(group, of, out)
        return out

    def _bundle(self, group: list[np.ndarray], of: list[int], out: np.ndarray) -> None:
        base = len(self.vectors[0])
        codes = []
        for x in group:
            code = x[: len(x) - self.n + 1].copy()
            for k in range(1, self.n):
                code = code * base + x[k : len(x) - self.n + 1 + k]
            codes.append(code)
        rows = np.repeat(np.arange(len(group)), [len(c) for c in codes])
        distinct, index = np.unique(np.concatenate(codes), return_inverse=True)
        for at in range(0, len(distinct), VECTORS_AT_ONCE):
            part = distinct[at : at + VECTORS_AT_ONCE]
            vectors, rest = None, part
            for k in reversed(range(self.n)):
                rest, letter = np.divmod(rest, base)
                v = self.vectors[k][letter]
                vectors = v if vectors is None else vectors * v
            here = (index >= at) & (index < at + len(part))
            counts = np.bincount(rows[here] * len(part) + index[here] - at, minlength=len(group) * len(part)).reshape(len(group), len(part))
            np.add.at(out, np.array(of), counts.astype(np.float32) @ vectors.astype(np.float32))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = TRAINING_DOCS, seed: int = 3) -> dict[str, np.ndarray]:
    """Prototype of each language, learned outside the held-out fold.

    Of a language with more documents, about ``docs_each`` are drawn by a seed.
    Rows with a null language or text teach nothing, rows that repeat an id are
    drawn together, and a long text counts as much as a short one. Sums are formed on the
    executors; the driver gets a vector a language, and every language has one. Nothing to
    learn from, as in an empty table, gives no prototype.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    share = checkpointed(rows.groupBy(F.col(lang_col).alias("__lang")).agg((F.lit(float(docs_each)) / F.count(F.lit(1))).alias("__share")))
    drawn = rows.join(if_small(share), F.col(lang_col) == F.col("__lang")).filter(draw(seed, F.col(id_col)) < F.col("__share")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles, sums = Profiles(seed=seed), {}
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                units = _unit(profiles.bundle(part["text"].tolist())).astype(np.float64)
                for lang, own in part.groupby("lang").indices.items():
                    sums[lang] = sums.get(lang, 0) + units[own].sum(axis=0)
        if sums:  # a partition without a training row has nothing to say
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    parts = in_batches(drawn).mapInPandas(add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        if any(x.x for x in r.v):
            found[r.lang] = np.array([x.x for x in r.v])
    return dict(sorted(found.items()))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], keys: list[str], text_col: str = "text", seed: int = 3) -> DataFrame:
    """``keys`` of each row, its language by whole text, and the cosine with that prototype.

    Columns: ``keys``, lang_pred string, score double (a cosine below 0 counts
    as 0). A null text, one without a letter, or no prototype at all gives
    ``und`` and 0. Of equal cosines the first language in order of code points wins.
    Whole texts are read, however long, in parts of bounded size. Rows that
    repeat are answered alike; an empty table gives an empty table.
    """
    names = list(prototypes)
    matrix = _unit(np.array([prototypes[x] for x in names], np.float64).reshape(len(names), DIMENSIONS)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    docs = docs.select(*keys, F.col(text_col).alias("__text"))
    fields = [f for f in docs.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        profiles = Profiles(seed=seed)
        for pdf in batches:
            langs, scores = [], []
            for at in range(0, len(pdf), 256):
                rows = profiles.bundle(pdf["__text"].iloc[at : at + 256].fillna("").tolist())
                any_letter = rows.any(axis=1)
                cosines = _unit(rows) @ matrix.T if names else np.zeros((len(rows), 1))
                best = cosines.argmax(axis=1)
                langs += [names[b] if ok and names else UNDETERMINED for b, ok in zip(best.tolist(), any_letter.tolist(), strict=True)]
                scores += np.where(any_letter & bool(names), np.clip(cosines.max(axis=1), 0, 1), 0.0).astype(float).tolist()
            yield pdf[keys].assign(lang_pred=langs, score=scores)

    return in_batches(docs).mapInPandas(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
