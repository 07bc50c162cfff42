"""Quality rules with adaptive thresholds.

Texts are measured one by one. The distribution of each ratio goes into a
quantile sketch for every language and source: a count for each bucket of the
logarithm, by which any quantile is known to a fixed relative error. Sketches
merge by adding counts, in any order, to those of a language and of all texts.
Thresholds read from them replace fixed cutoffs: a text is rejected that lies
far outside what is usual in its own source. A source's sketch holds some texts
of its language's distribution besides its own, and a language's some of all, so
a source of few texts goes by its language, and by itself the more it has. The verdicts come from a join of
measures and thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpointed, if_small, in_batches

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words of a window that is looked for again in its text.
WINDOW = 5
#: Relative error of a sketch's quantiles.
SKETCH_ERROR = 0.01
#: So many texts, at equal steps of its distribution, a language gives to the sketch of each of its sources, and all texts to that of each language.
PARENT_TEXTS = 50
#: The quantile from which limits are counted: junk moves them only where it is more than the rest, a quarter of a group.
UPPER = 0.75
#: How many times the distance from the median to the upper quantile a text may lie beyond that quantile.
DISTANCE = 8.0
#: By ratio, the least such distance, where texts hardly differ.
LEAST_SPREAD = {"symbols_per_word": 0.025, "dup_lines_per_line": 0.05, "repeats_per_word": 0.025, "chars_per_word": 1.0}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words that occurs twice or more in the list, its first place included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    key, base = ids, len(known)
    for k in range(1, window):
        last = ids[k:]
        key = key[: len(last)]
        if key.max() > (1 << 62) // base:  # numbers as small as can be, so that the next step is exact
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + last
    _, index, counts = np.unique(key, return_inverse=True, return_counts=True)
    change = np.zeros(n + 1, np.int64)
    again = np.flatnonzero(counts[index] > 1)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``; none of a null text. Lines without a word don't count."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    characters = len(text or "") - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), characters, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` of each row and the measures of its whole text, as longs."""
    docs = docs.select(*keys, F.col(text_col).alias("__text"))
    fields = [f for f in docs.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measures(x.as_py()) for x in b.column(b.num_columns - 1)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*(f.name for f in fields), *MEASURES])

    return in_batches(docs).mapInArrow(run, T.StructType([*fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def ratios() -> dict[str, Column]:
    """The ratios that thresholds adapt to."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines_per_line": per("n_dup_lines", "n_lines"),
        "repeats_per_word": per("n_repeat_words", "n_words"),
        "chars_per_word": per("word_chars", "n_words"),
    }


_BASE = math.log((1 + SKETCH_ERROR) / (1 - SKETCH_ERROR))


def sketch(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """Sketches of ``values`` for each group of ``by``: columns by, name, bucket and n. A value of 0 has the bucket null."""
    bucket = lambda v: F.when(v > 0, F.ceil(F.log(v) / _BASE)).cast("long")
    packed = F.array(*[F.struct(F.lit(name).alias("name"), bucket(v).alias("bucket")) for name, v in values.items()])
    return rows.select(*by, F.inline(packed)).groupBy(*by, "name", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up to the coarser groups of ``by``."""
    return sketches.groupBy(*by, "name", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """Quantiles of sketches: columns by, name, texts, and one for each of ``wanted``.

    A bucket's middle is within ``SKETCH_ERROR`` of all its values.
    """
    group = Window.partitionBy(*by, "name")
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.exp(F.col("bucket") * _BASE) * (2 / (1 + math.exp(_BASE))))
    rows = sketches.withColumn("upto", F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("texts", F.sum("n").over(group))
    return rows.groupBy(*by, "name").agg(
        F.max("texts").alias("texts"), *[F.min(F.when(F.col("upto") >= F.ceil(F.col("texts") * q), value)).alias(name) for name, q in wanted.items()]
    )


def steps(sketches: DataFrame, by: list[str], texts: int) -> DataFrame:
    """Sketches of ``texts`` texts each, which lie at equal steps of the given ones' distributions."""
    group = Window.partitionBy(*by, "name")
    upto, total = F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first())), F.sum("n").over(group)
    rows = sketches.withColumn("upto", upto).withColumn("total", total)
    step = lambda x: F.call_function("div", x * texts, F.col("total"))
    return rows.select(*by, "name", "bucket", (step(F.col("upto")) - step(F.col("upto") - F.col("n"))).alias("n")).filter("n > 0")


def added(sketches: DataFrame, by: list[str], parents: DataFrame, on: list[str]) -> DataFrame:
    """Sketches of the groups ``by``, each with the one of its parent added, whose group is ``on``."""
    parents = parents.select(*[F.col(c).alias(f"p_{c}") for c in (*on, "name")], "bucket", "n")
    same = F.col("name") == F.col("p_name")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    given = sketches.select(*by, "name").distinct().join(if_small(checkpointed(parents)), same).select(*by, "name", "bucket", "n")
    return merged(sketches.unionByName(given), by)


def thresholds(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: ``by`` with s_ before the names, and for each ratio the value beyond which a text is rejected."""
    spread = F.lit(0.0)
    for name, least in LEAST_SPREAD.items():
        spread = F.when(F.col("name") == name, least).otherwise(spread)
    limits = quantiles(sketches, by, {"middle": 0.5, "high": UPPER}).withColumn("limit", F.col("high") + DISTANCE * F.greatest(F.col("high") - F.col("middle"), spread))
    return limits.groupBy(*[F.col(c).alias(f"s_{c}") for c in by]).agg(*[F.max(F.when(F.col("name") == name, F.col("limit"))).alias(f"most_{name}") for name in LEAST_SPREAD])


def base_failed() -> Column:
    """True for fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", parent_texts: int = PARENT_TEXTS) -> DataFrame:
    """Every row of ``docs`` with its measures and the verdict.

    Columns: ``id_col``, the measures, base_failed and kept. Rows that fail the
    base rules are in no sketch. Every language and source has limits of its own:
    its sketch is of its own texts and ``parent_texts`` of its language's, whose
    sketch likewise has as many of all. A value equal to its limit is kept. A null language or
    source is a group of its own; a null text has no words and fails. Texts of
    any length are measured whole, repeated rows count each, an empty table
    gives an empty table.
    """
    rows = checkpointed(measured(docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), ["id", "lang", "source"]))
    values = ratios()
    own = checkpointed(sketch(rows.filter(~base_failed()), ["lang", "source"], values))
    # sketches meet in the small tables of groups; rows then need one join
    tongues = added(merged(own, ["lang"]), ["lang"], steps(merged(own, []), [], parent_texts), [])
    groups = thresholds(added(own, ["lang", "source"], steps(tongues, ["lang"], parent_texts), ["lang"]), ["lang", "source"])
    groups = if_small(checkpointed(groups))
    out = rows.withColumn("base_failed", base_failed()).join(groups, F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")), "left")
    verdict = ~F.col("base_failed")
    for name, value in values.items():
        verdict = verdict & ~F.coalesce(value > F.col(f"most_{name}"), F.lit(False))
    return out.select(F.col("id").alias(id_col), *MEASURES, "base_failed", verdict.alias("kept"))
