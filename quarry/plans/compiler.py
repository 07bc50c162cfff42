"""From the query language to DataFrame plans.

A corpus is two tables: blocks, and the entities that lie in them. Filters on
the fields of blocks and of entities are routed to their side; a block matches
if one of its entities satisfies all filters of entities at once, which is a
semi join. Filters become column expressions, inner queries become joins of the
same plan, and nothing is collected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as default
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import InvalidQuery
from quarry.functions.analysis import index_length, index_positions, may_hold, query_tokens
from quarry.plans.terms import B, K1, TextIndex
from quarry.plans.query import FIELDS, And, Exact, Field, FieldFilter, Filter, InRange, InResult, Not, Or, Term, field

#: How far apart the tokens of an exact match in a text may lie.
SLOP = 10
#: Documents of an inner query whose values count.
INNER_LIMIT = 1_000


@dataclass(frozen=True)
class Corpus:
    """Tables of blocks and entities, synonyms for queries of source code, and stored indexes of their texts.

    ``blocks`` has id; ``entities`` has id and block_id; other fields' columns
    may be missing, and then hold nothing. Ids are unique. Without an index
    of theirs, texts are analysed where a filter asks for them.
    """

    blocks: DataFrame
    entities: DataFrame
    synonyms: dict[str, str] = default(default_factory=dict)
    block_terms: TextIndex | None = None
    entity_terms: TextIndex | None = None

    def documents(self) -> DataFrame:
        """Blocks and entities in one table, told apart by doc_kind."""
        return self.blocks.withColumn("doc_kind", F.lit("Parent")).unionByName(self.entities.withColumn("doc_kind", F.lit("Child")), allowMissingColumns=True)


def route(filters: tuple[FieldFilter, ...]) -> tuple[list[FieldFilter], list[FieldFilter]]:
    """Filters of blocks and filters of entities; a field that both have counts as one of blocks."""
    parent = [f for f in filters if field(f.field).parent]
    return parent, [f for f in filters if not field(f.field).parent]


def glob_pattern(s: str) -> str:
    """An anchored regular expression for a value with ``*`` and ``?``."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^0-9A-Za-z\s_])", r"\\\1", c) if ord(c) < 128 else c for c in s) + "$"


def _wild(s: str) -> bool:
    return "*" in s or "?" in s


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def phrase(positions: Column, tokens: Column, slop: int = SLOP) -> Column:
    """True if all tokens occur, in places that differ from their order in the query by ``slop`` at most in total.

    With p_i the place of the i-th token, max(p_i - i) - min(p_i - i) is at most
    ``slop``; the smallest is tried from every place.
    """
    shifts = let(
        F.transform(positions, lambda forms, k: F.struct(forms.alias("forms"), k.alias("k"))),
        lambda numbered: F.transform(tokens, lambda t, i: F.transform(F.filter(numbered, lambda p: F.array_contains(p["forms"], t)), lambda p: p["k"] - i)),
    )

    def close(shifts: Column) -> Column:
        near = lambda low: F.forall(shifts, lambda own: F.exists(own, lambda s: (s >= low) & (s <= low + slop)))
        return F.forall(shifts, lambda own: F.size(own) > 0) & F.exists(F.array_distinct(F.flatten(shifts)), near)

    return (F.size(tokens) > 0) & let(shifts, close)


class Compiler:
    """Compiles the filters of one table; inner queries and stored indexes add columns to it, which ``rows`` carries."""

    def __init__(self, corpus: Corpus, rows: DataFrame, terms: TextIndex | None = None):
        self.corpus, self.rows, self.added, self.terms = corpus, rows, [], terms

    def value(self, f: Field) -> Column:
        if f.kind == "children":
            raise InvalidQuery(f"{f.name} has no values to compare")
        return F.col(f.column) if f.column in self.rows.columns else F.lit(None).cast("array<string>" if f.kind == "strings" else "string")

    def positions(self, f: Field) -> Column:
        """The analysed text; a column of that name with ``_positions`` behind it stands for one made at import."""
        made = f"{f.column}_positions"
        return F.col(made) if made in self.rows.columns else index_positions(self.value(f), f.kind)

    def may_hold(self, f: Field, piece: Column) -> Column:
        """A cheap test that spares most texts their analysis."""
        return F.lit(True) if f"{f.column}_positions" in self.rows.columns else may_hold(self.value(f), f.kind, piece)

    def length(self, f: Field) -> Column:
        made = f"{f.column}_positions"
        return F.size(made) if made in self.rows.columns else index_length(self.value(f), f.kind)

    def _any(self, f: Field, test) -> Column:
        value = self.value(f)
        return F.exists(value, test) if f.kind == "strings" else test(value)

    def _same(self, f: Field, s: str):
        def test(v: Column) -> Column:
            if f.kind == "int":
                return v == F.expr(f"try_cast('{s}' as bigint)") if re.fullmatch(r"[+-]?\d{1,18}", s) else F.lit(False)
            return v == F.lit(s)

        return test

    def compile(self, f: Field, filter_: Filter) -> Column:
        """The condition as a column, null where the field has no value and nothing matches."""
        match filter_:
            case Term(inner) if f.is_text:
                if not inner.strip():
                    return F.lit(False)
                if self.terms is not None:
                    if _wild(inner):
                        return self._marked(self.terms.like(f.column, inner.lower(), glob_pattern))
                    found = self.query(f, inner)
                    return self._marked(self.terms.any_of(f.column, found)) if found else F.lit(False)
                positions = self.positions(f)
                if _wild(inner):  # one pattern, white space and all
                    piece = max(re.split(r"[*?]", inner.lower()), key=len)
                    return self.may_hold(f, F.lit(piece)) & F.exists(F.flatten(positions), lambda t: t.rlike(glob_pattern(inner.lower())))
                tokens = self._query(f, inner)
                return F.exists(tokens, lambda t: self.may_hold(f, t)) & F.arrays_overlap(F.flatten(positions), tokens)
            case Term(inner):
                if _wild(inner):
                    return self._any(f, lambda v: v.cast("string").rlike(glob_pattern(inner)))
                return self._any(f, self._same(f, inner))
            case Exact(inner) if f.is_text:
                if self.terms is not None:
                    found = self.query(f, inner)
                    return self._marked(self.terms.near(f.column, found, SLOP)) if found else F.lit(False)
                tokens = self._query(f, inner)
                return F.forall(tokens, lambda t: self.may_hold(f, t)) & phrase(self.positions(f), tokens)
            case Exact(inner):
                return self._any(f, self._same(f, inner))
            case InRange(from_, to):
                return self._any(f, lambda v: v.between(F.lit(from_), F.lit(to)))
            case Not(inner):
                value = self.value(f)
                exists = value.isNotNull() & (F.size(value) > 0) if f.kind == "strings" else value.isNotNull()
                return exists & ~F.coalesce(self.compile(f, inner), F.lit(False))
            case And(filters):
                return reduce(lambda a, b: a & b, [self.compile(f, x) for x in filters])
            case Or(filters):
                return reduce(lambda a, b: a | b, [F.coalesce(self.compile(f, x), F.lit(False)) for x in filters])
            case InResult():
                return self._in_result(f, filter_)
        raise InvalidQuery(f"not a filter: {filter_!r}")

    def _marked(self, ids: DataFrame) -> Column:
        """True for the rows with one of some distinct ids."""
        name = f"__in{len(self.added)}"
        self.added.append(name)
        ids = ids.select(F.col("id").alias(f"{name}_id"), F.lit(True).alias(name))
        self.rows = self.rows.join(ids, F.col("id") == F.col(f"{name}_id"), "left").drop(f"{name}_id")
        return F.coalesce(F.col(name), F.lit(False))

    def query(self, f: Field, s: str) -> list[str]:
        """Tokens of a query's own text; the optimiser works them out without a job."""
        one = self.rows.sparkSession.sql("SELECT 1 AS x")
        return one.select(query_tokens(F.lit(s), f.kind, self.corpus.synonyms).alias("t")).first().t

    def _query(self, f: Field, s: str) -> Column:
        tokens = self.query(f, s)
        return F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")

    def _in_result(self, f: Field, filter_: InResult) -> Column:
        values = inner_values(self.corpus, filter_)
        if f.is_text:
            tokens = values.select(F.explode(query_tokens(F.col("value").cast("string"), f.kind, self.corpus.synonyms)).alias("token")).distinct()
            if self.terms is not None:
                return self._marked(self.terms.with_any(f.column, tokens))
            held = self.rows.select("id", F.explode(F.flatten(self.positions(f))).alias("token"))
            return self._marked(held.join(tokens, "token", "left_semi").select("id").distinct())
        values = values.select(F.col("value").cast("string").alias("__value"))
        if f.kind == "strings":  # at most 1000 documents' values, met by each value of a row
            held = self.rows.select("id", F.explode(self.value(f).cast("array<string>")).alias("__value"))
            return self._marked(held.join(values, "__value", "left_semi").select("id").distinct())
        name = f"__in{len(self.added)}"
        self.added.append(name)
        values = values.select(F.col("__value").alias(f"{name}_value"), F.lit(True).alias(name))
        self.rows = self.rows.join(values, self.value(f).cast("string") == F.col(f"{name}_value"), "left").drop(f"{name}_value")
        return F.coalesce(F.col(name), F.lit(False))

    def all(self, filters: list[FieldFilter]) -> DataFrame:
        """The rows that match all filters, with the columns that the table had."""
        columns = self.rows.columns
        conditions = [self.compile(field(x.field), x.filter) for x in filters]
        rows = self.rows
        for c in conditions:
            rows = rows.filter(c)
        return rows.select(columns)


def matching(corpus: Corpus, rows: DataFrame, filters: list[FieldFilter], terms: TextIndex | None = None) -> DataFrame:
    return Compiler(corpus, rows, terms).all(filters)


def inner_values(corpus: Corpus, filter_: InResult) -> DataFrame:
    """Distinct values (column value) of a field in the first documents of an inner query, which sees blocks and entities alike.

    A field that every document must have raises an error where one lacks it.
    """
    of = field(filter_.of_field)
    if of.kind == "children":
        raise InvalidQuery("children can't be the field of an inner query")
    if not filter_.filters:
        raise InvalidQuery("an inner query needs a filter")
    top = documents(corpus, filter_.filters).orderBy(F.desc("score"), F.col("id").asc()).limit(INNER_LIMIT)
    if of.column not in top.columns:
        return top.limit(0).select(F.lit(None).cast("string").alias("value"))
    if of.kind == "strings":
        return top.select(F.explode(of.column).alias("value")).distinct()
    value = F.when(F.col(of.column).isNull(), F.raise_error(F.lit(f"a document of the inner query has no {of.name}"))).otherwise(F.col(of.column))
    return top.select(value.alias("value")).distinct()


# ranking


def _leaves(filter_: Filter) -> list[Filter]:
    match filter_:
        case And(filters) | Or(filters):
            return [x for f in filters for x in _leaves(f)]
    return [filter_]


def scored(corpus: Corpus, rows: DataFrame, everything: DataFrame, filter_: FieldFilter | None, terms: TextIndex | None = None) -> DataFrame:
    """``rows``, which match one filter, with a score for it, to 6 digits: BM25 on texts, 1 for each other part that matches.

    Numbers of documents, their lengths and how many hold a token come from
    the stored index, or else from ``everything``, as one row beside the plan.
    """
    if filter_ is None:
        return rows.withColumn("score", F.lit(1.0))
    f = field(filter_.field)
    compiler = Compiler(corpus, rows, terms)
    columns = rows.columns
    leaves = _leaves(filter_.filter)
    total = F.lit(0.0)
    own = Compiler(corpus, everything)
    for k, leaf in enumerate(leaves):
        plain = isinstance(leaf, (Term, Exact)) and f.is_text and not (isinstance(leaf, Term) and (_wild(leaf.inner) or not leaf.inner.strip()))
        # rows match the whole filter already, so only its parts are asked again
        matched_ = F.lit(True) if len(leaves) == 1 else F.coalesce(compiler.compile(f, leaf), F.lit(False))
        if not plain:
            total = total + F.when(matched_, 1.0).otherwise(0.0)
            continue
        tokens = list(dict.fromkeys(compiler.query(f, leaf.inner)))
        if terms is not None:
            gained = terms.gains(f.column, tokens).select(F.col("id").alias(f"__id{k}"), F.col("gain").alias(f"__gain{k}")) if tokens else None
            if gained is not None:
                compiler.rows = compiler.rows.join(gained, F.col("id") == F.col(f"__id{k}"), "left")
                total = total + F.when(matched_, F.coalesce(f"__gain{k}", F.lit(0.0))).otherwise(0.0)
            continue
        positions = own.positions(f)
        held = [F.sum((own.may_hold(f, F.lit(t)) & F.exists(positions, lambda p: F.array_contains(p, t))).cast("long")).alias(f"__df{k}_{i}") for i, t in enumerate(tokens)]  # noqa: B023
        stats = everything.filter(own.value(f).isNotNull()).agg(F.count(F.lit(1)).alias(f"__n{k}"), F.avg(own.length(f)).alias(f"__avg{k}"), *held)
        compiler.rows = compiler.rows.crossJoin(F.broadcast(stats))

        def gains(mine: Column) -> Column:
            n, out = F.col(f"__n{k}"), F.lit(0.0)  # noqa: B023
            norm = K1 * (1 - B + B * F.size(mine) / F.col(f"__avg{k}"))  # noqa: B023
            for i, t in enumerate(tokens):  # noqa: B023
                tf, df = F.size(F.filter(mine, lambda p: F.array_contains(p, t))), F.col(f"__df{k}_{i}")  # noqa: B023
                out = out + F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + norm)
            return out

        total = total + F.when(matched_, let(compiler.positions(f), gains)).otherwise(0.0)
    return compiler.rows.withColumn("score", F.round(total, 6)).select(*columns, "score")


def blocks(corpus: Corpus, filters: tuple[FieldFilter, ...]) -> DataFrame:
    """Blocks that match, with their score: that of the first filter of blocks plus the best entity's for the first filter of entities."""
    parent, child = route(filters)
    rows = matching(corpus, corpus.blocks, parent, corpus.block_terms)
    rows = scored(corpus, rows, corpus.blocks, parent[0] if parent else None, corpus.block_terms)
    if not child:
        return rows
    hits = scored(corpus, matching(corpus, corpus.entities, child, corpus.entity_terms), corpus.entities, child[0], corpus.entity_terms)
    best = hits.groupBy(F.col("block_id").alias("__block")).agg(F.max("score").alias("__best"))
    return rows.join(best, F.col("id") == F.col("__block")).withColumn("score", F.round(F.col("score") + F.col("__best"), 6)).drop("__block", "__best")


def documents(corpus: Corpus, filters: tuple[FieldFilter, ...]) -> DataFrame:
    """Blocks and entities that match, each by its own fields, with their score for the first filter."""
    both = corpus.documents()
    return scored(corpus, matching(corpus, both, list(filters)), both, filters[0] if filters else None)


def with_children(corpus: Corpus, page: DataFrame) -> DataFrame:
    """A page of blocks with all entities of each as an array, matched or not, in order of id."""
    own = [c for c in corpus.entities.columns if not c.endswith("_positions")]
    ids = page.select(F.col("id").alias("__page"))
    nested = corpus.entities.join(ids, F.col("block_id") == F.col("__page"), "left_semi")
    nested = nested.groupBy(F.col("block_id").alias("__block")).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("entities"))
    joined = page.join(nested, F.col("id") == F.col("__block"), "left").drop("__block")
    return joined.withColumn("entities", F.coalesce("entities", F.array().cast(joined.schema["entities"].dataType)))


# facets


def facet_counts(corpus: Corpus, filters: tuple[FieldFilter, ...], names: tuple[str, ...]) -> DataFrame:
    """Counts of blocks by value of several fields: columns field, value (string) and count. Each table is read once, whatever the number of fields.

    Filters on a column of the same name don't restrict a field, so that several
    of its values can be chosen. A field of entities counts each block once.
    Every row says by a bit a column which filters it fails, and counts for the
    fields whose own bit is all that is set; blocks and entities meet in a
    window by block, over distinct values only. A block with very many entities
    so has a row for each distinct value in one task, which spills.
    """
    names = tuple(dict.fromkeys(names))
    fields = [field(n) for n in names]
    for f in fields:
        if not f.facetable:
            raise InvalidQuery(f"{f.name} can't be counted")
    parent, child = route(filters)
    own = {f.column for f in fields}
    of_blocks = [(k, f) for k, f in enumerate(fields) if not f.child]
    of_entities = [(k, f) for k, f in enumerate(fields) if f.child]
    # a pair of a field's number and a value; -1 stands for the entity that a block needs, -2 for the block itself
    parts = []
    if of_entities or (of_blocks and child):
        rows, failed = _failed(corpus, corpus.entities, child, own, corpus.entity_terms)
        if "doc_kind" not in rows.columns:
            rows = rows.withColumn("doc_kind", F.lit("Child"))
        pairs = [_values(corpus, rows, k, f, failed(f.column)) for k, f in of_entities]
        if of_blocks and child:
            pairs.append(_mark(-1, failed(None)))
        parts.append(rows.select(F.col("block_id").alias("owner"), F.lit(None).cast("long").alias("failed"), F.inline(F.concat(*pairs))).distinct())
    if of_blocks or (of_entities and parent):
        rows, failed = _failed(corpus, corpus.blocks, parent, own, corpus.block_terms)
        pairs = [_values(corpus, rows, k, f, failed(f.column)) for k, f in of_blocks]
        if of_entities and parent:
            pairs.append(_mark(-2, F.lit(0)))
        parts.append(rows.select(F.col("id").alias("owner"), failed(None).alias("failed"), F.inline(F.concat(*pairs))).distinct())
    pairs = reduce(DataFrame.unionByName, parts) if parts else None
    if pairs is None:
        raise InvalidQuery("facets of no fields")
    if (of_blocks and child) or (of_entities and parent):
        whole = Window.partitionBy("owner")
        met = F.max(F.col("number") == -1).over(whole)
        block = F.max(F.when(F.col("number") == -2, F.col("failed"))).over(whole)
        pairs = pairs.withColumns({"__met": met, "__block": block})
        bits = _bits(parent, own)
        for k, f in of_entities:
            if any(field(x.field).column != f.column for x in parent):
                pairs = pairs.filter((F.col("number") != k) | F.coalesce(F.col("__block").bitwiseAND(~bits.get(f.column, 0)) == 0, F.lit(False)))
        if of_blocks and child:
            pairs = pairs.filter(~F.col("number").isin([k for k, _ in of_blocks]) | F.col("__met"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("number") + 1)
    counted = pairs.filter("number >= 0 AND value IS NOT NULL").groupBy("number", "value").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(name.alias("field"), "value", "count")


def _bits(filters: list[FieldFilter], own: set[str]) -> dict[str, int]:
    """A bit for each column that is filtered and also counted."""
    return {c: 1 << k for k, c in enumerate(dict.fromkeys(field(x.field).column for x in filters if field(x.field).column in own))}


def _failed(corpus: Corpus, rows: DataFrame, filters: list[FieldFilter], own: set[str], terms: TextIndex | None):
    """Rows that match the filters on columns that aren't counted, and the bits of the others that a row fails, as a function of a column whose bit doesn't matter."""
    bits = _bits(filters, own)
    rows = matching(corpus, rows, [x for x in filters if field(x.field).column not in bits], terms)
    compiler = Compiler(corpus, rows, terms)
    fails = F.lit(0).cast("long")
    for column, bit in bits.items():
        same = [F.coalesce(compiler.compile(field(x.field), x.filter), F.lit(False)) for x in filters if field(x.field).column == column]
        fails = fails + F.when(reduce(lambda a, b: a & b, same), 0).otherwise(bit)
    return compiler.rows.withColumn("__failed", fails), lambda column: F.col("__failed").bitwiseAND(~bits.get(column, 0))


def _values(corpus: Corpus, rows: DataFrame, number: int, f: Field, failed: Column) -> Column:
    """A row's distinct values of a field as pairs with its number, none where a filter of another column fails."""
    if f.is_text:  # its values are the tokens of the index
        values = F.array_distinct(F.flatten(Compiler(corpus, rows).positions(f)))
    else:
        values = F.array(F.col(f.column).cast("string") if f.column in rows.columns else F.lit(None).cast("string"))
    pairs = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(number).alias("number"), v.alias("value")))
    return F.when(failed == 0, F.filter(pairs, lambda p: p["value"].isNotNull())).otherwise(F.array().cast("array<struct<number:int,value:string>>"))


def _mark(number: int, failed: Column) -> Column:
    one = F.array(F.struct(F.lit(number).alias("number"), F.lit(None).cast("string").alias("value")))
    return F.when(failed == 0, one).otherwise(F.array().cast("array<struct<number:int,value:string>>"))


def few(counts: DataFrame, max_facets: int) -> DataFrame:
    """The counts of the fields with fewer than ``max_facets`` values, the others give nothing. Both uses of ``counts`` read the same shuffle."""
    sizes = counts.groupBy("field").agg(F.count(F.lit(1)).alias("__n"), F.max("count").alias("__most"), F.max(F.char_length("value")).alias("__longest"))
    sizes = sizes.filter((F.col("__n") < max_facets) & (F.col("__most") > 0) & (F.col("__longest") >= 0)).select("field")
    return counts.join(F.broadcast(sizes), "field", "left_semi")  # one row a field


def facet(corpus: Corpus, filters: tuple[FieldFilter, ...], name: str, max_facets: int = 100) -> DataFrame:
    """``facet_counts`` of one field; one with ``max_facets`` values or more gives nothing."""
    return facets(corpus, filters, (name,), max_facets)


def facets(corpus: Corpus, filters: tuple[FieldFilter, ...], names: tuple[str, ...], max_facets: int = 100) -> DataFrame | None:
    """Facets of several fields as one table, None for no fields."""
    if max_facets < 0:
        raise InvalidQuery(f"{max_facets} facets")
    return few(facet_counts(corpus, filters, names), max_facets) if names else None


def facets_with_selection(counts: DataFrame, selected: DataFrame) -> DataFrame:
    """Counts joined with what a user has chosen (field, value): a chosen value without count has 0."""
    both = counts.join(selected.withColumn("selected", F.lit(True)), ["field", "value"], "full")
    return both.select("field", "value", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("selected", F.lit(False)).alias("selected"))


__all__ = ["FIELDS", "Compiler", "Corpus", "blocks", "documents", "facet", "facet_counts", "facets", "facets_with_selection", "few", "glob_pattern", "inner_values", "matching", "phrase", "route", "scored", "with_children"]
