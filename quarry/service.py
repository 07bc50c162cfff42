"""The engine as its callers see it: indexes, searches, facets and lookups, with checked requests."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.errors import InvalidQuery, NotFound, UnknownIndex
from quarry.operators import lookup, paging
from quarry.plans import compiler
from quarry.plans.compiler import Corpus
from quarry.plans.query import FacetQuery, FilterQuery
from quarry.sources.catalog import Catalog


#: Rows of a page (id and score) that are sent to all executors at most; larger ones meet their blocks in a shuffled join.
MAX_SENT_PAGE = 100_000


@dataclass
class ResultList:
    """A page of results, how many there are in all, and the cursor behind the page."""

    values: list[Row]
    count: int
    next_cursor: str


def timed(f):
    """Notes in ``last_ms`` how long a request took."""

    @wraps(f)
    def run(self, *args, **kwargs):
        began = time.perf_counter()
        try:
            return f(self, *args, **kwargs)
        finally:
            self.last_ms = round((time.perf_counter() - began) * 1000)

    return run


def _id(id_: str) -> str:
    if id_ is None or not str(id_).strip():
        raise InvalidQuery("a blank id")
    return id_


class Engine:
    """Answers requests on the indexes of a catalog, or on corpora given by name."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, corpora: dict[str, Corpus] | None = None, synonyms: dict[str, str] | None = None):
        self.spark, self.catalog, self.corpora, self.synonyms, self.last_ms = spark, catalog, dict(corpora or {}), synonyms or {}, None

    def corpus(self, index: str) -> Corpus:
        if index in self.corpora:
            return self.corpora[index]
        if self.catalog is None or not self.catalog.exists(index):
            raise UnknownIndex(index)
        return self.catalog.corpus(index, self.synonyms)

    @timed
    def list_indexes(self) -> list[str]:
        from quarry.sources.catalog import default_first

        return default_first([*self.corpora, *(self.catalog.names() if self.catalog else [])])

    def _page(self, rows: DataFrame, q: FilterQuery) -> tuple[DataFrame, int]:
        """Id and score of a page's rows, and the number of all; the search itself runs once for both."""
        if q.page_size < 0:
            raise InvalidQuery(f"a page of {q.page_size}")
        if q.cursor is not None and not q.cursor.strip():
            raise InvalidQuery("a blank cursor")
        hits = rows.select("id", "score").persist()
        try:
            page, count = paging.page(hits, q.page_size, q.cursor).collect(), hits.count()
        finally:
            hits.unpersist()
        page = self.spark.createDataFrame(page, hits.schema)
        return F.broadcast(page) if q.page_size <= MAX_SENT_PAGE else page, count

    @timed
    def search(self, index: str, q: FilterQuery) -> ResultList:
        """Blocks by rank, each with all its entities in short."""
        corpus = self.corpus(index)
        page, count = self._page(compiler.blocks(corpus, q.filters), q)
        page = corpus.blocks.join(page, "id")  # wide columns of this page's blocks alone
        short = [c for c in ("id", "kind", "name") if c in corpus.entities.columns]
        nested = compiler.with_children(Corpus(corpus.blocks, corpus.entities.select("block_id", *short)), page)
        rows = nested.orderBy(F.desc("score"), "id").collect()
        return ResultList(rows, count, paging.next_cursor(rows, q.cursor))

    @timed
    def search_documents(self, index: str, q: FilterQuery) -> ResultList:
        """Blocks and entities by rank, each by its own fields."""
        corpus = self.corpus(index)
        page, count = self._page(compiler.documents(corpus, q.filters), q)
        rows = corpus.documents().join(page, "id").orderBy(F.desc("score"), "id").collect()
        return ResultList(rows, count, paging.next_cursor(rows, q.cursor))

    @timed
    def facet(self, index: str, q: FacetQuery) -> dict[str, dict[str, int]]:
        """Counts by field and value; fields with too many values are left out, those with none are empty."""
        corpus = self.corpus(index)
        if q.max_facets < 1:
            raise InvalidQuery(f"{q.max_facets} facets")
        if not q.fields:
            return {}
        counts = compiler.facet_counts(corpus, q.filters, tuple(q.fields)).persist()
        try:
            sizes = {r.field: r.n for r in counts.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
            out: dict[str, dict[str, int]] = {n: {} for n in q.fields if sizes.get(n, 0) < q.max_facets}
            for r in counts.filter(F.col("field").isin(*out)).collect() if out else []:
                out[r.field][r.value] = r["count"]
        finally:
            counts.unpersist()
        return out

    def _one(self, rows: list[Row], id_: str) -> Row:
        if len(rows) != 1:
            raise NotFound(str(id_))
        return rows[0]

    @timed
    def get_block(self, index: str, id_: str) -> Row:
        """The block with an id, or the one around an entity with it, with all its entities."""
        corpus = self.corpus(index)
        return self._one(compiler.with_children(corpus, lookup.block_of(corpus, _id(id_))).collect(), id_)

    @timed
    def get_short_block(self, index: str, id_: str) -> Row:
        """The same with its entities in short."""
        corpus = self.corpus(index)
        slim = Corpus(corpus.blocks, corpus.entities.select("id", "block_id", "kind", "name"))
        return self._one(compiler.with_children(slim, lookup.block_of(slim, _id(id_))).collect(), id_)

    @timed
    def get_resolved(self, index: str, id_: str) -> Row:
        """An entity with what it uses in short."""
        corpus = self.corpus(index)
        return self._one(lookup.resolved(corpus, corpus.entities.filter(F.col("id") == F.lit(_id(id_)))).limit(2).collect(), id_)
