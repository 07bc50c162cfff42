"""Indexes: named pairs of Parquet tables below a root folder, in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.errors import UnknownIndex
from quarry.plans import terms
from quarry.plans.compiler import Corpus
from quarry.plans.terms import TextIndex
from quarry.sources import shards

BLOCKS = "id string, theory string, theory_facet string, start_line int, command string, src_before string, src string, src_after string"
ENTITIES = "id string, block_id string, kind string, name string, name_facet string, type string, type_facet string, uses array<string>, theory string"
POSTINGS = "column string, token string, id string, theory string, positions array<int>, length int, bucket int"
LENGTHS = "column string, theory string, docs bigint, total bigint"
GRAMS = "column string, gram string, token string"


#: Text columns of each table with their analyses, which get stored indexes.
TEXTS = {"blocks": {"src": "source_text", "theory": "name_text"}, "entities": {"name": "name_text", "type": "type_text"}}


class Catalog:
    """Creates, lists, writes and opens the indexes below ``root``.

    An index is a row of versions. Each write adds files of its theories under
    its own number to the tables blocks, entities and those of their stored
    indexes, then a manifest that says for every theory of the index which
    version holds it, and last a mark, made at once, that the version is whole. A
    reader takes the last marked version and sees all tables as that one left
    them, whatever is written meanwhile; a write that fails leaves no trace but
    files that no manifest names. A write costs what its theories hold, and a row
    a theory for the manifest.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def create(self, name: str) -> bool:
        """True if the index is new."""
        if self.exists(name):
            return False
        path, fs = self._path(name, "_versions")
        fs.mkdirs(path)
        return True

    def names(self) -> list[str]:
        path, fs = self._path()
        found = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
        return default_first(found)

    def version(self, name: str) -> int:
        """The last version that is whole, 0 for a new index."""
        if not self.exists(name):
            raise UnknownIndex(name)
        path, fs = self._path(name, "_versions")
        return max([0, *(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())])

    def _read(self, name: str, table: str, schema: str, version: int) -> DataFrame:
        """A table as a version has it: rows of each theory from the version that the manifest names."""
        path, fs = self._path(name, table)
        if not version or not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, version int").parquet(f"{self.root}/{name}/{table}").filter(F.col("version") <= version)
        return rows.join(self.manifest(name, version), ["theory", "version"], "left_semi").select([c.split(" ")[0] for c in schema.split(", ")])

    def manifest(self, name: str, version: int) -> DataFrame:
        """For each theory of a version the one whose files hold it: columns theory and version."""
        if not version:
            return self.spark.createDataFrame([], "theory string, version int")
        return self.spark.read.schema("theory string, version int").parquet(f"{self.root}/{name}/manifests/{version}")

    def table(self, name: str, table: str, version: int | None = None) -> DataFrame:
        """Blocks or entities of a version, of the last one if none is given."""
        return self._read(name, table, BLOCKS if table == "blocks" else ENTITIES, self.version(name) if version is None else version)

    def terms(self, name: str, table: str, version: int | None = None) -> TextIndex:
        """The stored index of a table's texts. Grams may name tokens that have gone; postings decide."""
        version = self.version(name) if version is None else version
        postings = self._read(name, f"{table}_postings", POSTINGS, version)
        lengths = self._read(name, f"{table}_lengths", LENGTHS, version)
        path, fs = self._path(name, f"{table}_grams")
        grams = self.spark.read.schema(f"{GRAMS}, version int").parquet(f"{self.root}/{name}/{table}_grams") if version and fs.exists(path) else self.spark.createDataFrame([], f"{GRAMS}, version int")
        return TextIndex(postings, grams.filter(F.col("version") <= version).drop("version"), lengths)

    def corpus(self, name: str, synonyms: dict[str, str] | None = None, version: int | None = None) -> Corpus:
        """An index as of one version, with the stored indexes of its texts."""
        version = self.version(name) if version is None else version
        at = self._dealt(name, version)
        if version and shards.number(self.spark, at) is not None:
            blocks, entities = shards.read(self.spark, at)
        else:
            blocks, entities = self.table(name, "blocks", version), self.table(name, "entities", version)
        return Corpus(blocks, entities, synonyms or {}, self.terms(name, "blocks", version), self.terms(name, "entities", version))

    def _dealt(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/dealt/{version}"

    def deal(self, name: str, number: int | None = None) -> int:
        """Deals the last version's blocks and entities into shards by block id, which searches of that version then read without a shuffle.

        Gives the number of shards: ``number``, or one for each 256 MB of
        files. A version that is dealt already stays; so do later versions
        until they are dealt themselves. An empty index has one shard.
        """
        version = self.version(name)
        at = self._dealt(name, version)
        made = shards.number(self.spark, at)
        if made is not None:
            return made
        number = number or shards.number_for(self.spark, [f"{self.root}/{name}/{t}" for t in ("blocks", "entities")])
        shards.forget(self.spark, at)  # what a failed call left
        shards.write(self.table(name, "blocks", version), self.table(name, "entities", version), at, number)
        return number

    def write(self, name: str, blocks: DataFrame, entities: DataFrame) -> int:
        """Replaces the theories that ``blocks`` holds, all tables at once, and returns the version; writing nothing changes nothing.

        Entities belong to the theory of their block; those of other blocks are
        left out. Columns that an index doesn't have are dropped.
        """
        theories = blocks.select("theory").distinct()
        return self._commit(name, blocks, entities, theories)

    def _commit(self, name: str, blocks: DataFrame, entities: DataFrame, replaced: DataFrame) -> int:
        """A version with ``blocks`` and their ``entities`` in place of the theories ``replaced``."""
        before = self.version(name)
        number = 1 + max([before, *self._numbers(name)])
        entities = entities.drop("theory").join(blocks.select(F.col("id").alias("block_id"), "theory"), "block_id")
        for rows, table, schema in ((blocks, "blocks", BLOCKS), (entities, "entities", ENTITIES)):
            names = [c.split(" ")[0] for c in schema.split(", ")]
            missing = {c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in schema.split(", ") if c.split(" ")[0] not in rows.columns}
            at = f"{self.root}/{name}/{table}/version={number}"
            rows.withColumns(missing).select(names).write.partitionBy("theory").parquet(at)
            stored = self.spark.read.schema(schema).parquet(at)
            postings, lengths = terms.postings_of(stored.withColumn("__theory", F.col("theory")), TEXTS[table], ("__theory",)), terms.lengths_of(stored.withColumn("__theory", F.col("theory")), TEXTS[table], ("__theory",))
            terms.write_parts(postings.withColumnRenamed("__theory", "theory"), lengths.withColumnRenamed("__theory", "theory"), lambda part, at=f"{self.root}/{name}/{table}": f"{at}_{part}/version={number}")
        now = self.spark.read.schema(BLOCKS).parquet(f"{self.root}/{name}/blocks/version={number}").select("theory").distinct().withColumn("version", F.lit(number))
        kept = self.manifest(name, before).join(replaced.select("theory").distinct(), "theory", "left_anti")
        kept.unionByName(now).coalesce(1).write.parquet(f"{self.root}/{name}/manifests/{number}")
        path, fs = self._path(name, "_versions", str(number))
        fs.create(path, False).close()  # fails if another writer took the number
        return number

    def _numbers(self, name: str) -> list[int]:
        """Versions that were begun, whole or not."""
        path, fs = self._path(name, "blocks")
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [int(n.removeprefix("version=")) for n in found if n.startswith("version=")]

    def delete(self, name: str, where: Column) -> int:
        """Removes the blocks that match and their entities: a version in which the theories that lose any are written anew."""
        corpus = self.corpus(name)
        touched = corpus.blocks.filter(where).select("theory").distinct()
        kept = corpus.blocks.join(touched, "theory", "left_semi").filter(~F.coalesce(where, F.lit(False)))
        return self._commit(name, kept, corpus.entities, touched)

    def vacuum(self, name: str) -> None:
        """Removes the files of versions that the last one doesn't name; earlier versions can't be read afterwards."""
        last = self.version(name)
        needed = {r.version for r in self.manifest(name, last).select("version").distinct().collect()}  # one row a version
        for table in ("blocks", "entities"):
            for part in (table, f"{table}_postings", f"{table}_lengths"):
                path, fs = self._path(name, part)
                for s in fs.listStatus(path) if fs.exists(path) else []:
                    number = s.getPath().getName().removeprefix("version=")
                    if number.isdigit() and int(number) not in needed and int(number) <= last:
                        fs.delete(s.getPath(), True)
        path, fs = self._path(name, "dealt")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if int(s.getPath().getName()) < last:
                shards.forget(self.spark, self._dealt(name, int(s.getPath().getName())))


def default_first(names: list[str]) -> list[str]:
    """The first name that contains "default" moves to the front."""
    at = next((i for i, n in enumerate(names) if "default" in n), None)
    return names if at is None else [names[at], *names[:at], *names[at + 1 :]]


def default_first_table(names: DataFrame, name: str = "name", order: str = "ordinal") -> DataFrame:
    """The same for a table of names in order: adds rank, from 1."""
    has = F.col(name).contains("default")
    everything = Window.partitionBy(F.lit(0))
    first = F.min(F.when(has, F.col(order))).over(everything)
    rank = F.row_number().over(Window.orderBy(F.when(F.col(order) == F.col("__first"), 0).otherwise(1), order))
    return names.withColumn("__first", first).withColumn("rank", rank).drop("__first")


def name_parts(name: Column) -> Column:
    """A name of three parts joined by _ as struct (name, release, archive); another is all name."""
    p = F.split(name, "_")
    three = F.size(p) == 3
    return F.struct(F.when(three, p[0]).otherwise(name).alias("name"), F.when(three, p[1]).alias("release"), F.when(three, p[2]).alias("archive"))


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Of rows that share a key the one with the highest version: what an upsert leaves. Ties fall to any one of equal rows."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("r"))
    return newest.select("r.*")


def upsert(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those that share their key."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


# dumps


def sessions(dirs: DataFrame, column: str = "dir") -> DataFrame:
    """All sessions of a dump: the first dotted part of its folders' names."""
    return dirs.select(F.split(column, r"\.")[0].alias("session")).distinct()


def of_sessions(dirs: DataFrame, chosen: list[str], column: str = "dir") -> DataFrame:
    """Folders that are a chosen session or lie below one."""
    hit = F.lit(False)
    for s in chosen:
        hit = hit | (F.col(column) == s) | F.col(column).startswith(f"{s}.")
    return dirs.filter(hit)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Spans of an exported dump, JSON lines of session, theory, n and text."""
    return spark.read.schema("session string, theory string, n int, text string").json(path)


def read_build(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """The same from a build database, over JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select("session", "theory", "n", "text")


def symbol_synonyms(lines: DataFrame, column: str = "value") -> DataFrame:
    """Synonyms from a table of symbols, lines of ``\\<name> code: 0xHEX ... abbrev: X``: columns word and replacement.

    An abbreviation counts if it occurs once in the whole file and a query's
    tokens can hold it.
    """
    # fixed values: the shape of a line, of an abbreviation, and what a query's token can't hold
    shape = r"^(\\<[^\s]*>)\s*code: 0x([0-9a-fA-F]*) .*"
    line = F.col(column)
    hexes = F.conv(F.regexp_extract(line, shape, 2), 16, 10).cast("int")
    utf32 = F.unhex(F.lpad(F.hex(hexes), 8, "0"))
    rows = lines.select(line.alias("line"), F.regexp_extract(line, shape, 1).alias("name"), F.decode(utf32, "UTF-32").alias("replacement"), F.regexp_extract_all(line, F.lit(r"abbrev: ([^\s]+)"), F.lit(1)).alias("abbrevs"))
    once = rows.select(F.explode("abbrevs").alias("word")).groupBy("word").count().filter("count = 1").select("word")
    symbols = rows.filter("name <> ''")
    short = symbols.select(F.explode("abbrevs").alias("word"), "replacement").join(once, "word", "left_semi").filter(~F.col("word").rlike(r"[(){}\[\].,:\"]|=>"))
    return symbols.select(F.col("name").alias("word"), "replacement").unionByName(short)


def read_synonyms(spark: SparkSession, path: str) -> dict[str, str]:
    """Rules ``a,b => c`` of a file, one a line, as a table of words; a file of rules is small by nature."""
    out: dict[str, str] = {}
    for r in spark.read.text(path).filter(F.col("value").contains("=>") & ~F.col("value").startswith("#")).toLocalIterator():
        words, _, target = r.value.partition(" => ")
        for w in words.split(","):
            out[w.strip().replace("\\\\", "\\")] = target.strip()
    return out
