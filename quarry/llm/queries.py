"""The registered queries of this subpackage, each one operator over its whole table.

What each does with nulls, empty and long texts, ties, repeated rows and empty
tables is what its operator's docstring says; columns beyond those read don't matter.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, exactdedup, html, langid, linededup, mixing, quality, sharding, simhash, suffixes, toxicity, tries, upsert
from quarry.llm.common import held_out, shared_folder, table
from quarry.llm.oracle import ORACLE_SQL  # noqa: F401


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id",
        sharding.text_size(F.col("text")).alias("size"),
        sharding.text_crc(F.col("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.occurrences(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.classes(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, changes = table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes")
    crc = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")))
    max_rows = 1 + clients.count() // 1000
    folder = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    upsert.write_files(clients.filter("client_id is not null").filter(crc("client_id") % 7 > 3), folder, "client_id", max_rows)

    def action(low):
        h = F.crc32(low.cast("string")) % 16
        deletes = F.coalesce(F.col("op") == "D", F.lit(False)) | (crc("change_id") % 8 < h)
        return F.when(h > 7, F.lit(None)).when(deletes, "D").otherwise("S")

    sets = ["source", "segment", "city", "balance"]
    upsert.apply_changes(spark, folder, clients.schema, upsert.newest(changes, "client_id", ["seq", "change_id"]), "client_id", max_rows, sets, action)
    rows = upsert.upserted(spark, folder, clients.schema)
    text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")])
    rows = rows.withColumn("cents", F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0)).cast("long")).withColumn("rows_crc", F.crc32(text))
    found = upsert.file_digests(rows, "client_id", ["cents", "rows_crc"])
    return found.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(clients.columns)).alias("columns"), "path", "rewritten")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_langid, op3_linededup, op4_mixing, op5_bpe, op6_exact_dedup, op7_toxicity, op8_simhash, op9_quality, op10_html, op11_conversation_trie, op12_upsert, op13_suffix_dedup)}
