"""Dumps: nested folders of markup, a folder for each theory, as ordered spans of text.

A markup file is a sequence of XML elements and texts. Each outermost one is a
span; what is marked within it doesn't matter. Files are read in pieces that
end before each ``<``, so Spark splits large ones, and no file is ever held as
one text; nesting is a running sum over the pieces of a theory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.analysis import references_decoded

#: A tag behind its ``<``: whether it closes, what it holds, whether it is empty.
_TAG = r"""(?s)^(/?)((?:[^>"'/]++|"[^"]*+"|'[^']*+'|/(?!>))*+)(/?)>"""
#: A symbol by name (fixed values of the exported texts).
SYMBOL = r"\\<\^?[A-Za-z][A-Za-z0-9_']*>"


def symbols_of(rules: DataFrame) -> dict[str, str]:
    """Symbols by name from the rules of a table of symbols (``symbol_synonyms``), which is a part of a configuration and small by nature."""
    return {r.word: r.replacement for r in rules.filter(F.col("word").rlike(f"^{SYMBOL}$")).toLocalIterator()}


def decoded(text: Column, symbols: dict[str, str]) -> Column:
    """``text`` with the characters of its symbols; those that the table doesn't have stay as they are."""
    if not symbols:
        return text
    known = F.create_map(*[F.lit(x) for pair in sorted(symbols.items()) for x in pair])
    pieces = F.regexp_extract_all(text, F.lit(rf"{SYMBOL}|\\|[^\\]++"), F.lit(0))
    joined = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("\\<"), F.coalesce(F.try_element_at(known, p), p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("\\<")), joined).otherwise(text)


def symbol_length(text: Column) -> Column:
    """Length in symbols, as exported positions count: a symbol by name is one, as is any other character."""
    return F.char_length(F.regexp_replace(text, SYMBOL, "x"))


def escaped(text: Column) -> Column:
    """``text`` as HTML holds it."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def session_of(folder: Column, chosen: list[str] | None) -> Column:
    """The session of a theory's folder: the longest chosen one that it is or lies below, null if none; its first dotted part if none are named."""
    if chosen is None:
        return F.split(folder, r"\.")[0]
    out = F.lit(None).cast("string")
    for s in sorted(chosen, key=len):
        out = F.when((folder == s) | folder.startswith(f"{s}."), F.lit(s)).otherwise(out)
    return out


def read_markup(spark: SparkSession, root: str, symbols: dict[str, str] | None = None, chosen: list[str] | None = None, files: str = "markup.xml", theory_folder: str = "([^/]+)/") -> DataFrame:
    """Spans of the theories below ``root``: session, theory, n (ascending within a theory, with gaps) and text, character references and symbols decoded.

    A theory is a folder right below ``root``, at any depth of which its
    markup lies in files of the name ``files``; ``theory_folder`` takes its name
    from the path behind ``root``. ``chosen`` names the sessions that are read,
    all if None. Elements without text give no span; comments (without a
    ``<``) and instructions count as nothing; sections of unparsed text aren't part of the format. An
    empty file, or a folder without such files, gives nothing. A theory's
    pieces are sorted in one task, which spills; a span is one text.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    plain = lambda path: F.regexp_replace(path, "^file:/+", "/")
    read = spark.read.option("lineSep", "<").option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(root)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = read.select("value", plain(path).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece"))
    theory = F.regexp_extract(F.substr("path", F.char_length(plain(F.lit(base))) + 2), f"^{theory_folder}", 1)
    rows = rows.withColumn("theory", theory).withColumn("session", session_of(theory, chosen)).filter("session is not null")

    order = Window.partitionBy("session", "theory").orderBy("path", "block", "piece")
    # the piece before a file's first < has no tag; a task may read several files, so only the order tells which it is
    rows = rows.withColumn("is_tag", F.coalesce(F.lag("path").over(order) == F.col("path"), F.lit(False)))
    is_tag = F.col("is_tag")
    closes, empty = (F.regexp_extract("value", _TAG, k) for k in (1, 3))
    counts = is_tag & ~F.col("value").rlike("^[!?]")
    step = F.when(~counts | (empty == "/"), 0).when(closes == "/", -1).otherwise(1)
    text = F.when(~is_tag, F.col("value")).when(F.startswith("value", F.lit("!--")), F.regexp_replace("value", "(?s)^.*?-->", "")).when(~counts, F.regexp_replace("value", "^[^>]*>", "")).otherwise(F.regexp_replace("value", _TAG, ""))
    pieces = rows.select("session", "theory", "path", "block", "piece", step.alias("step"), text.alias("text"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.sum("step").over(so_far)
    begun = ((F.col("depth") == 1) & (F.col("step") == 1)) | ((F.col("depth") == 0) & (F.col("text") != ""))
    placed = pieces.withColumn("depth", depth).withColumn("n", F.sum(F.when(begun, 1).otherwise(0)).over(so_far).cast("int"))
    spans = placed.filter("text <> ''").groupBy("session", "theory", "n").agg(F.array_sort(F.collect_list(F.struct("path", "block", "piece", "text"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return spans.select("session", "theory", "n", decoded(references_decoded(whole), symbols or {}).alias("text"))
