"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Lines are compared without white space at their ends. Equal lines form one
class at once. Two different lines are linked if so few edits (insertions, deletions,
substitutions of a code point) turn one into the other as the shorter allows: one
for every ``EDIT_CHARS`` of its code points, ``THRESHOLD`` at most. Lines too
short for an edit are only compared for equality. A line is cut into one segment
more than it allows edits, so a linked longer line holds one of them unchanged,
and not far from its place. Segments are indexed by length of the line, number
and content; a line probes the index with those of its substrings that can match,
for its own length and for each length that is less by what edits allow.

Candidates are emitted once, and must nearly agree in the letters' counts, modulo
four, before they are, and in the counts themselves before their texts are read. What is left of two lines between their first and last difference is
checked by a banded bit-parallel edit distance, which stops where its registers
run empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, if_small
from quarry.llm.components import components

THRESHOLD = 2
#: So many code points of the shorter line allow an edit; two edits on a word of three letters would link words that have nothing in common.
EDIT_CHARS = 10
#: Characters whose counts a pair of lines must nearly share before its edit distance is computed.
COUNTED_CHARS = " etaoinshrdlucmfwypvbgkjqxz0123456789.,-"
#: Lines that are indexed by one key in one place; where there are more, they are dealt out and what looks them up goes to all of these places.
DEALT = 512
#: Columns after which an edit distance may stop.
BLOCK = 32


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(17), line).alias("k2")]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line with a word: doc_id, at (from 0), line (trimmed) and its key of 128 bits, k1 and k2. A null text has none."""
    split = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "line"))
    split = split.withColumn("line", F.btrim("line", F.lit(" \t\x0b\x0c\r"))).filter("line <> ''")
    return split.select("doc_id", "at", "line", *_keys(F.col("line")))


def _moves(threshold: int) -> list[tuple[int, int, int]]:
    """What a line looks up: for lines so much shorter, the segment of that number, moved by so much.

    A segment's place may have moved by the edits before it, of which there are
    at most as many as segments before it, or else by the edits behind it.
    """
    return [
        (shorter, i, moved)
        for shorter in range(threshold + 1)
        for i in range(threshold + 1)
        for moved in range(max(-i, shorter - (threshold - i)), min(i, shorter + threshold - i) + 1)
    ]


def _places(length: Column, shorter: Column, i: Column, moved: Column, threshold: int) -> tuple[Column, Column, Column]:
    """Where a line of ``length`` looks for the segment ``i`` of a line so much shorter: from (from 1), size, and whether that lies in the line.

    A segment's size is the length divided by their number; the last ones are one longer where that leaves a rest.
    """
    parts = threshold + 1
    other = length - shorter
    base, plain = F.call_function("div", other, F.lit(parts)).cast("int"), parts - F.pmod(other, F.lit(parts))
    at = base * i + F.greatest(i - plain, F.lit(0)) + moved + 1
    size = base + (i >= plain).cast("int")
    return at, size, (other >= 0) & (at >= 1) & (at + size - 1 <= length)


def allowed(length: Column, threshold: int, edit_chars: int) -> Column:
    """How many edits may part a line of ``length`` code points from one that isn't shorter."""
    return F.least(F.call_function("div", length, F.lit(edit_chars)), F.lit(threshold)).cast("int")


def _looks(threshold: int) -> list[tuple[int, int, int, int]]:
    """Everything a line looks up: for lines that allow so many edits, the moves for that many."""
    return [(edits, *move) for edits in range(1, threshold + 1) for move in _moves(edits)]


def _probes(line: Column, threshold: int, edit_chars: int) -> Column:
    """Keys of the substrings that can equal a segment of a line that isn't longer, in the order of ``_looks``; null where none fits."""
    length, keys = F.char_length(line), []
    for edits, shorter, i, moved in _looks(threshold):
        at, size, fits = _places(length, F.lit(shorter), F.lit(i), F.lit(moved), edits)
        fits = fits & (allowed(length - shorter, threshold, edit_chars) == edits)
        keys.append(F.when(fits, F.xxhash64(F.lit(0).cast("long"), length - shorter, F.lit(i), F.substring(line, at, size))))
    return F.array(*keys)


def _counts(line: Column) -> Column:
    """How often each of ``COUNTED_CHARS`` occurs. An edit changes their sum of differences by two at most."""
    return F.array(*[F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED_CHARS])


def _marks(counts: Column) -> list[Column]:
    """Two words with a bit each for each of ``COUNTED_CHARS``: its count from 0 to 3, beginning again at 4, as 00, 10, 11, 01. An edit changes two bits at most."""
    word = lambda more: F.aggregate(F.transform(counts, lambda n, k: F.call_function("shiftleft", F.pmod(F.call_function("div", n + more, F.lit(2)), F.lit(2)).cast("long"), k)), F.lit(0).cast("long"), lambda x, bit: x.bitwiseOR(bit))
    return [word(1).alias("m1"), word(0).alias("m2")]


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common beginning of two strings, by halving."""
    least = F.least(F.char_length(a), F.char_length(b))
    steps = F.filter(F.array(*[F.lit(1 << k) for k in reversed(range(31))]), lambda x: x <= least)
    return F.aggregate(steps, F.lit(0), lambda m, x: F.when((m + x <= least) & (F.substring(a, m + 1, x) == F.substring(b, m + 1, x)), m + x).otherwise(m))


def _trimmed(a: Column, b: Column) -> Column:
    """Two strings without what they begin and end with alike, as arrays of characters; their edit distance is the same."""
    chars = lambda x: F.when(x != "", F.split(x, "", -1)).otherwise(F.array().cast("array<string>"))
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    rest = lambda p: _let(_common(p["a"], p["b"]), lambda m: pair(F.substr(p["a"], m + 1), F.substr(p["b"], m + 1)))
    turned = lambda p: pair(F.reverse(p["a"]), F.reverse(p["b"]))
    return _let(_let(_let(pair(a, b), rest), turned), lambda p: _let(rest(p), lambda q: pair(chars(q["a"]), chars(q["b"]))))


def edit_distance_within(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings by code points, null if it exceeds ``threshold``.

    Bit d of the e-th register says that the first j - threshold + d code
    points of ``a`` become the first j of ``b`` by e edits or fewer; only these
    2 * threshold + 1 diagonals count, so registers are one word for lines of
    any length. Where the last register has no bit left after ``BLOCK``
    columns, no more are looked at.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1

    def equal(p: Column, j: Column) -> Column:
        """Diagonals on which the j-th character of b meets an equal one of a."""
        bits = F.lit(0)
        for d in range(width):
            at = j - 1 - threshold + d
            bits = bits.bitwiseOR(F.when((at >= 0) & (F.get(p["a"], at) == F.get(p["b"], j - 1)), 1 << d).otherwise(0))
        return bits

    def step(registers: Column, mask: Column) -> Column:
        out: list[Column] = []
        for e in range(threshold + 1):
            new = registers[f"r{e}"].bitwiseAND(mask)
            if e:
                before = registers[f"r{e - 1}"]
                new = new.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full))
            out.append(new)
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(out)])

    def run(p: Column, registers: Column, begin: int, end: Column) -> Column:
        columns = F.when(end > begin, F.sequence(F.lit(begin + 1), end)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(F.transform(columns, lambda j: equal(p, j)), registers, step)

    start = F.struct(*[F.lit(sum(1 << threshold + k for k in range(e + 1)) & full).alias(f"r{e}") for e in range(threshold + 1)])

    def least(p: Column, registers: Column) -> Column:
        end, found = F.call_function("shiftleft", F.lit(1), F.size(p["a"]) - F.size(p["b"]) + threshold), F.lit(None).cast("int")
        for e in reversed(range(threshold + 1)):
            found = F.when(registers[f"r{e}"].bitwiseAND(end) != 0, e).otherwise(found)
        return found

    def whole(p: Column) -> Column:
        n = F.size(p["b"])
        first = run(p, start, 0, F.least(n, F.lit(BLOCK)))
        return _let(first, lambda r: F.when(r[f"r{threshold}"] != 0, _let(run(p, r, BLOCK, n), lambda last: least(p, last))))

    # lengths that differ by more are told without a look at the characters
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) <= threshold, _let(_trimmed(a, b), whole))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """All pairs of different lines that are linked, each once: a and b (keys), distance.

    Two lines may differ by one edit for every ``edit_chars`` (two or more)
    code points of the shorter, and by ``threshold`` at most. Null and empty
    texts hold no line, lines of any length are compared as a whole, and
    repeated rows add no link; of pairs at the same distance each counts. An
    empty table gives an empty table.
    """
    if edit_chars < 2:
        raise ValueError("an edit needs two code points or more, so that no segment is empty")
    line = F.col("line")
    long = lines(docs, id_col, text_col).filter(F.char_length("line") >= edit_chars)
    # copies go before anything is met; what a line is found by depends on the line alone. Half the key tells lines apart
    # here, and where it doesn't, all lines that share it are checked
    probes = checkpointed(long.select("k1", _probes(line, threshold, edit_chars).alias("probes")).distinct())
    in_place = [k for k, (_, shorter, _, moved) in enumerate(_looks(threshold)) if shorter == moved == 0]
    own = F.array(*[F.get("probes", F.lit(k)) for k in in_place])
    looks = probes.select("k1", own.alias("own"), F.explode(F.array_distinct("probes")).alias("key")).filter("key is not null")
    looks = looks.select("k1", "key", F.exists("own", lambda k: k.eqNullSafe(F.col("key"))).alias("own"))
    shared = _shared(looks)
    posts = checkpointed(looks.join(if_small(shared), "key"))
    wanted = if_small(checkpointed(posts.select("k1").distinct()))
    texts = checkpointed(long.select("k1", "k2", "line").join(wanted, "k1", "left_semi").distinct())
    light = checkpointed(texts.select("k1", F.char_length("line").alias("n"), _counts(line).alias("counts")).select("*", *_marks(F.col("counts"))))
    # what a line is indexed by and what it looks up, of the keys by which lines meet
    held = posts.groupBy("k1").agg(F.collect_set(F.when(F.col("own"), F.col("key"))).alias("owned"), F.collect_set("key").alias("looked"))
    pairs = checkpointed(_met(posts.join(light.select("k1", "n", "m1", "m2"), "k1").join(held, "k1"), threshold, edit_chars).distinct())

    # counts first, texts for what is left
    side = lambda rows, x: rows.select(F.col("k1").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c != "k1"])
    differ = F.aggregate(F.zip_with("a_counts", "b_counts", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    most = allowed(F.least("a_n", "b_n"), threshold, edit_chars)
    near = (F.abs(F.col("a_n") - F.col("b_n")) <= most) & (differ <= 2 * most)
    pairs = pairs.join(side(light.drop("m1", "m2"), "a"), "a").join(side(light.drop("m1", "m2"), "b"), "b").filter(near).select("a", "b").distinct()
    whole = texts.select("k1", F.struct("k1", "k2").alias("key"), "line")
    found = pairs.join(side(whole, "a"), "a").join(side(whole, "b"), "b").repartition(F.col("a"), F.col("b"))
    most = allowed(F.least(F.char_length("a_line"), F.char_length("b_line")), threshold, edit_chars)
    checked = found.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), edit_distance_within(F.col("a_line"), F.col("b_line"), threshold).alias("distance"), most.alias("most"))
    return checked.filter("distance <= most and a <> b").select("a", "b", "distance").distinct()


def _shared(looks: DataFrame) -> DataFrame:
    """Keys by which lines meet, and how many lines are indexed by each: key and indexed."""
    counts = looks.groupBy("key").agg(F.count_if("own").alias("indexed"), F.count(F.lit(1)).alias("n"))
    return checkpointed(counts.filter("indexed > 0 and n > 1").select("key", "indexed"))


def _met(posts: DataFrame, threshold: int, edit_chars: int) -> DataFrame:
    """Candidate pairs, the smaller number first: a line that is indexed by a key and one that looks it up, nearly alike in how often letters occur.

    A line looks up what isn't longer, so lines of one length would meet both
    ways and one way is enough. A pair is made at the first key by which it
    meets, so it is made once, whatever the two have in common.
    """
    places = F.ceil(F.col("indexed") / DEALT).cast("int")
    own = posts.filter("own").select("key", F.pmod(F.xxhash64("k1"), places).cast("int").alias("place"), F.col("k1").alias("x"), F.col("n").alias("x_n"), F.col("m1").alias("x1"), F.col("m2").alias("x2"), "owned")
    looks = posts.select("key", F.explode(F.sequence(F.lit(0), places - 1)).alias("place"), F.col("k1").alias("y"), F.col("n").alias("y_n"), F.col("m1").alias("y1"), F.col("m2").alias("y2"), "looked")
    ordered = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x") < F.col("y")))
    near = F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))) + F.bit_count(F.col("x2").bitwiseXOR(F.col("y2"))) <= 2 * allowed(F.col("x_n"), threshold, edit_chars)
    first = F.array_min(F.array_intersect("owned", "looked")) == F.col("key")
    return own.join(looks, ["key", "place"]).filter(ordered & near & first & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """One row for every distinct line with a word, and the class of linked lines that it belongs to.

    Columns: k1 and k2 (the line's key), doc_id (the smallest that holds it),
    n_copies (how often it occurs), n_links (different lines that it is linked
    to), class_k1 and class_k2 (the smallest key reachable), class_doc_id (the
    smallest id that holds a line of the class). Rows that repeat an id count
    as they are; null ids hold lines, but name no class that has another id. Lines
    of any length are compared as a whole; of equal ids or keys either names the
    class. An empty table gives an empty table.
    """
    found = checkpointed(links(docs, id_col, text_col, threshold, edit_chars))
    key = F.struct("k1", "k2")
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    near = checkpointed(components(found.select("a", "b")).join(degree, "node", "left"))
    own = lines(docs, id_col, text_col).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("doc_id"))
    rows = own.withColumn("node", key).join(near, "node", "left")
    lowest = checkpointed(rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_doc_id")))
    return rows.join(lowest, "component", "left").select(
        "k1", "k2", "doc_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component.k1", "k1").alias("class_k1"), F.coalesce("component.k2", "k2").alias("class_k2"), F.coalesce("class_doc_id", "doc_id").alias("class_doc_id"),
    )


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """One row for every line with a word in every document, and the class of linked lines that it belongs to.

    Columns: doc_id and at (the line's place from 0), k1 and k2 (its key),
    n_links (different lines that it is linked to), class_k1 and class_k2 (the
    smallest key reachable), class_size (occurrences in the class),
    class_doc_id and class_at (the first of them, by id and place; null ids
    come last) and kept (whether this is the first). Rows that repeat an id are
    rows of one document. A null text has no line; an empty table gives an
    empty table.
    """
    found = checkpointed(links(docs, id_col, text_col, threshold, edit_chars))
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    near = components(found.select("a", "b")).join(degree, "node")
    near = if_small(checkpointed(near.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), F.col("component.k1").alias("c1"), F.col("component.k2").alias("c2"), "n_links")))
    rows = lines(docs, id_col, text_col).select("doc_id", "at", "k1", "k2").join(near, ["k1", "k2"], "left")
    rows = rows.select("doc_id", "at", "k1", "k2", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c1", "k1").alias("class_k1"), F.coalesce("c2", "k2").alias("class_k2"))
    # only classes with a second line meet their lines again
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at")
    first = rows.groupBy("class_k1", "class_k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    first = if_small(checkpointed(first))
    out = rows.join(first, ["class_k1", "class_k2"], "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id", "at", "k1", "k2", "n_links", "class_k1", "class_k2", F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"), F.when(alone, F.col("at")).otherwise(F.col("first.at")).alias("class_at"),
        (alone | (place == F.col("first"))).alias("kept"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``docs`` without the lines whose class has an earlier line, by id and place in the text; columns stay as they are.

    Lines without a word stay. Ids are taken as unique; where one repeats, its
    rows lose what any of them would.
    """
    classed = checkpointed(classes(docs, id_col, text_col, threshold, edit_chars).filter("n_copies > 1 or n_links > 0").select("k1", "k2", "class_k1", "class_k2"))
    placed = lines(docs, id_col, text_col).select("doc_id", "at", "k1", "k2").join(classed, ["k1", "k2"]).withColumn("place", F.struct("doc_id", "at"))
    first = placed.groupBy("class_k1", "class_k2").agg(F.min("place").alias("first"))
    later = placed.join(first, ["class_k1", "class_k2"]).filter(F.col("place") != F.col("first")).groupBy("doc_id").agg(F.collect_set("at").alias("__gone")).withColumnRenamed("doc_id", "__id")
    kept = F.array_join(F.transform(F.filter(F.transform(F.split(F.col(text_col), "\n", -1), lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda s: ~F.array_contains("__gone", s["k"])), lambda s: s["x"]), "\n")
    return docs.join(later, docs[id_col] == later["__id"], "left").withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)
