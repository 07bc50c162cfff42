"""Byte-level BPE encoding and decoding through an index of pair occurrences.

A partition's new words lie behind one another in flat arrays. An index maps
each adjacent pair of symbols to all positions where it occurs. Ranks that occur
are applied in ascending order, each at all its positions at once, and the
lists of the pairs beside a merge are updated. A word met before in the same
partition isn't encoded again.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import in_batches

#: How byte-level tokenizers split a text before the merges (a fixed value of the format).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of Latin-1 characters alone, with the classes written out; Python's own engine takes it and is faster.
LATIN_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
#: A vocabulary file above this size isn't sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Words whose ids a worker remembers; past this it forgets them all, which changes no result.
REMEMBERED_WORDS = 200_000
#: Characters of texts that are taken in a group.
INDEXED_CHARS = 1_000_000
#: Characters of new words that are indexed at once: lists of places take up to about 100 bytes a character.
INDEXED_AT_ONCE = 120_000


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def parsed(content: str) -> tuple[list[int], list[bytes], np.ndarray, dict[str, int]]:
    """Ids of bytes, bytes of tokens, merges by rank and special tokens of a vocabulary file, as plain values that are sent to executors."""
    spec = json.loads(content)
    model, letter = spec["model"], byte_letters()
    ids = model["vocab"]
    byte_id = [0] * 256
    for c, b in letter.items():
        byte_id[b] = ids[c]
    token_bytes = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in ids.items():
        token_bytes[i] = bytes(letter[c] for c in token)
    pairs, born = [], {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        pairs.append((ids[a], ids[b], ids[a + b]))
        born.setdefault(ids[a + b], rank)
    # a merge's parts are older than itself, so ascending ranks never have to turn back
    if any(max(born.get(a, -1), born.get(b, -1)) >= rank for rank, (a, b, _) in enumerate(pairs)):
        raise ValueError("the merges are not in the order in which they build on one another")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for text, i in special.items():
        token_bytes[i] = text.encode()
    return byte_id, token_bytes, np.array(pairs, np.int64).reshape(-1, 3), special


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file in the JSON format of the tokenizers library."""

    def __init__(self, byte_id: list[int], token_bytes: list[bytes], pairs: np.ndarray, special: dict[str, int]):
        self.byte_id, self.token_bytes, self.special = np.array(byte_id, np.int32), token_bytes, special
        #: By rank: left symbol, right symbol, what they become.
        self.pairs = pairs
        codes = pairs[:, 0] << 32 | pairs[:, 1]
        self.rank_of = np.argsort(codes, kind="stable")
        self.codes = codes[self.rank_of]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    @classmethod
    def of(cls, content: str) -> Vocabulary:
        return cls(*parsed(content))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where no merge has it; symbols below 0 belong to none."""
        if not len(self.codes):
            return np.full(len(left), -1)
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.rank_of[at], -1)


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Packed ids of each word, by merging all words together through one pair index."""
    if not words:
        return []
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends, n = np.cumsum(size), int(size.sum())
    # position n stands for the end of a word, on either side
    symbol = np.append(vocabulary.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[n], after[(ends - 1)[size > 0]] = n, n
    before[(ends - size)[size > 0]], before[n] = n, n
    places: dict[int, list[np.ndarray]] = {}  # by rank, all positions where its pair occurs
    active: list[int] = []

    def note(at: np.ndarray) -> None:
        """Adds the pairs that begin at ``at`` to the index."""
        rank = vocabulary.ranks(symbol[at], symbol[after[at]])
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else rank
        for k, begin in enumerate(first.tolist()):
            if (r := int(rank[begin])) >= 0:
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(at[begin : first[k + 1] if k + 1 < len(first) else len(at)])

    for at in range(0, n, 1 << 18):  # in steps, as the arrays of a step are several times as wide
        note(np.arange(at, min(n, at + (1 << 18)), dtype=np.int32))
    while active:
        rank = heapq.heappop(active)
        left, right, new = vocabulary.pairs[rank].tolist()
        found = places.pop(rank)
        at = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
        at = at[np.append(True, at[1:] != at[:-1])]
        at = at[(symbol[at] == left) & (symbol[after[at]] == right)]  # an earlier merge may have taken one of the two
        if left == right and len(at) > 1:  # of overlapping pairs the first counts
            kept, taken = [], -1
            for i in at.tolist():
                if i != taken:
                    kept.append(i)
                    taken = int(after[i])
            at = np.array(kept, np.int32)
        if not len(at):
            continue
        gone = after[at]
        symbol[at], symbol[gone] = new, -1
        after[at] = after[gone]
        before[after[at]], before[n] = at, n
        note(np.concatenate([before[at], at]))
    kept = symbol[:n] >= 0
    packed = symbol[:n][kept].astype("<u4").tobytes()
    stops = [0, *(4 * np.append(0, np.cumsum(kept))[ends]).tolist()]
    return [packed[i:j] for i, j in zip(stops, stops[1:], strict=False)]


class Codec:
    """Encodes and decodes texts, remembering the ids of words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.latin_split, self.any_split = re.compile(LATIN_PATTERN).findall, regex.compile(SPLIT_PATTERN).findall
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary.special.items()}

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_split(text)
        return self.latin_split(text)

    def _parts(self, text: str) -> Iterator[tuple[bool, str]]:
        if self.vocabulary.special_split is None or not any(t in text for t in self.special_ids):
            yield False, text
            return
        for k, part in enumerate(self.vocabulary.special_split.split(text)):
            yield bool(k % 2), part

    def _learn(self, words: Iterable[str]) -> None:
        batch, size = [], 0
        for w in itertools.chain(words, [None]):
            if w is not None:
                batch.append(w)
                size += len(w)
            if batch and (w is None or size >= INDEXED_AT_ONCE):
                self.known.update(zip(batch, encode_words(self.vocabulary, [x.encode() for x in batch]), strict=True))
                batch, size = [], 0

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text, little-endian unsigned 32-bit integers."""
        group, chars = [], 0
        for text in itertools.chain(texts, [None]):
            if text is not None:
                group.append(text)
                chars += len(text)
            if group and (text is None or chars >= INDEXED_CHARS):
                # each distinct word is held once, texts as numbers of words
                number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
                parts = [[(special, part if special else array("I", map(number.__getitem__, self.split(part)))) for special, part in self._parts(x)] for x in group]
                group, chars = [], 0
                if len(self.known) + len(number) > REMEMBERED_WORDS:
                    self.known.clear()
                self._learn(w for w in number if w not in self.known)
                ids = [self.known[w] for w in number].__getitem__
                for of_text in parts:
                    yield b"".join(self.special_ids[part] if special else b"".join(map(ids, part)) for special, part in of_text)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; special tokens included."""
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def _content(docs: DataFrame, vocabulary_path: str):
    """The vocabulary of a file, read on the driver and parsed once for all tasks of a worker."""
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {len(content)} characters; at most {MAX_VOCABULARY_BYTES} are sent to executors")
    return docs.sparkSession.sparkContext.broadcast(parsed(content))


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids of each whole text.

    A null text is read as empty and gets an empty array; strings of special
    tokens in a text become these tokens. A column that is named ``ids_col``
    already is replaced. An empty table gives an empty table.
    """
    shared = _content(docs, vocabulary_path)
    docs = docs.drop(ids_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(Vocabulary(*shared.value))
        for pdf in batches:
            packed = codec.encode_batch(pdf[text_col].fillna("").tolist())
            yield pdf.assign(**{ids_col: [np.frombuffer(p, "<u4").astype("int32") for p in packed]})

    return in_batches(docs).mapInPandas(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids; null ids give an empty text, an id beyond the vocabulary raises. Rows that repeat are answered alike; an empty table gives an empty table."""
    shared = _content(rows, vocabulary_path)
    rows = rows.drop(text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(Vocabulary(*shared.value))
        for pdf in batches:
            yield pdf.assign(**{text_col: ["" if x is None else codec.decode(np.asarray(x).astype("<u4").tobytes()) for x in pdf[ids_col]]})

    return in_batches(rows).mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, vocabulary_path: str, keys: list[str], text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding each text, without moving ids out of the worker.

    Columns: ``keys``, n_tokens long, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of the decoded text in
    UTF-8), both lowercase hex. Null texts count as empty. Rows that repeat are
    answered alike, long texts are read as a whole, and an empty table gives an
    empty table.
    """
    shared = _content(docs, vocabulary_path)
    docs = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    fields = [f for f in docs.schema.fields if f.name != "__text"]
    digests = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary(*shared.value))
        for b in batches:
            found = [(len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(codec.decode(p).encode()).hexdigest()) for p in codec.encode_batch(x.as_py() for x in b.column(b.num_columns - 1))]
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[f.name for f in (*fields, *digests)])

    return in_batches(docs).mapInArrow(run, T.StructType([*fields, *digests]))
