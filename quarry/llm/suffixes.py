"""Removal of repeated passages by suffix arrays, sorted by a distributed difference-cover algorithm.

A passage is any string of ``window`` bytes. Every window is dealt out by its
*anchor*, the smallest of its 16-byte grams by a hash, so equal windows always
meet: they share their anchor, and the gram before or behind it. Texts are
shuffled once, into buckets. Three rounds go from buckets to ranges of anchors
and back, each with what the one before left open: anchors that several texts
have with a neighbour (40 bits each, packed), digests of the pieces of text that hold
all windows of one such anchor, and the bytes of those pieces that are not the
only ones of their anchor. There the pieces'
suffixes are sorted by the difference cover {1, 2} modulo 3: triples of the
sample are sorted and named, the names are sorted by recursion until they reach
over a window, the remaining suffixes are sorted by a byte and a rank and merged.
Neighbours in that order with equal windows are one passage, and the passage's
smallest document keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, in_batches, with_groups

#: Bytes of a passage.
WINDOW = 50
#: Bytes of the grams among which a window's anchor is chosen.
GRAM = 16
#: Bytes of texts that are looked at together.
STRETCH = 1 << 20
#: Anchors that a bucket of texts has, about, at most; buckets are smaller where the session's partitions would have less than ``BUCKETS`` of them.
HELD_ANCHORS = 1 << 20
#: Buckets of texts in a partition, about, unless they would fall below ``LEAST_BUCKET`` bytes.
BUCKETS = 8
LEAST_BUCKET = 1 << 17
#: Bytes of text whose anchors one task compares, about.
RANGE_BYTES = 1 << 25
#: Bytes of pieces whose suffixes are sorted together, about; whole anchors are.
SORTED_BYTES = 1 << 21
#: Different pieces of one anchor from which on its windows are dealt out one by one.
HOT_TEXTS = 100_000
#: Bytes of a piece's digest.
DIGEST = 12
#: Stands for a null id, which sorts behind all others.
_NO_ID = (1 << 63) - 1
#: Stands for no key.
_NO_KEY = np.uint64(1 << 40)


def _grams(b: np.ndarray) -> np.ndarray:
    """A hash of each string of ``GRAM`` bytes, by doubling."""
    x, length = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while length < GRAM:
        x = x[:-length] * np.uint64(0xD6E8FEB86659FD93) + x[length:]
        x ^= x >> np.uint64(32)
        length *= 2
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _runs(whole: np.ndarray, window: int, valid: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """By stretch: its grams' hashes, then for runs of ``valid`` windows with one anchor its place, the first and the last window's start, and where the stretch begins, at which places count from 0."""
    for begin in range(0, len(whole) - window + 1, STRETCH):
        grams = _grams(whole[begin : begin + STRETCH + window - 1])
        # place below the hash: the smallest is the leftmost of equals
        least, length, width = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64), 1, window - GRAM + 1
        while 2 * length <= width:
            least, length = np.minimum(least[:-length], least[length:]), 2 * length
        if length < width:
            least = np.minimum(least[: len(least) - (width - length)], least[width - length :])
        here = np.ones(len(least), bool) if valid is None else valid[begin : begin + len(least)]
        least[~here] = np.uint64((1 << 64) - 1)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], len(least)) - 1
        first, last = first[here[first]], last[here[first]]
        yield grams, (least[first] & np.uint64(0xFFFFFF)).astype(np.int64), first, last, begin


def anchors(text: bytes, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with one anchor: its hash, and the first and the last window's start.

    The anchor is the leftmost of the grams with the smallest hash, so it
    depends on the window's bytes alone.
    """
    for grams, at, first, last, begin in _runs(np.frombuffer(text, np.uint8), window):
        yield grams[at].view(np.int64), first + begin, last + begin


def _joined(texts: pa.Table) -> tuple[pa.Table, bytes, np.ndarray]:
    """A bucket's rows in an order that hangs on their texts, the texts with a byte between them, and where each begins; behind them all, where one more would."""
    texts = texts.sort_by([("tk", "ascending"), ("holder", "ascending")])
    parts = texts["text"].cast(pa.binary()).to_pylist()
    return texts, b"\0".join(parts), np.cumsum([0] + [len(p) + 1 for p in parts])


def _anchored(text: bytes, begins: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in a bucket's joined texts: 40 bits that stand for it, the first and the last window's start, and two keys.

    A key is 40 bits of a hash of the gram and the one before or behind it, or
    ``_NO_KEY``: each window has one of these at least, so equal windows share
    a key as well.
    """
    whole = np.frombuffer(text, np.uint8)
    valid = np.ones(max(len(whole) - window + 1, 0), bool)
    for k in (begins[1:-1] - 1).tolist():
        valid[k - window + 1 : k + 1] = False
    reach, out = min(GRAM, (window - GRAM) // 2), []

    def key(one: np.ndarray, two: np.ndarray, salt: int) -> np.ndarray:
        x = (one * np.uint64(0x9E3779B97F4A7C15) ^ (two >> np.uint64(7))) * np.uint64(0xFF51AFD7ED558CCD) + two * np.uint64(salt)
        return (x ^ (x >> np.uint64(33))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)

    for grams, at, first, last, begin in _runs(whole, window, valid):
        own = grams[at]
        before = np.where(at - first >= reach, key(grams[np.maximum(at - reach, 0)], own, 0xC2B2AE3D27D4EB4F), _NO_KEY)
        behind = np.where(at - last <= window - GRAM - reach, key(own, grams[np.minimum(at + reach, len(grams) - 1)], 0x165667B19E3779F9), _NO_KEY)
        out.append((key(own, own, 0x27D4EB2F165667C5), first + begin, last + begin, before, behind))  # hashed again, as smallest hashes lie close together
    kinds = (np.uint64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate([np.zeros(0, kind), *(x[k] for x in out)]) for k, kind in enumerate(kinds))


def _keys(first: np.ndarray, keys: list[np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a bucket in order, and whether several of its texts have each."""
    of = (np.searchsorted(begins, first, "right") - 1).astype(np.uint64)
    pairs = np.unique(np.concatenate([(x << np.uint64(24) | of)[x != _NO_KEY] for x in keys])) >> np.uint64(24)
    new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[new], np.diff(np.append(new, len(pairs))) > 1


def _packed(keys: np.ndarray) -> bytes:
    """Keys of 40 bits, in order and not all distinct, as Elias and Fano code them: 3 bytes each and bits that count up the rest."""
    high = (keys >> np.uint64(24)).astype(np.int64)
    bits = np.zeros(len(keys) + int(high[-1] - high[0]), bool)
    bits[np.arange(len(keys)) + high - high[0]] = True
    low = keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return np.array([len(keys), high[0]], "<i4").tobytes() + low.tobytes() + np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n, least = np.frombuffer(data, "<i4", 2).tolist()
    low = np.zeros((n, 4), np.uint8)
    low[:, :3] = np.frombuffer(data, np.uint8, 3 * n, 8).reshape(-1, 3)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 3 * n))) - np.arange(n) + least
    return high.astype(np.uint64) << np.uint64(24) | low.view("<u4").ravel()


def _planes(numbers: np.ndarray) -> bytes:
    """Longs, all lowest bytes first, then the next ones: so a shuffle's compression finds those that are zero."""
    return np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _longs(planes: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel() for x in planes)])


def _parts(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """Ranges that sorted keys fall into, and where."""
    part = (keys * np.uint64(ranges) >> np.uint64(40)).astype(np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    yield from zip(part[first].tolist(), map(slice, first.tolist(), [*first[1:].tolist(), len(part)]), strict=True)


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches as the maximal runs they make; those that touch are one."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(new[1:], True)]


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Non-negative integer columns as one whose order is theirs."""
    out, most = columns[0], int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        n = int(c.max(initial=0)) + 1
        if most * n >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            most = len(out) + 1
        out, most = out * n + c, most * n
    return out


def suffix_order(s: np.ndarray, most: int) -> np.ndarray:
    """Places of ``s``, positive integers, in an order of their suffixes by ``most`` symbols at least; equals lie side by side in any order."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i : i + most])), np.int64)
    padded = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names = np.unique(_codes(padded[sample], padded[sample + 1], padded[sample + 2]), return_inverse=True)[1] + 1
    if most <= 3 or int(names.max()) == len(sample):
        order = np.argsort(names, kind="stable")
    else:
        order = suffix_order(names, -(-most // 3))
    sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(_codes(padded[zeros], rank[zeros + 1]), kind="stable")]
    smaller = np.zeros(len(zeros), np.int64)
    for k in (1, 2):  # against places that are k modulo 3: k symbols, then ranks of the sample
        there = sample[sample % 3 == k]
        both = np.concatenate([there, zeros])
        codes = _codes(*[padded[both + j] for j in range(k)], rank[both + k])
        smaller += np.searchsorted(np.maximum.accumulate(codes[: len(there)]), codes[len(there) :])
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    at = np.arange(len(zeros)) + np.maximum.accumulate(smaller)  # equals may have been named in another order
    out[at], free[at] = zeros, False
    out[free] = sample
    return out


def first_holders(pieces: list[bytes], holders: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every piece the smallest holder of an equal one: all in one array, and where each piece's begin in it."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    counts = lengths - window + 1
    begins = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"".join(pieces), np.uint8)
    number = np.full(len(text), -1, np.int64)  # of the windows, by place
    places = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    number[places] = np.arange(len(places))
    order = suffix_order(text.astype(np.int64) + 1, window)
    order = order[number[order] >= 0]
    seen = np.lib.stride_tricks.sliding_window_view(text, window)
    new = np.ones(len(order), bool)
    for k in range(1, len(order), 1 << 17):  # neighbours with equal prefixes are one passage
        here = order[k - 1 : k + (1 << 17)]
        new[k : k + (1 << 17)] = (seen[here[1:]] != seen[here[:-1]]).any(axis=1)
    passage = np.cumsum(new) - 1
    held = np.repeat(holders, counts)[number[order]]
    out = np.empty(len(order), np.int64)
    out[number[order]] = np.minimum.reduceat(held, np.flatnonzero(new))[passage]
    return out, np.cumsum(counts) - counts


def _repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's keys in a range, a bit for those that several texts have."""
    rows = [r for b in batches for r in b.to_pylist()]
    for part in {r["part"] for r in rows}:
        own = [r for r in rows if r["part"] == part]
        keys = [_unpacked(r["keys"]) for r in own]
        cuts, all_keys = np.cumsum([0] + [len(x) for x in keys]), np.concatenate(keys)
        order = np.argsort(all_keys, kind="stable")
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(x)) for r, x in zip(own, keys, strict=True)]).astype(bool)
        new = np.append(True, all_keys[order[1:]] != all_keys[order[:-1]])
        run = np.cumsum(new) - 1
        repeated = np.empty(len(order), bool)
        repeated[order] = ((np.bincount(run) > 1) | (np.bincount(run, several[order]) > 0))[run]
        out = [(r["bucket"], part, np.packbits(repeated[i:j]).tobytes()) for r, i, j in zip(own, cuts[:-1], cuts[1:], strict=True)]
        yield from _table(out, bucket=pa.int32(), part=pa.int32(), repeated=pa.binary()).to_batches()


#: Pieces that are judged by their digests: a bucket's places of them.
_JUDGED = "bucket int, state string, keys binary, starts binary, lengths binary"
_JUDGED_KINDS = {"bucket": pa.int32(), "state": pa.string(), "keys": pa.binary(), "starts": pa.binary(), "lengths": pa.binary()}


def _judged(hot_texts: int):
    """Pieces in a range of anchors, judged: "late" if an earlier holder has the piece, "open" if its anchor has others, "hot" if very many."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["keys"] is None:  # judged in its bucket
                    yield from _table([(r["bucket"], "late", None, r["starts"], r["lengths"])], **_JUDGED_KINDS).to_batches()
                else:
                    by_part.setdefault(r["part"], []).append(r)
        for own in by_part.values():
            keys = [_unpacked(r["keys"]) for r in own]
            cuts, x = np.cumsum([0] + [len(k) for k in keys]), np.concatenate(keys)
            digests = np.frombuffer(b"".join(r["digests"] for r in own), [("a", "<u8"), ("b", "<u4")])
            holder, start, length = (_longs([r[c] for r in own]) for c in ("holders", "starts", "lengths"))
            order = np.lexsort((holder, digests["b"], digests["a"], x))
            of_anchor = np.append(True, x[order[1:]] != x[order[:-1]])
            new = of_anchor | np.append(True, digests[order[1:]] != digests[order[:-1]])
            piece, anchor = np.cumsum(new) - 1, np.cumsum(of_anchor) - 1
            late = holder[order] > holder[order][new][piece]
            several, many = np.bincount(anchor, new)[anchor] > 1, np.bincount(anchor, ~late)[anchor] > hot_texts
            state = np.empty(len(order), np.int8)
            state[order] = np.where(late, 1, np.where(several, np.where(many, 3, 2), 0))
            out = []
            for r, i, j in zip(own, cuts[:-1], cuts[1:], strict=True):
                for k, name in ((1, "late"), (2, "open"), (3, "hot")):
                    at = i + np.flatnonzero(state[i:j] == k)
                    if len(at):
                        out.append((r["bucket"], name, None if k == 1 else _packed(x[at]), _planes(start[at]), _planes(length[at])))
            yield from _table(out, **_JUDGED_KINDS).to_batches()

    return judge


def _meeting(window: int):
    """Pieces with their anchors' others, in order of anchors, become the stretches that an earlier holder has as well."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def resolved(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            holder = t["holder"].to_numpy()
            coded = t["piece"].chunk(0).dictionary_encode()
            of = coded.indices.to_numpy().astype(np.int64)
            distinct = coded.dictionary.to_pylist()
            smallest = np.full(len(distinct), _NO_ID)
            np.minimum.at(smallest, of, holder)
            counts = np.array([len(p) for p in distinct], np.int64) - window + 1
            begins = np.cumsum(counts) - counts
            # a piece that is its anchor's only one repeats as a whole; the others' suffixes are sorted
            anchor = np.empty(len(distinct), np.int64)
            anchor[of] = t["hash"].to_numpy()
            _, group, sizes = np.unique(anchor, return_inverse=True, return_counts=True)
            several = np.flatnonzero(sizes[group] > 1)
            firsts = np.repeat(smallest, counts)
            if len(several):
                at = np.repeat(begins[several], counts[several])
                found, own = first_holders([distinct[k] for k in several.tolist()], smallest[several], window)
                firsts[at + np.arange(len(found)) - np.repeat(own, counts[several])] = found
            # every window of every row, and whether an earlier holder has it
            n = counts[of]
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = firsts[np.repeat(begins[of], n) + shift] < np.repeat(holder, n)
            first = np.flatnonzero(gone & np.append(True, ~gone[:-1] | (shift[1:] == 0)))
            last = np.flatnonzero(gone & np.append(~gone[1:] | (shift[1:] == 0), True))
            row = np.repeat(np.arange(len(of)), n)[first]
            start = t["start"].to_numpy()[row]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(t["bucket"].to_numpy()[row], pa.int32()), "start": start + shift[first], "stop": start + shift[last] + window})

        waiting, size = [], 0
        for b in batches:
            yield b.filter(b.column(4).is_null()).select(["bucket", "start", "stop"])
            b = b.filter(b.column(4).is_valid())
            for k in range(0, b.num_rows, 8192):
                part = b.slice(k, 8192)
                waiting.append(part)
                size += part.column(4).nbytes
                if size > SORTED_BYTES:  # all anchors but the last are whole
                    rows = pa.Table.from_batches(waiting)
                    hashes = rows["hash"].to_numpy()
                    cut = int(np.argmax(hashes == hashes[-1]))
                    if cut:
                        yield resolved(rows.slice(0, cut))
                        waiting = rows.slice(cut).combine_chunks().to_batches()
                        size = sum(x.column(4).nbytes for x in waiting)
        if waiting:
            yield resolved(pa.Table.from_batches(waiting))

    return meet


def _less_repeats(texts: DataFrame, n_bytes: int, window: int, hot_texts: int) -> DataFrame:
    """Texts (id, holder, tk, text, rows) that are no shorter than the window, of ``n_bytes`` in all, as ``without_repeats`` returns them, and rows."""
    spark = texts.sparkSession
    per_bucket = HELD_ANCHORS * (window - GRAM + 2) // 2
    buckets = max(1, -(-n_bytes // per_bucket), min(-(-n_bytes // LEAST_BUCKET), BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranges = min(max(spark.sparkContext.defaultParallelism, -(-n_bytes // RANGE_BYTES)), 1 << 20)
    kind = dict(texts.dtypes)["id"]
    # the one shuffle of texts: all that follows reads the same partitions
    dealt = texts.select(F.pmod("tk", F.lit(buckets)).cast("int").alias("bucket"), "id", "holder", "tk", "text", "rows").repartition("bucket").groupBy("bucket")

    def index(texts: pa.Table) -> pa.Table:
        bucket = texts["bucket"][0].as_py()
        _, text, begins = _joined(texts)
        _, first, _, *keys = _anchored(text, begins, window)
        keys, several = _keys(first, keys, begins)
        out = [(part, bucket, _packed(keys[at]), np.packbits(several[at]).tobytes()) for part, at in _parts(keys, ranges)]
        return _table(out, part=pa.int32(), bucket=pa.int32(), keys=pa.binary(), several=pa.binary())

    keys = dealt.applyInArrow(index, "part int, bucket int, keys binary, several binary")
    repeated = keys.repartitionById(ranges, F.col("part")).mapInArrow(_repeated_keys, "bucket int, part int, repeated binary")

    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = {"part": pa.int32(), "bucket": pa.int32(), **{c: pa.binary() for c in ("keys", "digests", "holders", "starts", "lengths")}}
        if not len(texts):
            return _table([], **names)
        bucket = texts["bucket"][0].as_py()
        texts, text, begins = _joined(texts)
        anchor, first, last, *keys = _anchored(text, begins, window)
        known, _ = _keys(first, keys, begins)
        bits = {r["part"]: r["repeated"] for r in answers.to_pylist()}
        several = [np.unpackbits(np.frombuffer(bits[part], np.uint8), count=at.stop - at.start).astype(bool) for part, at in _parts(known, ranges)]
        known = known[np.concatenate([np.zeros(0, bool), *several])]
        chosen = np.zeros(len(first), bool)
        for x in keys:
            if len(known):
                chosen |= known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
        x, start, stop = anchor[chosen], first[chosen], last[chosen] + window
        digests = np.frombuffer(b"".join([blake2b(text[i:j], digest_size=DIGEST).digest() for i, j in zip(start.tolist(), stop.tolist(), strict=True)]), [("a", "<u8"), ("b", "<u4")])
        holder = texts["holder"].to_numpy()[np.searchsorted(begins, start, "right") - 1]
        order = np.lexsort((holder, digests["b"], digests["a"], x))
        x, start, stop, digests, holder = x[order], start[order], stop[order], digests[order], holder[order]
        new = np.append(True, (x[1:] != x[:-1]) | (digests[1:] != digests[:-1]))[: len(x)]
        late = holder > holder[new][np.cumsum(new) - 1] if len(x) else new
        i, j = _merged(start[late], stop[late])
        out = [(bucket % ranges, bucket, None, None, None, _planes(i), _planes(j - i))] if len(i) else []
        x, start, length, digests, holder = x[~late], start[~late], (stop - start)[~late], digests[~late], holder[~late]
        out += [(part, bucket, _packed(x[at]), digests[at].tobytes(), _planes(holder[at]), _planes(start[at]), _planes(length[at])) for part, at in _parts(x, ranges)]
        return _table(out, **names)

    pieces = dealt.cogroup(repeated.groupBy("bucket")).applyInArrow(cut, "part int, bucket int, keys binary, digests binary, holders binary, starts binary, lengths binary")
    judged = pieces.repartitionById(ranges, F.col("part")).mapInArrow(_judged(hot_texts), _JUDGED)

    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = {"hash": pa.int64(), "bucket": pa.int32(), "start": pa.int64(), "stop": pa.int64(), "piece": pa.binary(), "holder": pa.int64()}
        if not len(texts) or not len(answers):
            return _table([], **names)
        bucket = texts["bucket"][0].as_py()
        texts, text, begins = _joined(texts)
        rows = {name: [r for r in answers.to_pylist() if r["state"] == name] for name in ("late", "open", "hot")}
        at = {name: (_longs([r["starts"] for r in x]), _longs([r["lengths"] for r in x])) for name, x in rows.items()}
        number = lambda x: int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True)
        holder = lambda start: texts["holder"].to_numpy()[np.searchsorted(begins, start, "right") - 1]
        start, length = at["open"]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(r["keys"]) for r in rows["open"])]).astype(np.int64)
        parts = [(hashes, start, start + length, [text[i:j] for i, j in zip(start.tolist(), (start + length).tolist(), strict=True)])]
        # windows of hot anchors meet by themselves, each for the smallest holder that has it here
        start, length = at["hot"]
        n = length - window + 1
        start = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        alone, held, least = [text[i : i + window] for i in start.tolist()], holder(start), {}
        for p, h in zip(alone, held.tolist(), strict=True):
            least[p] = min(least.get(p, h), h)
        gone = held > np.array([least[p] for p in alone], np.int64)
        alone = [p for p, x in zip(alone, gone.tolist(), strict=True) if not x]
        parts.append((np.array([number(p) for p in alone], np.int64), start[~gone], start[~gone] + window, alone))
        start, stop = _merged(np.append(at["late"][0], start[gone]), np.append(sum(at["late"]), start[gone] + window))
        parts.append((np.full(len(start), number(bucket.to_bytes(4, "little"))), start, stop, [None] * len(start)))
        hashes, start, stop = (np.concatenate([p[k] for p in parts]) for k in range(3))
        pieces = [x for p in parts for x in p[3]]
        return pa.table([hashes, np.full(len(start), bucket, np.int32), start, stop, pa.array(pieces, pa.binary()), holder(start)], names=list(names))

    sent = dealt.cogroup(judged.groupBy("bucket")).applyInArrow(send, "hash long, bucket int, start long, stop long, piece binary, holder long")
    found = in_batches(sent.repartition("hash").sortWithinPartitions("hash")).mapInArrow(_meeting(window), "bucket int, start long, stop long")

    def cut_out(texts: pa.Table, found: pa.Table) -> pa.Table:
        names = ["id", "n_bytes", "spans", "kept", "rows"]
        of = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        texts, text, begins = _joined(texts)
        start, stop = _merged(found["start"].to_numpy(), found["stop"].to_numpy())
        cuts = np.searchsorted(start, begins)
        spans, kept = [], []
        for k, (begin, end) in enumerate(zip(begins[:-1].tolist(), (begins[1:] - 1).tolist(), strict=True)):
            at, out, own = begin, [], []
            for i, j in zip(start[cuts[k] : cuts[k + 1]].tolist(), stop[cuts[k] : cuts[k + 1]].tolist(), strict=True):
                own.append({"start": i - begin, "stop": j - begin})
                out.append(text[at:i])
                at = j
            spans.append(own)
            kept.append(b"".join([*out, text[at:end]]))
        return pa.table([texts["id"], pa.array(np.diff(begins) - 1, pa.int64()), pa.array(spans, of), pa.array(kept, pa.binary()), texts["rows"]], names=names)

    return dealt.cogroup(found.groupBy("bucket")).applyInArrow(cut_out, f"id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary, rows long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """Every row of ``docs`` with its text less what an earlier document has.

    Columns: ``id_col``, n_bytes long, spans (array of start and stop, the
    maximal runs of removed bytes), kept (the bytes that remain). A byte goes
    if a string of ``window`` bytes that covers it also starts in a document of
    a smaller id; strings are judged on the input and lie within one document.
    A null text is empty; a null id is larger than all others. Rows that share
    an id don't take from one another, so repeats within one document and of
    whole rows stay. Texts shorter than the window stay. Texts of any length
    are looked at as a whole. An empty table gives an empty table; other
    columns are not read.
    """
    if window < GRAM:
        raise ValueError(f"windows of {window} bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("holder"), text.alias("text"), F.xxhash64(text).alias("tk"), F.unhex(F.sha2(text, 256)).alias("sha"))
    # copies of a whole text are settled by their number alone
    by_holder = rows.groupBy("sha", "holder").agg(F.count(F.lit(1)).alias("rows"))
    copies = checkpointed(by_holder.groupBy("sha").agg(F.min("holder").alias("earliest"), F.sum("rows").alias("n"), F.min_by("rows", "holder").alias("same")).filter("n > 1"))
    marked = with_groups(rows, copies, ["sha"], "n", "left")
    late = F.col("earliest").isNotNull() & (F.col("earliest") < F.col("holder")) & (F.octet_length("text") >= window)
    own = marked.filter(~late).select("id", "holder", "tk", "text", "sha", "same")
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    no_span = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop")))
    gone = marked.filter(late).select("id", n_bytes, whole.alias("spans"), F.unhex(F.lit("")).alias("kept"))
    short = own.filter(F.octet_length("text") < window).select("id", n_bytes, no_span.alias("spans"), F.col("text").cast("binary").alias("kept"))

    long = own.filter(F.octet_length("text") >= window)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if copies.filter("same > 1").isEmpty():
        left = _less_repeats(long.select("id", "holder", "tk", "text", F.lit(1).cast("long").alias("rows")), total, window, hot_texts).drop("rows")
    else:  # of rows that repeat id and text one is looked at, and returned as often
        again = F.coalesce("same", F.lit(1)) > 1
        one = long.filter(again).groupBy("id", "sha").agg(F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in ("holder", "tk", "text")))
        once = long.filter(~again).withColumn("rows", F.lit(1).cast("long")).unionByName(one, allowMissingColumns=True)
        left = _less_repeats(once.select("id", "holder", "tk", "text", "rows"), total, window, hot_texts)
        left = left.select("id", "n_bytes", "spans", "kept", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row")).drop("row")
    return left.unionByName(gone).unionByName(short).withColumnRenamed("id", id_col)
