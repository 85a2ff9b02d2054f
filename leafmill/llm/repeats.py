"""Suffix-array dedup: bytes covered by strings that start in more than one place.

For strings of one length (a Scale):

1. Anchors. Every window of that length has an anchor: of its strings of `kmer` bytes the leftmost with the smallest
   quick hash, known from then on by a hash of 62 bits, which is made of the anchors alone. A run of windows with one anchor is a context of fewer than twice the length. Equal windows have equal anchors
   at equal distances, so only contexts whose anchor's hash occurs twice or more can hold a repeated window.
2. Buckets. Contexts are dealt by their anchor's hash; equal ones become one with its number of copies, counted
   before the shuffle. Their bytes are fetched once from one text that has them. The contexts of an anchor that has
   more than CROWD are dealt anew, window by window, by an anchor under another hash; so a frequent string whose
   surroundings differ is spread over as many buckets, and what stays together has more than one string in common.
3. Burrows-Wheeler transforms. The contexts of a bucket are split into even shards of about SHARD bytes. Over an alphabet of
   blocks of bytes each shard's suffixes are sorted and its transform (the block before each suffix) kept; shards are
   then merged, two by two, from their transforms alone by refining an interleave: a stable sort of the interleaved
   symbols orders suffixes by one more block. In the last merge the places where neighbours part give the common
   prefixes; after length / block rounds an interval without such a place is a set of equal windows, repeated if it
   has two copies or more.
4. The repeated windows go back to every text with the context; their union is the text's repeated bytes.

It is done twice: for PASSAGE over distinct texts, and for WHOLE over the repeated stretches that this has found, as
every string of the longer kind lies in one of them.

Null texts are empty; texts below the length lose nothing; repeated rows are separate documents, so that all they have
is repeated if it is long enough. Ties don't matter, as all copies are treated alike. Empty tables give empty results;
extra columns are not seen. Block, context and text identity rests on hashes of 62 bits and more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import materialize, only, partitions, release, text_or_empty, tune


@dataclass(frozen=True)
class Scale:
    """Strings of `length` bytes, with anchors of `kmer` bytes and a transform over blocks of `block` bytes."""

    length: int
    kmer: int
    block: int

    @property
    def span(self) -> int:
        return self.length - self.kmer + 1


WHOLE, PASSAGE = Scale(400, 128, 200), Scale(256, 96, 128)
#: Words from which a repeated stretch counts as a passage.
PASSAGE_WORDS = 50
CROWD, CHUNK, SHARD = 4_000, 1 << 19, 1 << 18
#: How often contexts of a crowded anchor are dealt anew; what is crowded still is merged as it is.
LEVELS = 3
#: Bits of a packed key that hold a place; longer texts are scanned in slices.
_PLACE = 23
#: Places whose hashes are made at a time, so that what that takes stays in the processor's cache.
_STEP = 1 << 15
#: Odd, with its powers and numbers for bytes modulo 2 ** 64 for the hash that only chooses anchors.
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(20240608)).integers(1, 1 << 64, 256, dtype=np.uint64)


@cache
def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _ODD and of its inverse modulo 2 ** 64, for exponents below n."""
    up, down = (np.full(n, x, np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    up[:1], down[:1] = 1, 1
    return np.cumprod(up), np.cumprod(down)


def choosing_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A quick hash of the `width` bytes at each place. Anchors are chosen by it, nothing is held equal for it."""
    out = np.empty(max(0, len(data) - width + 1), np.uint64)
    up, down = _odd_powers(_STEP + width)
    for at in range(0, len(out), _STEP):
        some = data[at : at + _STEP + width - 1]
        n = len(some) - width + 1
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(_BYTE[some] * up[: len(some)], out=sums[1:])
        np.multiply(sums[width:] - sums[:n], down[:n], out=out[at : at + n])
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """wordscan.prefix_hash with the bytes as they are, whose sums need no residues: for up to 2 ** 23 bytes."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    power = ws.powers(len(data))
    for k in range(2):
        np.cumsum(np.multiply(data, power[k], dtype=np.uint64), out=out[k, 1:])
    return out


def place_hash(data: np.ndarray, width: int) -> np.ndarray:
    """62 bits for the `width` bytes at each place, by both polynomials."""
    out = np.empty(max(0, len(data) - width + 1), np.uint64)
    for at in range(0, len(out), _STEP):
        some = data[at : at + _STEP + width - 1]
        n = len(some) - width + 1
        sums, inverse = prefix_hash(some), ws.powers(n)[2:]
        high, low = (ws.product(sums[k, width:] - sums[k, :n], inverse[k]) for k in range(2))
        out[at : at + n] = (high << np.uint64(31)) | low
    return out


def contexts(data: np.ndarray, off: np.ndarray, scale: Scale, salt: int = 0) -> tuple[np.ndarray, ...]:
    """As _contexts, in slices of 2 ** _PLACE bytes that share length - 1: every window is in one slice.

    A context that a slice's end parts becomes two under one anchor.
    """
    limit = 1 << _PLACE
    if len(data) <= limit:
        return _contexts(data, off, scale, salt)
    parts = [_contexts(data[:0], off[:1], scale, salt)]
    for k, (start, end) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        for at in range(start, end - scale.length + 1, limit - scale.length + 1):
            some = data[at : min(at + limit, end)]
            row, begin, *rest = _contexts(some, np.array([0, len(some)]), scale, salt)
            parts.append((row + k, begin + at - start, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _contexts(data: np.ndarray, off: np.ndarray, scale: Scale, salt: int) -> tuple[np.ndarray, ...]:
    """Row, first window (from the row's start), number of windows, anchor hash and hash of each context."""
    n = len(data) - scale.length + 1
    count = np.maximum(np.diff(off) - scale.length + 1, 0)
    if n <= 0 or not count.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    chosen = choosing_hash(data, scale.kmer)
    if salt:
        chosen = ws.mix(chosen ^ ws.mix(np.full(1, salt, np.uint64)))
    low = np.uint64((1 << _PLACE) - 1)
    span = scale.span
    blocks = -(-len(chosen) // span)
    table = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    np.bitwise_or(chosen & ~low, np.arange(len(chosen), dtype=np.uint64), out=table[: len(chosen)])
    table = table.reshape(blocks, span)
    upto = np.minimum.accumulate(table, axis=1).reshape(-1)
    onward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(onward[:n], upto[span - 1 : span - 1 + n])
    # A context begins where the anchor changes and at a row's first window, and ends before the next or with its row.
    full = np.flatnonzero(count)
    fresh = np.ones(n, bool)
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[off[full]] = True
    begin = np.flatnonzero(fresh)
    row = np.searchsorted(off, begin, "right") - 1
    inside = begin < off[row] + count[row]
    begin, row = begin[inside], row[inside]
    number = np.minimum(np.append(begin[1:], n), off[row] + count[row]) - begin
    place = (least[begin] & low).astype(np.int64)
    sums = prefix_hash(data)
    return row, begin - off[row], number, ws.range_hash(sums, place, place + scale.kmer), ws.range_hash(sums, begin, begin + number + scale.length - 1)


def stable_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """argsort(kind="stable") of numbers of 0 up, by one sort of the numbers with their places below them; and sorted."""
    bits = np.int64(max(1, len(symbols)).bit_length())
    keys = (symbols << bits) | np.arange(len(symbols))
    keys.sort()
    return keys & ((np.int64(1) << bits) - 1), keys >> bits


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of hashes of 62 bits, and a number from 1 for each of the different ones, in that order.

    One sort of their upper bits with their places below them.
    """
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    keys = ((hashes << np.uint64(2)) & ~low) | np.arange(len(hashes), dtype=np.uint64)
    keys.sort()
    order = (keys & low).view(np.int64)
    full = hashes[order]
    parts = np.ones(len(hashes), bool)
    parts[1:] = full[1:] != full[:-1]
    if np.any(parts[1:] & ((keys[1:] ^ keys[:-1]) <= low)):
        # Different hashes with equal upper bits may stand mixed.
        order = np.argsort(hashes, kind="stable")
        full = hashes[order]
        parts[1:] = full[1:] != full[:-1]
    return order, np.cumsum(parts)


class Transform:
    """A shard's suffixes in sorted order by what stands before each (`symbols`, 0 at a string's start) and where it is."""

    def __init__(self, symbols: np.ndarray, where: np.ndarray) -> None:
        self.symbols, self.where = symbols, where


def transform(symbols: np.ndarray, off: np.ndarray, block: int, first: np.ndarray) -> Transform:
    """From the block number (1 up) at each place and the strings' first places: sorted to the end of every string.

    Each string is `block` interleaved strings of blocks; the places past its last whole block are their ends. `first`
    has the other places in the order of their numbers, which is the first round.
    """
    before = np.zeros(len(symbols), np.int64)
    before[block:] = symbols[:-block]
    before[(off[:-1, None] + np.arange(block)).reshape(-1)] = 0
    ends = np.flatnonzero(symbols == 0)
    order = np.concatenate([ends, first])
    for _ in range(_deepest(off, block) - 1):
        # Whoever has a block before it leads to the suffix one block longer; the ends come first.
        led = before[order]
        some = np.flatnonzero(led)
        ranked, _ = stable_order(led[some])
        order = np.concatenate([ends, order[some][ranked] - block])
    return Transform(before[order], order)


def _deepest(off: np.ndarray, block: int) -> int:
    """Blocks of the longest suffix, as a string of m bytes has m + 1 places; the ends need no round."""
    return max(1, (int(np.diff(off).max(initial=1)) - 1) // block)


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """The two as one, sorted by `depth` blocks, and a number for each set of entries with the same blocks there."""
    # In the first round the order by one block, a's entries before b's, follows from how often each symbol is there.
    most = 1 + max(int(x.symbols.max(initial=0)) for x in (a, b))
    often = np.stack([np.bincount(x.symbols, minlength=most) for x in (a, b)], axis=1)
    side = np.repeat(np.tile([False, True], most), often.reshape(-1))
    group = np.repeat(np.arange(most), often.sum(axis=1))
    of_a, of_b = np.flatnonzero(~side), np.flatnonzero(side)
    symbols = np.empty(len(side), np.int64)
    for k in range(depth):
        if k:
            order, ranked = stable_order(symbols)
            side, group = side[order], group[order]
            parts = np.ones(len(side), bool)
            # Two ends never part; other suffixes part by their first block or by what follows it.
            parts[1:] = (ranked[1:] != ranked[:-1]) | ((group[1:] != group[:-1]) & (ranked[1:] > 0))
            group = np.cumsum(parts)
            of_a, of_b = np.flatnonzero(~side), np.flatnonzero(side)
        # The entries of each side in turn, in its own order.
        symbols[of_a], symbols[of_b] = a.symbols, b.symbols
    where = np.empty(len(side), np.int64)
    where[of_a], where[of_b] = a.where, b.where
    return Transform(symbols, where), group


def repeated_windows(texts: list[bytes], copies: np.ndarray, scale: Scale, shard: int = SHARD) -> list[np.ndarray]:
    """For each context: which of its windows are in the contexts twice or more, copies counted."""
    block = scale.block
    size = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    # A string of m bytes has m - block + 1 places with a block, and `block` ends.
    narrow = off + np.arange(len(texts) + 1)

    def until(last: np.ndarray, rest: int) -> np.ndarray:
        """Of each string the places up to its last, without the `rest` that follow."""
        return np.repeat(np.tile([True, False], len(texts)), np.stack([last + 1, np.full(len(texts), rest)], axis=1).reshape(-1))

    whole = np.flatnonzero(until(size - block, block))
    hashes = place_hash(data, block)
    order, number = numbered(hashes[until(size - block, block - 1)[: len(hashes)]])
    order = whole[order]
    symbols = np.zeros(int(narrow[-1]), np.int64)
    symbols[order] = number
    # Shards of whole strings, two at least, of about equal size.
    several = max(2, round(int(off[-1]) / shard))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(off, np.arange(1, several) * int(off[-1]) // several), [len(texts)]]))
    if len(cuts) == 2:
        cuts = np.unique(np.array([0, -(-len(texts) // 2), len(texts)]))
    shards = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        start, end = narrow[lo], narrow[hi]
        first = order[(order >= start) & (order < end)] - start
        t = transform(symbols[start:end], narrow[lo : hi + 1] - start, block, first)
        t.where = t.where + start
        shards.append(t)
    if len(shards) == 1:
        shards.append(Transform(symbols[:0], symbols[:0]))
    deepest = _deepest(narrow, block)
    while len(shards) > 2:
        shards = [merge(*shards[k : k + 2], deepest)[0] if k + 1 < len(shards) else shards[k] for k in range(0, len(shards), 2)]
    last, group = merge(*shards, scale.length // block)
    windows = until(size - scale.length, scale.length)
    is_window = windows[last.where]
    where, group = last.where[is_window], group[is_window]
    total = np.bincount(group, np.repeat(copies, size + 1)[where])
    flag = np.zeros(len(symbols), bool)
    flag[where] = total[group] > 1.5
    return [flag[narrow[i] : narrow[i] + size[i] - scale.length + 1] for i in range(len(texts))]


def _edges(flag: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8))).tolist()


Batches = Iterator[pa.RecordBatch]


def _marked(scale: Scale) -> Callable[[Batches], Batches]:
    """Of rows sorted by anchor, whole anchors are gathered up to CHUNK bytes and merged."""

    def flush(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        flags = repeated_windows([x[3] for x in held], np.array([x[2] for x in held], float), scale)
        columns = [[x[0] for x in held], [x[1] for x in held], [_edges(f) for f in flags]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["anchor", "hash", "spans"])

    def run(batches: Batches) -> Batches:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > CHUNK and held[-1][0] != row[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    return run


def _anew(scale: Scale, level: int) -> Callable[[Batches], Batches]:
    """The contexts of crowded anchors cut into contexts of anchors under the hash of this level."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in ws.pieces(batch, "bytes"):
                data, off = ws.buffers(part.column("bytes"))
                row, begin, number, anchor, hash_ = contexts(data, off, scale, level)
                parent = part.take(pa.array(row))
                raw = data.tobytes()
                start = (off[row] + begin).tolist()
                some = [raw[i : i + n + scale.length - 1] for i, n in zip(start, number.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([parent.column("anchor"), parent.column("hash"), pa.array(begin.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(hash_.view(np.int64)), parent.column("copies"), pa.array(some, pa.binary())], ["of_anchor", "of_hash", "at", "anchor", "hash", "copies", "bytes"])

    return run


def _marks(fetched: DataFrame, scale: Scale, level: int = 1) -> DataFrame:
    """anchor, hash, spans (starts and ends of runs of repeated windows) of contexts (anchor, hash, copies, bytes)."""
    spark = fetched.sparkSession
    crowded = materialize(fetched.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor"), "crowded")
    anew = level <= LEVELS and not crowded.isEmpty()
    calm = fetched.join(crowded, "anchor", "left_anti") if anew else fetched
    calm = calm.select("anchor", "hash", "copies", "bytes").repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", "hash")
    marks = calm.mapInArrow(_marked(scale), "anchor long, hash long, spans array<int>").where(F.size("spans") > 0)
    if anew:
        schema = "of_anchor long, of_hash long, at int, anchor long, hash long, copies long, bytes binary"
        parts = materialize(fetched.join(crowded, "anchor", "left_semi").select("anchor", "hash", "copies", "bytes").mapInArrow(_anew(scale, level), schema), "anew")
        below = _marks(materialize(parts.groupBy("anchor", "hash").agg(F.sum("copies").alias("copies"), F.first("bytes").alias("bytes")), "below"), scale, level + 1)
        back = parts.select("of_anchor", "of_hash", "at", "anchor", "hash").join(below, ["anchor", "hash"])
        shifted = F.transform("spans", lambda s: s + F.col("at"))
        again = back.groupBy(F.col("of_anchor").alias("anchor"), F.col("of_hash").alias("hash")).agg(F.flatten(F.collect_list(shifted)).alias("spans"))
        marks = marks.unionByName(again)
    return materialize(marks, "marks")


def _found(scale: Scale) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in ws.pieces(batch, "data", limit=1 << 19):
                row, begin, number, anchor, hash_ = contexts(*ws.buffers(part.column("data")), scale)
                of = part.select(["key", "n"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*of.columns, pa.array(begin.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(hash_.view(np.int64))], ["key", "n", "begin", "number", "anchor", "hash"])

    return run


def _fetched(scale: Scale) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for data, wanted in zip(batch.column("data"), batch.column("wanted"), strict=True):
                raw = data.as_py()
                rows = [(w["anchor"], w["hash"], w["copies"], raw[w["begin"] : w["begin"] + w["number"] + scale.length - 1]) for w in wanted.as_py()]
                for k in range(0, len(rows), 4096):
                    columns = zip(*rows[k : k + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "hash", "copies", "bytes"])

    return run


def _united(scale: Scale) -> Callable[[Batches], Batches]:
    """The union of a text's repeated windows: starts and ends, in turn, of its repeated bytes."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for marks in batch.column("marks"):
                runs: list[int] = []
                for start, end in sorted((m["begin"] + m["spans"][k], m["begin"] + m["spans"][k + 1] - 1 + scale.length) for m in marks.as_py() for k in range(0, len(m["spans"]), 2)):
                    if runs and start <= runs[-1]:
                        runs[-1] = max(runs[-1], end)
                    else:
                        runs += (start, end)
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int32()))], ["key", "runs"])

    return run


def repeated(texts: DataFrame, scale: Scale) -> DataFrame:
    """key, runs of each of texts (key, data, n: how often it is there) with bytes in strings that start elsewhere too."""
    found = materialize(texts.select("key", "data", "n").mapInArrow(_found(scale), "key binary, n long, begin int, number int, anchor long, hash long"), "contexts")
    # Written, so that the join has an exchange of its own on either side, whose large partitions Spark can split.
    often = materialize(found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "often")
    live = materialize(found.join(often, "anchor", "left_semi"), "live")
    release(found, often)
    # One context for each hash: its copies, and one text and place to fetch it from.
    distinct = live.groupBy("anchor", "hash").agg(F.sum("n").alias("copies"), F.min(F.struct("key", "begin", "number")).alias("at"))
    wanted = distinct.groupBy("at.key").agg(F.collect_list(F.struct("anchor", "hash", "copies", F.col("at.begin").alias("begin"), F.col("at.number").alias("number"))).alias("wanted"))
    fetched = materialize(texts.select("key", "data").join(wanted, "key").select("data", "wanted").mapInArrow(_fetched(scale), "anchor long, hash long, copies long, bytes binary"), "fetched")
    marks = _marks(fetched, scale)
    release(fetched)
    hits = live.select("key", "begin", "anchor", "hash").join(marks, ["anchor", "hash"]).groupBy("key").agg(F.collect_list(F.struct("begin", "spans")).alias("marks"))
    out = materialize(hits.mapInArrow(_united(scale), "key binary, runs array<int>"), "runs")
    release(live, marks)
    return out


def _stretches(batches: Batches) -> Batches:
    """The repeated stretches that are long enough to hold a longer string, each under its text's key and its start."""
    for batch in batches:
        for key, data, n, runs in zip(*(batch.column(c) for c in ("key", "data", "n", "runs")), strict=True):
            ends = runs.as_py()
            raw = data.as_py()
            some = [(key.as_py() + a.to_bytes(4, "big"), raw[a:b], n.as_py()) for a, b in zip(ends[::2], ends[1::2], strict=True) if b - a >= WHOLE.length]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["key", "data", "n"])


def _removed(batches: Batches) -> Batches:
    """What is left of each text without its repeated bytes, and the passages among its repeated stretches."""
    for batch in batches:
        rows = []
        for data, stretches, parts in zip(*(batch.column(c) for c in ("data", "stretches", "parts")), strict=True):
            raw = data.as_py()
            kept, at, spans, removed = [], 0, 0, 0
            gone = sorted((p["start"] + p["runs"][k], p["start"] + p["runs"][k + 1]) for p in (parts.as_py() or ()) for k in range(0, len(p["runs"]), 2))
            for start, end in gone:
                kept.append(raw[at:start])
                spans, removed, at = spans + 1, removed + end - start, end
            kept.append(raw[at:])
            ends = stretches.as_py()
            passages = sum(len(raw[a:b].split()) >= PASSAGE_WORDS for a, b in zip(ends[::2], ends[1::2], strict=True))
            rows.append((removed, spans, hashlib.sha256(b"".join(kept)).hexdigest(), passages))
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["_key", "n_removed", "n_spans", "kept", "n_passages"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages for every row of docs.

    n_passages counts repeated stretches of PASSAGE_WORDS words or more, of strings of PASSAGE.length bytes that start
    in more than one place; they may be shorter than what is removed.
    """
    tune(docs.sparkSession)
    texts = only(docs, "doc_id", "text").withColumn("data", text_or_empty().cast("binary")).withColumn("key", F.unhex(F.md5("data")))
    long = texts.where(F.octet_length("data") >= PASSAGE.length)
    unique = materialize(long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("data").alias("data")), "texts")
    stretches = repeated(unique, PASSAGE)
    hit = materialize(unique.join(stretches, "key"), "hit")
    release(unique)
    parts = repeated(hit.mapInArrow(_stretches, "key binary, data binary, n long"), WHOLE)
    start = F.conv(F.hex(F.substring("key", 17, 4)), 16, 10).cast("long")
    of_text = parts.groupBy(F.substring("key", 1, 16).alias("_text")).agg(F.collect_list(F.struct(start.alias("start"), "runs")).alias("parts"))
    done = hit.join(of_text, hit["key"] == of_text["_text"], "left").select("key", "data", F.col("runs").alias("stretches"), "parts")
    digests = materialize(done.mapInArrow(_removed, "_key binary, n_removed long, n_spans long, kept string, n_passages long"), "digests")
    release(hit, parts)
    own = texts.select("doc_id", "key", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha"))
    joined = own.join(digests, own["key"] == digests["_key"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")]
    return joined.select("doc_id", "n_bytes", *counts, F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))
