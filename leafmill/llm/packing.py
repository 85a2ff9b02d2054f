"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Tokenised documents are cut into pieces of up to CAPACITY. Pieces are range-sorted by length and numbered within it,
without any single-task sort. As lengths are whole numbers up to CAPACITY, sorted pieces and sorted gaps are tables of
runs: (length, first rank, number) and (gap, first sequence, number). A round goes over these tables:

1. Every length finds its successor, the smallest gap that holds it, and bundles as many pieces as that gap holds.
2. A sweep in falling order of size, gaps before bundles, matches a bundle with the last gap that is still open: of the
   gaps that are left, the smallest that holds it. Longer bundles come first and ranks decide among equals, so no two
   get one gap, and what finds none waits.
3. Matched gaps shrink by their bundle, and the round is repeated. Where nothing is matched any more, sequences are
   opened for what no gap holds. Lengths take part from the longest on, one halving after the other.

The tables have a few rows for each possible length, whatever the number of pieces, so the rounds are run on the
driver over collected counts (one query of Spark a round gave the same runs at a second or more for each of some fifty
rounds). Pieces themselves never come to it: Spark cuts, sorts, ranks and counts them, and they find their run by
length and rank in the end.

Null and empty texts are one piece, the closing id alone; empty tables give no pieces. Repeated rows are packed once
each; ties of length go by doc_id, piece and crc32. A document's pieces never share anything but the sequence they may
meet in. Extra columns are not seen. Long texts are encoded in parts that end at white space.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import materialize, only, ranked, tune

CAPACITY, CLOSING = 2048, 0
#: Bytes from which a text is encoded in parts.
LONG = 4 << 20
VOCABULARY = "word_bpe_49k.json"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of a to z and the small letters of Latin-1, once lower-cased: normal form C, one run of letters.
_PLAIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Byte-level vocabularies write printable bytes as themselves and the k-th other byte as character 256 + k.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_POINT = np.isin(np.arange(256), list(b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~'))
_ALNUM = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of texts by a tokenizer that lower-cases and never joins across white space.

    Each word is looked up by the hash of its lower-cased bytes in an open-addressing table of words already encoded;
    only new words are encoded. Punctuation that ends a word after a letter or digit is a word of its own (the
    tokenizer splits there anyway). Texts with a special token's opening go to the tokenizer as they are. When the
    table has `room` words, later new words are encoded anew for each batch: results don't depend on it.
    """

    SLOTS = 1 << 21

    def __init__(self, path: str, room: int = SLOTS // 2) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The same model without normaliser and splitter, for words of letters that need neither.
        bare = json.loads(self.tokenizer.to_str())
        bare |= {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.room = room
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.entry = np.full(self.SLOTS, -1, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.known = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = self.entry[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.SLOTS - 1)
            out[open_] = self.entry[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != hashes[open_])]
        return out

    def _encode(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        plain = np.fromiter((_PLAIN(w) is not None for w in some), bool, len(some))
        sizes, parts = np.zeros(len(some), np.int64), []
        for tokenizer, own in ((self.bare, np.flatnonzero(plain)), (self.tokenizer, np.flatnonzero(~plain))):
            given = [some[i] for i in own.tolist()]
            if tokenizer is self.bare:
                given = [w.lower() if w.isascii() else w.lower().encode().decode("latin-1").translate(_VISIBLE) for w in given]
            done = tokenizer.encode(given, is_pretokenized=True, add_special_tokens=False)
            sizes[own] = np.bincount(np.array(done.word_ids, np.int64), minlength=len(own)) if len(own) else 0
            parts.append((own, np.array(done.ids, np.uint32)))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.zeros(begin[-1], np.uint32)
        for own, got in parts:
            n = sizes[own]
            ids[np.arange(len(got)) + np.repeat(begin[own] - (np.cumsum(n) - n), n)] = got
        return ids, sizes

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add distinct new hashes with their ids."""
        n, used = len(hashes), int(self.begin[self.known])
        if self.known + n + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(max(n + 1, len(self.begin)), np.int64)])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), self.ids.dtype)])
        self.ids[used : used + len(ids)] = ids
        self.begin[self.known + 1 : self.known + n + 1] = used + np.cumsum(sizes)
        number = np.arange(self.known, self.known + n, dtype=np.int32)
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            self.entry[slot[free]] = number[free]
            self.keys[slot[free]] = hashes[free]
            left = left[self.entry[slot[left]] != number[left]]
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)
        self.known += n

    def _words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, ending punctuation apart, and each text's first."""
        starts, ends, first = ws.words(data, off)
        tail, open_ = ends.copy(), np.arange(len(ends))
        while len(open_):
            open_ = open_[(tail[open_] - 1 > starts[open_]) & _POINT[data[tail[open_] - 1]]]
            tail[open_] -= 1
        before, lead = data[tail - 1], data[np.maximum(tail - 2, 0)]
        sure = _ALNUM[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (tail - 2 >= starts))
        apart = (tail < ends) & sure
        shift = np.concatenate([[0], np.cumsum(apart)])
        at = np.arange(len(starts)) + shift[:-1]
        all_starts, all_ends = np.empty(len(starts) + shift[-1], np.int64), np.empty(len(starts) + shift[-1], np.int64)
        all_starts[at], all_ends[at] = starts, np.where(apart, tail, ends)
        all_starts[at[apart] + 1], all_ends[at[apart] + 1] = tail[apart], ends[apart]
        return all_starts, all_ends, first + shift[first]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first (n + 1)."""
        raw = data.tobytes()
        special = set()
        at = raw.find(b"<|")
        while at >= 0:
            row = int(np.searchsorted(off, at, "right")) - 1
            special.add(row)
            at = raw.find(b"<|", int(off[row + 1]))
        starts, ends, first = self._words(data, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        hashes = ws.range_hash(ws.prefix_hash(_LOWER[data]), starts, ends)
        kind = self._find(hashes)
        new = np.flatnonzero(kind < 0)
        ids, begin, sizes = self.ids, self.begin, None
        if len(new):
            keys, example = np.unique(hashes[new], return_index=True)
            example = new[example]
            some = [raw[i:j].decode("utf-8", "replace").replace("<|", "<") for i, j in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
            fresh, sizes = self._encode(some)
            if self.known + len(keys) <= self.room:
                self._learn(keys, fresh, sizes)
                ids, begin = self.ids, self.begin
                kind[new] = self._find(hashes[new])
            else:
                kind[new] = self.known + np.searchsorted(keys, hashes[new])
                used = int(self.begin[self.known])
                ids = np.concatenate([self.ids[:used].astype(np.uint32), fresh])
                begin = np.concatenate([self.begin[: self.known + 1], used + np.cumsum(sizes)])
        n = begin[kind + 1] - begin[kind]
        at = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.arange(at[-1]) + np.repeat(begin[kind] - at[:-1], n)].astype(np.uint32)
        bounds = at[first]
        if special:
            parts, sizes = [], np.diff(bounds)
            for row in range(len(off) - 1):
                if row in special:
                    own = self.tokenizer.encode(raw[int(off[row]) : int(off[row + 1])].decode("utf-8", "replace"), add_special_tokens=False).ids
                    parts.append(np.array(own, np.uint32))
                    sizes[row] = len(own)
                else:
                    parts.append(flat[bounds[row] : bounds[row + 1]])
            flat, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return flat, bounds


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process, so that its table serves all the tasks it runs."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every row of docs."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            for part in ws.pieces(batch, limit=1 << 20):
                data, off = ws.buffers(part.column("text"))
                if part.num_rows == 1 and len(data) > LONG:
                    own = [tokens.encode(some, np.array([0, len(some)]))[0] for some in ws.word_windows(data)]
                    ids = np.concatenate(own)
                    first = np.array([0, len(ids)])
                else:
                    ids, first = tokens.encode(data, off)
                doc, piece, start, length, crc = [], [], [], [], []
                for row, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    own = np.append(ids[i:j], np.uint32(CLOSING)).astype("<u4")
                    for k in range(0, len(own), capacity):
                        some = own[k : k + capacity]
                        doc.append(row)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(some))
                        crc.append(zlib.crc32(some.tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(pieces: dict[int, tuple[int, int]], gaps: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """One round: what is placed (length, first rank, bundles, each, first sequence, gap), and the gaps after it.

    pieces: first rank and number by length; gaps: runs (gap, first sequence, number).
    """
    sizes = sorted({gap for gap, _, _ in gaps})
    events = [(gap, 1, sequence, number, 0) for gap, sequence, number in gaps]
    for length, (_, number) in pieces.items():
        at = bisect_left(sizes, length)
        if at < len(sizes):
            each = sizes[at] // length
            whole, rest = divmod(number, each)
            events += [(n * length, 0, length, times, n) for n, times in ((each, whole), (rest, 1)) if n and times]
    # Falling by size, gaps before bundles: the last gap still open is the smallest that holds the bundle.
    open_gaps: list[tuple[int, int, int]] = []
    placed, after = [], []
    rank = {length: first for length, (first, _) in pieces.items()}
    for size, is_gap, name, number, each in sorted(events, reverse=True):
        if is_gap:
            open_gaps.append((size, name, number))
            continue
        while number and open_gaps:
            gap, sequence, there = open_gaps.pop()
            n = min(number, there)
            if there > n:
                open_gaps.append((gap, sequence, there - n))
            first = sequence + there - n
            placed.append((name, rank[name], n, each, first, gap))
            if gap > size:
                after.append((gap - size, first, n))
            rank[name] += n * each
            number -= n
    return placed, after + open_gaps


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, number, per sequence, first sequence, offset) that place `counts` pieces by length."""
    left = {length: (0, n) for length, n in counts.items() if n}
    gaps: list[tuple[int, int, int]] = []
    runs, opened, least = [], 0, capacity
    while left:
        some = {length: of for length, of in left.items() if length >= least}
        if not some:
            least = max(1, least // 2)
            continue
        placed, after = sweep(some, [g for g in gaps if g[0] >= least])
        if not placed:
            more = math.ceil(sum(Fraction(n, capacity // length) for length, (_, n) in some.items()))
            gaps.append((capacity, opened, more))
            opened += more
            continue
        gaps = [g for g in gaps if g[0] < least] + after
        for length, rank, bundles, each, sequence, gap in placed:
            n = bundles * each
            runs.append((length, rank, n, each, sequence, capacity - gap))
            first, number = left[length]
            left[length] = (first + n, number - n)
        left = {length: of for length, of in left.items() if of[1]}
    return runs


def _table(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(names)}))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs."""
    spark = docs.sparkSession
    pieces = materialize(ranked(cut(docs, path or vocabulary_path(), capacity), ["length"], ["doc_id", "piece", "ids_crc32"], index="rank"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    names = ("_length", "_rank", "_number", "_each", "_first", "_offset")
    # A few runs for each possible length: bounded by the capacity, so that they can be sent to every task.
    runs = F.broadcast(_table(spark, names, rounds(counts, capacity)))
    here = F.col("rank") - F.col("_rank")
    found = pieces.join(runs, (F.col("length") == F.col("_length")) & (here >= 0) & (here < F.col("_number")))
    sequence = (F.col("_first") + F.floor(here / F.col("_each"))).cast("long")
    offset = (F.col("_offset") + (here % F.col("_each")) * F.col("length")).cast("long")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
