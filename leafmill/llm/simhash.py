"""SimHash near-duplicates: fingerprints of whole texts, linked at TAU or fewer differing bits.

Candidates come by the generalised pigeonhole principle. Bits that agree often in a bounded sample are grouped into
partitions; a dynamic program gives each partition a threshold (-1: not probed) so that the thresholds plus one add
up to TAU + 1 and the estimated candidates and probes are fewest. Two fingerprints within TAU bits then agree within
its threshold in at least one partition. Buckets of up to BUCKET fingerprints are verified pair by pair; a
fingerprint in a larger bucket goes the exact way that is linear in the bucket: it is listed under itself and its 64
one-bit neighbours, and those listed together (65 at most, all within two bits) are linked to their smallest.

Null and empty texts have fingerprint zero and are linked like any other; texts of one or two words have one shingle.
Long texts are hashed in windows that share two words. Empty tables give empty results; extra columns are not seen.
Equal fingerprints are one node. A null doc_id never becomes a component_id unless its component has no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import by_sorting, columns, materialize, only, release, tune
from .graph import components

BITS, SHINGLE, SEED, TAU = 64, 3, 42, 2
#: Fingerprints of the bounded sample that partitions and thresholds are chosen from; results don't depend on it.
SAMPLE = 2048
BUCKET = 48
#: Bytes from which a text is hashed in windows.
LONG = 4 << 20
#: Fingerprints of a text under random weights, and the shingles that are weighed at once.
TABLES, SLICE = 24, 8192
_RANDOM = np.random.Generator(np.random.PCG64(20240612))
_SALTS = _RANDOM.integers(1, 1 << 63, 2 * TABLES + 1, dtype=np.uint64)
_FACTORS = _RANDOM.integers(1, 1 << 63, TABLES, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined_words(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words, lower-cased, each followed by one space; their starts and ends there, and each row's first word."""
    starts, ends, first = ws.words(data, off)
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    out = np.full(int(at[-1]), 32, np.uint8)
    if len(size):
        inside = ~ws.SPACE[data]
        # The k-th byte inside words moves right by one for each word before its own.
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _LOWER[data[inside]]
    return out.tobytes(), at[:-1], at[:-1] + size, first


def bit_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many of its shingles' hashes have each bit, and how many shingles it has."""
    text, starts, ends, first = joined_words(data, off)
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    word = np.arange(int(begin[-1])) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    last = np.minimum(word + SHINGLE, np.repeat(first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[i:j], SEED) for i, j in zip(starts[word].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(word))
    sums = np.zeros((len(n), BITS), np.int64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[some] = np.add.reduceat(bits, begin[some], axis=0, dtype=np.int32)
    return sums, count


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    if len(off) == 2 and len(data) > LONG:
        sums, count = np.zeros((1, BITS), np.int64), np.zeros(1, np.int64)
        for k, some in enumerate(ws.word_windows(data, SHINGLE - 1)):
            more, n = bit_counts(some, np.array([0, len(some)]))
            # A window that ends the text may have no shingle of its own beyond what the one before had.
            if not k or len(ws.words(some, np.array([0, len(some)]))[0]) >= SHINGLE:
                sums, count = sums + more, count + n
    else:
        sums, count = bit_counts(data, off)
    return np.packbits(sums * 2 > count[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row of docs."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(*ws.buffers(part.column("text"))).view(np.int64))], ["doc_id", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def weighted_fingerprints(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """TABLES fingerprints for each row's set of shingle hashes, rows x TABLES; rows without shingles have no use of theirs.

    A shingle weighs 2 ** 32 / r in a table, r being its own random number from 1 to 2 ** 32 there. So few shingles
    decide a table's fingerprint, and sets that share most of theirs differ in few bits of many tables, though in a
    seventh of the bits by equal weights. Sums are whole numbers below 2 ** 53: exact, and alike in any order.
    """
    out, sums = np.zeros((len(begin) - 1, TABLES), np.uint64), np.zeros((TABLES, BITS))
    for a in range(0, len(hashes), SLICE):
        some = hashes[a : a + SLICE]
        signs = np.unpackbits(ws.mix(some ^ _SALTS[0]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1
        weights = np.floor(2.0**32 / ((((some ^ _SALTS[1 : TABLES + 1, None]) * _FACTORS[:, None]) >> np.uint64(32)) + 1.0))
        for row in range(int(np.searchsorted(begin, a, "right")) - 1, int(np.searchsorted(begin, a + len(some)))):
            i, j = max(int(begin[row]) - a, 0), min(int(begin[row + 1]) - a, len(some))
            if i < j:
                sums += weights[:, i:j] @ signs[i:j]
                if begin[row + 1] <= a + len(some):
                    out[row] = np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0]
                    sums[:] = 0
    # No two tables share fingerprints, so that all can be linked at once.
    return out ^ _SALTS[TABLES + 1 :]


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def grouped_bits(fps: np.ndarray, m: int) -> list[list[int]]:
    """m near-equal groups of bit numbers, each grown by the bit that correlates most with it."""
    x = _bits(fps) if len(fps) else np.zeros((1, BITS))
    spread = x.std(0)
    c = np.abs(((x - x.mean(0)).T @ (x - x.mean(0))) / len(x) / np.maximum(np.outer(spread, spread), 1e-9))
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (c[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def allocate(fps: np.ndarray, groups: list[list[int]], total: int, tau: int = TAU) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(t + 1) = tau + 1, by dynamic programming on estimated pairs and probes."""
    x = _bits(fps)
    n = max(len(fps), 2)
    costs = []
    for group in groups:
        y = x[:, group]
        apart = y.sum(1)[:, None] + y.sum(1)[None, :] - 2 * y @ y.T
        ball, row = 0, [0.0]
        for t in range(tau + 1):
            ball += len(list(combinations(range(len(group)), t)))
            # Pairs of the sample agree by chance only once in a while: at least what independent bits would give.
            pairs = max(((apart <= t + 0.5).sum() - len(fps)) / (n * (n - 1)), ball / 2.0 ** len(group))
            row.append(total * ball + pairs * float(total) ** 2 / 2)
        costs.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, tau + 1):
                if used + t + 1 <= tau + 1:
                    there = (cost + row[t + 1], [*ts, t])
                    after[used + t + 1] = min(after.get(used + t + 1, (float("inf"), [])), there)
        best = after
    return best[tau + 1]


def plan(fps: np.ndarray, total: int) -> list[tuple[list[int], int]]:
    """The probed partitions and their thresholds."""
    found = min((allocate(fps, groups, total), groups) for groups in (grouped_bits(fps, m) for m in (2, 3, 4)))
    return [(g, t) for g, t in zip(found[1], found[0][1], strict=True) if t >= 0]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """a, b: links between different fingerprints of nodes (fp) that connect all within TAU bits of each other.

    If nodes have a `table`, only fingerprints of one table need be connected.
    """
    exact, probes = None, None
    table = F.col("table").cast("int") if "table" in nodes.columns else F.lit(0)
    for k, (group, t) in enumerate(chosen):
        mask = sum(1 << b for b in group)
        flips = [sum(1 << b for b in some) for d in range(t + 1) for some in combinations(group, d)]
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long"))
        here = nodes.select("fp", (F.lit(k) + len(chosen) * table).alias("part"), key.alias("key"))
        exact = here if exact is None else exact.unionByName(here)
        there = here.withColumn("key", F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(_signed(f)).cast("long")) for f in flips]))) if t else here
        probes = there if probes is None else probes.unionByName(there)
    assert exact is not None and probes is not None
    plain = not any(t for _, t in chosen)
    exact = materialize(exact, "keys")
    probes = exact if plain else materialize(probes, "probes")
    several = materialize(probes.groupBy("part", "key").count().where(F.col("count") > (1 if plain else BUCKET)), "several")
    full = by_sorting(several.where(F.col("count") > BUCKET).select("part", "key"))
    crowded = probes.join(full, ["part", "key"], "left_semi").select("fp").distinct()
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= TAU
    # Where nothing is probed both sides are the same rows, and only keys that several have are of use.
    left = probes.join(by_sorting(several.where(F.col("count") <= BUCKET)), ["part", "key"], "left_semi") if plain else probes.join(full, ["part", "key"], "left_anti")
    left = left.select("part", "key", F.col("fp").alias("a"))
    right = left.withColumnRenamed("a", "b") if plain else exact.select("part", "key", F.col("fp").alias("b"))
    pairs = left.join(by_sorting(right), ["part", "key"]).where((F.col("a") != F.col("b")) & near).select("a", "b")
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in range(BITS)])
    balls = crowded.select("fp", F.explode(around).alias("key")).groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("in")).where(F.size("in") > 1)
    stars = balls.select(F.explode(F.slice("in", 2, BITS)).alias("a"), F.col("in")[0].alias("b"))
    out = materialize(pairs.unionByName(stars).distinct(), "near")
    release(*([exact] if plain else [exact, probes]), several)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs; component_id is the smallest doc_id reachable by links."""
    prints = materialize(fingerprint(docs), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    total = nodes.count()
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    if total < 2:
        known = nodes.select("fp", F.col("first_id").alias("component_id"))
    else:
        found = links(nodes.select("fp"), plan(sample, total))
        roots = components(found)
        placed = nodes.join(by_sorting(roots), nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
        least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
        known = materialize(placed.join(by_sorting(least), "root").select("fp", "component_id"), "known")
    return prints.join(by_sorting(known), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of docs, all columns as they are, whose doc_id is its component's smallest; one row a component.

    Rows that repeat a doc_id are one document, of which one row stays; rows without doc_id are kept. `classes` gives
    doc_id and component_id.
    """
    found = materialize(classes(docs), "classes")
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    ids, again = kept.select("doc_id"), kept.where("_n > 1").select("doc_id")
    out = docs.join(ids, "doc_id", "left_semi").select(*columns(docs))
    if not again.isEmpty():
        repeats = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*columns(docs))
        out = out.join(again, "doc_id", "left_anti").select(*columns(docs)).unionByName(repeats)
    return out.unionByName(docs.where("doc_id is null"))
