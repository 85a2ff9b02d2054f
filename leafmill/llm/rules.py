"""Quality rules: counts over whole texts, judged by an isolation forest calibrated on labelled rows.

Each text's statistics are ratios, scaled to 0 to 1 by fixed bounds (SCALES). A tree splits a cell of that space, not
the range of its rows, by a random statistic at a random place, until a cell holds one row or none or is DEEPEST deep;
so every statistic is split over its whole range, also where the fitted rows are all alike, and a text that stands
where they don't has a short path. Each tree draws its SUBSAMPLE rows from the one half of all rows labelled good, every
other one in hash order (without such rows, from all documents), and the cut is set on the scores of the whole other
half and of all rows labelled bad. Both are done where the rows are: only the trees' draws reach the driver.

Null and empty texts have zero counts and fail the base rule (fewer than 20 words). Repeated rows are judged alike; a
doc_id that occurs more than once is fitted once, labels that disagree count as bad. With no labelled rows of both
kinds the threshold is DEFAULT_CUT. Extra columns are carried by keep_good and not seen otherwise. Empty tables give
empty results. A text of any length is held whole with some 60 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import materialize, only, ranked, release, tune

TREES, SUBSAMPLE, DEEPEST, SEED = 100, 256, 20, 7
#: Score from which a document is anomalous if no labelled row is there to calibrate it.
DEFAULT_CUT = 0.6
#: Share of labelled good rows that calibration may lose at most.
GOOD_LOSS = 0.005
#: Words of ordinary text that each text's ratios are mixed with.
PRIOR = 40
#: The statistics and where each counts as at its most.
STATISTICS = ("symbols a word", "repeated lines", "repeated words", "word length", "capitals", "digits", "!? a word", "doubled words")
SCALES = np.array([4.0, 1, 1, 20, 1, 1, 1, 1])
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_ENDING = np.isin(np.arange(256), list(b"!?"))


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """One True for each key beyond the first of its value."""
    order = np.argsort(keys)
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def _salted(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return ws.mix(hashes ^ ws.mix(rows.astype(np.uint64) + np.uint64(1)))


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five counts of each text, and its row of the forest's features (ratios, so that length plays no part)."""
    n = len(off) - 1
    starts, ends, first = ws.words(data, off)
    sums = ws.prefix_hash(data)
    hashes = ws.range_hash(sums, starts, ends)
    rows = ws.rows_of(first)
    n_words = np.diff(first)

    def count(flags: np.ndarray) -> np.ndarray:
        running = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=running[1:])
        return running[off[1:]] - running[off[:-1]]

    inside = ~ws.SPACE[data]
    word_chars = count(inside & ((data & 0xC0) != 0x80))
    n_symbols = count(_SYMBOL[data])
    high = np.zeros(len(data), bool)
    if len(data) > 1:
        high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper, digits, endings = count(_UPPER[data] | high), count(_DIGIT[data]), count(_ENDING[data])

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
    line_row = np.searchsorted(off, line_starts, "right") - 1
    at_end = np.zeros(len(data) + 1, bool)
    line_row = np.where(line_starts >= off[-1], n - 1, line_row)
    # A break that ends a text starts an empty line of that text, not of the next one.
    line_ends = np.concatenate([line_starts[1:], [len(data)]])
    at_end[breaks] = True
    full = line_ends > line_starts
    line_starts, line_ends, line_row = line_starts[full], line_ends[full], line_row[full]
    line_ends = line_ends - at_end[line_ends - 1]
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    wordy = filled[line_ends] > filled[line_starts]
    line_starts, line_ends, line_row = line_starts[wordy], line_ends[wordy], line_row[wordy]
    later = _later(_salted(ws.range_hash(sums, line_starts, line_ends), line_row))
    n_lines = np.bincount(line_row, minlength=n)
    n_dup_lines = np.bincount(line_row[later], minlength=n)

    covered = np.zeros(len(starts) + 1, np.int64)
    m = len(starts) - WINDOW + 1
    if m > 0:
        gram = np.zeros(m, np.uint64)
        for j in range(WINDOW):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + m]
        whole = np.flatnonzero(rows[:m] == rows[WINDOW - 1 :])
        hit = whole[_repeats(_salted(gram[whole], rows[whole]))]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    n_repeat = ws.per_row(np.cumsum(covered[:-1]) > 0, first)
    twice = np.zeros(len(starts), bool)
    if len(starts) > 1:
        twice[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    adjacent = ws.per_row(twice, first)

    counts = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat}
    # Ratios are drawn towards those of ordinary text by PRIOR words, so that a short text isn't extreme by chance.
    w, c = n_words + PRIOR, word_chars + 5 * PRIOR
    ratios = [n_symbols / w, n_dup_lines / (n_lines + 4), n_repeat / w, c / w, (upper + PRIOR / 5) / c, digits / c, endings / w, adjacent / w]
    return counts, np.sqrt(np.clip(np.column_stack(ratios) / SCALES, 0, 1))


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


def _c(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 for a leaf), split, children, and a leaf's path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    norm: float
    cut: float = DEFAULT_CUT

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); higher means shorter paths."""
        if not len(self.roots) or not len(x):
            return np.ones(len(x))
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            # A leaf is its own child on both sides.
            node = np.where(x[rows, np.maximum(f, 0)] < self.split[node], self.left[node], self.right[node])
        return 2.0 ** (-self.length[node].mean(axis=1) / self.norm)


def draws(n: int, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> list[np.ndarray]:
    """For each tree the places, of n, of the rows that it is grown on."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return [rng.choice(n, min(subsample, n), replace=False) for _ in range(trees if n else 0)]


def grow(sample: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, deepest: int = DEEPEST) -> Forest:
    """An isolation forest over the sample's rows (statistics of 0 to 1)."""
    return grown([sample[d] for d in draws(len(sample), trees, subsample, seed)], sample.shape[1], seed, deepest)


def grown(drawn: list[np.ndarray], width: int, seed: int = SEED, deepest: int = DEEPEST) -> Forest:
    """A tree on each of the drawn rows; splits are uniform over a node's cell."""
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    feature, split, left, right, length, roots = [], [], [], [], [], []
    size = len(drawn[0]) if drawn else 0

    def node(rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
        me = len(feature)
        for column, value in ((feature, -1), (split, 0.0), (left, me), (right, me), (length, 0.0)):
            column.append(value)
        if len(rows) <= 1 or depth >= deepest:
            length[me] = depth + float(_c(len(rows)))
            return me
        f = int(rng.integers(width))
        at = rng.uniform(low[f], high[f])
        feature[me], split[me] = f, at
        below, above = high.copy(), low.copy()
        below[f] = above[f] = at
        left[me] = node(rows[rows[:, f] < at], low, below, depth + 1)
        right[me] = node(rows[rows[:, f] >= at], above, high, depth + 1)
        return me

    for rows in drawn:
        roots.append(node(rows, np.zeros(width), np.ones(width), 0))
    return Forest(np.array(feature, int), np.array(split), np.array(left, int), np.array(right, int), np.array(length), np.array(roots, int), max(float(_c(max(size, 2))), 1e-9))


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray) -> Forest:
    """Set the cut where the share of bad rows caught, less ten times that of good rows lost, is largest.

    Without rows of both kinds the cut stays as it is.
    """
    if good.any() and (~good).any():
        s = forest.score(x)
        g, b = np.sort(s[good]), np.sort(s[~good])
        cuts = np.unique(s)
        lost = 1 - np.searchsorted(g, cuts, "left") / len(g)
        caught = 1 - np.searchsorted(b, cuts, "left") / len(b)
        value = np.where(lost <= GOOD_LOSS, caught - 10 * lost, -1.0)
        k = int(np.argmax(value))
        if value[k] > 0:
            below = s[s < cuts[k]]
            forest.cut = float((cuts[k] + below.max()) / 2) if len(below) else float(cuts[k])
        else:
            forest.cut = 1.0
    return forest


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ws.pieces(batch):
            counts, x = statistics(*ws.buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base_failed(counts)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "failed", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    """Grow and calibrate on all labelled documents, or grow on all documents where none is labelled good."""
    tune(docs.sparkSession)
    # Statistics are made of every text where it is read, so that no text is shuffled.
    features = only(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(_features, "doc_id long, failed boolean, x array<double>")
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = materialize(_one_each(features.join(marked, "doc_id"), "quality"), "known")
    good = materialize(_numbered(known.where("quality = 1")), "good")
    n = good.count()
    if not n:
        everything = materialize(_numbered(_one_each(features)), "everything")
        forest = _grown_on(everything, everything.count(), 1)
        release(everything)
    else:
        forest = _grown_on(good, (n + 1) // 2, 2)
        held = good.where("slot % 2 = 1").select("x", F.lit(1).cast("long").alias("good"))
        forest = calibrate_on(forest, held.unionByName(known.where("quality = 0").select("x", F.lit(0).cast("long").alias("good"))))
    release(known, good)
    return forest


def _one_each(features: DataFrame, *others: str) -> DataFrame:
    """One row a doc_id, without those that fail the base rule: doc_id, x and the others."""
    one = features.groupBy("doc_id", *others).agg(F.min(F.struct("x", "failed")).alias("of"))
    return one.where("not of.failed").select("doc_id", F.col("of.x").alias("x"), *others)


def _numbered(rows: DataFrame) -> DataFrame:
    """x and slot: the rows' places in hash order of doc_id."""
    return ranked(rows.select("doc_id", "x", F.xxhash64("doc_id").alias("_hash")), [], ["_hash", "doc_id"]).select("x", "slot")


def _grown_on(rows: DataFrame, n: int, every: int) -> Forest:
    """The forest on the n rows whose slot divides by `every`; at most TREES * SUBSAMPLE of them are collected."""
    drawn = draws(n)
    places = np.unique(np.concatenate([np.zeros(0, np.int64), *drawn]))
    if not len(places):
        return grown([], len(SCALES))
    wanted = rows.sparkSession.createDataFrame([(every * int(p),) for p in places], "slot long")
    got = rows.join(F.broadcast(wanted), "slot", "left_semi").select("slot", "x").collect()
    x = np.array([r["x"] for r in sorted(got, key=lambda r: r["slot"])])
    return grown([x[np.searchsorted(places, d)] for d in drawn], len(SCALES))


def calibrate_on(forest: Forest, rows: DataFrame) -> Forest:
    """As calibrate, for rows (x, good as 0 or 1) of any number; one row reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(x)), batch.column("good")], ["score", "good"])

    scored = materialize(ranked(rows.select("x", "good").mapInArrow(run, "score double, good long"), [], ["score", "good"], size="good"), "scored")
    all_good, every = scored.agg(F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1))).first()
    if 0 < all_good < every:
        per = scored.groupBy("score").agg(F.min("slot").alias("below"), F.min("before").alias("good_below"))
        lost = 1 - F.col("good_below") / F.lit(float(all_good))
        caught = 1 - (F.col("below") - F.col("good_below")) / F.lit(float(every - all_good))
        best = per.select("score", F.when(lost <= GOOD_LOSS, caught - 10 * lost).otherwise(-1.0).alias("value")).orderBy(F.desc("value"), "score").first()
        if best["value"] > 0:
            lower = scored.where(F.col("score") < best["score"]).agg(F.max("score")).first()[0]
            forest.cut = best["score"] if lower is None else (best["score"] + lower) / 2
        else:
            forest.cut = 1.0
    release(scored)
    return forest


def _judge(forest: Forest, part: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    counts, x = statistics(*ws.buffers(part.column(part.schema.get_field_index("text"))))
    failed = base_failed(counts)
    score = forest.score(x)
    return counts, failed, score, ~failed & (score < forest.cut)


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the counts, base_failed, the anomaly score and kept, for every row of docs (doc_id, text)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch):
                counts, failed, score, kept = _judge(forest, part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean, anomaly double"])
    return only(docs, "doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is kept; no shuffle."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch):
                kept = _judge(forest, part)[3]
                if kept.any():
                    yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
