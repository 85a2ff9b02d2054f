"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes, framed by PAD zero bytes on either side, become symbols: a byte, marked if the MATCH bytes up to it
are the same as LAGS bytes or fewer before, which tells the filters of repetition. The symbols are cut into chunks of WIDTH that start every
STRIDE and so overlap and cover the whole text. Each chunk's embeddings go through learned filters; the largest
response of each filter over all chunks (global max-pooling), a hidden layer and a sigmoid give one probability.

The network is fitted by Adam on the driver to whole texts of at most SAMPLE labelled rows and SAMPLE_BYTES bytes, first
in hash order of doc_id, whose crc32(doc_id) mod 5 is not 0. Scoring reads every byte of every text, a long one in
windows that share a chunk's overlap. Labels, language, source and doc_id are never inputs. Null and empty texts have
one chunk of zeros; with no labelled rows of both kinds the score is the share of good rows (0.5 for none). Repeated
rows have one score; a doc_id that is labelled twice counts once, as the worse; a score at the cut is predicted good;
extra columns are not seen; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import bounded_sample, only, text_or_empty, tune

#: Bounds of the labelled sample: its rows, and the bytes of their texts in all.
SAMPLE, SAMPLE_BYTES = 3000, 64 << 20
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN, PAD = 6, 16, 8, 24, 12, 16
MATCH, LAGS = 8, 32
EPOCHS, BATCH, RATE, DECAY, SEED = 10, 32, 0.004, 1e-4, 11
CUT = 0.3
FOLDS = 5


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    constant: float | None = field(default=None)

    def names(self) -> tuple[str, ...]:
        return ("embed", "filters", "bias", "w1", "b1", "w2", "b2")


def fresh(seed: int = SEED) -> Net:
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return Net(draw(512, EMBED, scale=1.0), draw(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), zero(FILTERS), draw(FILTERS, HIDDEN, scale=FILTERS**-0.5), zero(HIDDEN), draw(HIDDEN, 1, scale=HIDDEN**-0.5), zero(1))


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Framed symbols, each text's a multiple of STRIDE, and each text's first chunk (n + 1).

    Chunk c of all has the bytes from c * STRIDE on, as every text's frame is a multiple of STRIDE; the chunks that
    would reach from one text into the next are left out by counting one less a text.
    """
    size = np.diff(off)
    blocks = (size + 2 * PAD + STRIDE - 1) // STRIDE
    at = np.concatenate([[0], np.cumsum(blocks)])
    framed = np.zeros(int(at[-1]) * STRIDE, np.uint8)
    framed[np.arange(len(data)) + np.repeat(at[:-1] * STRIDE + PAD - off[:-1], size)] = data
    return framed + np.uint16(256) * repeated(framed), at


def repeated(framed: np.ndarray) -> np.ndarray:
    """Whether the MATCH bytes up to each are those of some lag of 2 to LAGS before; frames (zeros) never match.

    Frames between texts are LAGS bytes or more, so that nothing matches across texts.
    """
    out = np.zeros(len(framed), bool)
    filled = framed != 0
    for lag in range(2, LAGS + 1):
        same = (framed[lag:] == framed[:-lag]) & filled[lag:]
        width = 1
        while width < MATCH:
            same = same[width:] & same[:-width]
            width *= 2
        if same.any():
            out[lag + MATCH - 1 :] |= same
    return out


def pooled(net: Net, framed: np.ndarray, at: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's largest response over each text's chunks, and (for training) the block the chunk starts at."""
    each = WIDTH // STRIDE
    vectors = net.embed[framed].reshape(len(framed) // STRIDE, STRIDE * EMBED)
    # A filter over WIDTH bytes is a sum of parts over STRIDE bytes each.
    parts = [vectors @ net.filters[k * STRIDE * EMBED : (k + 1) * STRIDE * EMBED] for k in range(each)]
    n = len(vectors) - each + 1
    response = parts[0][:n].copy()
    for k in range(1, each):
        response += parts[k][k : k + n]
    # The last each - 1 blocks of a text start no chunk of their own.
    for k in range(1, each):
        last = at[1:] - k
        response[last[last < n]] = -np.inf
    top = np.maximum.reduceat(response, at[:-1], axis=0)
    if not where:
        return top + net.bias, None
    arg = np.empty(top.shape, np.int64)
    for i in range(len(at) - 1):
        arg[i] = at[i] + response[at[i] : min(at[i + 1], n)].argmax(0)
    return top + net.bias, arg


def head(net: Net, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pool = np.maximum(top, 0)
    hidden = np.maximum(pool @ net.w1 + net.b1, 0)
    z = (hidden @ net.w2)[:, 0] + net.b2[0]
    return pool, hidden, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pooled_long(net: Net, framed: np.ndarray, blocks: int = 1 << 17) -> np.ndarray:
    """As pooled, for one text, in windows of `blocks` that share what a chunk reaches beyond its first block."""
    reach = WIDTH // STRIDE - 1
    tops = []
    for at in range(0, max(1, len(framed) // STRIDE - reach), blocks):
        some = framed[at * STRIDE : (at + blocks + reach) * STRIDE]
        tops.append(pooled(net, some, np.array([0, len(some) // STRIDE]))[0])
    return np.maximum.reduce(tops)


def scores(net: Net, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(off) - 1, net.constant)
    framed, at = chunks(data, off)
    top = pooled_long(net, framed) if len(at) == 2 else pooled(net, framed, at)[0]
    return head(net, top)[2].astype(np.float64)


def train(texts: list[bytes], good: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    net = fresh(seed)
    good = good.astype(np.float32)
    if not len(good) or good.min() == good.max():
        net.constant = float(good.mean()) if len(good) else 0.5
        return net
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    # Classes count alike; the prior odds are put back into the last bias at the end.
    weight = np.where(good > 0, 0.5 / good.mean(), 0.5 / (1 - good.mean())).astype(np.float32)
    first = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
    second = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
    step, each = 0, WIDTH // STRIDE
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / epochs) ** 0.5
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            some = [texts[r] for r in rows]
            data = np.frombuffer(b"".join(some), np.uint8)
            framed, at = chunks(data, np.concatenate([[0], np.cumsum([len(t) for t in some])]))
            top, arg = pooled(net, framed, at, True)
            pool, hidden, p = head(net, top)
            dz = ((p - good[rows]) * weight[rows] / len(rows))[:, None].astype(np.float32)
            grads = {"w2": hidden.T @ dz, "b2": dz.sum(0)}
            dh = (dz @ net.w2.T) * (hidden > 0)
            grads |= {"w1": pool.T @ dh, "b1": dh.sum(0)}
            dtop = (dh @ net.w1.T) * (pool > 0)
            grads["bias"] = dtop.sum(0)
            # Only the winning chunk of each filter and text passes a gradient on.
            window = framed.reshape(-1, STRIDE)[arg[:, :, None] + np.arange(each)].reshape(*arg.shape, WIDTH)
            seen = net.embed[window].reshape(*arg.shape, WIDTH * EMBED)
            grads["filters"] = np.einsum("nfd,nf->df", seen, dtop)
            dseen = (dtop[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            dembed = np.zeros_like(net.embed)
            np.add.at(dembed, window.reshape(-1), dseen)
            grads["embed"] = dembed
            step += 1
            for k in net.names():
                g = grads[k] + (DECAY * getattr(net, k) if getattr(net, k).ndim > 1 else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    net.b2 = (net.b2 + np.log(good.mean() / (1 - good.mean()))).astype(np.float32)
    return net


def fold(doc_id: str | Column = "doc_id") -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    """Fit on SAMPLE labelled rows outside fold 0."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(fold() != 0)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = only(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    rows = bounded_sample(texts, "doc_id", "text", SAMPLE, SAMPLE_BYTES, marked)
    return train([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch, limit=1 << 20):
                s = scores(net, *ws.buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
