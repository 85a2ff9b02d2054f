"""Secret scans: three fixed patterns, and a randomness battery over long tokens with false-discovery control.

The battery takes maximal runs of token characters of MIN_TOKEN or more. It infers an encoding and tests that the
symbols look uniform and independent in it (chi-squared, runs, lag-1 serial correlation). Fisher's combination of the
three p-values and the likelihood ratio of uniform symbols to a text model are e-values against "this is text"; the
inverse of their product is the token's p-value, and it is 1 where one test alone rules out random symbols. Runs without
a digit or small letter are weighed as small letters, since titles are text. Longer tokens carry more evidence, so the
p-values of a document go through a weighted Benjamini-Hochberg step with weights in proportion to length; runs without
a digit, most of which are words, are a family of their own. Each document is judged by itself.

Positions are code points of the whole text, ends exclusive. Null and empty texts and empty tables have no spans;
repeated rows have the same spans each; of spans that start together the kind listed first comes first; extra columns
are carried by mask_documents and not seen otherwise. A text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordscan as ws
from .common import only, tune

# The base patterns, applied to bytes (all their classes are ASCII; ASSIGN to the lower-cased copy).
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_VALUE, ACCESS_SIZE, HEX_SIZE = 8, 16, 32
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")
MASK = "<secret>"

MIN_TOKEN = 20
#: Level at which a test rules out random symbols, the shape of the battery's p-values for text, the false-discovery rate.
UNIFORM_LEVEL, SHAPE, DISCOVERY_RATE = 0.001, 0.1, 1e-4
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_TOKEN = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))
_DIGITS = np.isin(np.arange(256), list(b"0123456789"))
_DIGIT, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from the narrowest to the widest; the first that holds all symbols is the encoding.
ENCODINGS = (("hex", _DIGIT + "abcdef"), ("HEX", _DIGIT + "ABCDEF"), ("lower", _LOW), ("upper", _UP), ("letters", _UP + _LOW), ("base32", _UP + "234567"), ("lower36", _DIGIT + _LOW), ("upper36", _DIGIT + _UP), ("base62", _UP + _LOW + _DIGIT), ("base64", _UP + _LOW + _DIGIT + "+/"), ("base64url", _UP + _LOW + _DIGIT + "-_"), ("mixed", _UP + _LOW + _DIGIT + "+/-_"))
#: Text model: chances of the next class (lower, upper, digit, other) after each, and at the start.
_CLASSES = "luds"
_NEXT = {"l": (0.90, 0.03, 0.03, 0.04), "u": (0.55, 0.35, 0.05, 0.05), "d": (0.06, 0.04, 0.80, 0.10), "s": (0.50, 0.20, 0.25, 0.05)}
#: Frequencies in per mille of the letters a to z in ordinary European text.
_LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)


def _class(c: str) -> str:
    return "l" if c in _LOW else "u" if c in _UP else "d" if c in _DIGIT else "s"


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by Wilson and Hilferty's cube root."""
    if df < 1:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, alphabet: str) -> tuple[float, float, float]:
    """p-values that the symbols are uniform (chi-squared) and independent (runs, lag-1 serial correlation)."""
    place = {c: i for i, c in enumerate(alphabet)}
    v = np.array([place[c] for c in token])
    n, k = len(v), len(alphabet)
    bins = min(k, max(2, n // 5))
    # Symbols are dealt to bins by place, so that each bin expects five or more.
    bin_of = (np.arange(k) * bins) // k
    expected = np.bincount(bin_of, minlength=bins) * n / k
    chi = float((((np.bincount(bin_of[v], minlength=bins) - expected) ** 2) / expected).sum())
    p_chi = _chi_tail(chi, bins - 1)
    high = v >= k / 2
    n1, n0 = int(high.sum()), int((~high).sum())
    p_runs = 0.0
    if n1 and n0:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n1 * n0 / n
        var = 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
        p_runs = _tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    spread = v.std()
    p_serial = _tail(float(np.mean((v[1:] - v.mean()) * (v[:-1] - v.mean())) / spread**2 * math.sqrt(n))) if spread > 0 else 0.0
    return p_chi, p_runs, p_serial


def evidence(ps: tuple[float, float, float]) -> float:
    """Log of the e-value of the battery against text, -inf where one test alone rules out random symbols.

    Fisher's combination of the three is uniform for random symbols and near 0 for text, whose density is taken as
    SHAPE * p ** (SHAPE - 1).
    """
    if min(1.0, 3 * min(ps)) < UNIFORM_LEVEL:
        return -math.inf
    half = -sum(math.log(p) for p in ps)
    combined = math.exp(-half) * (1 + half + half * half / 2)
    return (1 - SHAPE) * math.log(max(combined, 1e-300)) - math.log(SHAPE)


def likelihood(token: str, alphabet: str) -> float:
    """Log-likelihood ratio of uniform symbols to the text model."""
    total = sum(_LETTERS)
    log_ratio, before = 0.0, "s"
    for c in token:
        now = _class(c)
        chance = _NEXT[before][_CLASSES.index(now)]
        chance *= _LETTERS[(_LOW if now == "l" else _UP).index(c)] / total if now in "lu" else 0.1 if now == "d" else 0.25
        log_ratio += -math.log(len(alphabet)) - math.log(chance)
        before = now
    return log_ratio


def random_tokens(tokens: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans (start, end, token) that pass the battery, after weighted false-discovery control over all of them."""
    judged = []
    for start, end, token in tokens:
        body = token.strip("-_/+")
        if len(body) < MIN_TOKEN or set(body) <= set(_DIGIT):
            continue
        alphabet = next(a for _, a in ENCODINGS if set(body) <= set(a))
        plain = body.lower() if body == body.upper() and not set(body) & set(_DIGIT) else body
        p = math.exp(-max(0.0, likelihood(plain, alphabet) + evidence(battery(body, alphabet))))
        shift = token.index(body)
        judged.append((start + shift, start + shift + len(body), p))
    if not judged:
        return []
    mean = sum(e - s for s, e, _ in judged) / len(judged)
    weighed = sorted((p * mean / (e - s), s, e) for s, e, p in judged)
    last = max((k for k, (p, _, _) in enumerate(weighed, 1) if p <= DISCOVERY_RATE * k / len(weighed)), default=0)
    return [(s, e) for _, s, e in weighed[:last]]


def _runs(inside: np.ndarray, off: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of True within rows, of `least` or more."""
    if not len(inside):
        return []
    first = np.zeros(len(inside) + 1, bool)
    first[off] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def scan(data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each row with any: its spans (start, end, number of the kind) in code points, sorted by start and kind."""
    raw = data.tobytes()
    low = raw.lower()
    found: dict[int, list[tuple[int, int, int]]] = {}

    def row_of(at: int) -> int:
        return int(np.searchsorted(off, at, "right")) - 1

    def add(row: int, start: int, end: int, kind: int) -> None:
        found.setdefault(row, []).append((start - int(off[row]), end - int(off[row]), kind))

    for kind, words, source in ((0, KEYWORDS, low), (1, (b"AKIA",), raw)):
        rows, ends = set(), off.tolist()
        for word in words:
            at = source.find(word)
            while at >= 0:
                row = row_of(at)
                rows.add(row)
                at = source.find(word, ends[row + 1])
        for row in rows:
            text = source[ends[row] : ends[row + 1]]
            for m in (ASSIGN if kind == 0 else ACCESS).finditer(text):
                if (len(m[2]) >= ASSIGN_VALUE) if kind == 0 else (m.end() - m.start() >= ACCESS_SIZE):
                    found.setdefault(row, []).append((m.start(), m.end(), kind))
    for start, end in _runs(_HEX[data], off, HEX_SIZE):
        add(row_of(start), start, end, 2)
    tokens: dict[tuple[int, bool], list[tuple[int, int, str]]] = {}
    for start, end in _runs(_TOKEN[data], off, MIN_TOKEN):
        row = row_of(start)
        tokens.setdefault((row, bool(_DIGITS[data[start:end]].any())), []).append((start - int(off[row]), end - int(off[row]), raw[start:end].decode("ascii")))
    for (row, _), some in tokens.items():
        base = found.get(row, [])
        for start, end in random_tokens(some):
            if not any(s <= start and end <= e for s, e, _ in base):
                found.setdefault(row, []).append((start, end, 3))
    for row, spans in found.items():
        lead = np.zeros(int(off[row + 1] - off[row]) + 1, np.int64)
        np.cumsum((data[off[row] : off[row + 1]] & 0xC0) != 0x80, out=lead[1:])
        found[row] = sorted(((int(lead[s]), int(lead[e]), k) for s, e, k in spans), key=lambda x: (x[0], x[2]))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of docs."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch):
                found = scan(*ws.buffers(part.column("text")))
                rows = [found.get(i, []) for i in range(part.num_rows)]
                counts = [pa.array([sum(s[2] == k for s in spans) for spans in rows], pa.int64()) for k in range(4)]
                base = pa.array([hashlib.sha256(_joined([s for s in spans if s[2] < 3]).encode()).hexdigest() for spans in rows])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts[:3], base, pa.array([_joined(s) for s in rows]), counts[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each maximal covered stretch replaced by MASK."""
    out, at = [], 0
    for start, end, _ in spans:
        if end <= at:
            continue
        if start > at or not out:
            out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with every span masked in text; n_chars, where there, follows a changed text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch):
                at = part.schema.get_field_index("text")
                found = scan(*ws.buffers(part.column(at)))
                if found:
                    texts = part.column(at).to_pylist()
                    for row, spans in found.items():
                        texts[row] = masked(texts[row], spans)
                    columns = list(part.columns)
                    columns[at] = pa.array(texts, part.schema.field(at).type)
                    size = part.schema.get_field_index("n_chars")
                    if size >= 0:
                        sizes = columns[size].to_pylist()
                        for row in found:
                            sizes[row] = len(texts[row])
                        columns[size] = pa.array(sizes, part.schema.field(size).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, docs.schema)
