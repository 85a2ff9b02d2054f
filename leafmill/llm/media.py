"""Media columns: TIFF pages.

`pages` walks the chain of image directories (classic and 64-bit files), decodes strips and tiles (none, PackBits, LZW,
deflate) of 1, 2, 4, 8, 16 or 32 bits a sample, undoes the horizontal and the floating-point predictor and gives one
page a directory; `tiff_pages` emits one row per page of a binary column. Sizes are held against what the file stores
before anything is allocated, and pages are made one at a time. A file or page that can't be read, or that would have
more than MOST_PIXELS bytes, gives a row with `error` and no pixels; null and empty content give no row. Samples below
8 bits become one byte each; wider ones are in the machine's order. `encode` writes 8-bit samples, `WIDTH` to a row, as
pages of strips; it is deterministic, so equal texts have equal files.

Null texts are empty, and an empty one is a page of zeros. Repeated rows and keys are rows like any other; extra
columns are not seen; empty tables give empty results. A text is held whole, with its file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, tune

WIDTH, STRIP_ROWS, PAGE_ROWS = 64, 256, 4096
MOST_PIXELS = 1 << 28
# Fixed values of the format: compressions, field types by size, and the tags read here.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: The most bytes that one stored byte can become.
_GROWTH = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1100, OLD_DEFLATE: 1100}
T_WIDTH, T_HEIGHT, T_BITS, T_COMPRESSION, T_PHOTOMETRIC, T_OFFSETS, T_SAMPLES, T_ROWS, T_COUNTS, T_PLANAR, T_PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
T_TILE_WIDTH, T_TILE_HEIGHT, T_TILE_OFFSETS, T_TILE_COUNTS = 322, 323, 324, 325


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes | None
    error: str | None = None


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128 and i < len(data):
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def _lzw_places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offsets and widths of the n codes after a clear code: widths follow from the number of codes read."""
    k = np.arange(n)
    width = 9 + (k >= 254).astype(np.int64) + (k >= 766) + (k >= 1790)
    return np.cumsum(width) - width, width


def unpack_lzw(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, growing one code early; 256 clears, 257 ends.

    The string of table entry 258 + k is what the k-th code since the clear gave, with the byte that follows it; so it
    is copied from the output itself. Reading stops once there are `most` bytes.
    """
    out, at, bits = bytearray(), 0, 8 * len(data)
    stored = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    step = 4096
    while at + 9 <= bits:
        offset, width = _lzw_places(step)
        where = at + offset
        keep = int(np.searchsorted(where + width, bits, "right"))
        where, width = where[:keep], width[:keep]
        byte = where >> 3
        window = (stored[byte] << 24) | (stored[byte + 1] << 16) | (stored[byte + 2] << 8) | stored[byte + 3]
        codes = (window >> (32 - (where & 7) - width)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        if not len(stops) and keep == step:
            step *= 2
            continue
        n = int(stops[0]) if len(stops) else keep
        if n and not out and at == 0:
            raise ValueError("LZW data does not start with a clear code")
        begin, size = [], []
        for k, code in enumerate(codes[:n].tolist()):
            begin.append(len(out))
            if code < 256:
                out.append(code)
                size.append(1)
                continue
            k_from = code - 258
            if k_from >= k:
                raise ValueError("LZW code out of order")
            start, length = begin[k_from], size[k_from] + 1
            # The byte after the last string may be the first of this one.
            out += out[start : start + length] if start + length <= len(out) else out[start:] + out[start : start + 1]
            size.append(length)
        if n == keep or codes[n] == 257 or (most is not None and len(out) >= most):
            break
        at += int(offset[n] + width[n])
        step = 4096
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, have = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, have
        held, have = (held << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append((held >> have) & 255)
        held &= (1 << have) - 1

    table = {bytes((i,)): i for i in range(256)}
    size, width, now = 258, 9, b""
    put(256, 9)
    for i in range(len(data)):
        longer = now + data[i : i + 1]
        if longer in table:
            now = longer
            continue
        put(table[now], width)
        table[longer] = size
        size += 1
        now = data[i : i + 1]
        if size == 4094:
            put(table[now], 12)
            now = b""
            put(256, 12)
            table, size, width = {bytes((k,)): k for k in range(256)}, 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    if now:
        put(table[now], width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257, width)
    if have:
        out.append((held << (8 - have)) & 255)
    return bytes(out)


def _unpack(data: bytes, compression: int, most: int) -> bytes:
    """The block's bytes; what lies beyond `most` isn't needed and may be left out."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most) if most else b""
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data, most)
    raise ValueError(f"compression {compression} is not supported")


def _block(data: bytes, rows: int, columns: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """rows x columns x samples of one strip or tile, its predictor undone."""
    line = -(-columns * samples * bits // 8)
    if len(data) < rows * line:
        raise ValueError(f"a block has {len(data)} bytes of {rows * line}")
    raw = np.frombuffer(data, np.uint8, rows * line).reshape(rows, line)
    if bits < 8:
        wide = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        values = (wide << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        out = values[:, : columns * samples].reshape(rows, columns, samples)
    elif predictor == 3 and bits >= 16:
        # Differences between bytes, which stand in planes from the highest down.
        steps = raw.reshape(rows, -1, samples)
        planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, bits // 8, columns, samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 3, 1)).view(f">u{bits // 8}")[..., 0].astype(f"=u{bits // 8}")
    else:
        kind = np.dtype(f"{order}u{bits // 8}")
        out = np.ascontiguousarray(raw).view(kind).reshape(rows, columns, samples).astype(kind.newbyteorder("="))
    if predictor == 2:
        return np.cumsum(out, axis=1, dtype=out.dtype) & out.dtype.type((1 << bits) - 1)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} of {bits} bits is not supported")
    return out


def _fields(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, list[int]], int]:
    """The tags of a directory with their numbers, and where the next directory is."""
    head, entry, place = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
    (n,) = struct.unpack_from(order + head, data, at)
    at += struct.calcsize(order + head)
    step = struct.calcsize(order + entry) + place
    if at + n * step + place > len(data):
        raise ValueError("a directory lies outside the file")
    fields: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + entry, data, at + step * k)
        if kind not in _CODES:
            continue
        where = at + step * (k + 1) - place
        if _SIZES[kind] * count > place:
            (where,) = struct.unpack_from(order + ("Q" if big else "I"), data, where)
        if where + _SIZES[kind] * count > len(data):
            raise ValueError("a field's values lie outside the file")
        fields[tag] = list(struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, where))
    (following,) = struct.unpack_from(order + ("Q" if big else "I"), data, at + step * n)
    return fields, following


def _number(fields: dict[int, list[int]], tag: int, default: int) -> int:
    return (fields.get(tag) or [default])[0]


def _page(data: bytes, fields: dict[int, list[int]], order: str) -> Page:
    width, height, samples, bits, compression = (_number(fields, t, d) for t, d in ((T_WIDTH, 0), (T_HEIGHT, 0), (T_SAMPLES, 1), (T_BITS, 1), (T_COMPRESSION, NONE)))
    page = Page(width, height, samples, bits, compression, None)
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(fields.get(T_BITS, [1]))) != 1:
        raise ValueError(f"samples of {fields.get(T_BITS)} bits are not supported")
    if compression not in _GROWTH:
        raise ValueError(f"compression {compression} is not supported")
    if min(width, height, samples) < 1:
        raise ValueError("the page has no pixels")
    planar, predictor = _number(fields, T_PLANAR, 1) == 2, _number(fields, T_PREDICTOR, 1)
    deep, planes = (1, samples) if planar else (samples, 1)
    tiled = T_TILE_OFFSETS in fields
    tall, wide = (_number(fields, T_TILE_HEIGHT, 0), _number(fields, T_TILE_WIDTH, 0)) if tiled else (min(_number(fields, T_ROWS, height), height), width)
    if min(tall, wide) < 1:
        raise ValueError("a strip or tile has no pixels")
    offsets, counts = (fields[T_TILE_OFFSETS], fields.get(T_TILE_COUNTS, [])) if tiled else (fields.get(T_OFFSETS, []), fields.get(T_COUNTS, []))
    across, down = -(-width // wide), -(-height // tall)
    if min(len(offsets), len(counts)) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    depth = max(1, bits // 8)
    need = height * width * samples * depth
    # What the stored bytes can hold at the very most bounds what is allocated.
    if need > MOST_PIXELS or tall * wide * deep * depth > MOST_PIXELS:
        raise ValueError(f"the page has {need} bytes; at most {MOST_PIXELS} are read")
    stored = sum(max(0, min(c, len(data) - o)) for o, c in zip(offsets, counts, strict=False))
    if need * min(bits, 8) // 8 > stored * _GROWTH[compression]:
        raise ValueError(f"{stored} stored bytes can't hold a page of {need}")
    out = np.zeros((height, width, samples), f"=u{depth}")
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * tall, rest % across * wide
        rows = tall if tiled else min(tall, height - y)
        packed = data[offsets[k] : offsets[k] + counts[k]]
        block = _block(_unpack(packed, compression, rows * -(-wide * deep * bits // 8)), rows, wide, deep, bits, predictor, order)
        part = block[: height - y, : width - x]
        if planar:
            out[y : y + part.shape[0], x : x + part.shape[1], plane] = part[:, :, 0]
        else:
            out[y : y + part.shape[0], x : x + part.shape[1]] = part
    page.pixels = out.tobytes()
    return page


_BROKEN = (ValueError, KeyError, IndexError, OverflowError, MemoryError, zlib.error, struct.error)


def _short(number: int) -> int:
    """What a column of 32-bit numbers can hold of a broken file's claim."""
    return min(max(number, 0), (1 << 31) - 1)


def pages(data: bytes) -> Iterator[Page]:
    """One Page for each image directory, in the order of their chain; a directory met again ends it."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    try:
        (version,) = struct.unpack_from((order or "<") + "H", data, 2)
        if order is None or version not in (42, 43):
            raise ValueError("not a TIFF file")
        big = version == 43
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
        seen: set[int] = set()
        while at and at not in seen:
            seen.add(at)
            fields, at = _fields(data, at, order, big)
            try:
                yield _page(data, fields, order)
            except _BROKEN as e:
                yield Page(*(_short(_number(fields, t, 0)) for t in (T_WIDTH, T_HEIGHT, T_SAMPLES, T_BITS, T_COMPRESSION)), None, str(e) or type(e).__name__)
    except _BROKEN as e:
        yield Page(0, 0, 0, 0, 0, None, "not a TIFF file" if order is None else str(e) or type(e).__name__)


def decode(data: bytes) -> list[Page]:
    return list(pages(data))


def _pack(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: pack_bits, LZW: pack_lzw}[compression](data)


def encode(payload: bytes, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, width: int = WIDTH, page_rows: int = PAGE_ROWS, order: str = "<") -> bytes:
    """A TIFF of 8-bit grey pages with payload's bytes row by row; payload is a multiple of width. tile: 0 for strips."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray({"<": b"II*\0", ">": b"MM\0*"}[order] + b"\0\0\0\0")
    link = 4
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        blocks = []
        if tile:
            for y in range(0, len(page), tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile), np.uint8)
                    part = page[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            packed = _pack(block.tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        fields = [(T_WIDTH, 4, [width]), (T_HEIGHT, 4, [len(page)]), (T_BITS, 3, [8]), (T_COMPRESSION, 3, [compression]), (T_PHOTOMETRIC, 3, [1]), (T_SAMPLES, 3, [1]), (T_PREDICTOR, 3, [predictor])]
        fields += [(T_TILE_WIDTH, 4, [tile]), (T_TILE_HEIGHT, 4, [tile]), (T_TILE_OFFSETS, 4, offsets), (T_TILE_COUNTS, 4, counts)] if tile else [(T_OFFSETS, 4, offsets), (T_ROWS, 4, [STRIP_ROWS]), (T_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
            if len(body) > 4:
                where = len(out)
                out += body
                body = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def padded(text: bytes, unit: int = WIDTH) -> bytes:
    """text with bytes 0 up to a positive multiple of unit."""
    return text + b"\0" * (-len(text) % unit if text else unit)


def feature(pixels: bytes, pages: int) -> str:
    """Pages, mean, standard deviation and a histogram of 16 levels (shares in per mille)."""
    x = np.frombuffer(pixels, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // max(len(x), 1)
    return f"{pages};{x.mean():.3f};{x.std():.3f};{','.join(map(str, bins.tolist()))}"


def tiff_pages(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, page (from 0), width, height, samples, bits, compression, pixels, error: one row per page of each file."""
    tune(files.sparkSession)
    names = [key, "page", "width", "height", "samples", "bits", "compression", "pixels", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in zip(batch.column(0), batch.column(1), strict=True):
                if not blob.is_valid or not len(blob.as_py()):
                    continue
                for number, p in enumerate(pages(blob.as_py())):
                    fixed = (pa.array([getattr(p, c)], pa.int32()) for c in ("width", "height", "samples", "bits", "compression"))
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], batch.column(0).type), pa.array([number], pa.int32()), *fixed, pa.array([p.pixels], pa.binary()), pa.array([p.error], pa.string())], names)

    kind = files.schema[key].dataType.simpleString()
    return only(files, key, content).mapInArrow(run, f"{key} {kind}, page int, width int, height int, samples int, bits int, compression int, pixels binary, error string")


def media_digest(docs: DataFrame) -> DataFrame:
    """Each text stored as a TIFF and read back: doc_id, sizes, digests of the payload read and of the file, feature."""
    tune(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = (value.as_py() or "").encode()
                stored = encode(padded(text))
                read = decode(stored)
                bad = next((p.error for p in read if p.error), None)
                if bad:
                    raise ValueError(bad)
                payload = b"".join(p.pixels or b"" for p in read)
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload, len(read))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [f.split()[0] for f in schema.split(", ")])

    return only(docs, "doc_id", "text").mapInArrow(run, schema)
