"""TIFF: walks image directories, decodes strips and tiles, undoes predictors; one row a page.

Decodes uncompressed, LZW, deflate and PackBits data with 8-bit samples, chunky or planar, in either byte order, with horizontal differencing.
The writer makes the same, a directory a page.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, text_or_empty

# Numbers of the format (fixed values).
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = (
    256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325,
)
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257


@dataclass
class Page:
    number: int
    samples: np.ndarray  # rows x columns x samples
    compression: int
    predictor: int
    tiled: bool


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all else as literals."""
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in re.finditer(rb"(.)\1{2,}", data, re.DOTALL):
        literal(m.start())
        n = m.end() - m.start()
        while n > 128:
            out += bytes((129, data[m.start()]))
            n -= 128
        if n > 1:
            out += bytes((257 - n, data[m.start()]))
        elif n:
            out += bytes((0, data[m.start()]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


#: A table is full at so many codes beyond the first 258, after which the writer clears it; codes grow from 9 to 12 bits one code early, as the format has it.
_FULL = 4095 - 258


def _widths(n: int) -> np.ndarray:
    """The bits of the first ``n`` codes after a clear code."""
    k = np.arange(n)
    return 9 + (k >= 254).astype(np.int64) + (k >= 766) + (k >= 1790)


def _written(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes, most significant bit first, padded to whole bytes."""
    out = []
    for i in range(0, len(codes), 8192):  # a multiple of eight codes, so that every part but the last ends with a byte
        c, w = codes[i : i + 8192], widths[i : i + 8192]
        bits = (c[:, None] >> (w[:, None] - 1 - np.arange(12)).clip(0)) & 1
        out.append(bits[np.arange(12) < w[:, None]].astype(np.uint8))
    return np.packbits(np.concatenate(out)).tobytes() if out else b""


def lzw(data: bytes) -> bytes:
    """The table is keyed by (code of the prefix, byte) as one number; codes are gathered first and written together."""
    parts: list[list[int]] = []
    table: dict[int, int] = {}
    codes: list[int] = []
    get, free = table.get, 258
    it = iter(data)
    prefix = next(it, -1)
    for byte in it:
        key = prefix << 8 | byte
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        table[key] = free
        free += 1
        prefix = byte
        if free == 4095:
            parts.append(codes)
            codes, free = [], 258
            table.clear()
    if prefix >= 0:
        codes.append(prefix)
    parts.append([*codes, END])
    every, widths = [[CLEAR]], [np.array([9])]
    for k, part in enumerate(parts):
        # the clear code that ends a full part has the width of the next code
        closed = part if k == len(parts) - 1 else [*part, CLEAR]
        every.append(closed)
        widths.append(_widths(len(closed)))
    return _written(np.concatenate([np.array(x, np.int64) for x in every]), np.concatenate(widths))


def _codes(data: np.ndarray, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``n`` codes that follow a clear code which ends at bit ``at``, and where each ends; bits past the data are zero."""
    widths = _widths(n)
    ends = at + np.cumsum(widths)
    n = int(np.searchsorted(ends, 8 * (len(data) - 3), "right"))  # three bytes of zeros follow the data
    ends, widths = ends[:n], widths[:n]
    first = (ends - widths) >> 3
    word = data[first].astype(np.int64) << 16 | data[first + 1].astype(np.int64) << 8 | data[first + 2]
    return word >> (24 - widths - ((ends - widths) & 7)) & ((1 << widths) - 1), ends


def unlzw(data: bytes) -> bytes:
    """Codes are read by runs from one clear code to the next, where their widths are known from the start."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out: list[bytes] = []
    at, started = 0, False
    first = [bytes((i,)) for i in range(256)]
    while True:
        codes, ends = _codes(raw, at, _FULL + 2)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        if not len(stop) and len(codes) == _FULL + 2:  # a writer that never clears goes on at twelve bits
            codes, ends = _codes(raw, at, 8 * len(data) // 9)
            stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        if not len(codes):
            return b"".join(out)
        n = int(stop[0]) if len(stop) else len(codes)
        if n and not started:
            raise ValueError("LZW data begins without a clear code")
        table = [*first, b"", b""]
        add = table.append
        last = b""
        for code in codes[:n].tolist():
            if code < len(table):
                new = table[code]
            elif code == len(table) and last:
                new = last + last[:1]
            else:
                raise ValueError("an LZW code is beyond the table")
            out.append(new)
            if last and len(table) < 4096:
                add(last + new[:1])
            last = new
        if not len(stop) or codes[n] == END:
            return b"".join(out)
        at, started = int(ends[n]), True


def compress(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how == LZW:
        return lzw(data)
    return packbits(data) if how == PACKBITS else zlib.compress(data, 6)


def decompress(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data
    if how == LZW:
        return unlzw(data)
    if how == PACKBITS:
        return unpackbits(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {how} isn't supported")


#: The most bytes that a byte of data can stand for, by coding (fixed by the codings: runs of 128 in two bytes, deflate's 1032, a string of 3838 bytes in a twelve-bit code).
EXPANSION = {NONE: 1, PACKBITS: 64, DEFLATE: 1033, OLD_DEFLATE: 1033, LZW: 2560}


def _blocks(height: int, width: int, tile: tuple[int, int] | None, rows: int) -> list[tuple[int, int, int, int]]:
    """(first row, rows, first column, columns) of the tiles, or of the strips."""
    if tile:
        return [(y, tile[0], x, tile[1]) for y in range(0, height, tile[0]) for x in range(0, width, tile[1])]
    return [(y, min(rows, height - y), 0, width) for y in range(0, height, rows)]


def write_tiff(pages: list[np.ndarray], how: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows: int = 64, planar: bool = False, order: str = "<") -> bytes:
    """Pages of 8-bit samples (rows x columns x samples) as a TIFF file."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width, samples = page.shape
        planes = [page[:, :, k : k + 1] for k in range(samples)] if planar else [page]
        offsets, counts = [], []
        for plane in planes:
            for y, h, x, w in _blocks(height, width, tile, rows):
                block = np.zeros((h, w, plane.shape[2]), np.uint8)
                inside = plane[y : y + h, x : x + w]
                block[: inside.shape[0], : inside.shape[1]] = inside
                if predictor == 2:
                    block[:, 1:] = block[:, 1:] - block[:, :-1]
                data = compress(block.tobytes(), how)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        out += b"\0" * (len(out) % 2)
        fields = {WIDTH: [width], LENGTH: [height], BITS: [8] * samples, COMPRESSION: [how], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [2 if planar else 1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile[1]], TILE_LENGTH: [tile[0]], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows], STRIP_COUNTS: counts}
        far, entries = bytearray(), b""
        start = len(out)
        base = start + 2 + 12 * len(fields) + 4
        for tag, values in sorted(fields.items()):
            short = tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR)
            data = struct.pack(f"{order}{len(values)}{'H' if short else 'I'}", *values)
            if len(data) > 4:
                place = struct.pack(order + "I", base + len(far))
                far += data + b"\0" * (len(data) % 2)
            else:
                place = data.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, 3 if short else 4, len(values)) + place
        struct.pack_into(order + "I", out, link, start)
        out += struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0" + far
        link = base - 4
    return bytes(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = TYPE_SIZES.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if kind in (1, 3, 4):
                fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, place))
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_tiff(data: bytes) -> Iterator[Page]:
    """Every page, in the order of the directories."""
    for number, (_, f) in enumerate(_directories(data)):
        one = lambda tag, other=None, f=f: f.get(tag, [other])[0]
        height, width, samples = one(LENGTH), one(WIDTH), one(SAMPLES, 1)
        if any(b != 8 for b in f.get(BITS, [1])):
            raise ValueError("only samples of 8 bits are read")
        how, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor} isn't supported")
        tile = (one(TILE_LENGTH), one(TILE_WIDTH)) if TILE_OFFSETS in f else None
        offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tile else (f[STRIP_OFFSETS], f[STRIP_COUNTS])
        if min(height, width, samples) < 1 or tile and min(tile) < 1 or how not in EXPANSION:
            raise ValueError(f"a page of {height} x {width} x {samples} with coding {how}")
        held = sum(max(0, min(c, len(data) - o)) for o, c in zip(offsets, counts, strict=True))
        if height * width * samples > EXPANSION[how] * held or tile and tile[0] * tile[1] * samples * len(offsets) > EXPANSION[how] * held * (samples if planar else 1):
            raise ValueError("the page claims more than its data can hold")
        blocks = _blocks(height, width, tile, min(one(ROWS_PER_STRIP, height), max(height, 1)))
        out = np.zeros((height, width, samples), np.uint8)
        for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
            y, h, x, w = blocks[k % len(blocks)]
            each = 1 if planar else samples
            raw = decompress(data[offset : offset + count], how, h * w * each)
            block = np.frombuffer(raw, np.uint8, h * w * each).reshape(h, w, each)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            part = out[y : y + h, x : x + w]
            inside = block[: part.shape[0], : part.shape[1]]
            if planar:
                part[:, :, k // len(blocks)] = inside[:, :, 0]
            else:
                part[:] = inside
        yield Page(number, out, how, predictor, tile is not None)


def tiff_pages(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row a page of every file: the key, page, width, height, samples, compression, predictor, tiled, data (the samples), error.

    A null or broken file gives one row with the error and nulls besides.
    """
    ready(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()
    fields = ["page int", "width int", "height int", "samples int", "compression string", "predictor int", "tiled boolean", "data binary", "error string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
        for b in batches:
            for i in range(b.num_rows):
                try:
                    rows = [(p.number, p.samples.shape[1], p.samples.shape[0], p.samples.shape[2], NAMES[p.compression], p.predictor, p.tiled, p.samples.tobytes(), None) for p in read_tiff(b.column(1)[i].as_py() or b"")]
                except (ValueError, KeyError, TypeError, struct.error, zlib.error, IndexError, MemoryError) as e:
                    rows = [(None,) * 8 + (f"{type(e).__name__}: {e}",)]
                key_col = pa.concat_arrays([b.column(0).slice(i, 1)] * len(rows)) if rows else b.column(0).slice(i, 0)
                columns = list(zip(*rows, strict=True)) or [[]] * 9
                yield pa.RecordBatch.from_arrays([key_col, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, *(f.split()[0] for f in fields)])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(fields))


ROW, PAGE_ROWS = 192, 2048
#: (coding, predictor, tile, rows a strip) by the payload's checksum.
LAYOUTS = [
    (LZW, 1, None, 64),
    (DEFLATE, 2, None, PAGE_ROWS),
    (PACKBITS, 1, None, PAGE_ROWS),
    (DEFLATE, 1, (128, 64), PAGE_ROWS),
    (LZW, 2, None, PAGE_ROWS),
    (PACKBITS, 1, (16, 64), PAGE_ROWS),
]


def stored(payload: bytes) -> bytes:
    """A payload of whole rows of 192 bytes as a TIFF of 64 columns in three samples, PAGE_ROWS rows a page.

    The payload's checksum alone picks the coding (LZW, deflate or PackBits), the predictor, and strips or tiles, at every length.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    how, predictor, tile, strip = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    return write_tiff(pages, how, predictor=predictor, tile=tile, rows=strip)


def features(pages: list[Page]) -> str:
    """Pages, coding, and the mean and span of each sample in whole numbers."""
    total = sum(len(p.samples) for p in pages) * ROW // 3
    sums = sum(p.samples.sum(axis=(0, 1), dtype=np.int64) for p in pages)
    low, high = np.min([p.samples.min(axis=(0, 1)) for p in pages], axis=0), np.max([p.samples.max(axis=(0, 1)) for p in pages], axis=0)
    p = pages[0]
    return f"pages={len(pages)};size=64x{sum(len(p.samples) for p in pages)}x3;{NAMES[p.compression]};predictor={p.predictor};{'tiles' if p.tiled else 'strips'};mean={','.join(str(int(s) // total) for s in sums)};span={','.join(f'{a}-{b}' for a, b in zip(low, high, strict=True))}"


def text_media(docs: DataFrame) -> DataFrame:
    """Every text's payload (its UTF-8, filled with spaces to whole rows of 192 bytes, one at least) stored as TIFF and read back.

    A null text is empty. Equal texts have equal values, repeated rows are each stored, an empty table gives no row; other columns are left out.
    A long text has several pages of PAGE_ROWS rows; a task holds one text's file and pages at a time.
    """
    ready(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                media = stored(raw.ljust(max(1, -(-len(raw) // ROW)) * ROW))
                pages = list(read_tiff(media))
                payload = b"".join(p.samples.tobytes() for p in pages)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(pages)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
