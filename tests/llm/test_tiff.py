import hashlib
import random
import zlib

import numpy as np
import pytest

from verdictlab.llm import tiff

from .fixtures import ODD_ROWS, SCHEMA, TEXTS, documents


def inputs():
    rng = random.Random(7)
    yield from (b"", b"a", b"aaa", b"ab" * 5000, bytes(range(256)) * 40, b"\0" * 100_000)
    yield from (bytes(rng.choice(b"abc \0") for _ in range(n)) for n in (2, 127, 128, 129, 3000, 60_000))
    yield np.random.default_rng(1).integers(0, 256, 50_000, dtype=np.uint8).tobytes()


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_codecs_round_trip(how):
    for data in inputs():
        assert tiff.decompress(tiff.compress(data, how), how, len(data)) == data


def test_known_codes():
    # the worked examples of the format's description
    assert tiff.unpackbits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unlzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.unlzw(tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def plain_unlzw(data):
    """A reader of its own, bit by bit: codes grow when the table's next code would not fit less one."""
    bits, at, out = "".join(f"{b:08b}" for b in data), 0, b""
    table, last = {}, None
    while True:
        width = next(w for w in range(9, 13) if len(table) < 2**w - 1 or w == 12)
        code, at = int(bits[at : at + width] or "0", 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, last = {i: bytes([i]) for i in range(256)} | {256: None, 257: None}, None
            continue
        new = table[code] if code in table else last + last[:1]
        if last is not None:
            table[len(table)] = last + new[:1]
        out, last = out + new, new


def plain_samples(media):
    """Independent decoding of what ``stored`` writes: little-endian, one plane, three samples."""
    word = lambda at, n: int.from_bytes(media[at : at + n], "little")
    at, out = word(4, 4), b""
    while at:
        n, tags = word(at, 2), {}
        for e in range(at + 2, at + 2 + 12 * n, 12):
            size, many = {3: 2, 4: 4}[word(e + 2, 2)], word(e + 4, 4)
            place = e + 8 if size * many <= 4 else word(e + 8, 4)
            tags[word(e, 2)] = [word(place + size * i, size) for i in range(many)]
        width, height = tags[256][0], tags[257][0]
        tiled = 324 in tags
        page = np.zeros((height, width, 3), np.uint8)
        h, w = (tags[323][0], tags[322][0]) if tiled else (tags[278][0], width)
        corners = [(y, x) for y in range(0, height, h) for x in range(0, width, w)]
        for (y, x), o, c in zip(corners, tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True):
            data, how = media[o : o + c], tags[259][0]
            if how == 5:
                raw = plain_unlzw(data)
            elif how == 8:
                raw = zlib.decompress(data)
            else:
                raw, i = b"", 0
                while i < len(data):
                    k = data[i]
                    raw, i = (raw + data[i + 1 : i + 2 + k], i + 2 + k) if k < 128 else (raw + data[i + 1 : i + 2] * (257 - k), i + 2)
            block = np.frombuffer(raw, np.uint8).reshape(-1, w, 3).copy()
            if tags[317][0] == 2:
                for col in range(1, w):
                    block[:, col] += block[:, col - 1]
            page[y : y + h, x : x + w] = block[: height - y, : width - x]
        out += page.tobytes()
        at = word(at + 2 + 12 * n, 4)
    return out


def test_stored_form_by_another_reader():
    rng, seen = random.Random(3), set()
    for n in [1, 2, 5, 40, 300, 2049] * 6:
        payload = "".join(rng.choice(["the ", "on ", "êa ", "\n", "%%% ", "word"]) for _ in range(192 * n)).encode()[: 192 * n]
        media = tiff.stored(payload)
        assert plain_samples(media) == payload
        seen.update((p.compression, p.predictor, p.tiled) for p in tiff.read_tiff(media))
    assert seen == {(how, predictor, tile is not None) for how, predictor, tile, _ in tiff.LAYOUTS}


def test_lzw_without_clear_codes():
    data = np.random.default_rng(5).integers(0, 4, 60_000, dtype=np.uint8).tobytes()
    table, codes, prefix = {bytes([i]): i for i in range(256)}, [256], b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer not in table:
            codes.append(table[prefix])
            if len(table) + 2 < 4096:
                table[longer] = len(table) + 2
            longer = data[i : i + 1]
        prefix = longer
    codes += [table[prefix], 257]
    widths = [9, *(next(w for w in range(9, 13) if 258 + k < 2**w or w == 12) for k in range(len(codes) - 1))]
    bits = "".join(f"{c:0{w}b}" for c, w in zip(codes, widths, strict=True))
    assert tiff.unlzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == data


def test_forged_sizes(spark):
    page = np.zeros((8, 8, 3), np.uint8)
    files = []
    for how in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for tag in (tiff.WIDTH, tiff.LENGTH, tiff.ROWS_PER_STRIP):
            data = bytearray(tiff.write_tiff([page], how))
            at = int.from_bytes(data[4:8], "little")
            entry = next(e for e in range(at + 2, len(data), 12) if int.from_bytes(data[e : e + 2], "little") == tag)
            data[entry + 8 : entry + 12] = (2**31 - 1).to_bytes(4, "little")
            files.append(data)
    rows = tiff.tiff_pages(spark.createDataFrame(list(enumerate(files)), "id int, content binary"), "id", "content").collect()
    assert all((r["error"] is None) == (r["id"] % 3 == 2) for r in rows) and len(rows) == len(files)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_pages_round_trip(order, planar, tile, predictor, how):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 9, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (37, 50, 3), (16, 32, 4))]
    got = list(tiff.read_tiff(tiff.write_tiff(pages, how, predictor, tile, rows=5, planar=planar, order=order)))
    assert [p.number for p in got] == [0, 1, 2]
    for a, b in zip(pages, got, strict=True):
        assert (a == b.samples).all() and b.compression == how and b.tiled == (tile is not None)


def test_pages_of_files(spark):
    page = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    good = tiff.write_tiff([page, page])
    loop = bytearray(tiff.write_tiff([page]))
    at = int.from_bytes(loop[4:8], "little")
    n = int.from_bytes(loop[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = loop[4:8]
    files = spark.createDataFrame([(1, bytearray(good), "x"), (2, bytearray(b"no"), "x"), (3, None, "x"), (4, loop, "x"), (None, bytearray(good), "x")], "id long, content binary, page string")
    rows = tiff.tiff_pages(files, "id", "content").collect()
    assert sorted((r["id"] or 0, r["page"]) for r in rows if r["error"] is None) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sorted(r["id"] for r in rows if r["error"]) == [2, 3, 4]
    assert all(bytes(r["data"]) == page.tobytes() for r in rows if r["error"] is None)


def test_text_media(spark):
    docs = documents(spark, [*TEXTS, "x" * 192, "y" * 193, "long text, " * 60_000], ODD_ROWS).repartition(3)
    texts = {}
    for d, t, *_ in docs.collect():
        texts.setdefault(d, []).append((t or "").encode())
    rows = tiff.text_media(docs).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for r in rows:
        raw = texts[r["doc_id"]][0]
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(tiff.stored(payload)) and r["media_sha256"] == hashlib.sha256(tiff.stored(payload)).hexdigest()
        assert by_text.setdefault(raw, r["feature"]) == r["feature"]
    assert {r["feature"].split(";")[0] for r in rows} >= {"pages=1", "pages=2"}
    assert tiff.text_media(spark.createDataFrame([], SCHEMA)).count() == 0
