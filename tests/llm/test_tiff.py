import struct
import zlib

import numpy as np
import pytest

from arbora.llm.media_query import described
from arbora.llm.tiff import DEFLATE, LZW, NONE, PACKBITS, lzw_decode, lzw_encode, pack_bits, read_tiff, tiff_pages, unpack_bits, write_tiff


@pytest.mark.parametrize("compression", [NONE, LZW, DEFLATE, PACKBITS])
@pytest.mark.parametrize("tile", [None, 16, 64])
@pytest.mark.parametrize("predictor", [1, 2])
def test_round_trip(compression, tile, predictor):
    rng = np.random.default_rng(7)
    payload = (np.repeat(rng.integers(0, 6, 37 * 24), 8) * 40).astype(np.uint8).tobytes() + rng.integers(0, 256, 192 * 60, dtype=np.uint8).tobytes()
    payload = payload[: len(payload) // 192 * 192]
    pages = read_tiff(write_tiff(payload, 192, compression, predictor, page_rows=50, tile=tile, strip_rows=16))
    assert b"".join(p.pixels for p in pages) == payload and len(pages) == -(-len(payload) // 192 // 50)


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 200, bytes(range(256)) * 40, b"abababab" * 3000])
def test_codings(data):
    assert lzw_decode(lzw_encode(data), len(data)) == data
    assert unpack_bits(pack_bits(data), len(data)) == data


def test_known_codes():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert lzw_decode(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data
    assert unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA]), 10) == bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4)


def test_big_endian_planar_sixteen_bits():
    samples = (np.arange(2 * 3 * 2) * 1000).astype(">u2").reshape(2, 2, 3)
    data = b"".join(plane.tobytes() for plane in samples)
    tags = [(256, 3, 1, struct.pack(">HH", 3, 0)), (257, 3, 1, struct.pack(">HH", 2, 0)), (258, 3, 2, struct.pack(">HH", 16, 16)), (259, 3, 1, struct.pack(">HH", 1, 0)), (273, 4, 2, None), (277, 3, 1, struct.pack(">HH", 2, 0)), (278, 3, 1, struct.pack(">HH", 2, 0)), (279, 4, 2, None), (284, 3, 1, struct.pack(">HH", 2, 0))]
    more = 8 + len(data)
    arrays = struct.pack(">IIII", 8, 8 + 12, 12, 12)
    entries = b"".join(struct.pack(">HHI", t, k, n) + (v or struct.pack(">I", more + (0 if t == 273 else 8))) for t, k, n, v in tags)
    blob = b"MM\0*" + struct.pack(">I", more + 16) + data + arrays + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0"
    (page,) = read_tiff(blob)
    assert (np.frombuffer(page.pixels, ">u2").reshape(2, 3, 2) == samples.transpose(1, 2, 0)).all()


def test_cyclic_directories_end():
    blob = bytearray(write_tiff(bytes(192 * 4), page_rows=2))
    first = struct.unpack_from("<I", blob, 4)[0]
    second = struct.unpack_from("<I", blob, first + 2 + 12 * struct.unpack_from("<H", blob, first)[0])[0]
    struct.pack_into("<I", blob, second + 2 + 12 * struct.unpack_from("<H", blob, second)[0], first)
    assert len(read_tiff(bytes(blob))) == 2


def test_rows(spark):
    good = write_tiff(bytes(192 * 3), page_rows=2)
    rows = spark.createDataFrame([(1, good, "x"), (2, b"nonsense", "y"), (3, None, "z"), (4, good[:40], "w"), (5, b"", "v")], "id long, media binary, page string")
    found = [(r.id, r.page, r.height, r.error is not None) for r in tiff_pages(rows).orderBy("id", "page").collect()]
    assert found == [(1, 0, 2, False), (1, 1, 1, False), (2, None, None, True), (4, None, None, True), (5, None, None, True)]


@pytest.mark.parametrize("text", [b"", b"x", b"y" * 192, b"z" * 193, "é".encode() * 100_000])
def test_described(text):
    n, padded, *_ = described(text)
    assert n == len(text) and padded % 192 == 0 and padded >= max(n, 1)


def one_page(**changes):
    tags = {256: 4, 257: 4, 258: 8, 259: 1, 273: 8, 277: 1, 278: 4, 279: 16} | {int(k[1:]): v for k, v in changes.items()}
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items()) if v is not None)
    return b"II*\0" + struct.pack("<I", 24) + bytes(range(16)) + struct.pack("<H", entries.count(b"") and len(entries) // 12) + entries + b"\0\0\0\0"


@pytest.mark.parametrize("changes", [{"t278": 0}, {"t256": 0}, {"t257": 0}, {"t277": 0}, {"t256": 4_000_000_000, "t257": 4_000_000_000}, {"t322": 0, "t323": 16, "t324": 8, "t325": 16}, {"t322": 16, "t323": 0, "t324": 8, "t325": 16}, {"t279": None}, {"t259": 8}])
def test_bad_tags_give_an_error_row(spark, changes):
    assert read_tiff(one_page())[0].pixels == bytes(range(16))
    with pytest.raises((ValueError, KeyError, zlib.error)):
        read_tiff(one_page(**changes))
    (row,) = tiff_pages(spark.createDataFrame([(one_page(**changes),)], "media binary")).collect()
    assert row.error and row.pixels is None


def test_inflating_is_bounded():
    huge = zlib.compress(bytes(50_000_000), 9)
    blob = b"II*\0" + struct.pack("<I", 8 + len(huge)) + huge
    tags = {256: 4, 257: 4, 258: 8, 259: 8, 273: 8, 277: 1, 278: 4, 279: len(huge)}
    blob += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items())) + b"\0\0\0\0"
    assert read_tiff(blob)[0].pixels == bytes(16)
