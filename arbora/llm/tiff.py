"""TIFF: a writer for 8-bit grey pages and a reader that walks image directories and emits one row a page.

The reader takes either byte order, strips and tiles, chunky and planar samples of 8 or 16 bits, no compression, PackBits, LZW
and deflate, and undoes the horizontal predictor.

Defined cases: null bytes give no page; bytes that are no readable TIFF, or whose tags ask for an image or
tile of more than MOST_BYTES or of no extent, give one row with ``error`` set; a directory chain that
returns to itself ends there; further columns pass through, those with the name of a result column are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

MOST_BYTES = 1 << 30
PAGE_ROWS = 4096
STRIP_ROWS = 256
#: Fixed values of the format: tags, compression schemes and the bytes of a field type.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_LENGTH, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes


def pack_bits(data: bytes) -> bytes:
    """PackBits of one row."""
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
            end += 1
        out.append(end - i - 1)
        out += data[i:end]
        i = end
    return bytes(out)


def unpack_bits(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2 if head > 128 else 1
    return bytes(out[:most])


def lzw_encode(data: bytes) -> bytes:
    """LZW, most significant bit first, widths growing one code early; the table restarts when full."""
    held, width, value, bits, out = {bytes((i,)): i for i in range(256)}, 9, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal value, bits
        value, bits = (value << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((value >> bits) & 255)
        value &= (1 << bits) - 1

    put(256)
    seen = b""
    following = 258
    for i in range(len(data)):
        longer = seen + data[i : i + 1]
        if longer in held:
            seen = longer
            continue
        put(held[seen])
        held[longer] = following
        following += 1
        if following == 4095:
            put(256)
            held, following, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif following >= (1 << width):
            width += 1
        seen = data[i : i + 1]
    if seen:
        put(held[seen])
        following += 1
        if following >= (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((value << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, most: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, out, last, value, bits = list(first), 9, bytearray(), b"", 0, 0
    for byte in data:
        value, bits = (value << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = value >> bits
        value &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of order")
        out += entry
        if last:
            table.append(last + entry[:1])
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
        last = entry
        if len(out) >= most:
            break
    return bytes(out[:most])


def _packed(rows: np.ndarray, compression: int) -> bytes:
    if compression == PACKBITS:
        return b"".join(pack_bits(r.tobytes()) for r in rows)
    data = rows.tobytes()
    return {NONE: lambda: data, LZW: lambda: lzw_encode(data), DEFLATE: lambda: zlib.compress(data, 1)}[compression]()


def _unpacked(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data[:most]
    if compression == PACKBITS:
        return unpack_bits(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {compression} is not read")


def write_tiff(payload: bytes, width: int = 192, compression: int = DEFLATE, predictor: int = 2, page_rows: int = PAGE_ROWS, tile: int | None = None, strip_rows: int = STRIP_ROWS) -> bytes:
    """8-bit grey pages of ``page_rows`` rows at most; ``tile`` (a multiple of 16) writes square tiles instead of strips."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4

    def differenced(part: np.ndarray) -> np.ndarray:
        if predictor == 2:
            part = part.copy()
            part[:, 1:] -= part[:, :-1].copy()
        return part

    for top in range(0, len(pixels), page_rows):
        page = pixels[top : top + page_rows]
        if tile:
            filled = np.zeros((-(-len(page) // tile) * tile, -(-width // tile) * tile), np.uint8)
            filled[: len(page), :width] = page
            parts = [filled[y : y + tile, x : x + tile] for y in range(0, len(filled), tile) for x in range(0, filled.shape[1], tile)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        blobs = [_packed(differenced(p), compression) for p in parts]
        offsets = []
        for blob in blobs:
            offsets.append(len(out))
            out += blob + b"\0" * (len(blob) % 2)
        layout = {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: offsets, TILE_BYTES: [len(b) for b in blobs]} if tile else {STRIP_OFFSETS: offsets, STRIP_LENGTH: [strip_rows], STRIP_BYTES: [len(b) for b in blobs]}
        tags = {WIDTH: [width], LENGTH: [len(page)], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]} | layout
        entries = []
        for tag in sorted(tags):
            values = struct.pack(f"<{len(tags[tag])}I", *tags[tag])
            if len(values) > 4:
                values, where = struct.pack("<I", len(out)), values
                out += where
            entries.append(struct.pack("<HHI", tag, 4, len(tags[tag])) + values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, list[int]] = {}
    for place in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        if kind not in FIELD or kind == 2:
            continue
        if count > len(data):
            raise ValueError("a field longer than the file")
        length = struct.calcsize(FIELD[kind]) * count
        where = place + 8 if length <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        tags[tag] = list(struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, where))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, order: str, tags: dict[int, list[int]]) -> Page:
    one = lambda tag, default=None: tags[tag][0] if default is None or tag in tags else default
    width, height, samples, bits = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planes = one(COMPRESSION, 1), one(PREDICTOR, 1), samples if one(PLANAR, 1) == 2 else 1
    if bits not in (8, 16) or len(set(tags[BITS])) != 1 or predictor not in (1, 2):
        raise ValueError(f"{bits} bits with predictor {predictor} are not read")
    kind, depth = np.dtype(f"{order}u{bits // 8}"), samples // planes
    tiled = TILE_OFFSETS in tags
    part_width, part_height = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(STRIP_LENGTH, height), height))
    if min(width, height, samples, part_width, part_height) < 1:
        raise ValueError("an image, strip or tile without extent")
    if max(width * height, part_width * part_height) * samples * kind.itemsize > MOST_BYTES:
        raise ValueError("an image or tile beyond the bound of bytes")
    across, down = -(-width // part_width), -(-height // part_height)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    if len(offsets) != across * down * planes or len(counts) != len(offsets):
        raise ValueError("strips or tiles do not cover the image")
    image = np.zeros((height, width, samples), kind)
    for i, (offset, count) in enumerate(zip(offsets, counts)):
        plane, cell = divmod(i, across * down)
        y, x = cell // across * part_height, cell % across * part_width
        rows = part_height if tiled else min(part_height, height - y)
        raw = _unpacked(data[offset : offset + count], compression, rows * part_width * depth * kind.itemsize)
        part = np.frombuffer(raw, kind).reshape(rows, part_width, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        into = image[y : y + rows, x : x + part_width, plane : plane + depth] if planes > 1 else image[y : y + rows, x : x + part_width]
        into[...] = part[: into.shape[0], : into.shape[1]]
    return Page(width, height, samples, bits, compression, image.tobytes())


def read_tiff(data: bytes) -> list[Page]:
    """Each page in directory order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    pages, seen, at = [], set(), struct.unpack_from(order + "I", data, 4)[0]
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(data, order, at)
        pages.append(_page(data, order, tags))
    return pages


PAGE_FIELDS = (("page", IntegerType()), ("width", IntegerType()), ("height", IntegerType()), ("samples", IntegerType()), ("bits", IntegerType()), ("compression", IntegerType()), ("pixels", BinaryType()), ("error", StringType()))


def _pages(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 6 + [pa.binary(), pa.string()]
        for batch in batches:
            kept = [n for n in batch.schema.names if n not in dict(PAGE_FIELDS)]
            for i, data in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                if data is None:
                    continue
                try:
                    rows = [(n, p.width, p.height, p.samples, p.bits, p.compression, p.pixels, None) for n, p in enumerate(read_tiff(data))]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    rows = [(None,) * 7 + (str(e),)]
                again = pa.array([i] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)).take(again) for n in kept] + [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [batch.column(batch.schema.get_field_index(n)).slice(0, 0) for n in kept] + [pa.array([], t) for t in types], kept + [n for n, _ in PAGE_FIELDS])

    return run


def tiff_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row a page of each TIFF in ``column``: page, width, height, samples, bits, compression, pixels, error."""
    names = dict(PAGE_FIELDS)
    if column in names:
        raise ValueError(f"{column} is the name of a result column")
    schema = StructType([f for f in media.schema.fields if f.name not in names] + [StructField(n, t) for n, t in PAGE_FIELDS])
    return media.mapInArrow(_pages(column), schema)
