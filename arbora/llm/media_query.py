"""op10: every text of ``documents`` stored as a TIFF and read back.

Defined cases: null is the empty text, stored as one row of spaces; equal texts give equal values; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arbora.llm.common import texts_of
from arbora.llm.tiff import read_tiff, write_tiff
from arbora.sources.tables import table

UNIT = 192


def feature_of(pages: list, payload: bytes) -> str:
    """Pages, rows, and of the samples the least, greatest, sum and the counts of eight equal ranges."""
    values = np.frombuffer(payload, np.uint8)
    ranges = np.bincount(values >> 5, minlength=8)
    return f"pages={len(pages)};rows={sum(p.height for p in pages)};min={values.min()};max={values.max()};sum={int(values.sum(dtype=np.int64))};ranges={','.join(map(str, ranges))}"


def described(text: bytes) -> tuple:
    payload = text + b" " * (-len(text) % UNIT if text else UNIT)
    media = write_tiff(payload, UNIT)
    pages = read_tiff(media)
    back = b"".join(p.pixels for p in pages)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pages, back)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = list(map(described, texts_of(batch.column(1), 64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types))], names)


def op10_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


QUERIES = {"op10_tiff_media": op10_tiff_media}
ORACLES: dict[str, str] = {}
