"""Scalar functions of shapes, tokens, scores and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_EDGE, TILE_TOKENS, LEAST_UNIT, MOST_UNIT = 384, 258, 256, 768


def decorative(width: Column, height: Column) -> Column:
    """Small and near square; shapes without an extent are not."""
    wide, tall = F.greatest(width, height), F.least(width, height)
    return F.when((width <= 0) | (height <= 0), False).otherwise((wide / tall <= 2) & (width * height < 1600))


def equation_shaped(width: Column, height: Column) -> Column:
    return F.when((width <= 0) | (height <= 0), False).otherwise((width > height) & (height <= 70) & (width / height >= 2))


def image_tokens(width: Column, height: Column, scale: float = 1.0) -> Column:
    """Estimated tokens of an image: one tile when small, else tiles of a unit that follows its shorter edge."""
    unit = F.least(F.lit(MOST_UNIT), F.greatest(F.lit(LEAST_UNIT), F.floor(F.least(width, height) / 1.5)))
    tiles = F.ceil(width / unit) * F.ceil(height / unit)
    return F.when(F.greatest(width, height) <= SMALL_EDGE, F.ceil(F.lit(TILE_TOKENS * scale))).otherwise(F.ceil(TILE_TOKENS * tiles * scale))


def hamming_similarity(left: Column, right: Column, bits: int = 64) -> Column:
    """Percent of equal bits of two longs, to one decimal."""
    return F.round((1 - F.bit_count(left.bitwiseXOR(right)) / bits) * 100, 1)


def sign_bits(vector: Column, bits: int = 63) -> Column:
    """A long with a bit set for each positive leading component."""
    return F.aggregate(F.slice(vector, 1, bits), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1) + F.when(x > 0, 1).otherwise(0))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def centred_cosine(left: Column, right: Column) -> Column:
    """Correlation of two vectors, 0 where one is constant."""
    centred = lambda v: F.transform(v, lambda x: x.cast("double") - _sum(F.transform(v, lambda y: y.cast("double"))) / F.size(v))
    a, b = centred(left), centred(right)
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0, _sum(F.zip_with(a, b, lambda x, y: x * y)) / norm).otherwise(0.0)


def box_gap(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column) -> Column:
    """The lesser distance between facing edges of two boxes, whichever stands above."""
    return F.least(F.abs(top_b - bottom_a), F.abs(top_a - bottom_b))


def overlaps(a: str, b: str) -> Column:
    """Whether boxes with columns ``a``x0.. and ``b``x0.. share an inner point."""
    c = F.col
    return (c(f"{a}x0") < c(f"{b}x1")) & (c(f"{b}x0") < c(f"{a}x1")) & (c(f"{a}y0") < c(f"{b}y1")) & (c(f"{b}y0") < c(f"{a}y1"))
