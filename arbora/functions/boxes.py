"""Boxes, affine maps and table grids as column expressions. A box is four doubles x0, y0, x1, y1; a map is six, a b c d e f."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thickness of a rule, distance at which edges are one, slack of containment, spread of a neutral colour.
RULE_THICKNESS, SAME_EDGE, INSIDE_SLACK, NEUTRAL_SPREAD = 2.0, 2.0, 0.5, 0.05
#: A shape up to this aspect and area is decoration; a formula is wide and no taller than this.
SQUARE_ASPECT, NOISE_AREA, FORMULA_HEIGHT, FORMULA_ALT = 2.0, 1600.0, 70.0, "EQUATION"
LEAST_SHOWN = 2.0


def neutral(red: Column, green: Column, blue: Column) -> Column:
    """Whether a colour is a grey: its channels lie close together."""
    return F.greatest(red, green, blue) - F.least(red, green, blue) <= NEUTRAL_SPREAD


def composed(first: Column, second: Column) -> Column:
    """The map that takes ``first`` and then ``second``; null where either has not six numbers."""
    a = [F.get(first, i) for i in range(6)]
    b = [F.get(second, i) for i in range(6)]
    linear = [a[2 * r] * b[c] + a[2 * r + 1] * b[2 + c] for r in range(2) for c in range(2)]
    shift = [a[4] * b[c] + a[5] * b[2 + c] + b[4 + c] for c in range(2)]
    return F.when((F.size(first) == 6) & (F.size(second) == 6), F.array(*linear, *shift))


def placed_unit_square(matrix: Column) -> Column:
    """The box that a map gives the unit square, and whether it flips it sideways or upside down."""
    at = [[F.get(matrix, 0) * x + F.get(matrix, 2) * y + F.get(matrix, 4) for x in (0, 1) for y in (0, 1)], [F.get(matrix, 1) * x + F.get(matrix, 3) * y + F.get(matrix, 5) for x in (0, 1) for y in (0, 1)]]
    corners = [F.least(*at[0]).alias("x0"), F.least(*at[1]).alias("y0"), F.greatest(*at[0]).alias("x1"), F.greatest(*at[1]).alias("y1")]
    return F.struct(*corners, (F.get(matrix, 0) < 0).alias("flip_x"), (F.get(matrix, 3) < 0).alias("flip_y"))


def numbers(operands: Column) -> Column:
    """The numbers in a run of operands."""
    return F.transform(F.regexp_extract_all(operands, F.lit(r"(?<![\w.+-])[+-]?(?:\d+\.?\d*|\.\d+)(?![\w.])"), F.lit(0)), lambda x: x.cast("double"))


def number_tree_value(nums: Column, key: Column) -> Column:
    """The reference that a flat number tree ``k ref 0 R k ref 0 R`` holds for a key, else null."""
    pairs = F.regexp_extract_all(nums, F.lit(r"\d+\s+\d+\s+\d+\s+R"), F.lit(0))
    hit = F.filter(pairs, lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("long") == key)
    return F.regexp_extract(F.get(hit, 0), r"^\d+\s+(\d+)", 1).cast("long")


def within_limits(key: Column, limits: Column) -> Column:
    """Whether a key lies in a node's [low, high]; a node without limits may hold any."""
    return F.coalesce((key >= F.get(limits, 0)) & (key <= F.get(limits, 1)), F.lit(True))


def overlap(a: list[Column], b: list[Column]) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def contains(outer: list[Column], inner: list[Column], slack: float = INSIDE_SLACK) -> Column:
    return (inner[0] >= outer[0] - slack) & (inner[1] >= outer[1] - slack) & (inner[2] <= outer[2] + slack) & (inner[3] <= outer[3] + slack)


def rule_kind(box: list[Column]) -> Column:
    """horizontal or vertical for a box thin enough to be a rule, else null; a dot is horizontal."""
    return F.when(box[3] - box[1] <= RULE_THICKNESS, "horizontal").when(box[2] - box[0] <= RULE_THICKNESS, "vertical")


def in_band(top: Column, below: Column, above: Column) -> Column:
    """From ``below`` on, up to ``above`` where there is one."""
    return (top >= below - SAME_EDGE) & F.coalesce(top <= above, F.lit(True))


def is_row_rule(x0: Column, x1: Column, edges: Column) -> Column:
    """Whether both ends of a rule lie on a column edge or past the outer ones; ``edges`` ascend."""
    ends = lambda x: (x <= F.get(edges, 0) + SAME_EDGE) | (x >= F.element_at(edges, -1) - SAME_EDGE) | F.exists(edges, lambda e: F.abs(x - e) <= SAME_EDGE)
    return (F.size(edges) > 0) & ends(x0) & ends(x1)


def band_index(value: Column, edges: Column) -> Column:
    """The number of the band [edge, next edge) that holds a value, null outside; ``edges`` ascend."""
    below = F.size(F.filter(edges, lambda e: e <= value))
    return F.when((below > 0) & (below < F.size(edges)), below - 1)


def is_decorative(width: Column, height: Column) -> Column:
    """Small and about square; nothing without extent is."""
    sides = F.greatest(width, height), F.least(width, height)
    return (sides[1] > 0) & (F.try_divide(sides[0], sides[1]) <= SQUARE_ASPECT) & (width * height < NOISE_AREA)


def is_formula_shaped(width: Column, height: Column) -> Column:
    return (height > 0) & (width > height) & (height <= FORMULA_HEIGHT) & (F.try_divide(width, height) >= SQUARE_ASPECT)


def is_tagged_formula(alt: Column) -> Column:
    return F.coalesce(F.trim(alt) == FORMULA_ALT, F.lit(False))


def image_group(alt: Column, width: Column, height: Column, free: Column, vector: Column) -> Column:
    """equation, figure or unkeyed: a tag decides, then shape where an image is ``free`` of caption, decoration and tables."""
    shaped = free & is_formula_shaped(width, height)
    return F.when(is_tagged_formula(alt), "equation").when(~shaped, "figure").when(vector, "unkeyed").otherwise("equation")


def shown_box(box: list[Column]) -> Column:
    """left, top, width and height, with a visible extent at least."""
    return F.struct(box[0].alias("left"), box[1].alias("top"), F.greatest(box[2] - box[0], F.lit(LEAST_SHOWN)).alias("width"), F.greatest(box[3] - box[1], F.lit(LEAST_SHOWN)).alias("height"))


def clipped(box: list[Column], bounds: list[Column]) -> list[Column]:
    return [F.greatest(box[0], bounds[0]), F.greatest(box[1], bounds[1]), F.least(box[2], bounds[2]), F.least(box[3], bounds[3])]


def content_extent(box: list[Column], bounds: list[Column]) -> list[Column]:
    """Aggregates: the box around what is left of boxes clipped to their bounds; null where nothing is."""
    cut = clipped(box, bounds)
    left = (cut[2] > cut[0]) & (cut[3] > cut[1])
    return [f(F.when(left, x)).alias(n) for f, x, n in zip((F.min, F.min, F.max, F.max), cut, ("x0", "y0", "x1", "y1"))]
