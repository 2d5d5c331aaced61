"""Comparison of two document trees: which tables, rows and cells are counterparts, what passes, and why the rest does not.

Tables are rows of (scope, ord, key, title); grid cells rows of (table, row_ord, row_key, cell_ord, cell_key, content). What
needs order within a scope or a table streams through sorted groups; everything across them is joins and counts.

Defined cases: null titles and contents are empty ones; untitled tables match by place alone; empty cells are never alike;
empty sides give no pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.styled import counted
from arbora.functions.text import title_key
from arbora.operators.islands import by_key, in_order, row_pairs
from arbora.sources.staging import staged

#: Fixed value: scopes of more tables are looked at before they are gathered; there are few of them.
MANY_TABLES = 10_000


def _sided(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)))


def _split(rows: dict, *names: str) -> list[list[tuple]]:
    """The rows' values of ``names``, by side."""
    listed = list(zip(rows["__side"], *(rows[n] for n in names)))
    return [[r[1:] for r in listed if r[0] == side] for side in (0, 1)]


def _paired_scopes(both: DataFrame) -> DataFrame:
    """``both`` without the scopes of very many tables that one side alone has, which pair with none; a scope is held as a whole."""
    sides = both.groupBy(F.col("scope").alias("__scope")).agg(F.count("*").alias("n"), F.min("__side").alias("a"), F.max("__side").alias("b"))
    lone = sides.filter((F.col("a") == F.col("b")) & (F.col("n") > MANY_TABLES)).select("__scope")
    return both.join(F.broadcast(lone), F.col("scope").eqNullSafe(F.col("__scope")), "left_anti")


def titled_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_key, right_key) of tables paired by title within their scope: equal titles in order, differing runs by place."""

    def pair(_: tuple, rows: dict) -> list[tuple]:
        sides = _split(rows, "key", "__title")
        if not all(sides):
            return []
        names = [[title or (side, n) for n, (_, title) in enumerate(own)] for side, own in enumerate(sides)]
        return [(sides[0][i][0], sides[1][j][0]) for i, j in in_order(*names)]

    both = _paired_scopes(_sided(left, right)).withColumn("__title", title_key(F.coalesce("title", F.lit(""))))
    return by_key(both.select("scope", "ord", "key", "__title", "__side"), ["scope"], ["__side", "ord"], pair, "left_key string, right_key string")


def unique_title_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_key, right_key) of tables whose title no other of their side has."""

    def alone(side: DataFrame, name: str) -> DataFrame:
        titled = side.withColumn("__title", title_key(F.coalesce("title", F.lit("")))).filter("__title <> ''")
        return titled.groupBy("__title").agg(F.count("*").alias("n"), F.min("key").alias(name)).filter("n = 1").drop("n")

    return alone(left, "left_key").join(alone(right, "right_key"), "__title").drop("__title")


def table_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs within scopes, and of the tables left over those of a title unique on both sides."""
    inside = staged(titled_pairs(left, right))
    rest = [side.join(inside.select(F.col(name).alias("key")), "key", "left_anti") for side, name in ((left, "left_key"), (right, "right_key"))]
    return inside.unionByName(unique_title_pairs(*rest))


def grid_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_key, right_key) of the rows and cells of paired tables; right_key is null for what has no counterpart."""

    def pair(_: tuple, rows: dict) -> list[tuple]:
        sides, out = [], []
        for listed in _split(rows, "row_ord", "row_key", "cell_key", "content"):
            grid: dict = {}
            for row_ord, row_key, cell_key, content in listed:
                grid.setdefault(row_ord, (row_key, []))[1].append((cell_key, content or ""))
            sides.append(list(grid.values()))
        ours, theirs = sides
        partners = dict(row_pairs(*([[x for _, x in cells] for _, cells in side] for side in sides)))
        for n, (row, cells) in enumerate(ours):
            other, other_cells = theirs[partners[n]] if n in partners else (None, [])
            names = [[counted(x) or (side, i) for i, (_, x) in enumerate(own)] for side, own in enumerate((cells, other_cells))]
            met = dict(in_order(*names))
            out.append((row, other))
            out += [(cell, other_cells[met[i]][0] if i in met else None) for i, (cell, _) in enumerate(cells)]
        return out

    columns = ["row_ord", "row_key", "cell_ord", "cell_key", "content"]
    ours = left.join(pairs.select(F.col("left_key").alias("table")), "table", "left_semi").select("table", *columns)
    theirs = right.join(pairs.select(F.col("right_key").alias("table"), "left_key"), "table").select(F.col("left_key").alias("table"), *columns)
    return by_key(_sided(ours, theirs), ["table"], ["__side", "row_ord", "cell_ord"], pair, "left_key string, right_key string")


def counterparts(left_tables: DataFrame, right_tables: DataFrame, left_cells: DataFrame, right_cells: DataFrame) -> DataFrame:
    """(left_key, right_key) of all tables, rows and cells that are settled: pairs, and null for what must not be compared.

    A table without a counterpart whose key the other side has all the same is settled as none, with its rows and cells."""
    pairs = staged(table_pairs(left_tables, right_tables))
    unpaired = left_tables.select(F.col("key").alias("table")).join(pairs.select(F.col("left_key").alias("table")), "table", "left_anti").join(right_tables.select(F.col("key").alias("table")), "table", "left_semi")
    lost = left_cells.join(unpaired, "table", "left_semi")
    none = unpaired.select(F.col("table").alias("left_key")).unionByName(lost.select(F.col("row_key").alias("left_key")).distinct()).unionByName(lost.select(F.col("cell_key").alias("left_key")))
    return pairs.unionByName(grid_pairs(left_cells, right_cells, pairs)).unionByName(none.withColumn("right_key", F.lit(None).cast("string")))


def _partnered(side: DataFrame, settled: DataFrame) -> DataFrame:
    """``side`` with partner: the settled counterpart, none where none is settled as such, else the same key."""
    known = settled.select(F.col("left_key").alias("key"), F.col("right_key").alias("__to"), F.lit(True).alias("__known"))
    return side.join(known, "key", "left").withColumn("partner", F.when(F.col("__known"), F.col("__to")).otherwise(F.when(F.col("key") != "", F.col("key")))).drop("__to", "__known")


def compared(nodes: DataFrame, others: DataFrame, settled: DataFrame, images: DataFrame, matches: Callable[[Column, Column], Column]) -> DataFrame:
    """(path, key, ok, own_ok, partner, met) of every node of a tree: ok where it, its images and all below it pass.

    ``nodes`` are (path, key, type, content), a path being its parent's, a slash and its own place; ``others`` (key, content);
    ``images`` (owner_path, ok). A node without a key passes by itself, one with children where it has a counterpart, a leaf where ``matches`` says so
    of both contents, an empty cell without counterpart where its row has one. Failures alone go up: each names its ancestors,
    so the cost is failures times depth, and no node gathers its children. Contents are compared as they meet and left behind:
    what is dealt by path afterwards is keys and flags, and marks of what fails. Also has inner: of nodes that are not ok, those with
    nodes below them."""
    right = others.select(F.col("key").alias("partner"), F.col("content").alias("__other"), F.lit(True).alias("met"))
    content = F.coalesce("content", F.lit(""))
    told = {
        "met": F.coalesce("met", F.lit(False)),
        "keyless": F.coalesce("key", F.lit("")) == "",
        "blank": (F.col("type") == "Cell") & (F.trim(content) == ""),
        "alike": matches(content, F.coalesce("__other", F.lit(""))),
        "own": F.col("partner").eqNullSafe(F.col("key")),
        "elsewhere": F.when(~F.col("partner").eqNullSafe(F.col("key")), F.col("partner")),
    }
    known = staged(_partnered(nodes, settled).join(right.hint("merge"), "partner", "left").select("path", "key", *(x.alias(n) for n, x in told.items())))
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).alias("__parent")
    parents = staged(known.select(parent).filter("__parent IS NOT NULL").distinct().select(F.col("__parent").alias("path"), F.lit(True).alias("inner")))
    # only what may fail by itself asks whether it has nodes below it, or a row above it that has a counterpart
    suspects = known.filter(F.when(F.col("met"), ~F.col("alike")).otherwise(~F.col("keyless"))).select("path", parent, "met", "blank")
    above = known.filter("met").select(F.col("path").alias("__parent"), F.lit(True).alias("covered"))  # one alone, or as many that say the same
    no = F.lit(False)
    differing = suspects.filter("met").join(parents, "path", "left").select("path", F.coalesce("inner", no).alias("closed"), no.alias("covered"))
    empty = suspects.filter("NOT met AND blank").join(above.hint("merge"), "__parent", "left").select("path", no.alias("closed"), F.coalesce("covered", no).alias("covered"))
    lone = suspects.filter("NOT met AND NOT blank").select("path", no.alias("closed"), no.alias("covered"))
    settled_ones = staged(differing.unionByName(empty).unionByName(lone))
    failed = settled_ones.filter("NOT closed AND NOT covered").select("path").unionByName(images.filter("NOT ok").select(F.col("owner_path").alias("path"))).distinct()
    parts = F.split("path", "/")
    up = failed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    bad = up.join(parents.hint("merge"), "path", "left").select("path", no.alias("closed"), no.alias("covered"), F.lit(True).alias("bad"), F.coalesce("inner", no).alias("inner"))
    marks = bad.unionByName(settled_ones.filter("closed OR covered").select("path", "closed", "covered", no.alias("bad"), F.col("closed").alias("inner")))
    marks = marks.groupBy("path").agg(*(F.bool_or(n).alias(n) for n in ("closed", "covered", "bad", "inner")))
    marked = lambda n: F.coalesce(n, no)
    own = F.when(F.col("met"), F.col("alike") | marked("closed")).otherwise(F.col("keyless") | (F.col("blank") & marked("covered")))
    partner = F.when(F.col("own"), F.col("key")).otherwise(F.col("elsewhere"))
    return known.join(marks.hint("merge"), "path", "left").select("path", "key", partner.alias("partner"), "met", marked("inner").alias("inner"), own.alias("own_ok"), (~marked("bad")).alias("ok"))


def leaf_reasons(statuses: DataFrame, kinds: DataFrame) -> DataFrame:
    """(key, kind) of failed leaves with a key: no counterpart, the difference of ``kinds`` (key, kind), else an image inside."""
    failed = statuses.filter("NOT ok AND NOT inner AND key <> ''")
    return failed.join(kinds.withColumnRenamed("kind", "__kind"), "key", "left").select("key", F.when(~F.col("met"), "no_web").otherwise(F.coalesce("__kind", F.lit("image_inside"))).alias("kind"))


def image_reasons(images: DataFrame, others: DataFrame, settled: DataFrame) -> DataFrame:
    """(key, kind) of failed images (key, ok): one that differs, or none on the other side (key)."""
    there = others.select(F.col("key").alias("partner"), F.lit(True).alias("__there")).distinct()
    met = _partnered(images.filter("NOT ok"), settled).join(there, "partner", "left")
    return met.select("key", F.when(F.col("__there"), "image_differs").otherwise("no_web_image").alias("kind"))


def by_precedence(rows: DataFrame, key: str, sources: list[tuple[DataFrame, Column]], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` from the first source that knows them; each source is (table of key and columns, expression over ``rows``)."""
    out = rows
    for n, (source, expression) in enumerate(sources):
        own = source.select(F.col(key).alias(f"__k{n}"), *(F.col(x).alias(f"__{x}{n}") for x in columns), F.lit(True).alias(f"__has{n}"))
        out = out.withColumn(f"__e{n}", expression).join(own, F.col(f"__e{n}") == F.col(f"__k{n}"), "left").drop(f"__e{n}", f"__k{n}")
    for x in columns:
        value = F.lit(None)
        for n in reversed(range(len(sources))):
            value = F.when(F.col(f"__has{n}"), F.col(f"__{x}{n}")).otherwise(value)
        out = out.withColumn(x, value)
    return out.drop(*(f"__{x}{n}" for n in range(len(sources)) for x in (*columns, "has")))


def placed_cells(cells: DataFrame, rendered: DataFrame, table: str = "table") -> DataFrame:
    """(table, row_ord, cell, place) of a table's cells (table, row_ord, cell_ord, cell, content) in its rendered grid (table, row_ord, cell_ord, place, text).

    A table whose numbers of rows differ fails. Rows of as many cells pair off; of more, empty cells before a rendered text are
    passed over while there are too many; a row whose texts do not all find a place has none."""

    def place(own: tuple, rows: dict) -> list[tuple]:
        sides = []
        for listed in _split(rows, "row_ord", "cell", "content"):
            grid: dict = {}
            for row, cell, content in listed:
                grid.setdefault(row, []).append((cell, content or ""))
            sides.append(grid)
        if not sides[1]:
            return []
        if len(sides[0]) != len(sides[1]):
            raise ValueError(f"{own[0]}: {len(sides[1])} rendered rows, {len(sides[0])} in the document")
        out = []
        for (row, ours), theirs in zip(sides[0].items(), sides[1].values()):
            extra, free, pairs = len(ours) - len(theirs), list(theirs), []
            for cell, content in ours:
                if extra > 0 and free and not content and free[0][1]:
                    extra -= 1
                elif free:
                    pairs.append((cell, content, free.pop(0)[0]))
            whole = len(ours) == len(theirs) or (not free and sum(bool(x) for _, x in ours) == sum(bool(x) for _, x, _ in pairs))
            out += [(*own, row, cell, spot) for cell, _, spot in pairs if whole]
        return out

    columns = [table, "row_ord", "cell_ord"]
    both = _sided(cells.select(*columns, "cell", "content"), rendered.select(*columns, F.col("place").alias("cell"), F.col("text").alias("content")))
    kinds = dict(cells.dtypes)
    return by_key(both, [table], ["__side", "row_ord", "cell_ord"], place, f"{table} {kinds[table]}, row_ord {kinds['row_ord']}, cell string, place string")


def misaligned_rows(cells: DataFrame, placed: DataFrame, table: str = "table") -> DataFrame:
    """(table, row_ord) of rows with cells none of which was placed."""
    return cells.select(table, "row_ord").distinct().join(placed.select(table, "row_ord").distinct(), [table, "row_ord"], "left_anti")


def attached(rows: DataFrame, owners: DataFrame, owner: str = "owner") -> DataFrame:
    """``rows`` with parent_id, the node (citation, node_id) that their ``owner`` cites; the first one where several do, none is left out."""
    first = owners.groupBy(F.col("citation").alias(owner)).agg(F.min("node_id").alias("parent_id"))
    return rows.join(first, owner)


def nearest_shown(nodes: DataFrame, shown: Column, depth: int) -> DataFrame:
    """``nodes`` (path, ...) with host: the path of the nearest shown node at or above each, null where none is."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = nodes.select("path", F.explode(ups).alias("host"))
    seen = nodes.filter(shown).select(F.col("path").alias("host"))
    nearest = spread.join(seen, "host").groupBy("path").agg(F.max_by("host", F.length("host")).alias("host"))
    return nodes.join(nearest, "path", "left")


def once(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, which fail if a ``key`` occurs twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("__n", n).withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{key} twice: "), F.col(key).cast("string")))).otherwise(F.col("__n"))).filter("__n = 1").drop("__n")
