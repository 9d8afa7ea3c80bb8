"""Tables in positioned text: clusters, row and column boundaries, cells, and how regular a grid is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import LayoutConfig
from folioflow.functions import geometry as G
from folioflow.operators.layout import PAGE, islands


def clusters(fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``fragments`` with ``cluster``: a new one where nothing is for over ``table_gap`` points down the page."""
    order = [F.col("y").desc(), F.col("seq")]
    before = F.lag("y").over(Window.partitionBy(*PAGE).orderBy(*order))
    return islands(fragments, PAGE, order, before - (F.col("y") + F.col("height")) > config.table_gap, "cluster")


def aligned(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Values that lie within the tolerance of their neighbour become one boundary: their mean, and how many there are."""
    # Equal values are counted before they are put in order.
    values = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(value))
    own = islands(values, keys, [F.col(value)], F.col(value) - before > tolerance, "_g")
    mean = F.sum(F.col(value) * F.col("_c")) / F.sum(F.when(F.col(value).isNotNull(), F.col("_c")))
    return own.groupBy(*keys, "_g").agg(mean.alias("at"), F.sum("_c").alias("n")).drop("_g")


def boundaries(fragments: DataFrame, axis: str, keys: list[str], config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Boundaries along an axis, from both edges of the fragments: keys, at, n, index."""
    size = "width" if axis == "x" else "height"
    edges = fragments.select(*keys, F.explode(F.array(F.col(axis), F.col(axis) + F.col(size))).alias("v"))
    own = aligned(edges, keys, "v", config.table_tolerance)
    return own.withColumn("index", (F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).cast("long"))


def intervals(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals between neighbouring boundaries: keys, index, low, high."""
    w = Window.partitionBy(*keys).orderBy("at")
    return bounds.select(*keys, "index", F.col("at").alias("low"), F.lead("at").over(w).alias("high")).where("high is not null")


def cells(fragments: DataFrame, rows: DataFrame, cols: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments by the row and column their centre is in: keys, row, col and the texts joined by spaces.

    A page's boundaries are few and travel as an array with it, so this is an equi-join and a filter of an array, not a
    join on ranges.
    """
    pick = lambda spans, v: F.get(F.filter(spans, lambda s: (v >= s["low"]) & (v <= s["high"])), F.lit(0))["index"]
    as_array = lambda d, n: d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("index", "low", "high"))).alias(n))
    # Fragments with one box are looked up once.
    own = fragments.groupBy(*keys, "x", "y", "width", "height").agg(F.collect_list(F.struct("x", "seq", "text")).alias("_p"))
    own = own.join(as_array(rows, "_rows"), keys).join(as_array(cols, "_cols"), keys)
    own = own.withColumn("row", pick(F.col("_rows"), F.col("y") + F.col("height") / 2)).withColumn("col", pick(F.col("_cols"), F.col("x") + F.col("width") / 2))
    own = own.where("row is not null and col is not null").groupBy(*keys, "row", "col").agg(F.array_sort(F.flatten(F.collect_list("_p"))).alias("_p"))
    return own.select(*keys, "row", "col", F.array_join(F.transform("_p", lambda p: p["text"]), " ").alias("text"), F.size("_p").cast("long").alias("n"))


def regularity(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One minus the variation of the intervals' sizes, not below 0."""
    return spans.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1 - G.variation(F.col("high") - F.col("low"))).alias("regularity"))


def confidence(regular: Column, alignment: Column, rules: Column, occupied: Column) -> Column:
    """What speaks for a table: even sizes, aligned edges, drawn rules, filled cells."""
    return 0.3 * regular + 0.3 * alignment + 0.2 * rules + 0.2 * occupied


TABLE = "doc_id long, page long, cluster long, x double, y double, width double, height double, has_grid boolean, regular double, alignment double, rules double, occupied double, cells array<struct<row:int,col:int,text:string,row_span:int,col_span:int>>"


def _bounds(low: np.ndarray, high: np.ndarray, tolerance: float) -> np.ndarray:
    """Both edges, those within the tolerance of their neighbour as their mean."""
    v = np.sort(np.append(low, high))
    return np.array([p.mean() for p in np.split(v, np.flatnonzero(np.diff(v) > tolerance) + 1)])


def _table(left: np.ndarray, low: np.ndarray, width: np.ndarray, height: np.ndarray, texts: np.ndarray, drawn: np.ndarray, tolerance: float) -> tuple | None:
    """Box, visible grid, the four measures and the cells of a cluster, given in order of x; none with under two rows or columns."""
    right, high = left + width, low + height
    cols, rows = _bounds(left, right, tolerance), _bounds(low, high, tolerance)[::-1]
    if len(left) < 4 or len(cols) < 3 or len(rows) < 3:
        return None
    even = lambda v: max(0.0, 1 - np.std(v) / np.mean(v))
    regular = (even(-np.diff(rows)) + even(np.diff(cols))) / 2
    near = lambda v, b: (np.abs(v[:, None] - b) < 2 * tolerance).any(axis=1).astype(int)
    alignment = (near(left, cols) + near(right, cols) + near(high, rows) + near(low, rows) >= 2).mean()
    at = lambda b, i: np.array([bool((np.abs(drawn[:, [i, i + 2]] - v) < tolerance).all(axis=1).any()) for v in b])
    h, v = at(rows, 1), at(cols, 0)
    cells: dict[tuple[int, int], list] = {}
    for x0, y0, x1, y1, text in zip(left, low, right, high, texts, strict=True):
        i = np.flatnonzero(((y0 + y1) / 2 <= rows[:-1]) & ((y0 + y1) / 2 >= rows[1:]))
        j = np.flatnonzero(((x0 + x1) / 2 >= cols[:-1]) & ((x0 + x1) / 2 <= cols[1:]))
        if len(i) and len(j):
            c = cells.setdefault((int(i[0]), int(j[0])), [x0, y0, x1, y1, []])
            c[:4] = min(c[0], x0), min(c[1], y0), max(c[2], x1), max(c[3], y1)
            c[4].append(text)
    made = []
    for (i, j), (_, y0, x1, _, own) in sorted(cells.items()):
        # A cell goes on over the intervals that its content reaches into by more than the tolerance.
        down = next((k for k in range(i + 1, len(rows) - 1) if rows[k] - y0 <= tolerance), len(rows) - 1) - i
        across = next((k for k in range(j + 1, len(cols) - 1) if x1 - cols[k] <= tolerance), len(cols) - 1) - j
        made.append({"row": i, "col": j, "text": " ".join(own), "row_span": down, "col_span": across})
    box = (cols[0], rows[-1], cols[-1] - cols[0], rows[0] - rows[-1])
    return *box, bool((h.sum() + v.sum()) / (len(h) + len(v)) >= 0.5), regular, alignment, (h.mean() + v.mean()) / 2, len(cells) / ((len(rows) - 1) * (len(cols) - 1)), made


def detect_tables(fragments: DataFrame, rules: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Tables of the pages: box, whether half of the boundaries are drawn, confidence (0.5 at least) and cells with their spans.

    ``rules`` are drawn lines of doc_id, page, x1, y1, x2 and y2. Rows are from the top.
    """

    names = [f.split(" ")[0] for f in TABLE.split("array<")[0].split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for doc, page, cluster, texts, drawn, *box in zip(*[b[c] for c in (*PAGE, "cluster", "text", "drawn", "x", "y", "width", "height")], strict=True):
                lines = np.array([list(d) for d in drawn], float).reshape(-1, 4) if drawn is not None else np.empty((0, 4))
                t = _table(*[np.asarray(v, float) for v in box], texts, lines, config.table_tolerance)
                if t is not None:
                    found.append((doc, page, cluster, *t))
            yield pd.DataFrame(found, columns=names)

    keys = [*PAGE, "cluster"]
    own = clusters(fragments, config).select(*[F.col(c).cast("long") for c in keys], "seq", "text", "x", "y", "width", "height")
    # A row a cluster, its fragments in order of x, with the page's drawn lines: Python sees batches of them, not a table each.
    own = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "seq", "y", "width", "height", "text"))).alias("f"))
    own = own.select(*keys, *[F.col(f"f.{c}").alias(c) for c in ("text", "x", "y", "width", "height")])
    drawn = rules.select(*[F.col(c).cast("long") for c in PAGE], F.array("x1", "y1", "x2", "y2").alias("d")).groupBy(*PAGE).agg(F.collect_list("d").alias("drawn"))
    out = own.join(drawn, PAGE, "left").mapInPandas(run, TABLE)
    out = out.withColumn("confidence", confidence(F.col("regular"), F.col("alignment"), F.col("rules"), F.col("occupied")))
    return out.where(F.col("confidence") >= config.table_confidence).drop("regular", "alignment", "rules", "occupied")


def rule_groups(rules: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Drawn lines by direction, those at about the same place together: horizontal at a y, vertical at an x."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    own = rules.withColumn("direction", F.when(dy <= tolerance, "h").when(dx <= tolerance, "v").otherwise("d"))
    own = own.withColumn("v", F.when(F.col("direction") == "h", (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2))
    return aligned(own.where("direction <> 'd'"), [*PAGE, "direction"], "v", tolerance)


def drawn_groups(rules: DataFrame, tolerance: float = 3.0, least_length: float = 10.0) -> DataFrame:
    """Drawn lines at about one place together: doc_id, page, direction, at (their mean place), low and high (how far they reach), length and n.

    Lines shorter than ``least_length`` or aslant are left out. A line joins the group before while it is within the tolerance of its mean.
    """
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    level = F.when(dy <= tolerance, "h").when(dx <= tolerance, "v")
    own = rules.withColumn("direction", level).withColumn("length", F.sqrt(dx * dx + dy * dy)).where(F.col("direction").isNotNull() & (F.col("length") >= least_length))
    flat = F.col("direction") == "h"
    own = own.withColumn("v", F.when(flat, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2))
    a, b = F.when(flat, F.col("x1")).otherwise(F.col("y1")), F.when(flat, F.col("x2")).otherwise(F.col("y2"))
    own = own.groupBy(*PAGE, "direction").agg(F.array_sort(F.collect_list(F.struct("v", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), "length"))).alias("l"))
    state = lambda mean, n, group, out: F.struct(mean.alias("mean"), n.alias("n"), group.alias("group"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] > 0) & (x["v"] - acc["mean"] > tolerance)
        n = F.when(new, 1).otherwise(acc["n"] + 1)
        mean = F.when(new | (acc["n"] == 0), x["v"]).otherwise(acc["mean"] + (x["v"] - acc["mean"]) / (acc["n"] + 1))
        group = acc["group"] + new.cast("int")
        return state(mean, n, group, F.array_append(acc["out"], group))

    found = F.aggregate("l", state(F.lit(0.0), F.lit(0), F.lit(0), F.expr("cast(array() as array<int>)")), step, lambda acc: acc["out"])
    own = own.withColumn("g", found).select(*PAGE, "direction", F.explode(F.transform("l", lambda x, i: F.struct(F.get(F.col("g"), i).alias("g"), x.alias("x")))).alias("r"))
    return own.groupBy(*PAGE, "direction", "r.g").agg(
        F.avg("r.x.v").alias("at"), F.min("r.x.low").alias("low"), F.max("r.x.high").alias("high"), F.sum("r.x.length").alias("length"), F.count(F.lit(1)).alias("n")
    ).drop("g")


def drawn_grids(rules: DataFrame, tolerance: float = 3.0, least_length: float = 10.0, least_lines: int = 2) -> DataFrame:
    """The grid that a page's drawn lines make, if they do: box, rows, cols, the places of its lines (rows from the top), borders and confidence.

    The box goes from the first to the last place in both directions; lines that reach over less than half of it are left out.
    """
    groups = drawn_groups(rules, tolerance, least_length)
    side = lambda d, what: F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("at", "low", "high"))))
    page = groups.groupBy(*PAGE).agg(side("h", "y").alias("h"), side("v", "x").alias("v"))
    page = page.where((F.size("h") >= least_lines) & (F.size("v") >= least_lines))
    ends = lambda c: (F.get(c, F.lit(0))["at"], F.element_at(c, -1)["at"])
    (bottom, top), (left, right) = ends("h"), ends("v")
    page = page.select(*PAGE, "h", "v", left.alias("left"), right.alias("right"), bottom.alias("bottom"), top.alias("top")).where("right > left and top > bottom")

    def long(c: str, a: Column, b: Column) -> Column:
        over = lambda x: (x["high"] - x["low"] >= 0.5 * (b - a)) & (F.least(x["high"], b) > F.greatest(x["low"], a))
        return F.transform(F.filter(c, over), lambda x: x["at"])

    page = page.withColumn("ys", F.reverse(long("h", F.col("left"), F.col("right")))).withColumn("xs", long("v", F.col("bottom"), F.col("top")))
    page = page.where((F.size("ys") >= least_lines) & (F.size("xs") >= least_lines))
    gaps = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.abs(F.get(c, i) - F.get(c, i - 1)))
    even = lambda c: F.when(F.size(c) > 2, F.greatest(F.lit(0.0), 1 - G.variation_of(gaps(c)))).otherwise(1.0)
    near = lambda a, b: (F.abs(a - b) < tolerance).cast("int")
    first, last = (lambda c: F.get(c, F.lit(0))), (lambda c: F.element_at(c, -1))
    borders = near(first("ys"), F.col("top")) + near(last("ys"), F.col("bottom")) + near(first("xs"), F.col("left")) + near(last("xs"), F.col("right"))
    rows, cols = F.size("ys") - 1, F.size("xs") - 1
    points = F.when(rows * cols >= 9, 0.3).when(rows * cols >= 4, 0.2).otherwise(0.0) + 0.15 * (even("ys") + even("xs")) + 0.05 * borders + 0.2
    return page.select(
        *PAGE, G.box(F.col("left"), F.col("bottom"), F.col("right") - F.col("left"), F.col("top") - F.col("bottom")).alias("box"), rows.alias("rows"), cols.alias("cols"),
        "ys", "xs", borders.alias("borders"), F.least(points, F.lit(1.0)).alias("confidence"),
    )


def rule_statistics(rules: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Horizontal, vertical and slanted lines of each page, and their whole length."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    return rules.groupBy(*PAGE).agg(
        F.count_if(dy <= tolerance).alias("horizontal"), F.count_if((dy > tolerance) & (dx <= tolerance)).alias("vertical"),
        F.count_if((dy > tolerance) & (dx > tolerance)).alias("slanted"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"),
    )


def boxes_between(boxes: DataFrame, least_width: float = 0.0, least_height: float = 0.0) -> DataFrame:
    """Rectangles that are wide and high enough."""
    return boxes.where((F.col("box.width") >= least_width) & (F.col("box.height") >= least_height))
