"""Layout of positioned text: fragments to lines, columns, blocks, paragraphs, headings and reading order.

Fragments are rows of doc_id, page, seq, text, x, y, width, height and font_size, y growing upwards. All groupings are
gaps and islands: a window marks where something new begins, a running sum numbers it, and an aggregate makes it a row. Windows
go by page, and pages are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import LayoutConfig
from folioflow.functions import geometry as G
from folioflow.functions import text as X

PAGE = ["doc_id", "page"]


def dedupe(fragments: DataFrame) -> DataFrame:
    """One fragment a rounded place and text: the first."""
    w = Window.partitionBy(*PAGE, F.round("x"), F.round("y"), "text").orderBy("seq")
    return fragments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def islands(df: DataFrame, keys: list[str], order: list[Column], new: Column, name: str) -> DataFrame:
    """``df`` with a number that goes up, along the order, at every row for which ``new`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0)))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def line_tolerance(config: LayoutConfig = LayoutConfig()) -> Column:
    """An aggregate over a page's fragments: how far a baseline may be from its line's mean.

    Half the mean height; but where the tenth percentile of the gaps between baselines is under that, coordinates are compressed, and it is a fifth
    of that gap, 0.15 at least. Baselines count by tenths of a point, gaps over 0.1.
    """
    height = F.avg("height")
    standard = height * config.line_height_tolerance
    ys = F.array_sort(F.collect_set((F.col("y") * 10).cast("long") / 10))
    gaps = F.array_sort(F.filter(F.transform(ys, lambda y, i: F.when(i > 0, y - F.get(ys, i - 1))), lambda g: g > 0.1))
    least = F.get(gaps, F.floor(F.size(gaps) / 10).cast("int"))
    return F.when((F.size(ys) >= 3) & (least < 0.5 * height), F.greatest(0.2 * least, F.lit(0.15))).otherwise(standard)


def line_numbers(fragments: DataFrame, config: LayoutConfig = LayoutConfig(), keys: list[str] = PAGE) -> DataFrame:
    """``fragments`` with ``line``: a new one, from top to bottom, where y is further from the mean of the line so far than the page's tolerance.

    Lines are found in each group of ``keys`` by itself. What is kept along the page are the places where lines begin, so its cost goes by its
    fragments and lines, not by their square.
    """
    rest = [c for c in fragments.columns if c not in keys]
    piece = F.struct((-F.col("y")).alias("o"), F.col("seq").alias("s"), F.struct(*rest).alias("f"))
    pages = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("_p"), line_tolerance(config).alias("_t"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0.0).alias("total"), zero.alias("n"), F.lit(0).alias("i"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        y = -x["o"]
        new = (acc["n"] == 0) | F.coalesce(F.abs(y - acc["total"] / acc["n"]) > F.col("_t"), F.lit(False))
        return F.struct(
            F.when(new, y).otherwise(acc["total"] + y).alias("total"), F.when(new, F.lit(1).cast("long")).otherwise(acc["n"] + 1).alias("n"),
            (acc["i"] + 1).alias("i"), F.when(new, F.array_append(acc["out"], acc["i"])).otherwise(acc["out"]).alias("out"),
        )

    own = pages.withColumn("_n", F.aggregate("_p", start, step, lambda acc: acc["out"]))
    return own.select(*keys, F.posexplode(runs("_p", "_n")).alias("_l", "_x")).select(*keys, F.col("_l").cast("long").alias("line"), F.explode("_x").alias("_x")).select(
        *keys, *[F.col(f"_x.f.{c}").alias(c) for c in rest], "line"
    )


def runs(values: str, starts: str) -> Column:
    """The array ``values`` cut at the places ``starts`` (from 0, in order): an array of arrays."""
    end = lambda i: F.coalesce(F.get(F.col(starts), i + 1), F.size(values))
    return F.transform(starts, lambda a, i: F.slice(F.col(values), a + 1, end(i) - a))


def lines(fragments: DataFrame, config: LayoutConfig = LayoutConfig(), keys: list[str] = PAGE) -> DataFrame:
    """One row a line: text in order of x, box, font size, baseline, gaps to its neighbours and alignment, in each group of ``keys`` by itself."""
    piece = F.struct("x", "seq", "text", "width", "height")
    rows = line_numbers(fragments, config, keys).groupBy(*keys, "line").agg(
        F.array_sort(F.collect_list(piece)).alias("p"), G.hull(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("box"),
        F.avg("font_size").alias("font_size"), F.min("y").alias("baseline"), F.count(F.lit(1)).alias("n"),
    )
    # A space where the gap to the piece before is over a tenth of the height, and where both begin at one place: two texts over each other aren't a word.
    last = lambda i: F.get(F.col("p"), i - 1)
    behind = lambda x, i: x["x"] - (last(i)["x"] + last(i)["width"]) > 0.1 * x["height"]
    over = lambda x, i: (x["x"] == last(i)["x"]) & (x["width"] > 0) & (last(i)["width"] > 0)
    joined = F.transform("p", lambda x, i: F.concat(F.when((i > 0) & (behind(x, i) | over(x, i)), " ").otherwise(""), x["text"]))
    w = Window.partitionBy(*keys).orderBy("line")
    everything = Window.partitionBy(*keys)
    left, right = F.min(F.col("box.x")).over(everything), F.max(F.col("box.x") + F.col("box.width")).over(everything)
    own_right = F.col("box.x") + F.col("box.width")
    tol = config.align_tolerance
    align = (
        F.when(F.col("box.width") >= config.justified_ratio * (right - left), "justified")
        .when(F.abs((F.col("box.x") + own_right) / 2 - (left + right) / 2) <= tol, F.when(F.abs(F.col("box.x") - left) <= tol, "left").otherwise("center"))
        .when(F.abs(own_right - right) <= tol, F.when(F.abs(F.col("box.x") - left) <= tol, "left").otherwise("right"))
        .otherwise("left")
    )
    return rows.select(
        *keys, "line", F.array_join(joined, "").alias("text"), "box", "font_size", "baseline", "n",
        (F.lag("baseline").over(w) - F.col("baseline")).alias("before"), (F.col("baseline") - F.lead("baseline").over(w)).alias("after"), align.alias("alignment"),
    )


def column_histogram(fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """How many fragments of a page cover each bucket of x."""
    b = config.column_bucket
    covered = F.sequence(F.floor(F.col("x") / b), F.floor((F.col("x") + F.col("width")) / b))
    return fragments.select(*PAGE, F.explode(covered).alias("bucket")).groupBy(*PAGE, "bucket").agg(F.count(F.lit(1)).alias("n"))


def column_gaps(fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Gaps between columns: runs of buckets under a fifth of the mean cover, wide enough, inside the page's content."""
    h = column_histogram(fragments, config)
    span = h.groupBy(*PAGE).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"), F.avg("n").alias("mean"))
    buckets = span.select(*PAGE, "mean", F.explode(F.sequence("a", "b")).alias("bucket")).join(h, [*PAGE, "bucket"], "left")
    low = buckets.where(F.coalesce("n", F.lit(0)) < 0.2 * F.col("mean"))
    w = Window.partitionBy(*PAGE).orderBy("bucket")
    runs = low.withColumn("run", F.col("bucket") - F.row_number().over(w)).groupBy(*PAGE, "run")
    width = config.column_bucket
    gaps = runs.agg((F.min("bucket") * width).alias("from_x"), ((F.max("bucket") + 1) * width).alias("to_x"))
    return gaps.where(F.col("to_x") - F.col("from_x") >= config.column_gap).drop("run")


def columns(fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``fragments`` with ``column``: how many gaps lie to the left of the centre, up to the most columns."""
    gaps = column_gaps(fragments, config).groupBy(*PAGE).agg(F.collect_list((F.col("from_x") + F.col("to_x")) / 2).alias("cuts"))
    centre = F.col("x") + F.col("width") / 2
    number = F.size(F.filter(F.coalesce("cuts", F.expr("cast(array() as array<double>)")), lambda c: c <= centre))
    return fragments.join(gaps, PAGE, "left").withColumn("column", F.least(number, F.lit(config.most_columns - 1))).drop("cuts")


def reading_order(fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``fragments`` with ``position``: column by column, from right to left where most text is, lines from top to bottom."""
    own = columns(fragments, config).withColumn("_d", X.direction(F.col("text")))
    rtl = F.sum(F.when(F.col("_d") == "rtl", 1).when(F.col("_d") == "ltr", -1).otherwise(0)).over(Window.partitionBy(*PAGE)) > 0
    own = own.withColumn("_c", F.when(rtl, config.most_columns - 1 - F.col("column")).otherwise(F.col("column"))).drop("_d")
    own = line_numbers(own, config, [*PAGE, "_c"])
    w = Window.partitionBy(*PAGE).orderBy("_c", "line", "x", "seq")
    return own.withColumn("position", F.row_number().over(w).cast("long")).drop("_c", "line")


def blocks(line_rows: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Lines to blocks: a new one where the gap is over one and a half heights or the lines don't overlap in x."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    b = F.lag("box").over(w)
    apart = (F.col("before") > (1 + config.block_gap) * F.col("box.height")) | (G.right(b) < F.col("box.x")) | (G.right(F.col("box")) < b["x"])
    own = islands(line_rows, PAGE, [F.col("line")], apart, "block")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    hull = G.hull(F.col("box.x"), F.col("box.y"), F.col("box.width"), F.col("box.height"))
    return own.groupBy(*PAGE, "block").agg(text.alias("text"), hull.alias("box"), F.count(F.lit(1)).alias("n"))


def body_font(fragments: DataFrame) -> DataFrame:
    """The commonest font size of a document, in half points; the smallest of equals."""
    sizes = fragments.groupBy("doc_id", (F.round(F.col("font_size") * 2) / 2).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("body_size"))


def paragraphs(line_rows: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Lines to paragraphs with text, style and box.

    A paragraph begins at a wide gap, a change of font size or alignment, a new indent, a list marker, or behind a short line.
    """
    w = Window.partitionBy(*PAGE).orderBy("line")
    everything = Window.partitionBy(*PAGE)
    mean = F.avg("after").over(everything)
    last = lambda c: F.lag(c).over(w)
    ratio = F.greatest("font_size", last("font_size")) / F.least("font_size", last("font_size"))
    begins = (
        (F.col("before") > config.paragraph_spacing * mean) | (ratio > config.heading_ratio) | (F.col("alignment") != last("alignment"))
        | (F.col("box.x") - last("box.x") > config.indent) | (X.list_marker(F.col("text")) != "") | (last("box.width") < 0.7 * F.max("box.width").over(everything))
    )
    own = islands(line_rows, PAGE, [F.col("line")], begins, "paragraph")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    join = lambda acc, x: F.when(acc == "", x["text"]).when(F.endswith(acc, F.lit("-")), F.concat(acc, x["text"])).otherwise(
        F.concat(acc, F.lit(" "), x["text"])
    )
    hull = G.hull(F.col("box.x"), F.col("box.y"), F.col("box.width"), F.col("box.height"))
    grouped = own.groupBy(*PAGE, "paragraph").agg(
        ordered.alias("l"), hull.alias("box"), F.avg("font_size").alias("font_size"), F.count(F.lit(1)).alias("n_lines"), F.mode("alignment").alias("alignment")
    )
    text = F.aggregate("l", F.lit(""), join)
    left = F.min("box.x").over(everything)
    size = F.avg("font_size").over(everything)
    style = (
        F.when((F.col("font_size") > config.heading_ratio * size) & (F.col("n_lines") <= 3), "heading")
        .when(X.list_marker(text) != "", "list_item")
        .when(F.col("box.x") - left > config.quote_indent, "quote")
        .when((F.col("font_size") < size) & (F.col("n_lines") <= 2) & (F.col("alignment") == "center"), "caption")
        .otherwise("normal")
    )
    return grouped.select(*PAGE, "paragraph", text.alias("text"), "box", "font_size", "n_lines", "alignment", style.alias("style"))


def is_numbered(text: Column) -> Column:
    """Whether a line begins like a numbered heading."""
    return text.rlike(r"^((?i)(chapter|section|part)[\t\n\f\r ]+[0-9]+|[0-9]+(\.[0-9]+){0,2}\.?[\t\n\f\r ]|[IVXLCDM]+\.[\t\n\f\r ]|[A-Z]\.[\t\n\f\r ])")


def heading_confidence(ratio: Column, text: Column, bold: Column, centered: Column, n_lines: Column) -> Column:
    """How much speaks for a heading: its size over the body's, bold, capitals, number, centring, brevity. 1 at most."""
    size = F.when(ratio >= 1.5, 0.5).when(ratio >= 1.3, 0.35).when(ratio >= 1.15, 0.2).when(ratio >= 1.05, 0.1).otherwise(0.0)
    n = F.octet_length(text)
    points = (
        size + F.when(bold, 0.2).otherwise(0.0) + F.when(X.all_caps(text), 0.15).otherwise(0.0) + F.when(is_numbered(text), 0.2).otherwise(0.0)
        + F.when(centered, 0.1).otherwise(0.0) + F.when(n < 50, 0.1).when(n < 100, 0.05).otherwise(0.0) + F.when(n_lines == 1, 0.1).when(n_lines == 2, 0.05).otherwise(0.0)
    )
    return F.least(points, F.lit(1.0))


def heading_level(ratio: Column, text: Column, config: LayoutConfig = LayoutConfig()) -> Column:
    """Level by the dots of a number, else by the size ratio."""
    dots = F.regexp_extract(text, r"^([0-9]+(\.[0-9]+)*)\.?[ \t]", 1)
    by_ratio = F.lit(6)
    for i, r in reversed(list(enumerate(config.level_ratios))):
        by_ratio = F.when(ratio >= r, i + 1).otherwise(by_ratio)
    return F.when(dots != "", F.least(F.size(F.split(dots, r"\.")), F.lit(6))).otherwise(by_ratio)


def marked_headings(paragraph_rows: DataFrame, fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``paragraph_rows`` with ``confidence`` and, for those of up to three lines that are more likely headings than not, ``level``: the rank of their font size among them."""
    own = paragraph_rows.join(body_font(fragments), "doc_id").withColumn("ratio", F.col("font_size") / F.col("body_size"))
    own = own.withColumn("confidence", heading_confidence(F.col("ratio"), F.col("text"), F.lit(False), F.col("alignment") == "center", F.col("n_lines")))
    own = own.withColumn("_h", F.coalesce((F.col("n_lines") <= 3) & (F.col("confidence") >= 0.5), F.lit(False)))
    return ranked_levels(own, ["doc_id", "_h"]).withColumn("level", F.when(F.col("_h"), F.col("level"))).drop("_h")


def headings(paragraph_rows: DataFrame, fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Paragraphs of up to three lines that are more likely headings than not; level by rank of their font size in the document."""
    return marked_headings(paragraph_rows, fragments, config).where("level is not null")


def ranked_levels(rows: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    """``rows`` with ``level``: the dense rank of font sizes in tenths of a point, largest first, 6 at most."""
    w = Window.partitionBy(*keys).orderBy(F.round(F.col("font_size") * 10).desc())
    return rows.withColumn("level", F.least(F.dense_rank().over(w), F.lit(6)).cast("long"))


def heading_before(rows: DataFrame, heading_rows: DataFrame) -> DataFrame:
    """``rows`` with the last heading of the page above them: a union and a running last value, without a join on ranges."""
    a = rows.select(*PAGE, "y", F.lit(1).alias("_k"), F.struct(*rows.columns).alias("_r"), F.lit(None).cast("string").alias("_h"))
    b = heading_rows.select(*PAGE, "y", F.lit(0).alias("_k"), F.lit(None).cast(a.schema["_r"].dataType).alias("_r"), F.col("text").alias("_h"))
    w = Window.partitionBy(*PAGE).orderBy(F.col("y").desc(), "_k").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("heading", F.last("_h", ignorenulls=True).over(w)).where("_k = 1").select("_r.*", "heading")


def in_region(rows: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    return rows.where(G.intersects(F.col("box"), G.box(*[F.lit(v) for v in region])))


def page_text(line_rows: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Text of a page: a line break between lines, an empty line at gaps over one and a half times the mean."""
    mean = F.avg("before").over(Window.partitionBy(*PAGE))
    lead = F.when(F.col("before").isNull(), "").when(F.col("before") > config.paragraph_spacing * mean, "\n\n").otherwise("\n")
    pieces = line_rows.withColumn("_t", F.concat(lead, F.col("text")))
    return pieces.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_t"))), lambda x: x["_t"]), "").alias("text"))


def joined_text(paragraph_rows: DataFrame) -> DataFrame:
    """Text of a page by paragraphs: their lines joined by spaces, an empty line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("paragraph", "text")))
    return paragraph_rows.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def column_text(fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Text of a page column by column: a line break between lines, an empty line at gaps over 0.8 heights and between columns."""
    keys = [*PAGE, "column"]
    rows = lines(columns(fragments, config), config, keys)
    w = Window.partitionBy(*keys).orderBy("line")
    gap = F.lag("box.y").over(w) - G.top(F.col("box"))
    lead = F.when(gap.isNull(), "").when(gap > 0.8 * F.col("box.height"), "\n\n").otherwise("\n")
    pieces = rows.withColumn("_t", F.concat(lead, X.trimmed(F.col("text"))))
    each = pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_t"))), lambda x: x["_t"]), "").alias("_t"))
    return each.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "_t"))), lambda x: x["_t"]), "\n\n").alias("text"))


def spaced_text(fragments: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Text of a page as it looks in a font of equal widths: spaces up to each fragment's place, line breaks by the gaps.

    A character is 0.6 of the mean font size wide, but 40 to 200 of them fill the page. Fragments within half a height of a line's first one
    share its line.
    """
    size = F.avg(F.when(F.col("font_size") > 0, F.col("font_size")))
    wide = F.coalesce(0.6 * size, F.lit(page_width / 80))
    fit = F.floor(F.lit(page_width) / wide)
    wide = F.when(fit < 40, page_width / 40).when(fit > 200, page_width / 200).otherwise(wide)
    piece = F.struct((-F.col("y")).alias("o"), F.col("seq").alias("s"), "x", "y", "height", "text")
    pages = fragments.groupBy(*PAGE).agg(F.array_sort(F.collect_list(piece)).alias("_p"), wide.alias("_w"))
    # Lines first: where they begin, by the line's first baseline and greatest height so far.
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("h"), F.lit(0).alias("i"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["y"].isNotNull() & F.coalesce(F.abs(x["y"] - acc["y"]) > 0.5 * acc["h"], F.lit(False))
        return F.struct(
            F.when(new | acc["y"].isNull(), x["y"]).otherwise(acc["y"]).alias("y"), F.when(new, x["height"]).otherwise(F.greatest(acc["h"], x["height"])).alias("h"),
            (acc["i"] + 1).alias("i"), F.when(new | (acc["i"] == 0), F.array_append(acc["out"], acc["i"])).otherwise(acc["out"]).alias("out"),
        )

    own = pages.withColumn("_n", F.aggregate("_p", start, step, lambda acc: acc["out"]))
    own = own.select(*PAGE, "_w", F.posexplode(runs("_p", "_n")).alias("line", "_x")).select(*PAGE, "_w", "line", F.explode("_x").alias("f"))
    own = own.select(*PAGE, "line", "_w", "f.x", "f.s", "f.y", F.col("f.height").alias("h"), F.col("f.text").alias("t"))
    # With p the place of a piece and b the bytes of all before it, the spaces up to it are what the greatest p - b, 0 at least, grows by.
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "s", "t")
    place = F.greatest(F.floor(F.col("x") / F.col("_w")).cast("int"), F.lit(0))
    before = F.coalesce(F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("_a", (place - before).cast("int"))
    most = lambda last: F.greatest(F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, last)), F.lit(0))
    own = own.withColumn("pad", most(0) - most(-1))
    ordered = F.array_sort(F.collect_list(F.struct("x", "s", "t", "pad")))
    rows = own.groupBy(*PAGE, "line").agg(ordered.alias("l"), F.max("y").alias("y"), F.max("h").alias("h"), F.first("_w").alias("_w"))
    padded = F.array_join(F.transform("l", lambda x: F.concat(F.repeat(F.lit(" "), x["pad"]), x["t"])), "")
    gap = F.floor((F.lag("y").over(Window.partitionBy(*PAGE).orderBy("line")) - F.col("y")) / F.when(F.col("h") > 0, F.col("h")).otherwise(1.2 * F.col("_w")) + 0.5)
    rows = rows.select(*PAGE, "line", padded.alias("t"), F.greatest(gap, F.lit(1)).cast("int").alias("gap"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("line", "t", "gap"))), lambda x, i: F.concat(F.when(i > 0, F.repeat(F.lit("\n"), x["gap"])).otherwise(""), x["t"]))
    return rows.groupBy(*PAGE).agg(F.array_join(whole, "").alias("text"))


def line_statistics(line_rows: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """spacing and height of a page's lines on average; gaps that aren't over zero don't count."""
    return line_rows.groupBy(*PAGE).agg(F.avg(F.when(F.col("after") > 0, F.col("after"))).alias("spacing"), F.avg("box.height").alias("height"), F.count(F.lit(1)).alias("n"))


def with_breaks(line_rows: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``line_rows`` with ``breaks``: whether a paragraph ends behind the line, by a gap over one and a half times the page's mean."""
    mean = F.avg(F.when(F.col("after") > 0, F.col("after"))).over(Window.partitionBy(*PAGE))
    return line_rows.withColumn("breaks", F.coalesce(F.col("after") > config.paragraph_spacing * mean, F.lit(False)))


def aligned_as(line_rows: DataFrame, alignment: str) -> DataFrame:
    return line_rows.where(F.col("alignment") == alignment)


def styled_as(paragraph_rows: DataFrame, style: str) -> DataFrame:
    return paragraph_rows.where(F.col("style") == style)


def headings_between(heading_rows: DataFrame, first: int, last: int) -> DataFrame:
    """Headings of levels from first to last."""
    return heading_rows.where(F.col("level").between(first, last))


def outline(heading_rows: DataFrame, order: list[str]) -> DataFrame:
    """``heading_rows`` with ``item``, their number in the document, and ``parent``, the number of the last heading before of a lower level (null at the top)."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    own = heading_rows.withColumn("item", (F.row_number().over(w) - 1).cast("long"))
    by = Window.partitionBy("doc_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") <= k, F.col("item"))).over(by) for k in range(1, 6)]
    parent = F.lit(None).cast("long")
    for k, c in enumerate(above, 1):
        parent = F.when(F.col("level") == k + 1, c).otherwise(parent)
    return own.withColumn("parent", parent)


def merged_blocks(block_rows: DataFrame) -> DataFrame:
    """Blocks whose boxes overlap for the most part, joined to the first of them: text, box, n."""
    other = block_rows.select(*PAGE, F.col("block").alias("_b"), F.col("box").alias("_x"))
    first = block_rows.join(other, PAGE).where((F.col("_b") < F.col("block")) & G.mostly_overlaps(F.col("box"), F.col("_x")))
    first = first.groupBy(*PAGE, "block").agg(F.min("_b").alias("_first"))
    own = block_rows.join(first, [*PAGE, "block"], "left").withColumn("_first", F.coalesce("_first", "block"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    hull = G.hull(F.col("box.x"), F.col("box.y"), F.col("box.width"), F.col("box.height"))
    return own.groupBy(*PAGE, F.col("_first").alias("block")).agg(text.alias("text"), hull.alias("box"), F.sum("n").alias("n"))


def is_character_level(fragments: DataFrame) -> DataFrame:
    """Pages with ten fragments or more of which over 60 percent are single characters."""
    n, one = F.count(F.lit(1)), F.count_if(F.length("text") == 1)
    return fragments.groupBy(*PAGE).agg(((n >= 10) & (one > 0.6 * n)).alias("character_level"))


def repeated_lines(lines_: DataFrame, key: str, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Lines that repeat over pages, digits alike: text with # for digits, pages, and confidence.

    ``lines_`` has ``key`` (the document), page and text; a text must be on half of the pages, two at least.
    """
    own = lines_.withColumn("shape", X.digits_masked(X.trimmed(F.col("text"))))
    total = own.groupBy(key).agg(F.count_distinct("page").alias("n"))
    pages = own.select(key, "page", "shape").distinct().groupBy(key, "shape").agg(F.count(F.lit(1)).alias("pages"))
    enough = F.col("pages") >= F.greatest(F.lit(config.repeat_pages), F.floor(F.col("n") * config.repeat_ratio))
    kept = pages.join(total, key).where(enough & ((F.octet_length("shape") > 2) | X.is_page_number(F.col("shape"))))
    return kept.select(key, "shape", "pages", F.least(0.9 * F.col("pages") / F.col("n") + 0.1, F.lit(1.0)).alias("confidence"))


def banded(fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``fragments`` with ``region``: header in the top band of the page's content, footer in the bottom band, else null."""
    page = Window.partitionBy(*PAGE)
    high, low = F.max(F.col("y") + F.col("height")).over(page), F.min("y").over(page)
    region = F.when(F.col("y") + F.col("height") >= high - config.band, "header").when(F.col("y") <= low + config.band, "footer")
    return fragments.withColumn("region", region)


def header_footer(fragments: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Texts repeated at one place in the top and bottom bands of the pages: doc_id, region, shape, pages, confidence."""
    own = banded(fragments, config).where("region is not null").withColumn("key", F.concat_ws("|", "doc_id", "region"))
    own = own.withColumn("shape", X.digits_masked(X.trimmed(F.col("text"))))
    # All places of a text are within the tolerances of its first one.
    first = own.groupBy("key", "shape").agg(
        F.min(F.struct("page", "seq", "x", "y")).alias("f"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    near = lambda c, most: (F.col(f"{c}1") - F.col(f"f.{c}") <= most) & (F.col(f"f.{c}") - F.col(f"{c}0") <= most)
    steady = first.where(near("x", config.repeat_x) & near("y", config.repeat_y)).select("key", "shape")
    found = repeated_lines(own.select("key", "page", "text"), "key", config).join(steady, ["key", "shape"])
    parts = F.split("key", r"\|")
    return found.select(parts[0].cast("long").alias("doc_id"), parts[1].alias("region"), "shape", "pages", "confidence")


def without_regions(fragments: DataFrame, repeated: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Fragments that aren't, in the header or footer band of their page, among the repeated texts of that region."""
    own = banded(fragments, config).withColumn("shape", X.digits_masked(X.trimmed(F.col("text"))))
    return own.join(repeated.select("doc_id", "region", "shape").distinct(), ["doc_id", "region", "shape"], "left_anti").drop("region", "shape")


def without(rows: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """Rows whose text, digits alike, isn't among the repeated ones of their document."""
    own = rows.withColumn("shape", X.digits_masked(X.trimmed(F.col("text"))))
    return own.join(repeated.select(key, "shape"), [key, "shape"], "left_anti").drop("shape")
