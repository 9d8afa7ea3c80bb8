"""Lists among the paragraphs of a page: items, their kind, lists of neighbours, and nesting by indentation.

Paragraphs are rows of doc_id, page, paragraph (their number on the page), text, box and font_size, as ``layout.paragraphs`` makes them. A
list is one row with its items in order; an item knows its level and its parent, so the tree is in the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import text as X
from folioflow.operators.layout import PAGE, islands

# Bullets by style.
STYLES = {
    "disc": "•●", "circle": "○◦◉", "square": "■□▪▫", "dash": "-–—", "asterisk": "*✱✲", "arrow": "→▶►▸➤➜", "triangle": "‣⁃",
    "check_empty": "☐", "check_filled": "☑✓✔", "unknown": "✗✘",
}
NUMBERED, BARE, LETTERED, ROMAN = r"^([0-9]+)[.)]", r"^([0-9]+)$", r"^([a-zA-Z])[.)]", r"^([ivxlcdmIVXLCDM]{1,15})[.)]"
#: Points of indentation for a level, gap between neighbours in font sizes, items of a list at least.
INDENT, GAP, LEAST = 15.0, 2.0, 2


def bullet_style(text: Column) -> Column:
    """The style of the bullet a text begins with, or empty."""
    first, out = F.substring(X.trimmed(text), 1, 1), F.lit("")
    for style, chars in STYLES.items():
        out = F.when(first.isin(*chars), style).otherwise(out)
    return out


def number_of(digits: Column) -> Column:
    """The number that the digits of a text make; 0 without any."""
    own = F.regexp_replace(digits, "[^0-9]", "")
    return F.when(own == "", F.lit(0).cast("long")).otherwise(own.cast("long"))


def items(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs that read like list items: kind, style, prefix, clean (the text behind the prefix) and number."""
    t = X.trimmed(F.col("text"))
    style = bullet_style(F.col("text"))
    kind = (
        F.when(style.isin("check_empty", "check_filled"), "checkbox").when(style != "", "bullet").when(t.rlike(NUMBERED) | t.rlike(BARE), "numbered")
        .when(t.rlike(LETTERED), "lettered").when(t.rlike(ROMAN), "roman")
    )
    own = paragraphs.where(t != "").withColumn("style", style).withColumn("kind", kind).where("kind is not null")
    t = X.trimmed(F.col("text"))
    pattern = {"numbered": r"^[0-9]+([.)]|$)", "lettered": r"^[a-zA-Z][.)]", "roman": r"^[ivxlcdmIVXLCDM]+[.)]"}
    prefix = F.substring(t, 1, 1)
    for k, p in pattern.items():
        prefix = F.when(F.col("kind") == k, F.regexp_extract(t, p, 0)).otherwise(prefix)
    own = own.withColumn("prefix", prefix)
    mark = F.regexp_replace("prefix", "[.)]$", "")
    number = (
        F.when(F.col("kind") == "numbered", number_of(mark)).when(F.col("kind") == "lettered", F.ascii(F.lower(mark)).cast("long") - 96)
        .when(F.col("kind") == "roman", X.roman_value(F.upper(mark)).cast("long")).otherwise(F.lit(0).cast("long"))
    )
    return own.withColumn("number", number).withColumn("clean", X.trimmed(F.substring(t, F.length("prefix") + 1, F.length(t))))


def lists(paragraphs: DataFrame, indent: float = INDENT, gap: float = GAP, least: int = LEAST) -> DataFrame:
    """One row a list: kind and style of its first item, box, n_items, depth, and items (text, prefix, number, level, parent).

    Items belong together if nothing stands between them, or little room does, and they are of one kind. The level follows the
    indentation from the leftmost item; the parent is the last item before with a lower level (null at the top).
    """
    order = [F.col("paragraph")]
    w = Window.partitionBy(*PAGE).orderBy(*order)
    last = lambda c: F.lag(c).over(w)
    room = F.abs(last("box.y") - G.top(F.col("box")))
    near = (F.col("paragraph") == last("paragraph") + 1) | (room <= gap * (last("font_size") + F.col("font_size")) / 2)
    own = islands(items(paragraphs), PAGE, order, last("paragraph").isNotNull() & ~(near & (F.col("kind") == last("kind"))), "list")
    keys = [*PAGE, "list"]
    own = own.withColumn("level", F.floor((F.col("box.x") - F.min("box.x").over(Window.partitionBy(*keys))) / indent).cast("int"))
    piece = F.struct("paragraph", F.col("clean").alias("text"), "prefix", "number", "level")
    hull = G.hull(F.col("box.x"), F.col("box.y"), F.col("box.width"), F.col("box.height"))
    out = own.groupBy(*keys).agg(
        F.min_by("kind", "paragraph").alias("kind"), F.min_by("style", "paragraph").alias("style"), hull.alias("box"),
        F.count(F.lit(1)).alias("n_items"), (F.max("level") + 1).alias("depth"), F.array_sort(F.collect_list(piece)).alias("_i"),
    )
    before = lambda x, i: F.filter(F.sequence(F.lit(0), i - 1), lambda j: (j >= 0) & (j < i) & (F.get(F.col("_i"), j)["level"] < x["level"]))
    made = F.transform(
        "_i", lambda x, i: F.struct(x["text"].alias("text"), x["prefix"].alias("prefix"), x["number"].alias("number"), x["level"].alias("level"), F.array_max(before(x, i)).alias("parent"))
    )
    return out.where(F.col("n_items") >= least).withColumn("items", made).drop("_i")


def of_kind(list_rows: DataFrame, kind: str) -> DataFrame:
    return list_rows.where(F.col("kind") == kind)


def in_region(list_rows: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Lists whose box shares more than an edge with the region."""
    x, y, width, height = region
    b = F.col("box")
    return list_rows.where((G.right(b) > x) & (b["x"] < x + width) & (G.top(b) > y) & (b["y"] < y + height))


def text_of(items: Column) -> Column:
    """A line an item: prefix and text, two spaces a level of its parents."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.repeat(F.lit("  "), x["level"]), x["prefix"], F.lit(" "), x["text"], F.lit("\n"))), "")


def all_items(list_rows: DataFrame) -> DataFrame:
    """One row an item, nested ones behind their parents."""
    return list_rows.select(*PAGE, "list", F.posexplode("items").alias("item", "i")).select(*PAGE, "list", "item", "i.*")


def split_at(items: Column, at: Column) -> Column:
    """Two arrays: the items before the index, and from it on; the second one is null if the index is at an end or outside."""
    inside = (at > 0) & (at < F.size(items))
    return F.struct(
        F.when(inside, F.slice(items, F.lit(1), at)).otherwise(items).alias("first"),
        F.when(inside, F.slice(items, at + 1, F.size(items))).alias("second"),
    )


def formatted(items: Column, intro: Column, markers: bool = True) -> Column:
    """The list as text: introduction, empty line, items with or without their markers."""
    line = lambda x: F.concat(F.repeat(F.lit("  "), x["level"]), *([F.when(x["prefix"] != "", F.concat(x["prefix"], F.lit(" "))).otherwise("")] if markers else []), x["text"])
    body = F.array_join(F.transform(items, line), "\n")
    return X.trimmed(F.concat(F.when(F.coalesce(intro, F.lit("")) != "", F.concat(intro, F.lit("\n\n"))).otherwise(""), body))
