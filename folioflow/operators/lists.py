"""Lists in lines of text: items, their kind, splitting and normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X


def list_blocks(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring list lines: doc_id, block, kind of the first line, items and depth."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    own = lines.withColumn("kind", X.list_kind(F.col("text"))).withColumn("level", X.indent_level(F.col("text")))
    starts = (F.col("kind") != "") & (F.coalesce(F.lag("kind").over(w), F.lit("")) == "")
    own = own.withColumn("block", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("pos", X.list_marker(F.col("text")).alias("marker"), "text", "level")))
    return own.groupBy("doc_id", "block").agg(
        F.min_by("kind", "pos").alias("kind"), F.count(F.lit(1)).alias("n"), F.max("level").alias("depth"), ordered.alias("items"), F.min("pos").alias("first")
    )


def with_intro(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """List blocks with the line before them, if it introduces a list."""
    before = lines.select("doc_id", (F.col("pos") + 1).alias("first"), F.col("text").alias("intro")).where(X.introduces_list(F.col("intro")))
    return blocks.join(before, ["doc_id", "first"], "left")


def split_points(items: Column, least: int = 3) -> Column:
    """Indexes of top-level items without items under them that a list may be split at, behind the first ``least`` items."""
    level = lambda k: F.get(items, k)["level"]
    alone = lambda k: (level(k) <= 0) & F.coalesce(level(k + 1) <= level(k), F.lit(True))
    return F.when(F.size(items) > least, F.filter(F.sequence(F.lit(least), F.size(items) - 1), alone)).otherwise(F.expr("cast(array() as array<int>)"))


def kept_together(items: Column, most: int = 3000, least: int = 3) -> Column:
    """Whether a list is small enough, short enough, or nested without a point to split it at."""
    size = F.aggregate(items, F.lit(0), lambda a, x: a + F.octet_length(x["text"]) + 1)
    nested = F.exists(items, lambda x: x["level"] > 0)
    return (size <= most) | (F.size(items) < least) | (nested & (F.size(split_points(items, least)) == 0))


def normalised(line: Column, ordered: Column, number: Column) -> Column:
    """The line with a number or a bullet for its marker."""
    rest = X.trimmed(F.substring(X.trimmed(line), F.length(X.list_marker(line)) + 1, F.length(line)))
    return F.concat(F.when(ordered, F.concat(number.cast("string"), F.lit(". "))).otherwise(F.lit("• ")), rest)
