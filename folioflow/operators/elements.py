"""Elements of plain documents, and renderings of elements as text and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import tables
from folioflow.functions.text import trimmed


def line_elements(docs: DataFrame) -> DataFrame:
    """doc_id, pos and text of every line that isn't blank, one paragraph each."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: trimmed(x) != "")
    return docs.select("doc_id", F.posexplode(lines).alias("pos", "text")).select("doc_id", "pos", trimmed(F.col("text")).alias("text"))


def text_blocks(elements: DataFrame) -> DataFrame:
    """The paragraphs of each document joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return elements.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("n"))


def _cells(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda c: c["text"]))


def as_text(e: Column) -> Column:
    items = F.array_join(F.transform(e["items"], lambda x: F.concat(F.repeat(F.lit("  "), x["level"]), F.lit("- "), x["text"])), "\n")
    return F.when(e["type"] == "list", items).when(e["type"] == "table", tables.plain(_cells(e["rows"]))).otherwise(e["text"])


def as_markdown(e: Column) -> Column:
    return (
        F.when(e["type"] == "heading", F.concat(F.repeat(F.lit("#"), e["level"]), F.lit(" "), e["text"]))
        .when(e["type"] == "list", tables.list_markdown(e["items"], e["ordered"]))
        .when(e["type"] == "table", F.rtrim(tables.markdown(_cells(e["rows"]))))
        .when(e["type"] == "code", F.concat(F.lit("```\n"), e["text"], F.lit("\n```")))
        .when(e["type"] == "blockquote", F.concat(F.lit("> "), F.replace(e["text"], F.lit("\n"), F.lit("\n> "))))
        .otherwise(e["text"])
    )


def rendered(elements: DataFrame, form: str) -> DataFrame:
    """doc_id and all elements of each document as ``text`` or ``markdown``, in order."""
    make = as_text if form == "text" else as_markdown
    row = F.struct("page", "pos", "type", "text", "level", "ordered", "items", "rows")
    ordered = F.array_sort(F.collect_list(row))
    parts = F.filter(F.transform(ordered, make), lambda x: x.isNotNull() & (x != ""))
    return elements.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias(form))


def headings(elements: DataFrame) -> DataFrame:
    return elements.where("type = 'heading'").select("doc_id", "page", "pos", "text", "level")


def table_of_contents(elements: DataFrame) -> DataFrame:
    """doc_id and toc: one line a heading, indented by level."""
    line = lambda x: F.concat(F.repeat(F.lit("  "), x["level"] - 1), F.lit("- "), x["text"])
    ordered = F.array_sort(F.collect_list(F.struct("page", "pos", "level", "text")))
    return headings(elements).groupBy("doc_id").agg(F.array_join(F.transform(ordered, line), "\n").alias("toc"))


def of_type(elements: DataFrame, kind: str) -> DataFrame:
    """All headings, paragraphs, lists or tables, in the order of their documents."""
    return elements.where(F.col("type") == kind)


def page_texts(elements: DataFrame) -> DataFrame:
    """doc_id, page and the text of its elements, a line break between them."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    texts = F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t.isNotNull() & (t != ""))
    return elements.groupBy("doc_id", "page").agg(F.array_join(texts, "\n").alias("text"))
