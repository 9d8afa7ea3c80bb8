"""From files to elements, text, Markdown and chunks, with the options of a reader."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.config import LayoutConfig, SizeConfig
from folioflow.operators import layout
from folioflow.operators.chunking import chunk_elements
from folioflow.operators.elements import headings, rendered
from folioflow.schemas import ELEMENTS
from folioflow.sources.office import file_elements, read_files
from folioflow.sources.pdf import pdf_fragments


#: How the text of a PDF page is put together: line by line, by paragraphs, by columns, or as it looks.
MODES = ("lines", "paragraphs", "columns", "layout")


@dataclass(frozen=True)
class Options:
    """What is read: pages (all if empty), whether repeated headers and footers of PDF pages stay, and fragments drawn again. Every method gives new options."""

    pages: tuple[int, ...] = ()
    headers: bool = True
    footers: bool = True
    layout: LayoutConfig = field(default_factory=LayoutConfig)
    mode: str = "lines"
    repeats: bool = False

    def page(self, *numbers: int) -> Options:
        """With more pages; they count from 1."""
        if any(n < 1 for n in numbers):
            raise ValueError(f"pages count from 1: {numbers}")
        return replace(self, pages=(*self.pages, *numbers))

    def page_range(self, first: int, last: int) -> Options:
        return self.page(*range(first, last + 1))

    def without_headers(self) -> Options:
        return replace(self, headers=False)

    def without_footers(self) -> Options:
        return replace(self, footers=False)

    def join_paragraphs(self) -> Options:
        return replace(self, mode="paragraphs")

    def by_column(self) -> Options:
        return replace(self, mode="columns")

    def preserve_layout(self) -> Options:
        return replace(self, mode="layout")

    def with_repeats(self) -> Options:
        """With every fragment, those of one text at one place, too."""
        return replace(self, repeats=True)


def chosen(fragments: DataFrame, options: Options = Options()) -> DataFrame:
    """Fragments without repeats (unless they stay), and without the pages, headers and footers that the options leave out. Headers are found on all pages."""
    own = fragments.where("page > 0")
    own = own if options.repeats else layout.dedupe(own)
    if not (options.headers and options.footers):
        found = layout.header_footer(own, options.layout)
        drop = [r for r, stay in (("header", options.headers), ("footer", options.footers)) if not stay]
        own = layout.without_regions(own, found.where(F.col("region").isin(*drop)), options.layout)
    return own.where(F.col("page").isin(*sorted(set(options.pages)))) if options.pages else own


def missing_pages(fragments: DataFrame, options: Options) -> DataFrame:
    """doc_id and page of the pages asked for that a document doesn't have."""
    asked = F.explode(F.array(*[F.lit(p) for p in sorted(set(options.pages))]))
    have = fragments.groupBy("doc_id").agg(F.max("page").alias("_n"))
    return have.select("doc_id", "_n", asked.alias("page")).where(F.col("page") > F.col("_n")).drop("_n")


def page_texts(fragments: DataFrame, options: Options = Options(), page_width: float = 612.0) -> DataFrame:
    """doc_id, page and text of positioned text, put together by the options' mode."""
    own, config = chosen(fragments, options), options.layout
    if options.mode == "layout":
        return layout.spaced_text(own, page_width)
    if options.mode == "columns":
        return layout.column_text(own, config)
    rows = layout.lines(own, config)
    if options.mode == "paragraphs":
        return layout.joined_text(layout.paragraphs(rows, config))
    if options.mode != "lines":
        raise ValueError(f"{options.mode} is none of {MODES}")
    return layout.page_text(rows, config)


def document_texts(fragments: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id and text: the texts of its pages, an empty line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    texts = F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t != "")
    return page_texts(fragments, options).groupBy("doc_id").agg(F.array_join(texts, "\n\n").alias("text"))


def fragment_elements(fragments: DataFrame, options: Options = Options()) -> DataFrame:
    """Elements of positioned text: headings and paragraphs in reading order, without what the options leave out."""
    kept = chosen(fragments, options)
    # The columns of a page are read one after the other: each is a page of its own to the line finder.
    own = layout.columns(kept, options.layout).withColumn("page", F.col("page") * 100 + F.col("column")).drop("column")
    out = layout.marked_headings(layout.paragraphs(layout.lines(own, options.layout), options.layout), kept, options.layout)
    real = F.floor(F.col("page") / 100).cast("int")
    pos = F.row_number().over(Window.partitionBy("doc_id", real).orderBy("page", "paragraph")) - 1
    empty = {c: t for c, t in (f.strip().split(" ", 1) for f in re.split(r",\s*(?![^<]*>)", ELEMENTS))}
    made = {"doc_id": F.col("doc_id"), "page": real, "pos": pos.cast("int"), "type": F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph"), "text": F.col("text"), "level": F.col("level").cast("int")}
    return out.select(*[made[c].alias(c) if c in made else F.lit(None).cast(t).alias(c) for c, t in empty.items()])


def open_files(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """Elements of all files under a path, whatever their format."""
    files = read_files(spark, path)
    out = file_elements(files).unionByName(fragment_elements(pdf_fragments(files), options))
    return out.where(F.col("page").isin(*sorted(set(options.pages)))) if options.pages else out


def text(elements: DataFrame) -> DataFrame:
    return rendered(elements, "text")


def markdown(elements: DataFrame, titles: DataFrame | None = None, contents: bool = False) -> DataFrame:
    """doc_id and Markdown; with ``titles`` (doc_id, title) under front matter, with ``contents`` under numbered headings if there are two."""
    out = rendered(elements, "markdown")
    if contents:
        line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"])
        ordered = F.array_sort(F.collect_list(F.struct("page", "pos", "text")))
        toc = headings(elements).groupBy("doc_id").agg(ordered.alias("h")).where(F.size("h") > 1)
        toc = toc.select("doc_id", F.concat(F.lit("## Contents\n\n"), F.array_join(F.transform("h", line), "\n"), F.lit("\n\n")).alias("toc"))
        out = out.join(toc, "doc_id", "left").select("doc_id", F.concat(F.coalesce("toc", F.lit("")), "markdown").alias("markdown"))
    if titles is not None:
        head = F.concat(F.lit("---\ntitle: "), F.coalesce("title", F.lit("")), F.lit("\n---\n\n"))
        out = out.join(titles.select("doc_id", "title"), "doc_id", "left").select("doc_id", F.concat(head, "markdown").alias("markdown"))
    return out


def chunks(elements: DataFrame, config: SizeConfig = SizeConfig()) -> DataFrame:
    return chunk_elements(elements, config)


def layout_counts(elements: DataFrame) -> DataFrame:
    """How many elements of each kind a document has."""
    kinds = ("heading", "paragraph", "list", "table", "image", "code", "blockquote")
    return elements.groupBy("doc_id").agg(F.max("page").alias("pages"), *[F.count_if(F.col("type") == k).alias(f"{k}s") for k in kinds])
