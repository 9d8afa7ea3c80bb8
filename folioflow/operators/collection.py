"""A collection of chunks is a DataFrame; here are its filters, lookups, statistics and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T


def line_chunks(docs: DataFrame, per_page: int = 10) -> DataFrame:
    """Lines as chunks with metadata: ten lines a page, language and source as section path."""
    cleaned = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: T.trimmed(x) != "")
    lines = docs.select("doc_id", "lang", "source", F.posexplode(cleaned).alias("pos", "raw")).withColumn("text", T.trimmed(F.col("raw")))
    page = (F.floor(F.col("pos") / per_page) + 1).cast("long")
    table = F.col("text").contains("|")
    size = F.octet_length("text").cast("long")
    return lines.select(
        "doc_id", F.col("pos").cast("long").alias("chunk_index"), F.concat(F.lit("chunk-"), F.col("pos").cast("string")).alias("id"), "text",
        page.alias("page_start"), page.alias("page_end"), F.array("lang", "source").alias("section_path"), F.col("source").alias("section_title"),
        F.array(F.when(table, "table").otherwise("paragraph")).alias("element_types"), table.alias("has_table"),
        (T.list_kind(F.col("text")) != "").alias("has_list"), F.col("text").contains("![").alias("has_image"), size.alias("char_count"),
        T.words(F.col("text")).alias("word_count"), F.floor(size / 4).cast("long").alias("estimated_tokens"),
    )


def in_section(title: str) -> Column:
    return F.coalesce(F.col("section_title") == title, F.lit(False)) | F.array_contains("section_path", title)


def on_page(page: int) -> Column:
    return F.lit(page).between(F.col("page_start"), F.col("page_end"))


def on_pages(first: int, last: int) -> Column:
    return (F.col("page_start") <= last) & (F.col("page_end") >= first)


def of_type(kind: str) -> Column:
    return F.exists("element_types", lambda t: F.lower(t) == kind.lower())


def has(what: str) -> Column:
    return F.col(f"has_{what}")


def tokens_between(least: int | None = None, most: int | None = None) -> Column:
    out = F.lit(True)
    if least is not None:
        out = out & (F.col("estimated_tokens") >= least)
    return out if most is None else out & (F.col("estimated_tokens") <= most)


def mentions(words: str) -> Column:
    """Contains the words, whatever the case."""
    return F.contains(F.lower("text"), F.lit(words.lower()))


def first_last(chunks: DataFrame) -> DataFrame:
    """doc_id with the ids of its first and last chunk."""
    return chunks.groupBy("doc_id").agg(F.min_by("id", "chunk_index").alias("first_id"), F.max_by("id", "chunk_index").alias("last_id"))


def sections(chunks: DataFrame) -> DataFrame:
    """Section titles of each document in the order they are first seen."""
    seen = chunks.where(F.coalesce("section_title", F.lit("")) != "").groupBy("doc_id", "section_title").agg(F.min("chunk_index").alias("at"))
    return seen.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "section_title"))), lambda x: x["section_title"]).alias("sections"))


def page_range(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))


def statistics(chunks: DataFrame, *keys: str) -> DataFrame:
    """Counts, sums and extremes of chunks, by keys or over all."""
    n = F.count(F.lit(1))
    long = lambda c: c.cast("long")
    return chunks.groupBy(*keys).agg(
        long(n).alias("total_chunks"), long(F.sum("estimated_tokens")).alias("total_tokens"), long(F.sum("word_count")).alias("total_words"),
        long(F.sum("char_count")).alias("total_chars"), long(F.floor(F.sum("estimated_tokens") / n)).alias("avg_tokens"),
        long(F.min("estimated_tokens")).alias("min_tokens"), long(F.max("estimated_tokens")).alias("max_tokens"),
        long(F.count_if("has_table")).alias("with_tables"), long(F.count_if("has_list")).alias("with_lists"), long(F.count_if("has_image")).alias("with_images"),
        F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"),
    )


def summaries(chunks: DataFrame) -> DataFrame:
    """doc_id, id and a line that says what is in the chunk."""
    parts = F.array_compact(
        F.array(
            F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit("Section: "), "section_title")),
            T.page_range(F.col("page_start"), F.col("page_end")), F.concat(F.col("word_count").cast("string"), F.lit(" words")),
            *[F.when(F.col(f"has_{w}"), F.lit(f"contains {w}")) for w in ("table", "list", "image")],
        )
    )
    return chunks.select("doc_id", "id", F.array_join(parts, " | ").alias("summary"))


def with_section_changes(chunks: DataFrame) -> DataFrame:
    """``chunks`` with changed: whether the section differs from the chunk before."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("changed", ~F.lag("section_title").over(w).eqNullSafe(F.col("section_title")))


def collection_markdown(chunks: DataFrame, by: str = "\n\n---\n\n") -> DataFrame:
    """doc_id and markdown: chunk texts, each new section under its heading."""
    own = with_section_changes(chunks)
    titled = F.col("changed") & (F.coalesce("section_title", F.lit("")) != "")
    piece = F.when(titled, F.concat(F.lit("## "), "section_title", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", piece.alias("piece"))))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), by).alias("markdown"))


def contents(chunks: DataFrame) -> DataFrame:
    """doc_id and toc: one line a distinct section, in the order they are first seen."""
    return sections(chunks).select("doc_id", F.array_join(F.transform("sections", lambda s: F.concat(F.lit("- "), s)), "\n").alias("toc"))


def chunk_markdown(ids: bool = False, pages: bool = False, offset: int = 0, most: int = 6) -> Column:
    """A chunk as Markdown: its id as a comment, its section as a heading, its text, its pages; the heading stands for a text that only repeats it."""
    title = F.coalesce("section_title", F.lit(""))
    level = F.coalesce(F.when(F.col("heading_level") > 0, F.col("heading_level")), F.lit(2)) + offset
    level = F.least(F.greatest(level, F.lit(1)), F.lit(most)) if most > 0 else F.greatest(level, F.lit(1))
    parts = [F.when(title != "", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title, F.lit("\n\n"))).otherwise(""), F.when(F.col("text") == title, "").otherwise(F.col("text"))]
    if ids:
        parts.insert(0, F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit("<!-- chunk: "), "id", F.lit(" -->\n"))).otherwise(""))
    if pages:
        parts.append(F.when(F.col("page_start") > 0, F.concat(F.lit("\n\n*"), T.page_range(F.col("page_start"), F.col("page_end")), F.lit("*"))).otherwise(""))
    return F.concat(*parts)


def by_index(chunks: DataFrame, index: int) -> DataFrame:
    """The chunk with a place in each document."""
    return chunks.where(F.col("chunk_index") == index)


def statistics_json(chunks: DataFrame, *keys: str) -> DataFrame:
    """Keys and the statistics as one JSON object."""
    own = statistics(chunks, *keys)
    return own.select(*keys, F.to_json(F.struct(*[c for c in own.columns if c not in keys])).alias("json"))
