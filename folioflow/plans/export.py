"""Exports of chunks: JSON lines, JSON, CSV and TSV, numbered batches, and the layouts of three vector stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.tables import embedding_text
from folioflow.operators.ranks import running

#: Metadata that goes into an export by default.
METADATA = ("section_title", "page_start", "page_end", "chunk_index", "char_count", "word_count", "estimated_tokens", "has_table", "has_list", "has_image")


def not_empty(c: Column, kind: str) -> Column:
    """The value, or null where it is empty, zero or false, so that JSON leaves it out."""
    empty = {"string": F.lit(""), "boolean": F.lit(False)}.get(kind, F.lit(0))
    return F.when(c != empty, c)


def metadata(chunks: DataFrame, fields: tuple[str, ...] = METADATA) -> Column:
    kinds = dict(chunks.dtypes)
    return F.struct(*[not_empty(F.col(f), kinds[f]).alias(f) for f in fields if f in kinds])


def json_lines(chunks: DataFrame, fields: tuple[str, ...] = METADATA) -> DataFrame:
    """doc_id, chunk_index and one JSON object a chunk in ``value``."""
    return chunks.select("doc_id", "chunk_index", F.to_json(F.struct("id", "text", metadata(chunks, fields).alias("metadata"))).alias("value"))


def json_array(chunks: DataFrame, fields: tuple[str, ...] = METADATA) -> DataFrame:
    """doc_id and one JSON array a document."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "value")))
    return json_lines(chunks, fields).groupBy("doc_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["value"]), ","), F.lit("]")).alias("json")
    )


def delimited(chunks: DataFrame, by: str = ",", columns: tuple[str, ...] = ("id", "text", "section_title", "page_start", "chunk_index")) -> DataFrame:
    """doc_id, chunk_index and a line of delimited fields, quoted where needed."""
    def field(name: str) -> Column:
        c = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(c.rlike(f'[{by}"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return chunks.select("doc_id", "chunk_index", F.concat_ws(by, *[field(c) for c in columns]).alias("line"))


def batches(chunks: DataFrame, size: int) -> DataFrame:
    """``chunks`` with batch and place in it, by document."""
    return chunks.withColumn("batch", F.floor(F.col("chunk_index") / size).cast("long")).withColumn("place", (F.col("chunk_index") % size).cast("long"))


def batch_bounds(chunks: DataFrame, size: int) -> DataFrame:
    return batches(chunks, size).groupBy("doc_id", "batch").agg(
        F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("char_count").alias("bytes")
    )


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``row``, their number over all documents.

    Numbers come from the counts of documents before; these are summed by ranges of documents.
    """
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("_n"))
    start = running(counts, [F.col("doc_id")], {"_start": F.col("_n")}).select("doc_id", "_start")
    return chunks.join(start, "doc_id").withColumn("row", (F.col("_start") + F.col("chunk_index")).cast("long")).drop("_start")


def pinecone(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """id, values, metadata of the chunks that have an embedding in their place (row = vec_id)."""
    own = chunks.join(embeddings.select(F.col("vec_id").alias("row"), "embedding"), "row")
    return own.select("row", "id", F.col("embedding").alias("values"), F.to_json(metadata(own)).alias("metadata"))


def weaviate(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """All chunks as objects, with a vector where there is one."""
    own = chunks.join(embeddings.select(F.col("vec_id").alias("row"), "embedding"), "row", "left")
    return own.select("row", "id", F.to_json(F.struct("text", metadata(own).alias("properties"))).alias("object"), F.col("embedding").alias("vector"))


def chroma(chunks: DataFrame, embeddings: DataFrame | None = None, size: int = 1000) -> DataFrame:
    """Parallel arrays of ids, documents and metadatas, in batches of rows."""
    own = chunks.withColumn("batch", F.floor(F.col("row") / size))
    if embeddings is not None:
        own = own.join(embeddings.select(F.col("vec_id").alias("row"), "embedding"), "row", "left")
    extra = [F.col("embedding")] if embeddings is not None else []
    rows = F.array_sort(F.collect_list(F.struct("row", "id", "text", F.to_json(metadata(own)).alias("m"), *extra)))
    of = lambda n: F.transform(rows, lambda x: x[n])
    names = {"ids": "id", "documents": "text", "metadatas": "m"} | ({"embeddings": "embedding"} if extra else {})
    return own.groupBy("batch").agg(*[of(c).alias(n) for n, c in names.items()])


def embedding_lines(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", embedding_text(F.col("embedding")).alias("text"))


def write(chunks: DataFrame, path: str, form: str = "jsonl", fields: tuple[str, ...] = METADATA) -> None:
    """Write chunks as jsonl, json, csv or tsv files; every partition writes its own."""
    if form in ("jsonl", "json"):
        (json_lines(chunks, fields).select("value") if form == "jsonl" else json_array(chunks, fields).select("json")).write.text(path)
    else:
        chunks.select("id", "text", *[f for f in fields if f in chunks.columns]).write.csv(path, header=True, sep="," if form == "csv" else "\t")


def write_batches(chunks: DataFrame, path: str, size: int) -> None:
    """One folder a batch number."""
    own = batches(chunks, size)
    json_lines(own).join(own.select("doc_id", "chunk_index", "batch"), ["doc_id", "chunk_index"]).select("batch", "value").write.partitionBy("batch").text(path)


def pretty_metadata(chunks: DataFrame, fields: tuple[str, ...] = METADATA) -> Column:
    """The metadata as indented JSON."""
    return F.to_json(metadata(chunks, fields), {"pretty": "true"})


def flattened(value: Column, kind: str, prefix: str = "") -> Column:
    """A struct as a map from dotted names to texts, in the order of its fields. ``kind`` is its type."""
    maps = []
    for f in T._parse_datatype_string(kind):
        name, own = f"{prefix}{f.name}", value[f.name]
        if isinstance(f.dataType, T.StructType):
            maps.append(flattened(own, f.dataType.simpleString(), f"{name}."))
        else:
            maps.append(F.create_map(F.lit(name), own.cast("string")))
    return F.map_concat(*maps)


#: Columns that a CSV export has always, behind id and text.
CSV_COLUMNS = ("chunk_index", "document_title", "page_start", "page_end", "section_title", "has_table", "has_list", "has_image")


def csv_columns(fields: tuple[str, ...]) -> list[str]:
    """Names of a CSV export: id, text, the fixed ones, then the other metadata in order."""
    return ["id", "text", *CSV_COLUMNS, *(f for f in fields if f not in CSV_COLUMNS)]


def as_string(chunks: DataFrame, form: str = "jsonl") -> DataFrame:
    """doc_id and the whole export of each document as one text."""
    if form == "json":
        return json_array(chunks).withColumnRenamed("json", "value")
    lines = json_lines(chunks) if form == "jsonl" else delimited(chunks, "," if form == "csv" else "\t").withColumnRenamed("line", "value")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "value")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"))
