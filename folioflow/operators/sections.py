"""The second chunker: one chunk a section of the heading tree, sections over the limit packed from paragraphs and sentences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.sentences import loose_sentences, split_to_size
from folioflow.config import Limit, SizeConfig
from folioflow.operators.chunking import _finished, level_of, list_text, next_path, table_text
from folioflow.schemas import CHUNKS, FIELDS
from folioflow.shared import arrow_schema, record_batch, slices


@dataclass(frozen=True)
class SectionConfig:
    most: int = 2000
    least: int = 100
    #: Headings below this level are content of the section they are in.
    deepest: int = 3
    prefix: str = "chunk"


def _text(e: dict) -> str:
    if e["type"] == "list":
        return list_text(e["items"], bool(e["ordered"])) if e["items"] is not None else ""
    if e["type"] == "table":
        return table_text(e["rows"]) if e["rows"] is not None and len(e["rows"]) else ""
    return (e["text"] or "").strip()


def sections_of(elements: list[dict], config: SectionConfig) -> list[dict]:
    """Sections in order: path, level, title and the elements under each heading; the text before the first has no title."""
    out = [{"path": [], "level": 0, "title": "", "body": []}]
    for e in elements:
        if e["type"] == "heading" and level_of(e) <= config.deepest and _text(e):
            path = next_path(out[-1]["path"], out[-1]["level"], _text(e), level_of(e))
            out.append({"path": path, "level": level_of(e), "title": _text(e), "body": []})
        else:
            out[-1]["body"].append(e)
    return [s for s in out if s["title"] or s["body"]]


def packed(parts: list[tuple[str, dict]], config: SectionConfig) -> list[list[tuple[str, dict]]]:
    """Parts in groups of at most ``most`` bytes; a small last group joins the one before if both fit.

    A part that introduces a list stays with the list; one over the limit is packed from its sentences.
    """
    size = lambda t: len(t.encode())
    fine: list[tuple[str, dict]] = []
    for t, e in parts:
        if size(t) <= config.most:
            fine.append((t, e))
            continue
        held = ""
        for s in loose_sentences(t) if e["type"] not in ("table", "list") else [t]:
            for piece in split_to_size(s, SizeConfig(most=Limit(config.most, soft=False))) if size(s) > config.most else [s]:
                if held and size(held) + 1 + size(piece) > config.most:
                    fine.append((held, e))
                    held = ""
                held = f"{held} {piece}".strip()
        if held:
            fine.append((held, e))
    groups: list[list[tuple[str, dict]]] = []
    total = 0
    for k, (t, e) in enumerate(fine):
        after = fine[k + 1] if k + 1 < len(fine) else None
        intro = after is not None and after[1]["type"] == "list" and t.rstrip().endswith(":")
        need = size(t) + (size(after[0]) + 2 if intro and size(t) + size(after[0]) + 2 <= config.most else 0)
        if groups and total + 2 + need <= config.most:
            groups[-1].append((t, e))
            total += 2 + size(t)
        else:
            groups.append([(t, e)])
            total = size(t)
    if len(groups) > 1:
        last, before = (size("\n\n".join(t for t, _ in g)) for g in (groups[-1], groups[-2]))
        if last < config.least and last + 2 + before <= config.most:
            groups[-2:] = [groups[-2] + groups[-1]]
    return groups


def section_chunks(elements: list[dict], config: SectionConfig) -> list[dict]:
    out = []
    for s in sections_of(elements, config):
        parts = [(t, e) for e in s["body"] if (t := _text(e))]
        groups = packed(parts, config) if parts else [[]]
        for g in groups:
            texts = ([s["title"]] if s["title"] and g is groups[0] else []) + [t for t, _ in g]
            if not texts:
                continue
            kinds = list(dict.fromkeys((["heading"] if s["title"] and g is groups[0] else []) + [e["type"] for _, e in g]))
            pages = [e["page"] for _, e in g] or [1]
            out.append(
                {
                    "text": "\n\n".join(texts), "section_path": s["path"], "section_title": s["title"], "heading_level": s["level"],
                    "page_start": min(pages), "page_end": max(pages), "level": "section" if len(groups) == 1 else "paragraph", "element_types": kinds,
                    "has_table": "table" in kinds, "has_list": "list" in kinds, "has_image": "image" in kinds,
                }
            )
    for i, c in enumerate(out):
        c |= {"chunk_index": i, "id": f"{config.prefix}_{i}", "total_chunks": len(out)}
    return out


def chunk_sections(elements: DataFrame, config: SectionConfig = SectionConfig()) -> DataFrame:
    """Chunks by section of documents given as elements."""

    schema = arrow_schema(CHUNKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, bodies in slices(batches, "doc_id", "elements"):
            yield record_batch([_finished(doc, "", c) for doc, es in zip(docs, bodies, strict=True) for c in section_chunks(es, config)], schema)

    own = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("elements"))
    return own.mapInArrow(run, CHUNKS)


def kept_with_next(elements: DataFrame) -> Column:
    """Whether an element must stay with the one behind it: a heading, a list's introduction, a caption."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    after = F.lead("type").over(w)
    caption = ((after == "table") & X.is_caption(F.col("text"), "table")) | ((after == "image") & X.is_caption(F.col("text"), "figure"))
    return (F.col("type") == "heading") | ((after == "list") & X.introduces_list(F.col("text"))) | caption


def atomic_blocks(elements: DataFrame) -> DataFrame:
    """Runs of elements that mustn't be parted: doc_id, first, last, kind. Tables, lists and images, with what belongs to them."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    own = elements.withColumn("_keep", F.coalesce(kept_with_next(elements), F.lit(False)) & (F.col("type") != "heading"))
    own = own.withColumn("_new", (~F.coalesce(F.lag("_keep").over(w), F.lit(False))).cast("int"))
    own = own.withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.max(F.when(F.col("type").isin("table", "list", "image"), F.col("type")))
    return own.groupBy("doc_id", "_b").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), kind.alias("kind")).where("kind is not null").drop("_b")


def block_at(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` (doc_id, pos, ...) with block_first, block_last and block_kind of the atomic block they lie in, null outside.

    Blocks don't overlap, so the one that began last is looked at alone: a union and a running last value, without a join on ranges.
    """
    a = rows.select("doc_id", "pos", F.lit(1).alias("_k"), F.struct(*rows.columns).alias("_r"), F.lit(None).cast("struct<first:long,last:long,kind:string>").alias("_b"))
    own = F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "kind")
    b = blocks.select("doc_id", F.col("first").alias("pos"), F.lit(0).alias("_k"), F.lit(None).cast(a.schema["_r"].dataType).alias("_r"), own.alias("_b"))
    w = Window.partitionBy("doc_id").orderBy("pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_b", F.last("_b", ignorenulls=True).over(w)).where("_k = 1")
    inside = F.col("_b.last") >= F.col("pos")
    return out.select("_r.*", *[F.when(inside, F.col(f"_b.{c}")).alias(f"block_{c}") for c in ("first", "last", "kind")])


def within_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` with ``within``: whether they lie in an atomic block."""
    return block_at(rows, blocks).withColumn("within", F.col("block_first").isNotNull()).drop("block_first", "block_last", "block_kind")
