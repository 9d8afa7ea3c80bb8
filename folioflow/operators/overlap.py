"""Overlap between neighbouring chunks, boundaries for cuts, orphans, and captions beside tables and figures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.config import OverlapConfig
from folioflow.functions import text as X
from folioflow.functions.sentences import byte_ends, character_overlap, paragraph_list, strict_sentences, text_udf

#: What a cut is worth before a heading and after a table or figure, a list, a paragraph, a sentence.
SCORES = {"heading": 100, "table": 85, "figure": 85, "list": 80, "paragraph": 70, "sentence": 20}


def overlap_of(text: str, config: OverlapConfig) -> str:
    """What the next chunk repeats of ``text``."""
    if config.strategy == "none" or not text:
        return ""
    if config.strategy == "character":
        out = character_overlap(text, config.size, config.keep_words)
    elif config.strategy == "paragraph":
        out = "\n\n".join(paragraph_list(text)[-config.size :])
    else:
        out = " ".join(strict_sentences(text)[-config.size :]) or character_overlap(text, config.size, config.keep_words)
    if len(out.encode()) > config.most:
        kept = ""
        for s in strict_sentences(out):
            if len((kept + " " + s).strip().encode()) > config.most:
                break
            kept = (kept + " " + s).strip()
        out = kept or character_overlap(out, config.most, config.keep_words)
    return out


def overlap(text: Column, config: OverlapConfig = OverlapConfig()) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: overlap_of(t, config))

    return run(text)


def character_tail(text: Column, size: int) -> Column:
    """The character overlap without a UDF, for sizes in code points."""
    tail = F.substring(text, -size, size)
    return F.when(F.length(text) <= size, text).otherwise(X.trimmed(F.regexp_replace(tail, r"\A[^ \t\n\r]*[ \t\n\r]*", "")))


def with_previous(rows: DataFrame, key: str, order: str, config: OverlapConfig = OverlapConfig()) -> DataFrame:
    """``rows`` with the overlap of the row before in ``prefix`` and the text under it in ``text_with_overlap``.

    The overlap is taken of the row's own text, not of one that has a prefix already; so one lag over a sort by key is enough.
    """
    w = Window.partitionBy(key).orderBy(order)
    own = rows.withColumn("_tail", overlap(F.col("text"), config)).withColumn("prefix", F.coalesce(F.lag("_tail").over(w), F.lit("")))
    joined = F.when(F.octet_length("prefix") >= config.least, F.concat("prefix", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return own.withColumn("text_with_overlap", joined).drop("_tail")


def boundaries(elements: DataFrame) -> DataFrame:
    """doc_id, pos, position (byte offset behind the element), kind and score of the cuts between elements.

    There is none behind a heading, nor between a list and the line that introduces it; offsets are running sums.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    upto = F.sum(F.octet_length("text") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 2
    after = F.lead("type").over(w)
    own = elements.withColumn("position", upto.cast("long")).withColumn("after", after)
    kind = F.when(F.col("after") == "heading", "heading").otherwise(F.col("type"))
    score = F.coalesce(*[F.when(kind == k, F.lit(s)) for k, s in SCORES.items()], F.lit(0))
    together = (F.col("type") == "heading") | ((F.col("after") == "list") & X.introduces_list(F.col("text")))
    return own.where(F.col("after").isNotNull() & ~together).select("doc_id", "pos", "position", kind.alias("kind"), score.cast("long").alias("score"))


def best_boundary(cuts: DataFrame, least: int, most: int) -> DataFrame:
    """The best cut between two offsets in each document; the earliest of equals."""
    inside = cuts.where(F.col("position").between(least, most))
    return inside.groupBy("doc_id").agg(F.max_by(F.struct("position", "score"), F.struct("score", (-F.col("position")).alias("p"))).alias("b")).select("doc_id", "b.*")


def boundary_near(cuts: DataFrame, position: int, tolerance: int) -> DataFrame:
    """The best cut within a tolerance of an offset, the earliest of equals."""
    return best_boundary(cuts, max(0, position - tolerance), position + tolerance)


def boundary_ahead(cuts: DataFrame, target: int, look_ahead: int = 200) -> DataFrame:
    """The best cut within half the look-ahead of a target."""
    return boundary_near(cuts, target, look_ahead // 2)


def boundary_within(cuts: DataFrame, cut: int, window: int, upper: int) -> DataFrame:
    """The best cut from 1 to ``upper`` within a window of an offset; of equals the one nearest to it, then the earliest."""
    inside = cuts.where(F.col("position").between(max(1, cut - window), min(upper, cut + window)))
    rank = F.struct("score", (-F.abs(F.col("position") - cut)).alias("d"), (-F.col("position")).alias("p"))
    return inside.groupBy("doc_id").agg(F.max_by(F.struct("position", "score"), rank).alias("b")).select("doc_id", "b.*")


def sides(data: Column, position: Column) -> tuple[Column, Column]:
    """Bytes of a text before and behind an offset, without white space at their ends."""
    size = lambda part: F.octet_length(X.trimmed(F.decode(part, "UTF-8")))
    raw = F.encode(data, "UTF-8")
    return size(F.substring(raw, F.lit(1), position.cast("int"))), size(F.substring(raw, position.cast("int") + 1, F.octet_length(raw)))


def orphans(text: Column, position: Column, least: int) -> Column:
    """Whether a cut of the text leaves a side that isn't empty but, trimmed, too small."""
    before, behind = sides(text, position)
    return ((before > 0) & (before < least)) | ((behind > 0) & (behind < least))


def without_orphans(text: Column, position: Column, cuts: Column, least: int) -> Column:
    """The position, or if it leaves an orphan the first of the cuts (an array, in order) nearer than ``least`` that leaves none."""
    good = F.filter(cuts, lambda c: (c > position - least) & (c < position + least) & ~orphans(text, c, least))
    return F.when(orphans(text, position, least), F.coalesce(F.get(good, F.lit(0)), position)).otherwise(position)


def makes_orphan(position: Column, total: Column, least: int) -> Column:
    """Whether a cut leaves a side that isn't empty but too small."""
    return ((position > 0) & (position < least)) | ((total - position > 0) & (total - position < least))


def captions(rows: DataFrame, key: str, order: str, is_target: Column, kind: str) -> DataFrame:
    """Rows that are tables or figures, with the caption before or else behind them."""
    w = Window.partitionBy(key).orderBy(order)
    own = rows.withColumn("_b", F.lag("text").over(w)).withColumn("_a", F.lead("text").over(w)).where(is_target)
    caption = F.when(X.is_caption(F.col("_b"), kind), F.col("_b")).when(X.is_caption(F.col("_a"), kind), F.col("_a")).otherwise("")
    return own.withColumn("caption", caption).drop("_a", "_b")


def end_near(data: bytes, target: int) -> int:
    """The sentence end nearest before the byte offset, within 100 bytes; else the next one within 100; else a word boundary within 50; else the offset."""
    n = len(data)
    if target >= n:
        return n
    stop, gap = b".!?", b" \n"
    for i in range(target, max(-1, target - 100), -1):
        if data[i] in stop and i + 1 < n and data[i + 1] in gap:
            return i + 1
    for i in range(target, min(n, target + 100)):
        if data[i] in stop and (i + 1 >= n or data[i + 1] in gap):
            return i + 1
    for far in range(50):
        for i in (target - far, target + far):
            if 0 <= i < n and data[i] in gap:
                return i
    return target


def sentence_end_near(text: Column, target: int) -> Column:
    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: end_near(t.encode(), target))

    return run(text)


def sentence_positions(text: Column) -> Column:
    """Byte offsets of the sentence ends inside a text."""
    return text_udf(byte_ends, T.ArrayType(T.LongType()))(text)
