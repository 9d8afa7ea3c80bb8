"""Removal of boilerplate lines by the number of distinct sites they appear on.

Each line gets a HyperLogLog sketch of its sites, which merges by aggregation; a line whose estimate is clearly below
or above ``min_sites`` is decided by it. Lines near the threshold get an exact distinct count: only their rows are
read again. A line on ``min_sites`` sites or more is boilerplate; it stays where it first appears (smallest doc_id,
then text hash, then position) and goes everywhere else, so that no content is lost altogether.

A line is what lies between line feeds, without spaces at its ends, and it needs a word; blank lines always stay.
Lines are known by the 128 bits of their MD5. The sketch is
a fixed 2^``LG_K`` registers at most, so the hot line of a third of all documents costs no more than any other, and
every count is combined before the shuffle.

Defined results: null text counts as empty and comes out as it was; null is not a site, so lines of documents without
a source are counted by other sources alone; rows that agree in doc_id, source and text are treated alike, and all of
them keep a line that first appears there; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import SPACES, cut, free, read, text_of

MIN_SITES = 5
LG_K = 10
#: The sketch's relative error is about 1.04 / sqrt(2^LG_K) = 0.033; lines within six times that are counted exactly.
BAND = 0.2
#: Boilerplate lines with their first places are broadcast up to so many by count.
BROADCAST_LINES = 200_000
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(SPACES)).cast("binary")))


def explode_lines(docs: DataFrame) -> DataFrame:
    """One row a line with a word: source, first (where it stands: doc_id, text hash, position), line (its key)."""
    at = docs.select("doc_id", "source", F.xxhash64(text_of()).alias("text_key"), F.posexplode(_lines(text_of())).alias("pos", "raw"))
    at = at.where(F.btrim("raw", F.lit(SPACES)) != "")
    return at.select("source", F.struct("doc_id", "text_key", "pos").alias("first"), _key(F.col("raw")).alias("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """The boilerplate lines: line, first."""
    sites = lines.groupBy("line").agg(
        F.hll_sketch_agg(F.coalesce("source", F.lit("")), F.lit(LG_K)).alias("sites"),
        F.max(F.col("source").isNull().cast("int")).alias("nulls"),
        F.min("first").alias("first"),
    )
    # A null source went into the sketch as one more site.
    sites = sites.select("line", "first", (F.hll_sketch_estimate("sites") - F.col("nulls")).alias("about"))
    sites = cut(sites.where(F.col("about") >= min_sites * (1 - band)), "sites")
    sure = sites.where(F.col("about") > min_sites * (1 + band)).select("line", "first")
    near = sites.where(F.col("about") <= min_sites * (1 + band)).select("line", "first")
    asked = near.select("line")
    pairs = lines.where(F.col("source").isNotNull()).select("line", "source")
    if asked.count() <= BROADCAST_LINES:
        pairs = pairs.join(F.broadcast(asked), "line", "left_semi").distinct()
    else:  # the rows of a line and site are combined before they meet the lines
        pairs = pairs.distinct().join(asked, "line", "left_semi")
    exact = (
        pairs
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_sites)
    )
    return sure.unionByName(near.join(exact.select("line"), "line", "left_semi"))


def repeats(docs: DataFrame, lines: DataFrame, boiler: DataFrame) -> DataFrame:
    """Positions of boilerplate lines that aren't first places: _doc, _key, _gone (array of positions).

    The boilerplate is broadcast while it is small by count. Otherwise it is joined with salted keys, so that the rows of
    a very common line are dealt over ``SALTS`` tasks.
    """
    boiler = cut(boiler, "boilerplate")
    at = lines.select("line", F.col("first").alias("at"))
    if boiler.count() <= BROADCAST_LINES:
        found = at.join(F.broadcast(boiler), "line")
    else:
        salted = boiler.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = at.withColumn("_salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).join(salted, ["line", "_salt"])
    found = found.where(~F.col("at").eqNullSafe(F.col("first")))
    return found.groupBy(F.col("at.doc_id").alias("_doc"), F.col("at.text_key").alias("_key")).agg(F.collect_set("at.pos").alias("_gone"))


def drop_lines(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, gone: str = "_gone") -> DataFrame:
    """``docs`` with its text without boilerplate, and under the name ``gone`` the positions of the lines removed (null: none)."""
    doc, key = free(docs, "_doc", "_key")
    lines = explode_lines(docs)
    found = repeats(docs, lines, boilerplate(lines, min_sites, band)).select(F.col("_doc").alias(doc), F.col("_key").alias(key), F.col("_gone").alias(gone))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(text_of()) == F.col(key))
    out = docs.join(found, same, "left").drop(doc, key)
    left = F.transform(F.array(_lines(F.col("text"))), lambda a: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col(gone)), lambda i: F.get(a, i)), "\n"
    ))[0]
    return out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and a digest of what is left."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = docs.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("text")))).cast("long"))
    out = drop_lines(docs)
    return out.select(
        "doc_id", "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.length(text_of()).cast("long").alias("kept_chars"), F.md5(text_of()).alias("kept_md5"),
    )


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, without boilerplate lines."""
    return drop_lines(docs, gone=free(docs, "_gone")[0]).select(*docs.columns)


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), l AS (
  SELECT rid, doc_id, source, t, unnest(string_split(t, chr(10))) AS raw, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d
), k AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l
), b AS (
  SELECT line, min({{'d': doc_id, 't': t, 'p': pos}}) AS first FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), kept AS (
  SELECT rid, count(*) FILTER (first IS NOT NULL AND first <> {{'d': doc_id, 't': t, 'p': pos}}) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (first IS NULL OR first = {{'d': doc_id, 't': t, 'p': pos}}), '') AS kept
  FROM k LEFT JOIN b USING (line) GROUP BY rid
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(t, chr(10))) END::BIGINT AS n_lines, n_removed::BIGINT AS n_removed,
  length(kept)::BIGINT AS kept_chars, md5(kept) AS kept_md5
FROM d JOIN kept USING (rid)
"""
