"""Quality rules with host-level verdicts, in DataFrame functions only.

``with_rules`` computes the rule figures of every whole text. ``host_verdicts`` then counts failing documents by
host, fits a beta prior to the hosts' rates by moments, shrinks each host's rate towards it, and rejects hosts whose
shrunk rate is over ``max_rate``. ``apply_hosts`` joins the verdicts back to the documents.

Defined results: null text counts as empty, so it has no words and fails; a null host is never judged as a host;
repeated rows are judged alike, each for itself; other columns pass through; no documents give no hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import SPACES, cut, free, read, text_of, words_of

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = "#*$%&|<>"
#: Hosts whose shrunk failure rate is over this are rejected.
MAX_HOST_RATE = 0.5
#: Verdicts of up to so many hosts are broadcast; more are joined by salted keys.
BROADCAST_HOSTS = 100_000
SALTS = 32


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, even where lambdas inside use it for each element."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in windows which occur twice or more.

    Hashes tell which texts have no such window at all; the others compare the windows themselves.
    """
    starts = lambda a: F.sequence(F.lit(0), F.size(a) - WINDOW)
    hashed = lambda h: F.transform(starts(h), lambda i: F.xxhash64(F.slice(h, i + 1, F.lit(WINDOW))))
    differ = let(let(F.transform(words, lambda w: F.xxhash64(w)), hashed), lambda x: F.size(F.array_distinct(x)) == F.size(x))
    windows = lambda w: F.transform(
        starts(w), lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("p"))
    )
    same = lambda s: F.filter(
        s, lambda x, i: F.get(s, i - 1)["w"].eqNullSafe(x["w"]) | F.get(s, i + 1)["w"].eqNullSafe(x["w"])
    )
    at = let(let(words, lambda w: F.sort_array(windows(w))), lambda s: F.sort_array(F.transform(same(s), lambda x: x["p"])))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n")),
    )["n"]
    return F.when((F.size(words) <= WINDOW) | differ, F.lit(0).cast("long")).otherwise(covered)


def with_rules(docs: DataFrame, name: str = "rules") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed in a struct of that name."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    figures = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )
    failed = lambda r: (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > MAX_REPEAT_PERCENT * r["n_words"])
    return docs.withColumn(name, let(figures, lambda r: r.withField("base_failed", failed(r))))


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row a host: n_docs, n_failed, rate (shrunk) and rejected. ``rules`` has source and base_failed.

    The prior is beta(m * k, (1 - m) * k), with m the share of all documents that fail. Hosts' observed rates differ from
    m by what the hosts differ and by chance: of N documents on H hosts, the sum of n * (r - m)^2 over the hosts is expected to be
    v * (N - H) + H * m * (1 - m), with v the variance between hosts. So v has chance taken off, and k = m * (1 - m) / v - 1, at least 0; without variance
    between hosts, or with one document a host, all hosts get the mean.
    """
    hosts = rules.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("base_failed"), 1)).alias("n_failed")
    )
    r = F.col("n_failed") / F.col("n_docs")
    mean = F.sum("n_failed") / F.sum("n_docs")
    n, h = F.sum("n_docs"), F.count(F.lit(1))
    moments = hosts.agg(mean.alias("m"), (F.sum(F.col("n_docs") * r * r) / n).alias("m2"), n.alias("n"), h.alias("h"))
    chance = F.col("m") * (1 - F.col("m"))
    v = F.when(F.col("n") > F.col("h"), (F.col("n") * (F.col("m2") - F.col("m") * F.col("m")) - F.col("h") * chance) / (F.col("n") - F.col("h")))
    k = F.when(v > 1e-12, F.greatest(chance / v - 1, F.lit(0.0))).otherwise(F.lit(1e12))
    prior = moments.select("m", k.alias("k"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    one = hosts.join(F.broadcast(prior))  # prior is one row
    return one.select("source", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk > max_rate).alias("rejected"))


def apply_hosts(docs: DataFrame, verdicts: DataFrame, name: str = "host_rejected") -> DataFrame:
    """``docs`` with a flag of that name for rejected hosts. The verdicts are broadcast while they are few by count, else joined by salted host."""
    host, own, salt = free(docs, "_host", "_own", "_salt")
    bad = cut(verdicts.where("rejected").select(F.col("source").alias(host)), "hosts")
    if bad.count() <= BROADCAST_HOSTS:
        joined = docs.join(F.broadcast(bad), docs["source"] == F.col(host), "left")
    else:
        salted = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn(own, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (F.col("source") == F.col(host)) & (F.col(own) == F.col(salt)), "left").drop(own, salt)
    return joined.withColumn(name, F.col(host).isNotNull()).drop(host)


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule figures and verdict of every document. The figures are computed once and written; hosts are counted on them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    figures = cut(with_rules(docs).select("doc_id", "source", "rules.*"), "rules")
    judged = apply_hosts(figures, host_verdicts(figures))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
    )


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with their columns.

    The documents with their verdict are written once, so that the rules run once for the host counts and the filter.
    """
    names = docs.columns
    rules, failed, rejected = free(docs, "_rules", "_failed", "_rejected")
    ruled = cut(with_rules(docs, rules).withColumn(failed, F.col(f"{rules}.base_failed")).drop(rules), "ruled")
    verdicts = host_verdicts(ruled.select("source", F.col(failed).alias("base_failed")))
    return apply_hosts(ruled.where(~F.col(failed)), verdicts, rejected).where(~F.col(rejected)).select(*names)


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS rid, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), win AS (
  SELECT rid, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'p': i, 's': array_to_string(w[i:i+7], ' ')}}), recursive := true) FROM d WHERE len(w) >= 8
), dup AS (
  SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c >= 2
), rep AS (
  SELECT rid, sum(least(8, coalesce(p - before, 8)))::BIGINT AS n FROM (SELECT *, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM dup) GROUP BY rid
), base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source
), m AS (SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS m2, sum(n) AS n, count(*) AS h FROM hosts
), v AS (SELECT m, CASE WHEN n > h THEN (n * (m2 - m * m) - h * m * (1 - m)) / (n - h) END AS v FROM m
), prior AS (SELECT m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 0.0) ELSE 1e12 END AS k FROM v
), bad AS (SELECT source FROM hosts, prior WHERE (f + m * k) / (n + k) > {MAX_HOST_RATE}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM judged
"""
