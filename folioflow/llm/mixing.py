"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is t and whose size is s wants every document t / s times. The whole part is taken outright;
the fractional parts are rounded by the pivotal method: two documents meet, words move from one's expected take to
the other's until one of the two is integral, in a random direction whose odds leave both expectations as they were.
So each document's expected copies stay t / s, and a source's words stay exactly at their target until its very last
fractional document is rounded: the total is off by less than one document.

The meetings form a tree. Units are dealt by hash to groups of about ``GROUP`` inside a source; each group leaves one
fractional unit at most; these meet in groups of ``FAN``, and so on until one a source is left. A hot source only has
more groups, and each level is written out, so that a lost executor repeats no draw differently.

Defined results: a null text has size 0 and is taken 0 times 0 words; null is a source of its own, after all others;
rows that agree in doc_id, source and text are one unit and get the same copies; draws depend only on the seed and
the rows, so reruns agree; no documents give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import cut, free, read, text_of, word_count
from folioflow.operators.ranks import numbered, running

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
GROUP, FAN = 4096, 64


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``sources`` (source, source_size) with the weight and target of each.

    The targets share the total by weight, none above ``most`` times its source: what a capped source can't take is
    shared again by weight. That ends at target = min(cap, level * weight); the level is found by sums over the sources
    in the order of cap / weight. Both orders are summed by ranges, so sources may be many.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = numbered(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], "_at")
    s = s.select(
        "source", "source_size", F.get(w, F.pmod("_at", F.lit(len(weights)))).alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")
    )
    s = running(s, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"_caps": F.col("cap"), "_weights": F.col("weight")})
    size, all_weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    ratio, level = F.col("cap") / F.col("weight"), (F.lit(float(size or 0)) - F.col("_caps")) / (F.lit(float(all_weights or 0)) - F.col("_weights"))
    found = s.agg(F.min(F.when(level <= ratio, F.struct(ratio.alias("r"), level.alias("level"))))["level"]).first()[0]
    target = F.col("cap") if found is None else F.least("cap", F.lit(found) * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _rounded(seed: int, last: bool):
    """Rounds one group: rows with ``size`` and ``part`` (the expected fraction); at most one stays fractional.

    With ``last`` that one is drawn as well. Large units meet first, so that what is left over tends to be small.
    """

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "text_key"], ascending=False, kind="stable").reset_index(drop=True)
        p, s = rows["part"].to_numpy(float).copy(), rows["size"].to_numpy(float)
        first = rows.iloc[0]
        draw = np.random.default_rng([seed, len(rows), int(first["text_key"]) & (2**63 - 1), int(key[1])]).random(len(rows) + 1)
        i = -1
        for j in range(len(p)):
            if i < 0:
                i = j
                continue
            up, down = min((1 - p[i]) * s[i], p[j] * s[j]), min(p[i] * s[i], (1 - p[j]) * s[j])
            move = up if draw[j] * (up + down) < down else -down
            p[i] += move / s[i]
            p[j] -= move / s[j]
            for k in (i, j):
                p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
            i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
        if last and i >= 0:
            p[i] = float(draw[-1] < p[i])
        rows["part"] = p
        return rows

    return meet


def copies(units: DataFrame, seed: int = 7) -> DataFrame:
    """``units`` (source, doc_id, text_key, size, rows, ...) with ``wanted`` copies a row, rounded to ``copies``.

    ``wanted`` is a double, alike for the units of a source; a unit weighs its size times its rows.
    """
    u = units.withColumn("whole", F.floor(F.col("wanted") + 1e-12).cast("double"))
    u = u.withColumn("part", F.greatest(F.col("wanted") - F.col("whole"), F.lit(0.0)))
    u = u.withColumn("part", F.when((F.col("size") == 0) | (F.col("part") < 1e-9), F.lit(0.0)).otherwise(F.col("part")))
    u = u.withColumn("whole", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("whole")))
    groups = u.where("part > 0").groupBy("source").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("groups"))
    u = u.join(groups.select(F.col("source").alias("_s"), "groups"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    u = u.withColumn("node", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.coalesce("groups", F.lit(1))))
    u = cut(u, "units")
    most = u.agg(F.max("groups")).first()[0] or 0
    done = [u.where("part = 0")]
    open_ = u.where("part > 0").withColumn("size", F.col("size") * F.col("rows"))
    levels = 1 + math.ceil(math.log(most, FAN) - 1e-9) if most > 1 else int(most == 1)
    for level in range(levels):
        if level:
            open_ = open_.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        met = open_.groupBy("source", "node").applyInPandas(_rounded(seed + level, level == levels - 1), open_.schema)
        met = cut(met, f"level{level}")
        done.append(met.where("part = 0 or part = 1").withColumn("size", F.col("size") / F.col("rows")))
        open_ = met.where("part > 0 and part < 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("copies", (F.col("whole") + F.col("part")).cast("long")).withColumn("size", F.col("size").cast("long")).drop("whole", "part", "groups", "node")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """One row a unit of ``docs`` (doc_id, source, text): source, doc_id, text_key, size, rows, source_size, target, copies."""
    keyed = docs.select("doc_id", "source", _key().alias("text_key"), word_count(text_of()).alias("size"))
    units = cut(keyed.groupBy("source", "doc_id", "text_key", "size").agg(F.count(F.lit(1)).alias("rows")), "mix")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = cut(targets(sources, weights, most), "targets")
    # One row a source; Spark broadcasts it by its own size check or splits the hot source when it is joined by shuffle.
    units = units.join(goal.withColumnRenamed("source", "_g"), F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return copies(units.withColumn("wanted", wanted).withColumn("size", F.col("size").cast("double")), seed)


def _key() -> Column:
    return F.xxhash64(text_of())


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    m = mix(read(spark, sf_dir, "documents"))
    m = m.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def keep_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as many times as the mix takes it."""
    d, s, k, n, one = free(docs, "_d", "_s", "_k", "_n", "_one")
    m = mix(docs).where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("text_key").alias(k), F.col("copies").alias(n))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (_key() == F.col(k))
    taken = docs.join(m, same).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return taken.select(*docs.columns)
