"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors form classes first, and one of each class goes on. In each table a vector falls into the bucket of its
signs against random hyperplanes. The number of bits follows the number of classes, so that buckets stay near
``BUCKET`` vectors at every size, and the number of tables follows the bits, so that a pair right at the threshold is
missed by all tables with probability ``MISS``. Buckets over ``BLOCK`` are cut into blocks, and each pair of blocks is a
task's work of its own.

What is dealt to the buckets is a vector's signs alone, a bit for each. Two members are candidates if their signs differ in so few places
as a pair at the threshold does but with a probability below 1e-9, and if they met in no earlier table. Only
vectors that have a candidate in a block go there in full, so a vector travels once for each table that finds it a new neighbour, and not
once a table. All candidates' cosines are then computed in double precision. A pair is counted in the first table it meets in, so
links are exact without a shuffle of pairs: what leaves a block is a count a vector and a spanning forest.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
of different lengths don't link; numbers are taken as doubles of any size; repeated rows count as vectors of their own; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import cut, drop_cut, read
from folioflow.llm.components import components, local_roots, runs

COSINE = 0.95
BUCKET, BLOCK, MISS = 64, 1000, 1e-5
#: Signs of a vector at the least; those beyond the tables' tell candidates alone.
SIGNS = 256
#: Standard deviations that the number of different signs may be over its mean at the threshold.
FAR = 7.0
#: Buckets that need blocks are broadcast up to so many by count; more are joined by shuffle.
BROADCAST_BUCKETS = 20_000
SEED = 11
KEY = ["t", "code", "i", "j"]


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Bits and tables for n vectors."""
    bits = min(30, max(4, round(math.log2(max(1, n) / BUCKET))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - together))


def most_different(signs: int, cosine: float) -> int:
    """Signs, of so many, that may differ between candidates."""
    p = math.acos(cosine) / math.pi
    return math.ceil(signs * p + FAR * math.sqrt(signs * p * (1 - p)))


def matrix(vectors: Iterable) -> np.ndarray:
    """Vectors of one length as lines of doubles, each scaled by a power of two to components of at most one, so that no product overflows or vanishes."""
    v = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _hashed(bits: int, tables: int):
    """Each vector's signs, once a table with its bucket there."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            for dim, part in b.groupby(b["v"].map(len) if len(b) else b["rep"]):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, max(SIGNS, bits * tables)))
                for at in range(0, len(part), 2000):
                    p = part.iloc[at : at + 2000]
                    signs = matrix(p["v"]) @ planes[dim] >= 0
                    codes = (signs[:, : bits * tables].reshape(len(p), tables, bits) * powers).sum(axis=2) << 16 | dim & 0xFFFF
                    own = [x.tobytes() for x in np.packbits(signs, axis=1)]
                    yield pd.DataFrame(
                        {"t": np.repeat(np.arange(tables, dtype=np.int32), len(p)), "code": codes.T.reshape(-1), "rep": np.tile(p["rep"].to_numpy(), tables), "signs": own * tables}
                    )

    return run


def _candidates(g: pd.DataFrame, bits: int, tables: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a block, or of two blocks, whose signs are close and that don't meet in an earlier table."""
    packed = np.frombuffer(b"".join(g["signs"]), np.uint8).reshape(len(g), -1)
    t, i, j = (int(g[k].iloc[0]) for k in ("t", "i", "j"))
    wide = np.zeros((len(g), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    wide = wide.view(np.uint64)
    powers = 1 << np.arange(bits, dtype=np.int64)
    codes = (np.unpackbits(packed, axis=1, count=bits * tables).reshape(len(g), tables, bits)[:, :t] * powers).sum(axis=2) if t else None
    c = g["c"].to_numpy()
    left = np.flatnonzero(c == i)
    right = left if i == j else np.flatnonzero(c == j)
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        apart = np.zeros((len(rows), len(right)), np.uint16)
        for w in range(wide.shape[1]):
            apart += np.bitwise_count(wide[rows, w][:, None] ^ wide[right, w][None, :])
        a, b = np.nonzero(apart <= most)
        a, b = rows[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 100_000):
            x, y = a[k : k + 100_000], b[k : k + 100_000]
            if t:
                new = ~(codes[x] == codes[y]).any(axis=1)
                x, y = x[new], y[new]
            if len(x):
                yield x, y


def _asked(bits: int, tables: int, most: int):
    """Members of blocks that have a candidate."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, KEY):
            some = np.zeros(len(g), bool)
            for x, y in _candidates(g, bits, tables, most) if len(g) > 1 else ():
                some[x] = some[y] = True
            if some.any():
                yield g[some]

    return run


def _compared(cosine: float, bits: int, tables: int, most: int):
    """Links inside each bucket or pair of blocks: rep, links, root."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, KEY):
            v, n, links, ends = matrix(g["v"]), g["n"].to_numpy(), np.zeros(len(g), np.int64), []
            size = np.sqrt((v * v).sum(axis=1))
            for x, y in _candidates(g, bits, tables, most):
                for k in range(0, len(x), 8192):
                    a, b = x[k : k + 8192], y[k : k + 8192]
                    near = np.einsum("ij,ij->i", v[a], v[b]) / (size[a] * size[b]) >= cosine
                    a, b = a[near], b[near]
                    np.add.at(links, a, n[b])
                    np.add.at(links, b, n[a])
                    ends.append((a, b))
            x, y = (np.concatenate([e[k] for e in ends]) if ends else np.empty(0, np.int64) for k in (0, 1))
            if len(x):
                ids = g["rep"].to_numpy()
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(g), np.int64)
                place[order] = np.arange(len(g))
                roots = ids[order][local_roots(len(g), place[x], place[y])][place]
                some = links > 0
                yield pd.DataFrame({"rep": ids[some], "links": links[some], "root": roots[some]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    # Rows without an id and those that link with nothing keep to themselves.
    v = v.withColumn("good", good & F.col("vec_id").isNotNull()).withColumn("key", F.md5(F.array_join(F.col("v").cast("array<string>"), ",")))
    classes = cut(v.where("good").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "classes")
    bits, tables = plan(classes.count(), cosine)
    most = most_different(max(SIGNS, bits * tables), cosine)
    hashed = cut(classes.select("rep", "v").mapInPandas(_hashed(bits, tables), "t int, code long, rep long, signs binary"), "hashed")
    buckets = hashed.groupBy("t", "code").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    large = cut(buckets.where(F.col("_n") > BLOCK).select("t", "code", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks")), "buckets")
    large = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large
    dealt = hashed.join(large, ["t", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o")).drop("o", "blocks")
    asked = cut(dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInPandas(_asked(bits, tables, most), dealt.schema), "asked")
    drop_cut(hashed)
    full = asked.join(classes.select("rep", "n", "v"), "rep")
    found = cut(
        full.repartition(*KEY).sortWithinPartitions(*KEY).mapInPandas(_compared(cosine, bits, tables, most), "rep long, links long, root long"),
        "links",
    )
    drop_cut(asked)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    per = (
        classes.select("key", "rep", "n")
        .join(links, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    out = v.where("good").select("vec_id", "key").join(per, "key").select("vec_id", "n_links", "component_id")
    alone = v.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_hyperplane_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whatever their labels."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: Brute force in SQL. DuckDB compares all pairs, which is right for the small tables it is run on.
OP9_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= {COSINE}
), reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.a = vec_id
"""
