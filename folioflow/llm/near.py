"""Near-duplicate documents: BagMinHash signatures, bands, exact multiset overlap, connected components.

1. Every whole text becomes its multiset of five-word shingles and a signature. Texts with equal multisets are one
   class, and only one of each class goes on.
2. Classes whose signatures agree in a band share a bucket. Each bucket's members are verified against two pivots by
   the overlap of their multisets; links of 0.8 or more give components.
3. In buckets that still hold several components, all pairs across components are compared, in blocks: first by their
   signatures (``LEAST`` registers in common, which a pair at 0.8 misses with a probability of 2e-7), then by the
   overlap. A pair that shares an earlier band is looked at there. Pairs that are connected already need no look,
   so what leaves a block is a forest.

No bucket, partner or candidate is capped. Defined results: texts without words, null texts among them, are groups of
their own; texts of one to four words are one shingle; rows that agree in doc_id and text are in one class like any
copies; the document that stays is the one with the smallest doc_id of its group; other columns pass through; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bagminhash as bag
from folioflow.llm.common import cut, free, read, text_of
from folioflow.llm.components import components, runs

SIMILAR = 0.8
LEAST = 74
BLOCK = 400
#: Buckets that need blocks are broadcast up to so many by count; more are joined by shuffle.
BROADCAST_BUCKETS = 50_000
#: Characters of text that are looked at together.
BLOCK_CHARS = 2_000_000


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Spans of rows whose sizes add up to about ``most``."""
    at = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def _signed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for x, y in _spans(b["text"].str.len().to_numpy(), BLOCK_CHARS):
            own = b.iloc[x:y]
            parts = bag.shingles(own["text"].tolist())
            sig = bag.signatures(parts)
            keys, short = bag.band_keys(sig), bag.short(sig)
            full = [len(p) > 0 for p in parts]
            yield pd.DataFrame(
                {
                    "doc_id": own["doc_id"], "text_key": own["text_key"],
                    "ck": [xxhash.xxh3_128_digest(p.tobytes()) if len(p) else None for p in parts],
                    "keys": [k.tolist() if f else None for k, f in zip(keys, full, strict=True)],
                    "short": [s.tobytes() if f else None for s, f in zip(short, full, strict=True)],
                }
            )
    bag.forget()


class _Bags:
    """Shingles of texts by class key, the latest ones kept."""

    def __init__(self) -> None:
        self.kept: dict[bytes, np.ndarray] = {}

    def __call__(self, key: bytes, text: str) -> np.ndarray:
        key = bytes(key)
        if key not in self.kept:
            if len(self.kept) >= 64:
                self.kept.pop(next(iter(self.kept)))
            self.kept[key] = bag.shingles([text])[0]
        return self.kept[key]


def _verified(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bags = _Bags()
    for b in batches:
        own = zip(b["u"], b["v"], b["text_u"], b["text_v"], strict=True)
        yield b.loc[[bag.overlap(bags(v, y), bags(u, x)) >= SIMILAR for u, v, x, y in own], ["u", "v"]]
    bag.forget()


def _candidates(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block, or of two blocks, across components, that aren't met in an earlier band."""
    short = np.frombuffer(b"".join(g["short"]), np.uint16).reshape(len(g), -1)
    keys = np.array(g["keys"].tolist(), dtype=np.int64)
    root = pd.factorize(g["root"])[0]
    i, j, band = (int(g[k].iloc[0]) for k in ("i", "j", "band"))
    c = g["c"].to_numpy()
    left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
    found = []
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        a, b = np.nonzero(root[rows][:, None] != root[right][None, :])
        a, b = rows[a], right[b]
        a, b = (a[a < b], b[a < b]) if i == j else (a, b)
        like = np.zeros(len(a), bool)
        for k in range(0, len(a), 20_000):
            s = slice(k, k + 20_000)
            like[s] = (short[a[s]] == short[b[s]]).sum(axis=1) >= LEAST
            if band:
                like[s] &= ~(keys[a[s], :band] == keys[b[s], :band]).any(axis=1)
        found.append((a[like], b[like]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def _asked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of blocks that have a candidate pair."""
    for g in runs(batches, ["band", "key", "i", "j"]):
        if len(g) > 1:
            some = np.unique(np.concatenate(_candidates(g)))
            if len(some):
                yield g.iloc[some][["band", "key", "i", "j", "c", "ck", "root", "keys", "short"]]


def _linked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A forest of the links between components in each block."""
    for g in runs(batches, ["band", "key", "i", "j"]):
        a, b = _candidates(g)
        parts, root = bag.shingles(g["text"].tolist()), pd.factorize(g["root"])[0]
        up = list(range(int(root.max()) + 1))

        def top(x: int, up: list[int] = up) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = top(int(root[x])), top(int(root[y]))
            if p != q and bag.overlap(parts[x], parts[y]) >= SIMILAR:
                up[max(p, q)] = min(p, q)
                out.append((g["ck"].iloc[x], g["ck"].iloc[y]))
        if out:
            yield pd.DataFrame(out, columns=["u", "v"])
    bag.forget()


def near_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, group_id (smallest doc_id of the group) and kept, a row for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = docs.mapInPandas(_signed, "doc_id long, text_key long, ck binary, keys array<long>, short binary")
    signed = cut(signed, "signed")
    own = signed.where("ck is not null")
    classes = own.groupBy("ck").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("keys").alias("keys"), F.first("short").alias("short"))
    classes = cut(classes, "classes")
    members = classes.select("ck", F.posexplode("keys").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("ck").alias("p"), F.min(F.struct(F.xxhash64("ck").alias("h"), "ck")).alias("q")
    )
    buckets = buckets.where("n > 1").select("band", "key", F.array_distinct(F.array("p", "q.ck")).alias("pivots"))
    members = cut(members.join(buckets, ["band", "key"]), "members")
    pairs = members.select("ck", F.explode("pivots").alias("p")).where(F.col("ck") != F.col("p"))
    pairs = pairs.select(F.least("ck", "p").alias("u"), F.greatest("ck", "p").alias("v")).distinct()

    def texts(asked: DataFrame) -> DataFrame:
        """ck and text of the classes in ``asked``, from one document of each."""
        reps = asked.distinct().join(classes.select("ck", "rep"), "ck")
        found = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_key") == F.col("rep.text_key")))
        return cut(found.select("ck", "text").dropDuplicates(["ck"]), "texts")

    pairs = cut(pairs, "pairs")
    t = texts(pairs.select(F.col("u").alias("ck")).unionByName(pairs.select(F.col("v").alias("ck"))))
    both = pairs.join(t.select(F.col("ck").alias("u"), F.col("text").alias("text_u")), "u")
    both = both.join(t.select(F.col("ck").alias("v"), F.col("text").alias("text_v")), "v")
    links = cut(both.select("u", "v", "text_u", "text_v").mapInPandas(_verified, "u binary, v binary"), "links")
    roots = components(links)

    # Buckets that still hold several components.
    labelled = members.drop("pivots").join(roots.withColumnRenamed("node", "ck"), "ck", "left").withColumn("root", F.coalesce("root", "ck"))
    labelled = cut(labelled, "labelled")
    open_ = labelled.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
    open_ = cut(open_.where("a <> b").select("band", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    open_ = F.broadcast(open_) if open_.count() <= BROADCAST_BUCKETS else open_
    dealt = labelled.join(open_, ["band", "key"]).withColumn("c", F.pmod(F.xxhash64("ck"), F.col("blocks")).cast("int"))
    dealt = dealt.join(classes.select("ck", "keys", "short"), "ck")
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o"))
    order = ["band", "key", "i", "j"]
    dealt = dealt.select(*order, "c", "ck", "root", "keys", "short")
    asked = dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(_asked, dealt.schema)
    asked = cut(asked, "asked")
    more = asked.join(texts(asked.select("ck")), "ck").repartition(*order).sortWithinPartitions(*order)
    more = cut(more.mapInPandas(_linked, "u binary, v binary"), "more")
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    groups = classes.select("ck", "rep").join(roots.withColumnRenamed("node", "ck"), "ck", "left").withColumn("root", F.coalesce("root", "ck"))
    first = groups.groupBy("root").agg(F.min("rep").alias("first"))
    groups = groups.join(first, "root").select("ck", "first")
    out = signed.select("doc_id", "text_key", "ck").join(groups, "ck", "left")
    mine = F.struct("doc_id", "text_key")
    return out.select(
        "doc_id", "text_key", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("group_id"),
        F.when(F.col("first").isNull(), F.lit(True)).otherwise(F.col("first").eqNullSafe(mine)).alias("kept"),
    )


def op8_bagminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_documents(read(spark, sf_dir, "documents")).select("doc_id", "group_id", "kept")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, and every document without words."""
    d, k, n = free(docs, "_d", "_k", "_n")
    found = near_documents(docs).where("kept").groupBy(F.col("doc_id").alias(d), F.col("text_key").alias(k))
    found = cut(found.agg(F.count(F.lit(1)).alias(n)), "kept")
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(text_of()) == F.col(k))
    stay = docs.join(found, same)
    words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    once = stay.where((F.col(n) == 1) | ~F.coalesce(words, F.lit(False)))
    again = stay.where((F.col(n) > 1) & F.coalesce(words, F.lit(False))).dropDuplicates([d, k])
    return once.unionByName(again).select(*docs.columns)
