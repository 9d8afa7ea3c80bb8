"""Removal of repeated byte strings across documents by sharded suffix arrays.

A string of ``LENGTH`` bytes that starts in two places is removed in both. Suffixes are compared in shards, and equal
strings must meet in one:

1. Every start of a ``LENGTH``-byte string has an anchor, the string's least ``GRAM``-byte piece by hash, leftmost
   first. The anchor depends on the string alone, so equal strings have equal anchors at the same place. A run of
   starts with one anchor is a segment. Only hashes of anchors and segments are shuffled.
2. An anchor that occurs once can't be in a repeated string, and its segments are done. Equal segments are counted by
   aggregation and go on as one. What is left are anchors with several different segments. A string reaches ``reach()`` bytes
   beyond its anchor on one side at least, so a segment that shares neither the bytes before nor those behind its anchor
   with another one of the anchor is done, too.
3. These segments' bytes are dealt to shards by anchor, and each shard is one suffix array, induced linearly, with
   permuted common prefixes; a start with a neighbour that agrees in ``LENGTH`` bytes is repeated. Segments are separated
   by the byte 0xFF, which UTF-8 has nowhere, so no match runs from one segment into the next.
4. A hot anchor, one with over ``CHUNK`` segments, is split by content first: its segments are cut into cells of ``CELL``
   starts by distance from the anchor, and a cell's anchor is what all its strings have in common, over ``LENGTH - CELL``
   bytes. Cells are counted like segments; few go to a shard. Where a cell's anchor is still hot, its cells are dealt to
   chunks of about ``CHUNK``, each in a shard; a chunk's strings that are still single, and one of each repeated
   one, are then compared across chunks by a 64-bit hash.

Equal hashes stand for equal bytes: of pieces of 32 bytes, of segments, which are 768 bytes at most (369 starts of 400 bytes), and of strings of 400.
Sums of powers modulo 2^64 are known to collide on certain strings of two letters from 1024 bytes on, whatever the powers; nothing
here is that long. For other texts the probability of a collision is that of 64 random bits.

Defined results: null text counts as empty; repeated rows are documents of their own and so remove each other if long
enough; texts under ``LENGTH`` bytes stay; hashes of 64 bits under an equal 64-bit anchor stand for segments; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.bagminhash import mix
from folioflow.llm.common import cut, drop_cut, read, text_of
from folioflow.llm.components import runs
from folioflow.llm.suffixes import permuted_lcp, suffix_array

LENGTH, GRAM = 400, 32


def reach() -> int:
    """A string has so many bytes on one side of its anchor at least."""
    return (LENGTH - GRAM) // 2


#: Segments of one anchor in a chunk, starts in a cell, bytes in a shard, bytes of text that are hashed at once.
CHUNK, CELL, SHARD_BYTES, BLOCK = 800, 16, 1_000_000, 1 << 22
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
TABLE = np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)


class _Powers:
    """Powers of a 64-bit number, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            p = np.full(max(n, 2 * len(self.known)), self.base, np.uint64)
            p[0] = 1
            self.known = np.multiply.accumulate(p)
        return self.known[:n]


_up, _down = _Powers(MULTIPLIER), _Powers(INVERSE)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers, modulo 2^64: n + 1 of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * _up(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, whatever their place."""
    return mix((prefix[end] - prefix[start]) * _down(len(prefix))[start])


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima over blocks from both sides."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, end (of the starts), where the anchor is, anchor, hash, and hashes of the bytes before and behind the anchor (0: there aren't
    enough) of each segment of a document."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        part = data[at : at + BLOCK + LENGTH - 1]
        prefix = prefix_hashes(part)
        n = len(part) - GRAM + 1
        place = np.arange(n, dtype=np.uint64)
        grams = mix((prefix[GRAM:] - prefix[:n]) * _down(n))
        anchor = _sliding_least((grams >> np.uint64(24) << np.uint64(24)) | place, LENGTH - GRAM + 1) & np.uint64(0xFFFFFF)
        anchor = anchor.astype(np.int64)
        start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        end = np.append(start[1:], len(anchor))
        own = anchor[start]
        key = mix(span_hashes(prefix, start, end + LENGTH - 1) + mix((own - start).astype(np.uint64) << np.uint64(32) | (end - start).astype(np.uint64)))
        near, size = reach(), len(part)
        before = np.where(own >= near, span_hashes(prefix, np.maximum(own - near, 0), own) | np.uint64(1), np.uint64(0))
        last = np.minimum(own + GRAM + near, size)
        behind = np.where(own + GRAM + near <= size, span_hashes(prefix, own + GRAM, last) | np.uint64(1), np.uint64(0))
        sides = [(x >> np.uint64(32)).astype(np.uint32).view(np.int32) | (x > 0) for x in (before, behind)]
        out.append((start + at, end + at, own - start, grams[own].view(np.int64), key.view(np.int64), *sides))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _occurring(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of all texts: doc_id, text_key, s, e, at, anchor, seg, before, behind."""
    names = ("s", "e", "at", "anchor", "seg", "before", "behind")
    kinds = (np.int32, np.int32, np.int32, np.int64, np.int64, np.int32, np.int32)
    for b in batches:
        docs, keys, found, n = b["doc_id"].astype("Int64"), b["text_key"].to_numpy(), [], 0

        def frame(docs: pd.Series = docs, keys: np.ndarray = keys) -> pd.DataFrame:
            row = np.repeat([i for i, _ in found], [len(f[0]) for _, f in found])
            columns = {c: np.concatenate([f[k] for _, f in found]).astype(t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))}
            return pd.DataFrame({"doc_id": docs.take(row).to_numpy(), "text_key": keys[row], **columns})

        for i, text in enumerate(b["text"]):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            if len(data) >= LENGTH:
                found.append((i, segments(data)))
                n += len(found[-1][1][0])
                if n >= 100_000:
                    yield frame()
                    found, n = [], 0
        if found:
            yield frame()


def _gathered(make, most: int = 100_000):
    """Joins the small frames that ``make`` yields."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in make(batches):
            held.append(f)
            n += len(f)
            if n >= most:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return run


def _pieces(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the segments that are asked for."""
    for b in batches:
        rows = []
        for text, asked in zip(b["text"], b["asked"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            rows += [(a["anchor"], a["seg"], a["chunk"], a["chunks"], a["e"] - a["s"], data[a["s"] : a["e"] + LENGTH - 1]) for a in asked]
        yield pd.DataFrame(rows, columns=["anchor", "seg", "chunk", "chunks", "starts", "bytes"])


def cells(data: np.ndarray, starts: int, at: int) -> Iterator[tuple[int, int, int, int]]:
    """First and last start, anchor and hash of each cell of a segment whose anchor is ``at`` bytes in."""
    prefix = prefix_hashes(data)
    c = np.arange(max(0, (at - starts + 1) // CELL), at // CELL + 1)
    a, b = np.maximum(at - c * CELL - CELL + 1, 0), np.minimum(at - c * CELL, starts - 1)
    core = at - c * CELL
    anchor = mix(span_hashes(prefix, core, core - CELL + 1 + LENGTH) + mix(c.astype(np.uint64)))
    key = mix(span_hashes(prefix, a, b + LENGTH) + mix((at - a).astype(np.uint64) << np.uint64(32) | (b - a).astype(np.uint64)))
    yield from zip(a.tolist(), (b + 1).tolist(), anchor.view(np.int64).tolist(), key.view(np.int64).tolist(), strict=True)


def _celled(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text, asked in zip(b["text"], b["asked"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for x in asked:
                part = data[x["s"] : x["e"] + LENGTH - 1]
                for first, last, anchor, key in cells(np.frombuffer(part, np.uint8), x["e"] - x["s"], x["at"]):
                    anchor = int(mix(np.array([(anchor ^ x["anchor"]) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])
                    rows.append((x["anchor"], x["seg"], first, last, anchor, key, last - first, part[first : last + LENGTH - 1]))
        yield pd.DataFrame(rows, columns=["anchor", "seg", "a", "b", "cell", "key", "starts", "bytes"])


def shard_repeats(pieces: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's segments: for every start its piece, its offset, whether its string is repeated, and whether it stands
    first among its like in the suffix array."""
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa)
    like = lcp[sa] >= LENGTH  # agrees with the one before
    after = np.append(like[1:], False)
    repeated, leads = np.zeros(len(text), bool), np.zeros(len(text), bool)
    repeated[sa] = like | after
    leads[sa] = ~like
    sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), starts)
    offset = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    at = first[piece] + offset
    return piece, offset, repeated[at], leads[at]


def _sorted_shards(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind 0: runs of repeated starts. kind 1: strings to compare across chunks, ``b`` 1 if single in its chunk."""
    for g in runs(batches, ["shard"]):
        g = g.drop_duplicates(["anchor", "seg"]).reset_index(drop=True)
        pieces, starts = [bytes(x) for x in g["bytes"]], g["starts"].to_numpy(np.int64)
        piece, offset, repeated, leads = shard_repeats(pieces, starts)
        anchor, seg, chunks = g["anchor"].to_numpy(), g["seg"].to_numpy(), g["chunks"].to_numpy()
        on = np.flatnonzero(repeated)
        if len(on):
            new = np.append(True, (np.diff(on) != 1) | (piece[on][1:] != piece[on][:-1]))
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(on)) - 1
            p = piece[on[a]]
            yield pd.DataFrame({"kind": 0, "anchor": anchor[p], "seg": seg[p], "a": offset[on[a]], "b": offset[on[z]] + 1, "h": 0})
        some = np.flatnonzero((chunks[piece] > 1) & leads)
        if len(some):
            text = np.frombuffer(b"".join(pieces), np.uint8)
            sizes = np.array([len(x) for x in pieces], dtype=np.int64)
            at = (np.cumsum(sizes) - sizes)[piece[some]] + offset[some]
            h = span_hashes(prefix_hashes(text), at, at + LENGTH).view(np.int64)
            p = piece[some]
            yield pd.DataFrame({"kind": 1, "anchor": anchor[p], "seg": seg[p], "a": offset[some], "b": (~repeated[some]).astype(np.int64), "h": h})


def _kept(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text, spans in zip(b["text"], b["spans"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            left, at, n = [], 0, 0
            if spans is not None:
                order = sorted((x["a"], x["b"]) for x in spans)
                end = -1
                for s, e in order:
                    if s > end:
                        if end >= 0:
                            n += 1
                            at = end
                        left.append(data[at:s])
                        end = e
                    else:
                        end = max(end, e)
                n, at = n + 1, end
            left.append(data[at:])
            kept = b"".join(left)
            rows.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        out.insert(0, "doc_id", b["doc_id"].to_numpy())
        yield out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """_doc, _key and ``spans`` (array of struct a, b: byte ranges, may overlap) of the documents that have any.

    ``docs`` has doc_id, text_key and text.
    """
    occ = docs.mapInPandas(_occurring, "doc_id long, text_key long, s int, e int, at int, anchor long, seg long, before int, behind int")
    occ = cut(occ, "occurrences")
    counts = occ.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("segs")).where("n > 1")
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot anchor's rows.
    counts = cut(counts.select("anchor", "segs"), "counts")
    live = cut(occ.join(counts, "anchor"), "live")
    drop_cut(occ)
    segs = live.groupBy("anchor", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.first("segs").alias("segs"), F.first("before").alias("before"), F.first("behind").alias("behind"), F.min(F.struct("doc_id", "text_key", "s", "e", "at")).alias("rep")
    )
    segs = cut(segs, "segments")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("x")), F.struct(F.lit(1).alias("side"), F.col("behind").alias("x")))
    around = segs.where("segs > 1").select("anchor", "seg", F.explode(sides).alias("y")).select("anchor", "seg", "y.side", "y.x").where("x <> 0")
    shared = around.groupBy("anchor", "side", "x").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    open_ = cut(segs.join(around.join(shared, ["anchor", "side", "x"]).select("anchor", "seg").distinct(), ["anchor", "seg"]), "open")
    many = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("segs"))
    open_ = cut(open_.drop("segs").join(many, "anchor"), "open")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))

    def with_text(asked: DataFrame, *more: str) -> DataFrame:
        """Texts of the segments' documents, each with what is asked of it."""
        parts = asked.groupBy(F.col("rep.doc_id").alias("_doc"), F.col("rep.text_key").alias("_key")).agg(
            F.collect_list(F.struct("anchor", "seg", "rep.s", "rep.e", *more)).alias("asked")
        )
        return docs.join(parts, same).select("text", "asked")

    def chunked(df: DataFrame) -> DataFrame:
        out = df.withColumn("chunks", F.ceil(F.col("segs") / CHUNK).cast("int"))
        return out.withColumn("chunk", F.pmod(F.xxhash64("seg"), F.col("chunks")).cast("int"))

    plain = chunked(open_.where(F.col("segs") <= CHUNK))
    pieces = with_text(plain, "chunk", "chunks").mapInPandas(
        _gathered(_pieces, 5_000), "anchor long, seg long, chunk int, chunks int, starts int, bytes binary"
    )
    size = plain.agg(F.sum(F.col("rep.e") - F.col("rep.s") + LENGTH)).first()[0] or 0
    celled = with_text(open_.where(F.col("segs") > CHUNK), "rep.at").mapInPandas(
        _celled, "anchor long, seg long, a long, b long, cell long, key long, starts int, bytes binary"
    )
    celled = cut(celled.dropDuplicates(["anchor", "seg", "a"]), "cells")
    like = celled.groupBy("cell", "key").agg(F.count(F.lit(1)).alias("n"), F.first("starts").alias("starts"), F.first("bytes").alias("bytes"))
    like = cut(like.join(like.groupBy("cell").agg(F.count(F.lit(1)).alias("segs"), F.sum("n").alias("all")).where(F.col("all") > 1), "cell"), "like")
    hot = chunked(like.where("segs > 1").withColumnsRenamed({"cell": "anchor", "key": "seg"}))
    pieces = pieces.unionByName(hot.select("anchor", "seg", "chunk", "chunks", "starts", "bytes"))
    size += hot.agg(F.sum(F.col("starts") + LENGTH)).first()[0] or 0
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("anchor", "chunk"), F.lit(max(1, size // SHARD_BYTES))))
    found = pieces.repartition("shard").sortWithinPartitions("shard").mapInPandas(
        _sorted_shards, "kind int, anchor long, seg long, a long, b long, h long"
    )
    found = cut(found, "found")
    inside = found.where("kind = 0").select("anchor", "seg", "a", "b")
    across = found.where("kind = 1")
    twice = across.groupBy("anchor", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "h")
    across = across.where("b = 1").join(twice, ["anchor", "h"]).select("anchor", "seg", "a", (F.col("a") + 1).alias("b"))
    inside = inside.unionByName(across)
    # What was found in cells, or holds for whole cells, said of their segments.
    of_cells = like.where("n > 1").select("cell", "key", F.lit(0).cast("long").alias("x"), F.col("starts").cast("long").alias("y")).unionByName(
        inside.select(F.col("anchor").alias("cell"), F.col("seg").alias("key"), F.col("a").alias("x"), F.col("b").alias("y"))
    )
    celled = celled.select("anchor", "seg", "a", "cell", "key").join(of_cells, ["cell", "key"])
    inside = inside.unionByName(celled.select("anchor", "seg", (F.col("a") + F.col("x")).alias("a"), (F.col("a") + F.col("y")).alias("b")))
    whole = segs.where("n > 1").select("anchor", "seg", F.lit(0).cast("long").alias("a"), (F.col("rep.e") - F.col("rep.s")).cast("long").alias("b"))
    ranges = whole.unionByName(inside)
    ranges = cut(ranges.groupBy("anchor", "seg").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")
    spans = live.join(ranges, ["anchor", "seg"]).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"),
        F.transform("ranges", lambda r: F.struct((F.col("s") + r["a"]).alias("a"), (F.col("s") + r["b"] + LENGTH - 1).alias("b"))).alias("r"),
    )
    return spans.groupBy("_doc", "_key").agg(F.flatten(F.collect_set("r")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (what is left, broken characters replaced) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    return docs.join(repeated_spans(docs), same, "left").select("doc_id", "text", "spans").mapInPandas(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated byte strings."""
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")
