"""Connected components by alternating large-star and small-star steps, and runs of equal keys in sorted batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of ``edges`` (u, v: long) but the roots.

    Large-star links each node's larger neighbours to its smallest one; small-star links its smaller neighbours and
    itself to the smallest. Both keep the components and end in stars. Minima are combined before the shuffle, and
    joins by a hot centre are inner or left joins, which Spark splits when they are skewed. Every round is written out.
    """
    now = cut(_down(edges), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _down(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(_down(small), "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.min("v")).first()
        if state == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, before = after, state


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' component, for edges between a and b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key together, from batches that are sorted by the keys. One key's rows are held at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys]
        new = np.flatnonzero((k.to_numpy()[1:] != k.to_numpy()[:-1]).any(axis=1)) + 1
        cuts = [0, *new.tolist(), len(b)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.iloc[s:e]
            if held and (held[-1][keys].iloc[0].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
