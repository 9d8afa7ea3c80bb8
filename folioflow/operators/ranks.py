"""Numbers and sums along one order of all rows, without a task that sees them all.

Rows are dealt by ranges of the order and written. The ranges' sums go to the driver, one row a range, and come back as what
stands before each; inside a range it is a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.shared import cut, free


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, under each name, the sum over all rows before a row. The order has to tell all rows apart."""
    part, start, *own = free(df, "_range", "_start", *[f"_{n}" for n in sums])
    dealt = df.select("*", *[c.alias(o) for o, c in zip(own, sums.values(), strict=True)])
    dealt = cut(dealt.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sums_of = [F.sum(o).alias(n) for n, o in zip(sums, own, strict=True)]
    kinds = dealt.agg(*sums_of).dtypes
    per = sorted(dealt.groupBy(part).agg(*sums_of).collect(), key=lambda r: r[part])
    before, rows = [0.0 if kind in ("double", "float") else 0 for _, kind in kinds], []
    for r in per:
        rows.append((r[part], tuple(before)))
        before = [b + (r[n] or 0) for b, n in zip(before, sums, strict=True)]
    kinds = ", ".join(f"{n}: {kind}" for n, kind in kinds)
    offsets = df.sparkSession.createDataFrame(rows, f"{part} int, {start} struct<{kinds}>")
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), part)  # a row a range
    return out.select(*df.columns, *[(F.coalesce(F.sum(o).over(w), F.lit(0)) + F.col(f"{start}.{n}")).alias(n) for n, o in zip(sums, own, strict=True)])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's number along the order, from 0 on."""
    return running(df, order, {name: F.lit(1).cast("long")})
