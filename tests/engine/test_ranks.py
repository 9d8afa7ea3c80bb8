from pyspark.sql import functions as F

from folioflow.operators.ranks import numbered, running


def test_numbers_and_sums_over_ranges(spark):
    rows = [(i * 7 % 1000, f"s{i % 13}", float(i % 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, _range string, v double").repartition(6)
    got = sorted(tuple(r) for r in running(df, [F.col("k")], {"n": F.lit(1).cast("long"), "before": F.col("v")}).collect())
    total = 0.0
    for i, (r, (k, name, v, n, before)) in enumerate(zip(sorted(rows), got, strict=True)):
        assert (k, name, v) == r and n == i and before == total
        total += v


def test_nulls_come_last_and_no_rows_give_none(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "s string")
    got = {r["s"]: r["n"] for r in numbered(df, [F.col("s").asc_nulls_last()], "n").collect()}
    assert got == {"a": 0, "b": 1, None: 2}
    assert numbered(df.limit(0), [F.col("s")], "n").count() == 0
