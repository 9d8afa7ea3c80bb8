"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: While a table is written: shuffle files go as soon as it is there, and Python workers get rows in batches of so many bytes at most.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset in local mode, as in tests, a folder of our own is used; on a cluster it has to be set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        conf = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="folioflow-")
        shared_dir.own = conf
    return conf.rstrip("/")


def cut(df: DataFrame, label: str, *by: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by the columns ``by``, and return the written table.

    Python workers get ``batch`` bytes at once, or what ``WHILE_WRITING`` says.

    Lineage ends there: a lost executor costs no recomputation of what stands before, and a plan that reads the
    result several times runs the steps before only once. The shuffle files of the run go as it ends, the table's files when the
    driver's JVM ends, or earlier by ``drop_cut``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioflow/{label}-{uuid.uuid4().hex}"
    now = WHILE_WRITING | ({"spark.sql.execution.arrow.maxBytesPerBatch": str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    paths = {p.rsplit("/", 1)[0] for p in df.inputFiles()}
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each under as many underscores as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: Bytes of input that a Python function over documents makes objects of at once.
SLICE = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], *columns: str, most: int = SLICE) -> Iterator[list[list]]:
    """Columns of Arrow batches as lists, a few rows at once: as many as have ``most`` bytes on average, one at least.

    A batch may have many MB; as Python objects it would have several times that, in every worker.
    """
    for b in batches:
        step = max(1, b.num_rows * most // max(b.nbytes, 1))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            yield [part.column(c).to_pylist() for c in columns]


def arrow_schema(kind: str) -> pa.Schema:
    """A row type in Spark's words as Arrow's; on the driver only."""
    return to_arrow_schema(T._parse_datatype_string(kind))


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
