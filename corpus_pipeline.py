"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last return the
columns of ``documents``. Between stages the table is written as Parquet and read again, so that a lost executor costs
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.bpe import encode_stage
from folioflow.llm.common import cut, read
from folioflow.llm.lines import drop_boilerplate
from folioflow.llm.mixing import keep_mix
from folioflow.llm.near import keep_one
from folioflow.llm.quality import keep_quality

STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_boilerplate),
    ("near duplicates", keep_one),
    ("source mix", keep_mix),
    ("encoding", encode_stage),
]

#: SQL can't express the signatures, the pivotal draws and the tokenizer; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents: doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document taken."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
