"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet to the folder all executors share and read again as the next one's
documents; what a stage decides takes effect for all that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticelab.llm import _shared, decontaminate, mixing, neardup, token_ids, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token_ids", token_ids.stage),
]

#: A learned stage is not expressible; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with _shared.swept(spark):  # what a stage writes for itself goes with it
            path = _shared.new_path(spark, name)
            result = stage(spark, docs, sf_dir)
            result.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
