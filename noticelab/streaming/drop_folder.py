"""Notices that arrive as files, triaged as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import triage, validators


def triage_stream(
    spark: SparkSession,
    folder: str,
    schema,
    golden: DataFrame,
    specs: DataFrame,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    window: Callable[[], dict] = dict,
) -> StreamingQuery:
    """Watch a folder of Parquet notices; each batch's verdicts are appended to
    `out`.  Documents are independent, so a batch is triaged by the same plan as
    a table; a batch that is run again replaces its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        findings = validators.run_all(rows, golden, specs, **window())
        triage.disposition(triage.reasons_of(findings), rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).parquet(folder)
    return (
        source.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
