"""noticelab run --blocks B --golden G --out O --as-of DATE [--docs FOLDER] ..."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabulary
from .operators import triage
from .plans import engine
from .sources import files, staging


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="noticelab")
    run = top.add_subparsers(dest="command", required=True).add_parser("run", help="triage a batch of read notices")
    run.add_argument("--blocks", required=True, help="JSON lines of blocks")
    run.add_argument("--golden", required=True, help="reference base, CSV")
    run.add_argument("--out", required=True)
    run.add_argument("--as-of", required=True, help="yyyy-mm-dd")
    run.add_argument("--docs", help="folder of the PDF files that were to be read, named by document; those without blocks have failed")
    run.add_argument("--votes", help="Parquet of what other classifiers said")
    run.add_argument("--candidates", help="Parquet of what other extractors said")
    run.add_argument("--returned", help="Parquet of what a sweep for missing fields brought back")
    run.add_argument("--offline", action="store_true", help="leave out what models said")
    run.add_argument("--config", help="YAML or JSON of contracts: event type -> required and optional fields")
    run.add_argument("--window-days", type=int, default=2 * 365, help="how far from --as-of a date may be")
    run.add_argument("--workers", type=int, help="threads of a local session")
    run.add_argument("--by-document", action="store_true", help="a folder for each record")
    run.add_argument("--trace", action="store_true", help="write the plans of the results beside them")
    return top


def contracts(spark: SparkSession, path: str | None) -> DataFrame:
    """The vocabulary's contracts, or those of a file."""
    if not path:
        return vocabulary.field_specs(spark)
    told = files.vocabulary(path)
    rows = [
        (t, f, k == 0, i) for t, x in told.items() for k, side in enumerate(("required", "optional")) for i, f in enumerate(x.get(side, []))
    ]
    return spark.createDataFrame(rows, "event_type string, field string, required boolean, ordinal int")


def main(argv: list[str] | None = None) -> int:
    args, began = parser().parse_args(argv), time.time()
    builder = SparkSession.builder.appName("noticelab")
    spark = (builder.master(f"local[{args.workers}]") if args.workers else builder).getOrCreate()
    asked = None
    if args.docs:
        asked = files.notice_files(spark, args.docs).select(F.col("stem").try_cast("long").alias("doc_id")).where("doc_id is not null")
        if not asked.take(1):
            return 1
    blocks = files.blocks(spark, args.blocks)
    if asked is None and not blocks.take(1):
        return 1
    read = lambda path: spark.read.parquet(path) if path and not args.offline else None
    config, before = engine.Config(args.as_of, args.window_days), len(staging.MADE)
    said = read(args.votes), read(args.candidates), asked, read(args.returned)
    result = engine.run(blocks, files.golden(spark, args.golden), contracts(spark, args.config), config, *said)
    records = files.records(result.notices, result.fields, result.findings, result.reasons, result.verdicts)
    files.write_records(records, f"{args.out}/records", args.by_document)
    lines = triage.per_document(result.verdicts, result.reasons)
    files.write_summary(triage.summary(result.verdicts), f"{args.out}/summary", lines, time.time() - began, {"as_of": args.as_of})
    if "://" not in args.out:
        Path(args.out, "exceptions.md").write_text(files.exceptions_report(result.verdicts, result.reasons), encoding="utf-8")
        if args.trace:
            plans = [f"== {name}\n{getattr(result, name)._jdf.queryExecution().toString()}" for name in ("fields", "reasons", "verdicts")]
            Path(args.out, "trace.txt").write_text("\n".join(plans), encoding="utf-8")
    staging.release(spark, before)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
