"""Sources and sinks of the notice engine."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = (
    "doc_id bigint, page int, reader string, kind string, block_order int, text string, "
    "x0 double, y0 double, x1 double, y1 double, role string, row int, col int, level string, pending boolean"
)


def notice_files(spark: SparkSession, folder: str) -> DataFrame:
    """The PDF files of a folder, by path: path, stem, size and content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("stem"), "length", "content").orderBy("path")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """What readers have read, as JSON lines of the blocks' schema."""
    return spark.read.schema(BLOCKS).json(path)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """The reference base: a CSV of strings, perhaps with a byte order mark, in its file's order."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    order = Window.orderBy(F.col("_id"))
    # a reference base is one small file, so one task numbers it
    return rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("row_idx", F.row_number().over(order) - 1).drop("_id")


def vocabulary(path: str) -> dict:
    """A vocabulary in YAML, or in JSON where no YAML reader is installed."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(raw)
    import yaml

    return yaml.safe_load(raw)


def to_top_left(y: Column, height: Column, origin: Column) -> Column:
    """A coordinate measured from the page's top, whatever its origin."""
    return F.when(F.upper(origin) == "BOTTOMLEFT", height - y).otherwise(y)


def clip(blocks_: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Blocks that meet a rectangle."""
    return blocks_.where((F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0))


def table_cells(tables: DataFrame) -> DataFrame:
    """One block per non-empty cell of tables (doc_id, page, grid: rows of cells
    (text, box), box); a cell without a box has its table's, and is pending."""
    rows = tables.select("doc_id", "page", "box", F.posexplode("grid").alias("row", "cells"))
    cells = rows.select(
        "doc_id",
        "page",
        "row",
        F.col("box").alias("_table"),
        F.posexplode("cells").alias("col", "cell"),
    ).where(F.trim("cell.text") != "")
    return cells.select(
        "doc_id",
        "page",
        "row",
        "col",
        F.col("cell.text").alias("text"),
        F.coalesce("cell.box", "_table").alias("box"),
        F.col("cell.box").isNull().alias("pending"),
    )


def text_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The texts between a page's tags, in order."""
    parts = F.transform(F.split(html, "<[^>]*>"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " ")))
    return pages.select(key, F.posexplode(F.filter(parts, lambda x: x != "")).alias("block_order", "block"))


def markdown_pairs(docs: DataFrame, column: str = "text") -> DataFrame:
    """Label and value of table rows, of lines with leaders, and of a label whose value is on one of the next two lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(column, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    leader = F.filter(F.transform(F.split("line", r"[.·•…]{3,}"), lambda x: F.trim(x)), lambda x: x != "")
    after = F.coalesce(F.nullif(F.lead("line", 1).over(order), F.lit("")), F.nullif(F.lead("line", 2).over(order), F.lit("")))
    pair = (
        F.when(F.col("line").startswith("|") & (F.size(cells) == 2) & ~F.col("line").rlike(r"^\|[\s:|-]+$"), cells)
        .when(F.size(leader) == 2, leader)
        .when(F.col("line").endswith(":") & after.isNotNull(), F.array(F.regexp_replace("line", ":$", ""), after))
    )
    return (
        lines.withColumn("pair", pair)
        .where("pair is not null")
        .select("doc_id", "line_no", F.col("pair")[0].alias("label"), F.col("pair")[1].alias("value"))
    )


def records(
    notices: DataFrame,
    fields: DataFrame | None,
    findings: DataFrame | None,
    reasons: DataFrame | None,
    verdicts: DataFrame,
) -> DataFrame:
    """One nested record per document: what it says, how each field was read and
    judged, what the validators found, and the verdict with its reasons.  Parts
    that notices (fields) and verdicts (validations, reasons) hold already are not given."""
    gathered = lambda rows, name, *cols: rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    said = [c for c in ("unanimous", "agrees_with_prior", "title_prior", "body_prior") if c in notices.columns]
    said += [] if fields else ["fields"]
    out = notices.select("doc_id", "event_type", *said).join(verdicts, "doc_id", "full_outer")
    kept = ("field", "value", "value_raw", "evidence", "level", "kinds", "grounding", "absence_reason", "candidates", "golden", "cut_by")
    parts = (
        gathered(fields, "fields", *[c for c in kept if c in fields.columns]) if fields else None,
        gathered(findings, "validations", "seq", "tool", "status", "reason_codes") if findings else None,
        gathered(reasons, "reasons", "seq", "code", "field") if reasons else None,
    )
    for part in filter(None, parts):
        out = out.join(part, "doc_id", "left")
    return out


def write_records(rows: DataFrame, path: str, by_document: bool = False) -> None:
    """JSON lines in UTF-8, one record a line; in a folder for each document if asked."""
    lines = rows.select("doc_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if by_document:
        lines.write.mode("overwrite").partitionBy("doc_id").text(path)
    else:
        lines.select("value").write.mode("overwrite").text(path)


def write_summary(
    summary: DataFrame,
    path: str,
    documents: DataFrame | None = None,
    elapsed: float | None = None,
    meta: dict | None = None,
) -> None:
    """The run's figures, one line; its documents' lines beside it."""
    told = summary
    if elapsed is not None:
        told = told.withColumn("elapsed_seconds", F.lit(float(elapsed)))
    if meta:
        told = told.withColumn("meta", F.create_map(*[F.lit(str(x)) for kv in sorted(meta.items()) for x in kv]))
    told.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    if documents is not None:
        documents.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}_documents")


def exceptions_report(verdicts: DataFrame, reasons: DataFrame, limit: int = 1000) -> str:
    """Markdown for readers: an overview and, worst first, the documents that
    are not automatic.  A report is for people, so it lists at most `limit` and
    says how many more there are; the records hold them all."""
    from ..operators import triage

    counts = {r[0]: r[1] for r in verdicts.groupBy("disposition").count().collect()}
    rows = reasons.withColumn("layer", triage.reason_order(F.col("code")))
    why = F.array_sort(F.collect_set(F.struct("layer", F.concat_ws(" ", "code", "field").alias("said"))))
    texts = rows.groupBy("doc_id").agg(F.array_join(F.transform(why, lambda x: x["said"]), "; ").alias("why"))
    open_ = verdicts.where("disposition <> 'auto'").join(texts, "doc_id", "left")
    rows = open_.orderBy(*triage.report_order(open_)).limit(limit).collect()
    total = sum(n for k, n in counts.items() if k != "auto")
    head = ["# Exceptions", "", "| disposition | documents |", "|---|---|", *[f"| {k} | {n} |" for k, n in sorted(counts.items())], ""]
    head += ["| document | disposition | reasons |", "|---|---|---|"]
    lines = [f"| {r['doc_id']} | {r['disposition']} | {r['why'] or ''} |" for r in rows]
    more = [f"\n{total - len(rows)} more are in the records."] if total > len(rows) else []
    return "\n".join(head + lines + more) + "\n"


def cached(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (key, ...) with their cached answers, and those that have none."""
    return asked.join(cache, "key"), asked.join(cache, "key", "left_anti")
