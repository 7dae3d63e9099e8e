"""Consensus over a whole page: what several readers saw, as one list of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources.staging import staged
from . import reading

READERS = ("parser", "ocr", "vlm")
PAGE = ["doc_id", "page"]


def lent(blocks: DataFrame) -> DataFrame:
    """Blocks with borrowed boxes for table cells that had none; what stays pending does not vote."""
    order = F.array_position(F.array(*map(F.lit, READERS)), F.col("reader")).cast("int")
    cells = blocks.where("row is not null and col is not null").withColumn("reader_ord", order)
    found = reading.lend_geometry(cells).where("was_lent").select(*PAGE, "reader", "row", "col", F.col("box").alias("_lent"))
    rows = blocks.join(found, [*PAGE, "reader", "row", "col"], "left")
    side = lambda c: F.coalesce(f"_lent.{c}", c).alias(c)
    keep = [c for c in blocks.columns if c not in ("x0", "y0", "x1", "y1", "pending")]
    return rows.where("not coalesce(pending, false) or _lent is not null").select(*keep, *[side(c) for c in ("x0", "y0", "x1", "y1")])


def visual_rows(blocks: DataFrame) -> DataFrame:
    """Blocks of one height joined: texts from left to right, the box around them, the weakest level."""
    keys = [*PAGE, "reader"]
    if "level" not in blocks.columns:
        blocks = blocks.withColumn("level", F.lit(None).cast("string"))
    # a block's columns go with it through the fold, so that rows need not be joined with blocks again
    placed = reading.cluster_rows(blocks, carried=("kind", "text", "x0", "y0", "x1", "y1", "level"))
    rows = placed.groupBy(*keys, "kind", "row_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "text"))), lambda x: x["text"]), " ").alias("text"),
        reading.weakest(F.col("level")).alias("level"),
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    order = Window.partitionBy(*keys).orderBy("y0", "x0", "row_index")
    return rows.withColumn("block_order", (F.row_number().over(order) - 1).cast("int")).drop("row_index")


def page_consensus(blocks: DataFrame) -> DataFrame:
    """Rows of the reader that saw most, each voted on with what the others saw
    in its place; the winner's original blocks carry the level, the mechanisms,
    the alternatives and the notes.  A block that shares height with two rows
    stands in each.  Rows that only other readers saw stay in their reads alone."""
    usable = staged(lent(blocks), "usable")
    rows = staged(visual_rows(usable), "rows")
    reference = staged(reading.reference_reader(rows, list(READERS)), "reference")
    sides = ("x0", "y0", "x1", "y1")
    rows = rows.withColumn("box", F.struct(*sides))
    own = rows.join(reference, [*PAGE, "reader"]).select(*PAGE, F.col("block_order").alias("region_id"), "reader", "kind", "text", "box")
    match = reading.spatial_match(rows, list(READERS)).join(
        rows.select(*PAGE, "reader", "block_order", "kind", "text", "box"),
        [*PAGE, "reader", "block_order"],
    )
    seen = own.unionByName(match.select(*PAGE, F.col("anchor").alias("region_id"), "reader", "kind", "text", "box"))
    seen = seen.withColumn("seq", F.array_position(F.array(*map(F.lit, READERS)), F.col("reader")))
    # a region is a row of a page
    voted = reading.resolve(staged(seen, "seen").withColumn("doc_id", F.struct("doc_id", "page")))
    kept = ("level", "kinds", "n_eliminated", "alternatives", "notes")
    voted = staged(voted.select("doc_id.doc_id", "doc_id.page", "region_id", "text", "reader", "box", *kept), "voted")
    cells = [c for c in ("role", "row", "col") if c in usable.columns]
    fine = usable.select(*PAGE, "reader", "block_order", F.col("text").alias("_text"), F.struct(*sides).alias("_box"), *cells)
    same = numbers.row_overlap(F.col("box"), F.col("_box")) >= reading.SAME_ROW
    fine = voted.join(fine, [*PAGE, "reader"]).where(same)
    bare = voted.join(fine.select(*PAGE, "region_id").distinct(), [*PAGE, "region_id"], "left_anti")
    columns = lambda df, t, b, order, own: df.select(
        *PAGE,
        "region_id",
        "reader",
        F.col(t).alias("text"),
        *[F.col(f"{b}.{c}").alias(c) for c in sides],
        *kept,
        order.alias("_order"),
        *own,
    )
    missing = [F.lit(None).cast(usable.schema[c].dataType).alias(c) for c in cells]
    both = columns(fine, "_text", "_box", F.col("block_order"), cells).unionByName(columns(bare, "text", "box", F.lit(0), missing))
    order = Window.partitionBy(*PAGE).orderBy("region_id", "_order", "x0", "text")
    return both.withColumn("block_order", (F.row_number().over(order) - 1).cast("int")).drop("_order")


def many_readers(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, n_regions, n_agreed): regions of a page, and those that more than one reader saw."""
    return blocks.groupBy(*PAGE).agg(F.count("*").alias("n_regions"), F.sum((F.size("alternatives") > 0).cast("long")).alias("n_agreed"))


def reader_notes(readers: DataFrame) -> DataFrame:
    """(doc_id, page, notes) from readers (doc_id, page, reader, available, error, n_blocks):
    who could not read, who failed, and who saw nothing, which is no disagreement."""
    note = (
        F.when(~F.col("available"), F.concat("reader", F.lit(" unavailable: no vote")))
        .when(F.col("error").isNotNull(), F.concat("reader", F.lit(" failed: "), "error"))
        .when(F.col("n_blocks") == 0, F.concat("reader", F.lit(" saw nothing: abstains")))
    )
    place = F.array_position(F.array(*map(F.lit, READERS)), F.col("reader"))
    rows = readers.withColumn("note", note).groupBy(*PAGE)
    items = F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct(place.alias("place"), "note"))))
    return rows.agg(F.transform(items, lambda x: x["note"]).alias("notes"))


def documents(blocks: DataFrame) -> DataFrame:
    """Each document's text in reading order, and whether any part of it was read weakly."""
    items = F.array_sort(F.collect_list(F.struct("page", "block_order", "text")))
    return blocks.groupBy("doc_id").agg(
        F.array_join(F.transform(items, lambda x: x["text"]), "\n").alias("raw"),
        F.max(F.col("level") == "baixa").alias("escalated"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds_seen"),
    )


def coverage(blocks: DataFrame) -> DataFrame:
    """How many readers saw each row of the reference reader."""
    rows = visual_rows(lent(blocks))
    own = rows.join(reading.reference_reader(rows, list(READERS)), [*PAGE, "reader"]).select(*PAGE, F.col("block_order").alias("anchor"))
    others = reading.spatial_match(rows, list(READERS)).groupBy(*PAGE, "anchor").agg(F.count("*").alias("n"))
    return own.join(others, [*PAGE, "anchor"], "left").select(*PAGE, "anchor", (F.coalesce("n", F.lit(0)) + 1).alias("n_readers"))
