"""Readings of the same page by several readers: rows, regions and votes.

blocks: doc_id, page, reader, kind, block_order, text, x0, y0, x1, y1, row, col.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from .. import vocabulary as v

OVERLAP, SAME_ROW = 0.15, 0.5


def level_of(kinds: Column) -> Column:
    """The level of a set of mechanisms that agree."""
    kinds = F.array_distinct(kinds)
    many = F.size(kinds) >= 2
    return F.when(
        F.array_contains(kinds, "text_layer"),
        F.when(many, "muito_alta").otherwise("alta"),
    ).otherwise(F.when(many, "media").otherwise("baixa"))


def rank_of(level: Column) -> Column:
    """Place on the ladder from 1, the strongest; null for an unknown level."""
    return F.nullif(F.array_position(F.array(*map(F.lit, v.LADDER)), level), F.lit(0)).cast("int")


def at_rank(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, v.LADDER)), F.greatest(F.least(rank, F.lit(4)), F.lit(1)).cast("int") - 1)


def demote(level: Column, steps: Column) -> Column:
    return at_rank(rank_of(level) + steps)


def weakest(levels: Column) -> Column:
    """The weakest known level of a group (an aggregate); none gives the lowest."""
    return F.coalesce(at_rank(F.max(rank_of(levels))), F.lit("baixa"))


def error_of(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(e)) for k, e in v.KINDS.items()], F.lit(1.0))


def combined_error(kinds: Column) -> Column:
    """One mechanism: its error; pixels only: half the least; else the product."""
    errors = F.transform(F.array_distinct(kinds), error_of)
    pixels = F.size(F.array_except(kinds, F.array(*map(F.lit, v.PIXEL_KINDS)))) == 0
    product = F.aggregate(errors, F.lit(1.0), lambda a, e: a * e)
    return F.when(F.size(errors) == 1, errors[0]).when(pixels, F.array_min(errors) * 0.5).otherwise(product)


def score(error: Column, eliminated: Column) -> Column:
    """How much a vote is worth: each eliminated reading costs a tenth."""
    return F.round((F.lit(1.0) - error) * F.pow(F.lit(0.9), eliminated), 4)


def resolve(readings: DataFrame) -> DataFrame:
    """One row per region (doc_id, region_id) from readings (reader, kind, text,
    seq, perhaps box): flawed readings are out unless all are; the group with
    the strongest level wins, first seen on ties; its most reliable reading is
    the text; each elimination costs a level, and a region of flawed readings
    only is at the lowest.  What did not win stays as alternatives, and notes
    say who was left out and why.  A region has a reading per reader, few."""
    region = Window.partitionBy("doc_id", "region_id")
    box = ["box"] if "box" in readings.columns else []
    rows = readings.withColumn("flaws", text.structural_flaws(F.col("text"))).withColumn("flawed", (F.size("flaws") > 0).cast("int"))
    rows = rows.withColumn("n_flawed", F.sum("flawed").over(region)).withColumn("n", F.count("*").over(region))
    rows = rows.withColumn("all", F.array_sort(F.collect_list(F.struct("seq", "reader", "text", "flaws")).over(region)))
    alive = rows.where("flawed = 0 or n_flawed = n").withColumn("key", text.vote_key(F.col("text")))
    best = F.min_by(F.struct("text", "reader", "kind", *box), F.struct(error_of(F.col("kind")), F.col("seq")))
    groups = alive.groupBy("doc_id", "region_id", "key", "n", "n_flawed").agg(
        F.collect_set("kind").alias("kinds"),
        F.min("seq").alias("seq"),
        best.alias("best"),
        F.any_value("all").alias("all"),
    )
    groups = groups.withColumn("level", level_of(F.col("kinds")))
    won = groups.withColumn("_n", F.row_number().over(region.orderBy(rank_of(F.col("level")), "seq"))).where("_n = 1")
    all_flawed = F.col("n_flawed") == F.col("n")
    level = F.when(all_flawed, "baixa").otherwise(demote(F.col("level"), F.col("n_flawed")))
    others = F.filter("all", lambda x: x["reader"] != F.col("best.reader"))
    out = F.transform(F.filter("all", lambda x: F.size(x["flaws"]) > 0), lambda x: F.concat(x["reader"], F.lit(" out: "), x["flaws"][0]))
    kept = F.array(F.concat(F.lit("no reading has a valid form ("), F.get(F.get("all", F.lit(0))["flaws"], F.lit(0)), F.lit(")")))
    return won.select(
        "doc_id",
        "region_id",
        *[f"best.{c}" for c in ("text", "reader", *box)],
        level.alias("level"),
        by_error(F.col("kinds")).alias("kinds"),
        F.when(all_flawed, 0).otherwise(F.col("n_flawed")).cast("long").alias("n_eliminated"),
        (F.col("n") - 1).alias("n_alternatives"),
        F.transform(others, lambda x: F.struct(x["reader"].alias("reader"), x["text"].alias("text"))).alias("alternatives"),
        F.when(all_flawed, kept).otherwise(out).alias("notes"),
    )


def by_error(kinds: Column) -> Column:
    """Mechanisms in the order of their errors."""
    return F.array_sort(kinds, lambda a, b: F.when(error_of(a) < error_of(b), -1).when(error_of(a) > error_of(b), 1).otherwise(0))


def reference_reader(rows: DataFrame, order: list[str]) -> DataFrame:
    """The reader with the most rows of a page; ties in the given order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("reader"))
    counts = rows.groupBy("doc_id", "page", "reader").agg(F.count("*").alias("n"))
    best = Window.partitionBy("doc_id", "page").orderBy(F.col("n").desc(), place)
    return counts.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("doc_id", "page", "reader")


def spatial_match(rows: DataFrame, order: list[str]) -> DataFrame:
    """For each row of the reference reader, of every other reader the row that
    overlaps it most (at least OVERLAP; ties: the first from the top left).
    The page is an equality key; the overlap is a residual condition."""
    box = F.struct("x0", "y0", "x1", "y1")
    reference = reference_reader(rows, order)
    left = rows.join(reference, ["doc_id", "page", "reader"]).select("doc_id", "page", F.col("block_order").alias("anchor"), box.alias("a"))
    right = rows.join(reference, ["doc_id", "page", "reader"], "left_anti").select(
        "doc_id",
        "page",
        "reader",
        "block_order",
        box.alias("b"),
    )
    pairs = left.join(right, ["doc_id", "page"]).withColumn("overlap", numbers.overlap("a", "b")).where(F.col("overlap") >= OVERLAP)
    best = Window.partitionBy("doc_id", "page", "anchor", "reader").orderBy(F.col("overlap").desc(), "b.y0", "b.x0", "block_order")
    return (
        pairs.withColumn("_n", F.row_number().over(best))
        .where("_n = 1")
        .select("doc_id", "page", "anchor", "reader", "block_order", "overlap")
    )


def lend_geometry(cells: DataFrame) -> DataFrame:
    """Boxes for cells without one of their own (pending): from the first other
    reader (by reader_ord) whose grid has the same shape, at the same row and
    column, if its cell overlaps the pending box.  A page is gathered once, and
    its cells ask each other where it stands: no join."""
    keys = ["doc_id", "page"]
    own = Window.partitionBy(*keys, "reader")
    rows = cells.withColumn("n_rows", F.max("row").over(own)).withColumn("n_cols", F.max("col").over(own))
    place = F.coalesce("reader_ord", F.lit(-(2**31))).alias("place")
    cell = F.struct("reader", place, "row", "col", "n_rows", "n_cols", "pending", F.struct("x0", "y0", "x1", "y1").alias("box"))
    pages = rows.groupBy(*keys).agg(F.collect_list(cell).alias("cells"))

    def offers(a: Column) -> Column:
        same = lambda g: reduce(and_, [g[c] == a[c] for c in ("row", "col", "n_rows", "n_cols")])
        fit = lambda g: ~g["pending"] & same(g) & (g["reader"] != a["reader"]) & (numbers.overlap(a["box"], g["box"]) >= OVERLAP)
        made = lambda g: F.struct(a["reader"].alias("reader"), a["row"].alias("row"), a["col"].alias("col"), g["place"].alias("place"), g["box"].alias("box"))
        return F.transform(F.filter("cells", fit), made)

    def first(made: Column) -> Column:
        least = lambda o: F.array_min(F.transform(F.filter(made, lambda x: x["reader"] == o["reader"]), lambda x: x["place"]))
        return F.filter(made, lambda o: o["place"] == least(o))

    lent = text.let(F.flatten(F.transform(F.filter("cells", lambda c: c["pending"]), offers)), first)
    out = pages.select(*keys, F.explode("cells").alias("c"), lent.alias("lent"))
    mine = lambda o: (o["reader"] == F.col("c.reader")) & (o["row"] == F.col("c.row")) & (o["col"] == F.col("c.col"))
    out = out.select(*keys, "c", F.explode_outer(F.filter("lent", mine)).alias("o"))
    return out.select(
        *keys,
        "c.reader",
        "c.row",
        "c.col",
        F.coalesce("o.box", "c.box").alias("box"),
        (F.col("c.pending") & F.col("o").isNull()).alias("pending"),
        F.col("o").isNotNull().alias("was_lent"),
    )


def cluster_rows(blocks: DataFrame, chained: bool = False, carried: tuple = ()) -> DataFrame:
    """Visual rows of a page: (doc_id, page, reader, block_order, row_index,
    col_index, n_cols), and the blocks' columns that are to be carried along.

    From the top, a block joins the first row whose seed (chained: whose last
    block) shares enough height with it, or begins a row.  The order matters,
    so this is a fold over each page's blocks, which are few."""
    keys = ["doc_id", "page", "reader"]
    more = [F.struct(*carried).alias("carried")] if carried else []
    item = F.struct("y0", *([] if chained else ["x0"]), "block_order", *(["x0"] if chained else []), "y1", "x1", *more)
    pages = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    # the seed's or last block's height, and the members from the left
    held = ", ".join(f"`{c}`: {blocks.schema[c].dataType.simpleString()}" for c in carried)
    member = "x0: double, block_order: int" + (f", carried: struct<{held}>" if carried else "")
    kind = f"array<struct<seed: struct<y0: double, y1: double>, members: array<struct<{member}>>>>"

    def step(rows: Column, b: Column) -> Column:
        near = F.transform(rows, lambda r, i: F.when(numbers.row_overlap(r["seed"], b) >= SAME_ROW, i))
        at = F.array_min(near)
        parts = [b["x0"].cast("double").alias("x0"), b["block_order"].cast("int").alias("block_order")]
        own = F.struct(*parts, *([b["carried"].alias("carried")] if carried else []))
        here = F.struct(b["y0"].cast("double").alias("y0"), b["y1"].cast("double").alias("y1"))
        joined = lambda at: F.transform(
            rows,
            lambda r, i: F.when(
                i == at,
                F.struct((here if chained else r["seed"]).alias("seed"), F.concat(r["members"], F.array(own)).alias("members")),
            ).otherwise(r),
        )
        begun = F.concat(rows, F.array(F.struct(here.alias("seed"), F.array(own).alias("members"))))
        return text.let(at, lambda at: F.when(at.isNull(), begun).otherwise(joined(at)))

    folded = pages.select(*keys, F.aggregate("items", F.array().cast(kind), step).alias("rows"))
    # an inner explode adds a filter on the list, in which the fold is made again; no page is without a row
    out = folded.select(*keys, F.posexplode_outer("rows").alias("row_index", "r")).withColumn("n_cols", F.size("r.members"))
    out = out.select(*keys, "row_index", "n_cols", F.posexplode(F.array_sort("r.members")).alias("col_index", "m"))
    return out.select(*keys, "m.block_order", "row_index", "col_index", "n_cols", *[f"m.carried.{c}" for c in carried])


def table_roles(blocks: DataFrame) -> DataFrame:
    """Row and column numbers of blocks that stand beside others, as cells of a table."""
    keys = ["doc_id", "page", "reader", "block_order"]
    cell = F.col("n_cols") >= 2
    placed = cluster_rows(blocks, chained=True)
    return placed.select(
        *keys,
        F.when(cell, F.lit("table_cell")).alias("role"),
        F.when(cell, F.col("row_index")).alias("row"),
        F.when(cell, F.col("col_index")).alias("col"),
    )


def grid_shape(cells: DataFrame) -> DataFrame:
    """Rows and columns of each reader's grid."""
    return cells.groupBy("doc_id", "page", "reader").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def label_value_pairs(blocks: DataFrame) -> DataFrame:
    """Leftmost and rightmost text of each visual row of two blocks or more."""
    keys = ["doc_id", "page", "reader"]
    rows = cluster_rows(blocks, chained=True).where("n_cols >= 2").join(blocks.select(*keys, "block_order", "text"), [*keys, "block_order"])
    return rows.groupBy(*keys, "row_index").agg(F.min_by("text", "col_index").alias("label"), F.max_by("text", "col_index").alias("value"))


def split_fused(blocks: DataFrame) -> DataFrame:
    """Blocks that hold a label and its value become two, the box cut by characters."""
    parts = text.split_label_value(F.col("text"))
    share = F.length(parts[0]) / F.greatest(F.length(parts[0]) + F.length(parts[1]), F.lit(1))
    cut = F.col("x0") + (F.col("x1") - F.col("x0")) * share
    piece = lambda t, a, b, k: F.struct(t.alias("text"), a.alias("x0"), b.alias("x1"), F.lit(k).alias("piece"))
    pieces = F.when(
        parts.isNotNull(),
        F.array(piece(parts[0], F.col("x0"), cut, 0), piece(parts[1], cut, F.col("x1"), 1)),
    ).otherwise(F.array(piece(F.col("text"), F.col("x0"), F.col("x1"), 0)))
    return blocks.withColumn("p", F.explode(pieces)).select(
        "doc_id",
        "page",
        "reader",
        "block_order",
        "p.piece",
        "p.text",
        "p.x0",
        "y0",
        "p.x1",
        "y1",
    )


def reads_by_kind(blocks: DataFrame) -> DataFrame:
    """The text of each mechanism, in reading order, blank texts left out."""
    rows = (
        blocks.where(F.trim("text") != "")
        .groupBy("doc_id", "kind")
        .agg(F.array_sort(F.collect_list(F.struct("page", "block_order", "text"))).alias("items"))
    )
    return rows.select("doc_id", "kind", F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("text"))
