"""Mixing sources to target weights by hierarchical budgets.

Sources form a tree domain - language - source.  A token budget goes down the
tree in proportion to weights.  A child that cannot use its share (its tokens
times max_epochs) takes what it has, and the rest goes to its siblings by
their weights before any of it leaves the parent; a parent's own lack goes to
its siblings likewise, as a parent's capacity is the sum of its leaves'.

A leaf serves its budget by whole epochs and a prefix, in tokens, of one more
epoch; each epoch has its own seeded order of the documents.  Where the prefix
ends is found by histograms of the order's leading digits, so that no task
gathers a leaf's documents, however large the leaf.  Everything is DataFrame
functions and exact numbers.

Leaves meet their documents by broadcast where they are BROADCAST_LEAVES at
most.  Where they are more, those that hold more than one row in
BROADCAST_LEAVES are (there are no more of them than that), and the others,
none of them large, meet their documents by a shuffle.

Cases: null languages and sources are leaves of their own (''), a null or
empty text has no token and goes with its place in the order; a leaf without
tokens gets no budget; rows that repeat an id stand and fall together in a
prefix; an empty table gives an empty result; of the other columns the query
returns none and the stage all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

TREE = ("domain", "lang", "source")
SEED = 2024
#: Integer weights by level; names that are not listed weigh DEFAULT_WEIGHT.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 3}}
DEFAULT_WEIGHT = 1
SHARE_PERCENT, MAX_EPOCHS = 80, 2
STAGE_SHARE_PERCENT, STAGE_MAX_EPOCHS = 95, 1
BROADCAST_LEAVES = 20_000  #: rows of a leaf table that are broadcast at most
WORDS = r"[^\x09-\x0D ]+"


def weight(level: str, name: Column, weights: dict = WEIGHTS) -> Column:
    whens = [F.when(name == k, F.lit(w)) for k, w in weights.get(level, {}).items()]
    return F.coalesce(*whens, F.lit(DEFAULT_WEIGHT)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number's remainder, or 'other'."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("long") % 3).cast("string")))


def fill(rows: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's `budget` over its rows (weight, capacity): the level
    at which capacities are met rises until the budget is used."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("budget", F.least("budget", F.sum("capacity").over(group)))
    left = F.col("budget") - (F.sum("capacity").over(upto) - F.col("capacity"))
    wide = lambda x: x.cast("decimal(20,0)")  # noqa: E731  the product of two may exceed 64 bits
    rows = rows.withColumn("met", wide(F.col("capacity")) * wide(F.sum("weight").over(onward)) <= wide(left) * wide(F.col("weight")))
    rows = rows.withColumn("met", F.min("met").over(upto))
    rest = F.col("budget") - F.sum(F.when(F.col("met"), F.col("capacity")).otherwise(0)).over(group)
    unmet = F.sum(F.when(F.col("met"), 0).otherwise(F.col("weight"))).over(group)
    rows = rows.withColumn("rest", rest).withColumn("unmet", unmet)
    # rest * weight div unmet, without a product that could exceed 64 bits
    split = F.expr("(rest div unmet) * weight + ((rest % unmet) * weight) div unmet")
    share = F.when(F.col("met"), F.col("capacity")).otherwise(split)
    return rows.withColumn("budget", share).drop("met", "rest", "unmet")


def budgets(leaves: DataFrame, total: Column, max_epochs: int, weights: dict = WEIGHTS) -> DataFrame:
    """Budgets of leaves (domain, lang, source, tokens), level by level."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    out = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("budget", total)
    out = fill(out.withColumn("weight", weight("domain", F.col("domain"), weights)), [], "domain")
    middle = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(out.select("domain", "budget"), "domain")
    out = fill(middle.withColumn("weight", weight("lang", F.col("lang"), weights)), ["domain"], "lang")
    bottom = leaves.join(out.select("domain", "lang", "budget"), ["domain", "lang"])
    out = fill(bottom.withColumn("weight", weight("source", F.col("source"), weights)), ["domain", "lang"], "source")
    return out.select(*TREE, "tokens", "budget")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


class Leaves:
    """How the rows of a documents table meet the rows of a leaf table."""

    def __init__(self, leaves: DataFrame):
        """leaves: (*TREE, n_rows)."""
        count, rows = leaves.agg(F.count("*"), F.sum("n_rows")).first()
        self.small = count <= BROADCAST_LEAVES
        self.large = None if self.small else leaves.where(F.col("n_rows") * BROADCAST_LEAVES > rows).select(*TREE)

    def join(self, rows: DataFrame, leaf: DataFrame) -> DataFrame:
        """rows (*TREE, ...) with the columns of their leaf, if it is in the leaf table (*TREE, ...)."""
        keys = list(TREE)
        if self.small:
            return rows.join(F.broadcast(leaf), keys)
        large = F.broadcast(self.large)
        few = rows.join(large, keys, "left_anti").join(leaf.join(large, keys, "left_anti").hint("merge"), keys)
        return rows.join(F.broadcast(leaf.join(large, keys, "left_semi")), keys).unionByName(few)


def cuts(rows: DataFrame, share_percent: int, max_epochs: int, seed: int, weights: dict) -> tuple[DataFrame, Leaves]:
    """For each leaf the whole epochs and the last place taken of the next one,
    from rows (doc_id, domain, lang, source, n_tokens)."""
    leaves = rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"))
    leaves = _shared.written(leaves, "leaves")
    meet = Leaves(leaves)
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share_percent // 100
    leaf = budgets(leaves.drop("n_rows"), F.lit(total).cast("long"), max_epochs, weights)
    leaf = (
        leaf.where("tokens > 0")
        .withColumn("epochs", F.expr("budget div tokens"))
        .withColumn("rest", F.expr("budget % tokens"))
        .drop("tokens", "budget")
    )
    leaf = _shared.written(leaf, "budgets")
    keyed = meet.join(rows.select("doc_id", *TREE, "n_tokens"), leaf.select(*TREE, "epochs"))
    keyed = keyed.withColumn("key", order_key(seed, F.col("epochs") + 1, F.col("doc_id"))).drop("epochs", "doc_id")
    keyed = _shared.written(keyed, "keyed")
    leaf = leaf.withColumn("at", F.lit(""))
    for digits in (2, 4, 32):
        near = keyed if digits == 2 else meet.join(keyed, leaf.select(*TREE, "at")).where(F.col("key").startswith(F.col("at"))).drop("at")
        counts = near.groupBy(*TREE, F.substring("key", 1, digits).alias("digits")).agg(F.sum("n_tokens").alias("n"))
        order = Window.partitionBy(*TREE).orderBy("digits")
        counts = counts.withColumn("upto", F.sum("n").over(order)).join(leaf.select(*TREE, "rest"), list(TREE))
        if digits < 32:
            # the first group that the prefix does not hold whole; it always exists, as rest < tokens
            first = (
                counts.where("upto > rest")
                .groupBy(*TREE)
                .agg(F.min("digits").alias("at"), F.min_by(F.col("rest") - F.col("upto") + F.col("n"), "digits").alias("rest"))
            )
            leaf = leaf.drop("at", "rest").join(first, list(TREE))
        else:
            last = counts.where("upto <= rest").groupBy(*TREE).agg(F.max("digits").alias("last"))
            leaf = leaf.join(last, list(TREE), "left").withColumn("last", F.coalesce("last", "at"))
        leaf = _shared.written(leaf, "cuts")
    return leaf.select(*TREE, "epochs", "last"), meet


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def leaf_of(docs: DataFrame) -> list[Column]:
    """The columns of TREE."""
    return [
        domain_of(docs["source"]).alias("domain"),
        F.coalesce(docs["lang"], F.lit("")).alias("lang"),
        F.coalesce(docs["source"], F.lit("")).alias("source"),
    ]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens) of documents."""
    return docs.select("doc_id", *leaf_of(docs), _tokens(docs["text"]).alias("n_tokens"))


def mix(
    docs: DataFrame,
    share_percent: int = SHARE_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    weights: dict = WEIGHTS,
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of the documents taken:
    share_percent of all tokens, spread by weights over the tree."""
    rows = _shared.written(sizes(docs), "sizes")
    cut, meet = cuts(rows, share_percent, max_epochs, seed, weights)
    taken = meet.join(rows, cut)
    part = (order_key(seed, F.col("epochs") + 1, F.col("doc_id")) <= F.col("last")).cast("long")
    return taken.withColumn("copies", F.col("epochs") + part).where("copies > 0").select("doc_id", *TREE, "n_tokens", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_shared.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a document that the mixture takes; no epoch repeats, so none is doubled."""
    cut, meet = cuts(_shared.written(sizes(docs), "sizes"), STAGE_SHARE_PERCENT, STAGE_MAX_EPOCHS, SEED, WEIGHTS)
    rows = docs.select(*leaf_of(docs), F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    joined = meet.join(rows, cut)
    taken = (F.col("epochs") > 0) | (order_key(SEED, F.col("epochs") + 1, F.col("_doc.doc_id")) <= F.col("last"))
    return joined.where(taken).select("_doc.*")


def _level(source: str, parent: str, name: str, weight_sql: str) -> str:
    """The SQL of `fill`."""
    over = f"partition by {parent}" if parent else ""
    return f"""(
  select *, case when met then capacity else (rest * weight) // unmet end as share from (
    select *, budget - sum(case when met then capacity else 0 end) over ({over}) as rest,
           sum(case when met then 0 else weight end) over ({over}) as unmet from (
      select * replace (min(met) over ({over} order by capacity / weight, {name} rows unbounded preceding) as met) from (
        select *, capacity * sum(weight) over ({over} order by capacity / weight, {name} rows between current row and unbounded following)
                  <= (budget - (sum(capacity) over ({over} order by capacity / weight, {name} rows unbounded preceding) - capacity)) * weight as met from (
          select * replace (least(budget, sum(capacity) over ({over})) as budget), {weight_sql} as weight from {source}))))
)"""


def _weight_sql(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {w}" for k, w in WEIGHTS[level].items()) + f" else {DEFAULT_WEIGHT} end"


ORACLE_SQL = f"""
with docs as (
  select doc_id, case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'other'
                 else 'd' || cast(cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint) % 3 as varchar) end as domain,
         coalesce(lang, '') as lang, coalesce(source, '') as source,
         cast(coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D ]+')), 0) as bigint) as n_tokens
  from documents
), leaves as (
  select domain, lang, source, sum(n_tokens) as tokens, sum(n_tokens) * {MAX_EPOCHS} as capacity from docs group by all
), top as (
  select domain, sum(capacity) as capacity, (select sum(n_tokens) * {SHARE_PERCENT} // 100 from docs) as budget from leaves group by domain
), top_filled as (select domain, share as budget from {_level("top", "", "domain", _weight_sql("domain"))}
), middle as (
  select domain, lang, sum(capacity) as capacity, any_value(budget) as budget from leaves join top_filled using (domain) group by domain, lang
), middle_filled as (select domain, lang, share as budget from {_level("middle", "domain", "lang", _weight_sql("lang"))}
), bottom as (select leaves.*, budget from leaves join middle_filled using (domain, lang)
), filled as (select domain, lang, source, share // tokens as epochs, share % tokens as rest from {_level("bottom", "domain, lang", "source", _weight_sql("source"))} where tokens > 0
), placed as (
  select docs.*, epochs, rest, md5('{SEED}:' || cast(cast(epochs as bigint) + 1 as varchar) || ':' || coalesce(cast(doc_id as varchar), '')) as place
  from docs join filled using (domain, lang, source)
), taken as (
  select *, cast(epochs + case when sum(n_tokens) over (partition by domain, lang, source order by place) <= rest then 1 else 0 end as bigint) as copies from placed
)
select doc_id, domain, lang, source, n_tokens, copies from taken where copies > 0
"""
