"""Fields: extraction by anchors and sentences, grounding, repair, merge, sweep."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import dates, numbers, text
from ..functions.similarity import partial_ratio, ratio
from .. import vocabulary as v
from ..sources.staging import staged

FUZZY = 0.85
# Amounts and percentages, taken greedily for the repair to judge.
MONEY, PERCENT = r"r\$\s*[\d.,]+", r"\d[\d.,\s]*%"
KNOWN = 100_000  #: labels whose most similar anchor a task keeps
ITEMS = 2000  #: evidences that go with a plan at once


def match_anchor(pairs: DataFrame, anchors: dict[str, list[str]] = v.ANCHORS) -> DataFrame:
    """The field that a label announces: the longest anchor it contains, ties in
    the anchors' order.  The anchors are one literal, the best first: no join."""
    items = sorted(((f, a) for f, names in anchors.items() for a in names), key=lambda x: -len(x[1]))
    names = [F.struct(F.lit(f).alias("field"), F.lit(a).alias("anchor"), F.lit(_squash(a)).alias("tight")) for f, a in items]
    # a column named in the body of a loop may be computed there, once for each anchor: let binds it before
    held = lambda n, t: F.filter(F.array(*names), lambda x: n.contains(x["anchor"]) | t.contains(x["tight"]))
    best = text.let(text.normalize(F.col("label")), lambda n: text.let(text.tighten(n), lambda t: F.get(held(n, t), F.lit(0))))
    rows = pairs.withColumn("_best", best)
    return rows.withColumn("field", F.col("_best.field")).withColumn("anchor", F.col("_best.anchor")).drop("_best")


def _squash(anchor: str) -> str:
    import re

    return re.sub(text.SQUASHED, "", anchor)


def match_anchor_fuzzy(pairs: DataFrame, anchors: dict[str, list[str]] = v.ANCHORS) -> DataFrame:
    """As `match_anchor`; a label that contains no anchor takes the most similar
    one of at least FUZZY, by Arrow batches.  Rows stay where they are: a label
    that many rows share is compared once a task, not moved to one of them."""
    items = [(f, a, _squash(a)) for f, names in anchors.items() for a in names]

    @F.pandas_udf("struct<field: string, anchor: string>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        @lru_cache(KNOWN)
        def best(t: str) -> tuple:
            score, k = max((ratio(t, x[2]), -i) for i, x in enumerate(items))
            return items[-k][:2] if score >= FUZZY else (None, None)

        for tight in batches:
            yield pd.DataFrame([(None, None) if t is None else best(t) for t in tight], columns=["field", "anchor"])

    rows = match_anchor(pairs, anchors)
    rows = rows.withColumn("_near", nearest(F.when(F.col("field").isNull(), text.squash(F.col("label")))))
    return (
        rows.withColumn("field", F.coalesce("field", "_near.field"))
        .withColumn("anchor", F.coalesce("anchor", "_near.anchor"))
        .drop("_near")
    )


def prose_field(c: Column, field: str) -> Column:
    """The date of the field's first sentence template that the text holds."""
    tries = lambda n: [F.nullif(F.regexp_extract(n, p.replace("(DATE)", dates.ANY_DATE), 1), F.lit("")) for p in v.PROSE[field]]
    return text.let(text.normalize(c), lambda n: F.coalesce(*tries(n)))


def typed_key(field: Column, raw: Column) -> Column:
    """One spelling for equal values: a date, a number, or the squashed text."""
    date = F.when(field.isin(*v.DATE_FIELDS), dates.written_date(raw)["value"].cast("string"))
    number = F.when(field.isin(*v.MONEY_FIELDS, "tax_rate", "ratio_from", "ratio_to"), numbers.ptbr_number(raw).cast("string"))
    return F.coalesce(date, number, text.squash(raw))


def same_value(a: Column, b: Column) -> Column:
    x, y = numbers.decimal_number(a), numbers.decimal_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(text.squash(a) == text.squash(b))


def locate(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each evidence's (doc_id, evidence_id, evidence, value) best block and quality.
    Normal forms are made once a block and once an evidence, before they meet."""
    asked = evidence.where(F.trim("evidence") != "").select(
        "doc_id",
        "evidence_id",
        text.normalize(F.col("evidence")).alias("ne"),
        text.squash(F.col("value")).alias("sv"),
    )
    asked = asked.withColumn("se", text.tighten(F.col("ne")))
    held = blocks.select("doc_id", "block_order", text.normalize(F.col("text")).alias("nb"))
    held = held.withColumn("sb", text.tighten(F.col("nb")))
    ne, se, sv, nb, sb = map(F.col, ("ne", "se", "sv", "nb", "sb"))
    part = 0.6 * F.length(sb) / F.greatest(F.length(se), F.lit(1))
    inside = F.when(F.coalesce((sv != "") & sb.contains(sv), F.lit(False)), F.greatest(part, F.lit(0.9))).otherwise(part)
    quality = F.when(nb.contains(ne), 1.0).when(sb.contains(se), 0.85).when((sb != "") & se.contains(sb), inside)
    # sizes guessed from the columns of a compressed table would let one side of this join go through the driver
    found = asked.join(held.hint("merge"), "doc_id").withColumn("quality", quality).where("quality > 0")
    best = F.min_by(F.struct("block_order", "quality"), F.struct(-F.col("quality"), "block_order"))
    found = found.groupBy("doc_id", "evidence_id").agg(best.alias("best"))
    return found.select("doc_id", "evidence_id", "best.block_order", F.round("best.quality", 4).alias("quality"))


def grounding(evidence: Column, raw: Column, strict: Column) -> Column:
    """How a text holds an evidence: as it is, squashed, or with confused characters (not if strict)."""
    loose = lambda n: F.translate(n, "0158|", "olsbl")

    def decide(e: Column, r: Column, se: Column, sr: Column) -> Column:
        return (
            F.when(e.isNull() | (se == ""), "absent")
            .when(r.contains(e), "exact")
            .when(sr.contains(se), "normalized")
            .when(~strict & loose(sr).contains(loose(se)), "fuzzy")
            .otherwise("absent")
        )

    squashed = lambda e, r: text.let(text.tighten(e), lambda se: text.let(text.tighten(r), lambda sr: decide(e, r, se, sr)))
    return text.let(text.normalize(evidence), lambda e: text.let(text.normalize(raw), lambda r: squashed(e, r)))


@F.pandas_udf(DoubleType())
def partial_similarity(evidence: pd.Series, raw: pd.Series) -> pd.Series:
    """The best Indel similarity of an evidence to a stretch of a text, both squashed before."""
    return pd.Series([partial_ratio(a or "", b or "", FUZZY) for a, b in zip(evidence, raw)])


def ground(fields: DataFrame) -> DataFrame:
    """Grounding of fields (doc_id, field, evidence, raw, reader_kind); what
    remains absent in a reading from pixels gets a last chance by similarity.
    Only those rows go to the Python workers, the others stay in the JVM."""
    strict = F.coalesce(F.col("reader_kind") == "text_layer", F.lit(True))
    rows = staged(fields.withColumn("status", grounding(F.col("evidence"), F.col("raw"), strict)), "grounding")
    again = F.coalesce((F.col("status") == "absent") & ~strict & (text.squash(F.col("evidence")) != ""), F.lit(False))
    near = rows.where(again).withColumn("near", partial_similarity(text.squash(F.col("evidence")), text.squash(F.col("raw"))))
    near = near.withColumn("status", F.when(F.col("near") >= FUZZY, "fuzzy").otherwise(F.col("status")))
    return near.unionByName(rows.where(~again).withColumn("near", F.lit(None).cast("double")))


def _holding(block: Column):
    """Of items those that a text holds."""
    return lambda lr: F.filter(block, lambda x: lr.contains(x["le"]))


def find_evidence(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, status) of the documents (doc_id, text) that hold items
    (item_id, text).  Items are a stated set: ITEMS of them at a time go with
    the plan, every document is held against each, and is normalized once."""
    loose = lambda s: F.translate(s, "0158|", "olsbl")
    rows = items.select("item_id", text.normalize(F.col("text")).alias("e")).withColumn("se", text.tighten(F.col("e"))).where("se <> ''")
    rows = rows.withColumn("le", loose(F.col("se"))).orderBy("item_id", "e")
    held = docs.select("doc_id", text.normalize(F.col("text")).alias("r")).withColumn("sr", text.tighten(F.col("r")))
    held = staged(held, "texts")
    kind = "array<struct<item_id: bigint, e: string, se: string, le: string>>"
    found, wanted = None, [r.asDict() for r in rows.collect()]
    for at in range(0, max(len(wanted), 1), ITEMS):
        block = F.from_json(F.lit(json.dumps(wanted[at : at + ITEMS])), kind)
        # a column named in the body of a loop may be computed there, once for each item: let binds it before
        hits = text.let(loose(F.col("sr")), _holding(block))
        got = held.select("doc_id", "r", "sr", F.explode(hits).alias("x"))
        status = (
            F.when(F.col("r").contains(F.col("x.e")), "exact")
            .when(F.col("sr").contains(F.col("x.se")), "normalized")
            .otherwise("fuzzy")
        )
        got = got.select("x.item_id", "doc_id", status.alias("status"))
        found = got if found is None else found.unionByName(got)
    return found


def repair_date(raw: Column, level: Column, reader_kind: Column) -> Column:
    """struct(value, rule, candidates, absence_reason): undefined by its own words, an
    ambiguous year, a day that a lone optical reading may have cut, or a date."""
    weak = F.coalesce((level == "baixa") & (reader_kind == "ocr_deterministic"), F.lit(False))
    none = F.array().cast("array<string>")
    undefined = raw.rlike(dates.UNDEFINED)
    candidates = F.when(undefined, none).otherwise(F.coalesce(dates.year_candidates(raw), F.when(weak, dates.day_candidates(raw)), none))
    settled = lambda c: F.when(~undefined & (F.size(c) == 0), dates.written_date(raw))
    rule = lambda c, x: F.when(undefined, "stated_undefined").when(F.size(c) > 0, "ambiguous").otherwise(x["rule"])
    whole = lambda c, x: F.struct(
        x["value"].alias("value"),
        rule(c, x).alias("rule"),
        c.alias("candidates"),
        F.when(undefined, "stated_undefined").alias("absence_reason"),
    )
    return text.let(candidates, lambda c: text.let(settled(c), lambda x: whole(c, x)))


def repair_identifier(field: Column, raw: Column) -> Column:
    """Identifiers and other words in one spelling; what has no known form stays, in capitals without blanks if it should be a code."""
    plain = F.replace(F.replace(F.trim(raw), F.lit("（"), F.lit("(")), F.lit("）"), F.lit(")"))
    tight, upper = F.replace(F.upper(plain), F.lit(" "), F.lit("")), F.upper(plain)
    pick = lambda p: F.coalesce(F.nullif(F.regexp_extract(tight, p, 0), F.lit("")), tight)
    currency = F.when((upper == "") | upper.contains("R$") | upper.contains("BRL"), "BRL").otherwise(F.upper(F.trim(raw)))
    share = (
        F.when(upper.contains("PREFERENC") | upper.contains("PN"), "PN")
        .when(upper.contains("ORDIN") | upper.contains("ON"), "ON")
        .otherwise(plain)
    )
    return (
        F.when(field == "isin", pick(r"[A-Z]{2}[A-Z0-9]{9}\d"))
        .when(field == "ticker", pick(r"[A-Z]{4}\d{1,2}"))
        .when(field == "cnpj", text.format_cnpj(plain))
        .when(field == "currency", currency)
        .when(field == "share_class", share)
        .otherwise(F.trim(raw))
    )


def order_ratio(event_type: Column, first: Column, second: Column) -> Column:
    """struct(ratio_from, ratio_to, swapped): a grouping goes from more to fewer, other ratios the other way."""
    wrong = event_type.isin(*v.RATIO) & (first != second) & F.when(event_type == "grupamento", first < second).otherwise(first > second)
    wrong = F.coalesce(wrong, F.lit(False))
    return F.struct(
        F.when(wrong, second).otherwise(first).alias("ratio_from"),
        F.when(wrong, first).otherwise(second).alias("ratio_to"),
        wrong.alias("swapped"),
    )


def derive_ex_date(event_type: Column, ex: Column, start: Column) -> Column:
    return F.when(event_type.isin(*v.RATIO) & ex.isNull(), start).otherwise(ex)


def disambiguate(open_dates: DataFrame, notices: DataFrame, broken: Column) -> DataFrame:
    """Of a date's candidates (doc_id, field, candidates), the only one that
    breaks no rule of chronology in its notice; none or several settle nothing."""
    rows = open_dates.select(
        "doc_id",
        "field",
        F.explode("candidates").alias("candidate"),
    ).withColumn("tried", dates.calendar_date(F.col("candidate")))
    rows = rows.where("tried is not null").join(notices, "doc_id")
    for f in ("approval_date", "com_date", "ex_date", "payment_date"):
        rows = rows.withColumn(f, F.when(F.col("field") == f, F.col("tried")).otherwise(F.col(f)))
    good = rows.where(F.size(broken) == 0).groupBy("doc_id", "field").agg(F.count("*").alias("n"), F.min("tried").alias("value"))
    return (
        open_dates.select("doc_id", "field")
        .join(good, ["doc_id", "field"], "left")
        .select(
            "doc_id",
            "field",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_left"),
            F.when(F.col("n") == 1, F.col("value")).alias("value"),
        )
    )


def latest(candidates: DataFrame) -> DataFrame:
    """Of an append log the last row of each (doc_id, field, extractor)."""
    names = [c for c in candidates.columns if c not in ("doc_id", "field", "extractor")]
    return (
        candidates.groupBy("doc_id", "field", "extractor")
        .agg(F.max_by(F.struct(*names), "seq").alias("x"))
        .select("doc_id", "field", "extractor", "x.*")
    )


def merge(candidates: DataFrame, extractors: list[str]) -> DataFrame:
    """One value per field: the reading most extractors share (ties in their
    order), with the number of readings, and whether a critical field is disputed."""
    place = F.array_position(F.array(*map(F.lit, extractors)), F.col("extractor"))
    rows = (
        latest(candidates)
        .where("value_raw is not null")
        .withColumn("key", typed_key(F.col("field"), F.col("value_raw")))
        .withColumn("place", place)
    )
    groups = rows.groupBy("doc_id", "field", "key").agg(
        F.count("*").alias("votes"),
        F.min("place").alias("place"),
        F.min_by("value_raw", "place").alias("value_raw"),
    )
    best = Window.partitionBy("doc_id", "field").orderBy(F.col("votes").desc(), "place")
    out = (
        groups.withColumn("_n", F.row_number().over(best))
        .withColumn("readings", F.count("*").over(Window.partitionBy("doc_id", "field")))
        .where("_n = 1")
    )
    return out.select(
        "doc_id",
        "field",
        "value_raw",
        "votes",
        "readings",
        ((F.col("readings") > 1) & F.col("field").isin(*v.CRITICAL)).alias("disputed"),
    )


def ratio_pair_agrees(candidates: DataFrame) -> DataFrame:
    """Whether all extractors name the same two numbers of a ratio, in either
    order; null if one lacks a half or there is one extractor only."""
    rows = latest(candidates).where(F.col("field").isin("ratio_from", "ratio_to"))
    pairs = rows.groupBy("doc_id", "extractor").agg(F.array_sort(F.collect_list(numbers.first_int(F.col("value_raw")))).alias("pair"))
    out = pairs.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.min(F.size("pair")).alias("least"),
        F.size(F.collect_set("pair")).alias("different"),
    )
    return out.select("doc_id", F.when((F.col("n") >= 2) & (F.col("least") == 2), F.col("different") == 1).alias("agrees"))


def missing_fields(fields: DataFrame, notices: DataFrame, specs: DataFrame) -> DataFrame:
    """Fields of a type's contract without a row, or null for no stated reason."""
    settled = fields.where(
        F.col("value").isNotNull() | ~F.coalesce("absence_reason", F.lit("not_found")).isin("not_found")
    ).select("doc_id", "field")
    return (
        notices.select("doc_id", "event_type")
        .join(F.broadcast(specs), "event_type")
        .select("doc_id", "field", "required")
        .join(settled, ["doc_id", "field"], "left_anti")
    )


def fill_contract(fields: DataFrame, documents: DataFrame, specs: DataFrame) -> DataFrame:
    """fields (doc_id, event_type, field, value, absence_reason, candidates) and,
    for each document (doc_id, event_type), a row for every field of its type's
    contract that nobody gave."""
    contract = documents.select("doc_id", "event_type").join(F.broadcast(specs.select("event_type", "field")), "event_type")
    lost = contract.join(fields.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
    empty = {"value": F.lit(None).cast("string"), "absence_reason": F.lit("not_found"), "candidates": F.array().cast("array<string>")}
    return fields.select("doc_id", "event_type", "field", *empty).unionByName(
        lost.select("doc_id", "event_type", "field", *[c.alias(n) for n, c in empty.items()])
    )


def overlay(fields: DataFrame, recovered: DataFrame) -> DataFrame:
    """fields (doc_id, field, value, level, kinds) with the values a sweep has recovered in place of missing ones."""
    found = recovered.select("doc_id", "field", F.col("value").alias("_v"), F.col("level").alias("_l"), F.col("kinds").alias("_k"))
    rows = fields.join(found, ["doc_id", "field"], "full_outer")
    take = F.col("value").isNull() & F.col("_v").isNotNull()
    own = lambda c, new: F.when(take, F.col(new)).otherwise(F.col(c)).alias(c)
    return rows.select("doc_id", "field", own("value", "_v"), own("level", "_l"), own("kinds", "_k"), take.alias("recovered"))


def first_by_rule(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, field, value_raw, evidence, rule, at) the first non-empty
    value of the first rule that has one: by rule, then in reading order."""
    some = rows.where("trim(value_raw) <> ''")
    best = F.min_by(F.struct("value_raw", "evidence"), F.struct("rule", "at", "value_raw"))
    return some.groupBy("doc_id", "field").agg(best.alias("x")).select("doc_id", "field", "x.*")


def money_in(normal: Column) -> Column:
    """The first amount of a text in normal form, taken greedily."""
    return F.nullif(F.upper(F.regexp_extract(normal, MONEY, 0)), F.lit(""))


def percent_in(normal: Column) -> Column:
    """The first percentage, taken greedily."""
    return F.nullif(F.regexp_extract(normal, PERCENT, 0), F.lit(""))


def grounding_factor(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, F.lit(x)) for k, x in v.GROUNDING_FACTOR.items()])


def uncorroborated(fields: DataFrame) -> DataFrame:
    """Values that one mechanism alone has read, from pixels."""
    return fields.where(
        F.col("value").isNotNull() & (F.size("kinds") == 1) & F.get("kinds", F.lit(0)).isin(*v.PIXEL_KINDS)
    ).select("doc_id", "field")


def kinds_holding(value: Column, reads: Column) -> Column:
    """The mechanisms (keys of a map of texts) whose text holds a value, strongest first."""
    order = F.array(*map(F.lit, v.KINDS))
    read = lambda k: text.squash(F.get(F.map_values(F.map_filter(reads, lambda a, _: a == k)), F.lit(0)))
    held = lambda tight: F.filter(order, lambda k: F.coalesce(read(k).contains(tight), F.lit(False)) & (tight != ""))
    return text.let(text.squash(value), held)


def sweep_accept(returned: DataFrame, asked: DataFrame, reads: DataFrame, level_of) -> DataFrame:
    """Returned values (doc_id, field, value) that were asked for and that some
    mechanism's text holds; their level comes from the mechanisms that hold them."""
    rows = returned.join(asked.select("doc_id", "field"), ["doc_id", "field"], "left_semi").join(reads, "doc_id")
    rows = rows.withColumn("kinds", kinds_holding(F.col("value"), F.col("reads"))).where(F.size("kinds") > 0)
    return rows.select("doc_id", "field", "value", level_of(F.col("kinds")).alias("level"), F.lit(True).alias("recovered"))


def sweep_confirm(returned: DataFrame, fields: DataFrame, reads: DataFrame) -> DataFrame:
    """Mechanisms added to fields whose value came back the same; none is ever taken away."""
    rows = (
        fields.join(returned.withColumnRenamed("value", "again"), ["doc_id", "field"])
        .where(same_value(F.col("value"), F.col("again")))
        .join(reads, "doc_id")
    )
    both = F.array_union("kinds", kinds_holding(F.col("value"), F.col("reads")))
    order = F.array(*map(F.lit, v.KINDS))
    return rows.select("doc_id", "field", F.filter(order, lambda k: F.array_contains(both, k)).alias("kinds"))


def golden_status(field: Column, has_lookup: Column, agreeing: Column, row_found: Column, same: Column) -> Column:
    """How a field stands to the reference base."""
    return (
        F.when(~field.isin("isin", "ticker", "cnpj", "issuer"), "nao_aplicavel")
        .when(~has_lookup, "ausente")
        .when(F.array_contains(agreeing, field), "confere")
        .when(~row_found, "ausente")
        .when(~same, "diverge")
        .otherwise("confere")
    )


def field_status(value: Column, grounded: Column, review: Column) -> Column:
    return F.when(value.isNull(), "absent").when(grounded == "absent", "ungrounded").when(review, "review").otherwise("ok")


def unknown_figures(narrative: Column, known: Column) -> Column:
    """Figures that a narrative cites and the record does not hold, without punctuation and trailing zeros."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"\D", ""), "0+$", "")
    cited = F.filter(F.transform(F.regexp_extract_all(narrative, F.lit(r"\d[\d.,/]*\d|\d"), F.lit(0)), plain), lambda x: x != "")
    return F.array_sort(F.array_except(F.array_distinct(cited), F.transform(known, plain)))
