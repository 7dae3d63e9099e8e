"""From blocks that readers have read to triaged records, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import audit, classify, fields, page, reading, triage, validators
from ..sources.staging import staged
from .. import vocabulary as v

RULES = {"table": 0, "prose": 1, "identifier": 2, "first_block": 3, "share_class": 4, "currency": 5}


@dataclass(frozen=True)
class Config:
    as_of: str
    window_days: int = 2 * 365

    def window(self) -> dict:
        return {"as_of": self.as_of, "window_days": self.window_days}


@dataclass
class Result:
    """The tables of a run, by name."""

    blocks: DataFrame
    notices: DataFrame
    fields: DataFrame
    findings: DataFrame
    reasons: DataFrame
    verdicts: DataFrame


def extract(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, field, value_raw, evidence): the first rule that gives a field a value counts."""
    split = reading.split_fused(blocks).withColumn("block_order", F.col("block_order") * 2 + F.col("piece"))
    pairs = fields.match_anchor_fuzzy(reading.label_value_pairs(split.withColumn("reader", F.lit("consensus")))).where("field is not null")
    raw, norm = F.col("value"), text.normalize(F.col("value"))
    nonblank = lambda c: F.nullif(c, F.lit(""))
    date = F.coalesce(dates.first_date(raw), raw)
    value = (
        F.when(F.col("field").isin(*v.MONEY_FIELDS), F.coalesce(fields.money_in(norm), raw))
        .when(F.col("field") == "tax_rate", F.coalesce(fields.percent_in(norm), raw))
        .when(F.col("field").isin(*v.DATE_FIELDS), date)
        .otherwise(raw)
    )
    item = lambda f, c, rule: F.struct(F.lit(f).alias("field"), c.alias("value_raw"), F.lit(RULES[rule]).alias("rule"))
    at = F.struct("page", "row_index")
    table = pairs.where("field <> 'ratio'").select(
        "doc_id",
        "field",
        value.alias("value_raw"),
        F.lit(0).alias("rule"),
        raw.alias("evidence"),
        at.alias("at"),
    )
    halves = F.regexp_extract_all(raw, F.lit(r"(\d+)"), F.lit(1))
    ratio = (
        pairs.where("field = 'ratio'")
        .select(
            "doc_id",
            raw.alias("evidence"),
            at.alias("at"),
            F.explode(
                F.array(
                    item("ratio_text", raw, "table"),
                    item("ratio_from", F.get(halves, F.lit(0)), "table"),
                    item("ratio_to", F.get(halves, F.lit(1)), "table"),
                )
            ).alias("x"),
        )
        .select("doc_id", "x.*", "evidence", "at")
    )
    whole = F.col("raw")
    found = [item(f, fields.prose_field(whole, f), "prose") for f in v.PROSE]
    found += [
        item("isin", F.get(text.find_isins(whole), F.lit(0)), "identifier"),
        item("ticker", F.get(text.find_tickers(whole), F.lit(0)), "identifier"),
        item("cnpj", F.get(text.find_cnpjs(whole), F.lit(0)), "identifier"),
    ]
    found += [
        item("issuer", nonblank(F.trim(F.get(F.split(whole, "\n"), F.lit(0)))), "first_block"),
        item("share_class", text.share_class(whole), "share_class"),
        item("currency", F.when(whole.contains("R$"), F.lit("BRL")), "currency"),
    ]
    free = docs.select("doc_id", F.explode(F.array(*found)).alias("x")).select("doc_id", "x.*", F.col("x.value_raw").alias("evidence"))
    free = free.withColumn("at", F.lit(None).cast(table.schema["at"].dataType))
    return fields.first_by_rule(table.unionByName(ratio.select(*table.columns)).unionByName(free.select(*table.columns)))


def repaired(rows: DataFrame) -> DataFrame:
    """Canonical values, with candidates where a date is open and the reason where a value is said to be undefined."""
    raw, field = F.col("value_raw"), F.col("field")
    date = fields.repair_date(raw, F.col("level"), F.col("reader_kind"))
    rows = rows.withColumn("_d", F.when(field.isin(*v.DATE_FIELDS), date))
    value = (
        F.when(field.isin(*v.DATE_FIELDS), dates.show(F.col("_d.value")))
        .when(field.isin(*v.MONEY_FIELDS), numbers.show_decimal(numbers.ptbr_number(raw)))
        .when(field == "tax_rate", numbers.show_decimal(numbers.rate(raw), 0))
        .when(field.isin("ratio_from", "ratio_to"), numbers.first_int(raw).cast("string"))
        .otherwise(fields.repair_identifier(field, raw))
    )
    return (
        rows.withColumn("value", value)
        .withColumn("candidates", F.coalesce("_d.candidates", F.array().cast("array<string>")))
        .withColumn("absence_reason", F.col("_d.absence_reason"))
        .drop("_d")
    )


def _wide(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Typed notices, one row per document."""
    names = [
        "issuer",
        "cnpj",
        "isin",
        "ticker",
        "share_class",
        "currency",
        "event_type_label",
        "gross_per_share",
        "tax_rate",
        "net_per_share",
        "ratio_from",
        "ratio_to",
        *v.DATE_FIELDS,
    ]
    wide = rows.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in names])
    typed = [dates.calendar_date(F.col(f)).alias(f) for f in v.DATE_FIELDS]
    typed += [
        numbers.decimal_number(F.col(f)).cast(t).alias(f) for f, t in (
            ("gross_per_share", numbers.AMOUNT),
            ("net_per_share", numbers.AMOUNT),
            ("tax_rate", numbers.RATE),
        )
    ]
    typed += [F.col(f).try_cast("int").alias(f) for f in ("ratio_from", "ratio_to")]
    out = types.join(wide, "doc_id", "left")
    out = out.select(
        *types.columns,
        *[f for f in names if f not in {*v.DATE_FIELDS, "gross_per_share", "net_per_share", "tax_rate", "ratio_from", "ratio_to"}],
        *typed,
    )
    turned = fields.order_ratio(F.col("event_type"), F.col("ratio_from"), F.col("ratio_to"))
    out = (
        out.withColumn("_r", turned)
        .withColumn("ratio_from", F.col("_r.ratio_from"))
        .withColumn("ratio_to", F.col("_r.ratio_to"))
        .drop("_r")
    )
    return out.withColumn("ex_date", fields.derive_ex_date(F.col("event_type"), F.col("ex_date"), F.col("trading_start")))


def run(
    raw_blocks: DataFrame,
    golden: DataFrame,
    specs: DataFrame,
    config: Config,
    votes: DataFrame | None = None,
    candidates: DataFrame | None = None,
    asked: DataFrame | None = None,
    returned: DataFrame | None = None,
) -> Result:
    """The whole way.  `votes` (doc_id, modality_ord, available, event_type) and
    `candidates` (doc_id, field, extractor, seq, value_raw) are what models said, if
    any; documents of `asked` (doc_id) that nobody could read are failed ones;
    `returned` (doc_id, field, value) is what a last sweep for missing fields
    brought back, taken where some reader's own text holds it."""
    blocks = staged(page.page_consensus(raw_blocks), "blocks")
    docs = staged(page.documents(blocks), "documents")
    prior = staged(classify.priors(docs, "raw"), "prior")
    own = prior.select("doc_id", F.lit(0).alias("modality_ord"), F.lit(True).alias("available"), F.col("whole_prior").alias("event_type"))
    named = classify.consensus(
        own if votes is None else own.unionByName(votes),
        prior.select("doc_id", F.col("whole_prior").alias("prior")),
    )
    types = staged(named.join(prior.select("doc_id", "title_prior", "body_prior"), "doc_id"), "types")
    found = staged(extract(blocks, docs), "found")
    disputed = None
    if candidates is not None:
        said = found.select("doc_id", "field", F.lit("rule").alias("extractor"), F.lit(0).alias("seq"), "value_raw").unionByName(candidates)
        merged = fields.merge(said, ["rule", "text"])
        # two extractors that name the same two numbers of a ratio agree, in whatever order
        same = (
            fields.ratio_pair_agrees(said)
            .where("agrees")
            .select("doc_id", F.explode(F.array(F.lit("ratio_from"), F.lit("ratio_to"))).alias("field"))
        )
        disputed = staged(merged.where("disputed").select("doc_id", "field").join(same, ["doc_id", "field"], "left_anti"), "disputed")
        found = (
            merged.select("doc_id", "field", "value_raw")
            .join(found.select("doc_id", "field", "evidence"), ["doc_id", "field"], "left")
            .withColumn("evidence", F.coalesce("evidence", "value_raw"))
        )
        found = staged(found, "merged")
    evidence = found.withColumn("evidence_id", F.col("field")).withColumn("value", F.col("value_raw"))
    numbered = blocks.withColumn("block_order", F.struct("page", "block_order"))
    at = (
        fields.locate(evidence, numbered)
        .join(numbered.select("doc_id", "block_order", "level", "kinds"), ["doc_id", "block_order"])
        .select("doc_id", F.col("evidence_id").alias("field"), "level", "kinds")
    )
    rows = found.join(at, ["doc_id", "field"], "left").join(docs.select("doc_id", "raw"), "doc_id")
    rows = rows.withColumn(
        "kinds",
        F.coalesce("kinds", F.array().cast("array<string>")),
    ).withColumn("reader_kind", F.get("kinds", F.lit(0)))
    rows = staged(fields.ground(rows).withColumnRenamed("status", "grounding").drop("raw", "near"), "grounded")
    rows = staged(repaired(rows), "repaired")
    notices = staged(_wide(rows, types), "notices")
    long = types.select("doc_id", "event_type").join(rows.select("doc_id", "field", "value", "absence_reason", "candidates"), "doc_id")
    label = types.select(
        "doc_id",
        "event_type",
        F.lit("event_type_label").alias("field"),
        F.col("event_type").alias("value"),
        F.lit(None).cast("string").alias("absence_reason"),
        F.array().cast("array<string>").alias("candidates"),
    )
    long = long.unionByName(label.join(long.where("field = 'event_type_label'"), "doc_id", "left_anti"))
    ex = notices.where("ex_date is not null").select(
        "doc_id",
        "event_type",
        F.lit("ex_date").alias("field"),
        dates.show(F.col("ex_date")).alias("value"),
        F.lit(None).cast("string").alias("absence_reason"),
        F.array().cast("array<string>").alias("candidates"),
    )
    long = long.unionByName(ex.join(long.where("field = 'ex_date' and value is not null"), "doc_id", "left_anti"))
    settled = fields.disambiguate(
        long.where("size(candidates) > 0").select("doc_id", "field", "candidates"),
        notices.select("doc_id", *v.DATE_FIELDS[:4]),
        validators.date_rules(config.window_days, config.as_of),
    ).where("value is not null")
    long = long.join(settled.select("doc_id", "field", dates.show(F.col("value")).alias("_v")), ["doc_id", "field"], "left")
    long = (
        long.withColumn("value", F.coalesce("value", "_v"))
        .withColumn("candidates", F.when(F.col("_v").isNull(), F.col("candidates")).otherwise(F.array().cast("array<string>")))
        .drop("_v")
    )
    long = staged(fields.fill_contract(long, types, specs), "fields")
    recovered = None
    if returned is not None:
        texts = F.map_from_entries(F.collect_list(F.struct("kind", "text")))
        reads = staged(reading.reads_by_kind(raw_blocks).groupBy("doc_id").agg(texts.alias("reads")), "reads")
        wanted = fields.missing_fields(long, types, specs)
        recovered = staged(fields.sweep_accept(returned, wanted, reads, reading.level_of), "recovered")
        found_again = recovered.select("doc_id", "field", F.col("value").alias("_v"))
        long = long.join(found_again, ["doc_id", "field"], "left")
        reason = F.when(F.col("_v").isNull(), F.col("absence_reason"))
        long = long.withColumn("absence_reason", reason).withColumn("value", F.coalesce("value", "_v")).drop("_v")
        long = staged(long, "swept")
    # what a row says by itself, one projection and one lookup; what is missing is told by the long form, where excuses stand
    found_by = validators.run_all(notices, golden, specs, **config.window()).where("tool <> 'check_required_fields'")
    required = validators.required_fields(long, specs).withColumn("seq", F.lit(5))
    findings = found_by.unionByName(required)
    parts = 6
    findings = staged(findings, "findings")
    reasons = triage.reasons_of(findings)
    detail = long.join(
        F.broadcast(specs.select("event_type", "field", "required")),
        ["event_type", "field"],
        "left",
    ).withColumn("required", F.coalesce("required", F.lit(False)))
    detail = detail.join(
        rows.select("doc_id", "field", "grounding", "kinds"),
        ["doc_id", "field"],
        "left",
    ).withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    more = triage.field_reasons(detail).select("doc_id", F.lit(parts).alias("seq"), "code", "field")
    odd = lambda when, code: types.where(when).select(
        "doc_id",
        F.lit(parts).alias("seq"),
        F.lit(code).alias("code"),
        F.lit(None).cast("string").alias("field"),
    )
    more = more.unionByName(odd("event_type = 'outro'", "UNKNOWN_EVENT_TYPE")).unionByName(
        odd("not unanimous and event_type <> 'outro'", "CLASSIFIER_DISAGREEMENT")
    )
    if disputed is not None:
        more = more.unionByName(
            disputed.select("doc_id", F.lit(parts).alias("seq"), F.lit("EXTRACTOR_DISAGREEMENT").alias("code"), "field")
        )
    reasons = triage.dedupe(reasons.select("doc_id", "seq", "code", "field").unionByName(more), ["doc_id", "code", "field"], ["seq"])
    reasons = staged(reasons, "reasons")
    verdicts = triage.disposition(reasons, types)
    verdicts = verdicts.withColumn("justification", audit.narrative(F.col("disposition"), F.col("codes")))
    read = rows.select("doc_id", "field", "level")
    if recovered is not None:
        read = read.join(recovered, ["doc_id", "field"], "left_anti").unionByName(recovered.select("doc_id", "field", "level"))
    verdicts = verdicts.join(triage.for_review(reasons, long), "doc_id", "left").join(
        triage.weakest_critical(long.join(read, ["doc_id", "field"], "left")),
        "doc_id",
        "left",
    )
    verdicts = verdicts.withColumn("for_review", F.coalesce("for_review", F.array().cast("array<string>")))
    if asked is not None:
        verdicts = triage.failed(asked, verdicts)
    looked_up = staged(validators.lookup(notices, golden), "lookup")
    all_fields = rows.drop("value", "absence_reason", "candidates").join(long.drop("event_type"), ["doc_id", "field"], "full_outer")
    return Result(blocks, notices, audit.annotate(all_fields, findings, looked_up), findings, reasons, verdicts)
