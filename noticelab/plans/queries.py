"""The queries of the notice engine over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import classify, fields, reading, triage, validators
from .. import vocabulary
from . import derived
from .registry import ALL, ORACLE, joined, normal_sql, query, read

AS_OF = "1998-01-01"

# --- validators and triage ---------------------------------------------------

DATES_SQL = f"""dates as (select doc_id, list_filter([
    case when approval_date > com_date then 'approval_after_com' end, case when com_date >= ex_date then 'com_not_before_ex' end,
    case when ex_date > payment_date then 'ex_after_payment' end, case when com_date > payment_date then 'com_after_payment' end,
    case when abs(approval_date - date '{AS_OF}') > 730 then 'window:approval_date' end, case when abs(com_date - date '{AS_OF}') > 730 then 'window:com_date' end,
    case when abs(ex_date - date '{AS_OF}') > 730 then 'window:ex_date' end, case when abs(payment_date - date '{AS_OF}') > 730 then 'window:payment_date' end], lambda x: x is not null) as broken from notices)"""


@query(
    "date_coherence",
    f"with {derived.NOTICES_SQL}, {DATES_SQL} select doc_id, case when len(broken) > 0 then 'fail' else 'pass' end as status, "
    f"array_to_string(broken, ',') as broken from dates",
)
def date_coherence(spark, sf_dir):
    rows = derived.notices(spark, sf_dir).withColumn("broken", validators.date_rules(730, AS_OF))
    return rows.select("doc_id", F.when(F.size("broken") > 0, "fail").otherwise("pass").alias("status"), joined("broken").alias("broken"))


AMOUNT_SQL = (
    "case when gross_per_share is null then 'info' when abs(gross_per_share * cast(cast('1' as decimal(10,6)) - tax_rate as "
    "decimal(10,6)) - net_per_share) <= cast('0.000001' as decimal(10,6)) then 'pass' else 'fail' end"
)


@query("amount_coherence", f"with {derived.NOTICES_SQL} select doc_id, {AMOUNT_SQL} as status, gross_per_share, net_per_share from notices")
def amount_coherence(spark, sf_dir):
    rows = derived.notices(spark, sf_dir).withColumn("x", validators.amount_finding())
    return rows.select("doc_id", "x.status", "gross_per_share", "net_per_share")


LOOKUP_SQL = """pairs as (select doc_id, unnest(['isin','ticker','cnpj','issuer']) as key, unnest([isin, ticker, cnpj, issuer]) as value from notices),
base as (select key, lower(value) as value, min(row_idx) as row_idx from (select row_idx, unnest(['isin','ticker','cnpj','issuer']) as key, unnest([isin, ticker, cnpj, emissor]) as value from golden) group by key, lower(value)),
hits as (select doc_id, row_idx, list_sort(list(pairs.key)) as keys from pairs join base on pairs.key = base.key and lower(pairs.value) = base.value group by doc_id, row_idx),
best as (select *, (select list_sort(flatten(list(h.keys))) from hits h where h.doc_id = b.doc_id) as matched from (select *, row_number() over (partition by doc_id order by len(keys) desc, row_idx) as n from hits) b where n = 1),
found as (select n.doc_id, case when keys is null then 'NOT_FOUND' when len(matched) > len(keys) then 'KEY_CONFLICT' when len(keys) < 2 then 'WEAK_MATCH' when status <> 'ativo' then 'INACTIVE'
    when n.share_class <> g.classe or n.isin <> g.isin or n.ticker <> g.ticker or n.cnpj <> g.cnpj then 'MISMATCH' else 'MATCH' end as outcome,
  b.row_idx, coalesce(array_to_string(keys, ','), '') as agreeing, list_filter([case when n.share_class <> g.classe then 'share_class' end, case when n.isin <> g.isin then 'isin' end, case when n.ticker <> g.ticker then 'ticker' end, case when n.cnpj <> g.cnpj then 'cnpj' end], lambda x: x is not null) as differing
  from notices n left join best b on n.doc_id = b.doc_id left join golden g on g.row_idx = b.row_idx)"""


@query(
    "golden_lookup",
    f"with {derived.NOTICES_SQL}, {derived.GOLDEN_SQL}, {LOOKUP_SQL} select doc_id, outcome, row_idx, agreeing, case when outcome = "
    f"'MISMATCH' then array_to_string(differing, ',') else '' end as mismatched from found",
)
def golden_lookup(spark, sf_dir):
    found = validators.lookup(derived.notices(spark, sf_dir), derived.golden(spark, sf_dir))
    return found.select("doc_id", "outcome", "row_idx", joined("agreeing").alias("agreeing"), joined("mismatched").alias("mismatched"))


SPECS_SQL = "specs as (select * from (values " + ", ".join(
    f"('{t}', '{f}', {str(k == 0).lower()})" for t, sides in vocabulary.FIELD_SPECS.items() for k, side in enumerate(sides) for f in side
) + ") s(event_type, field, required))"
LONG_SQL = "long as (select doc_id, event_type, unnest([" + ", ".join(f"'{f}'" for f in validators.FIELDS) + "]) as field, unnest([" + ", ".join(
    f"cast({f} as varchar)" for f in validators.FIELDS
) + "]) as value from notices)"
MISSING_SQL = (
    "lacking as (select n.doc_id, list_sort(list(s.field)) as missing from notices n join specs s using (event_type) where s.required "
    "and not exists (select 1 from long l where l.doc_id = n.doc_id and l.field = s.field and l.value is not null) group by n.doc_id)"
)


@query(
    "required_fields",
    f"with {derived.NOTICES_SQL}, {SPECS_SQL}, {LONG_SQL}, {MISSING_SQL} select n.doc_id, case when missing is null then 'pass' else "
    f"'fail' end as status, coalesce(array_to_string(missing, ','), '') as missing from notices n left join lacking using (doc_id)",
)
def required_fields(spark, sf_dir):
    rows = derived.notices(spark, sf_dir)
    rows = rows.withColumn("missing", validators.lacking(rows.columns))
    return rows.select(
        "doc_id",
        F.when(F.size("missing") > 0, "fail").otherwise("pass").alias("status"),
        joined("missing").alias("missing"),
    )


TYPE_SQL = (
    "list_filter([case when title_prior <> body_prior then 'EVENT_TYPE_TITLE_CONFLICT' end, case when body_prior <> event_type then "
    "'CLASSIFIER_DISAGREEMENT' end], lambda x: x is not null)"
)


@query(
    "event_type_consistency",
    f"with {derived.NOTICES_SQL} select doc_id, case when len({TYPE_SQL}) > 0 then 'warn' else 'pass' end as status, "
    f"array_to_string({TYPE_SQL}, ',') as codes from notices",
)
def event_type_consistency(spark, sf_dir):
    return validators.event_type_consistency(derived.notices(spark, sf_dir)).select(
        "doc_id",
        "status",
        joined("reason_codes").alias("codes"),
    )


ISIN_SQL = """(regexp_full_match(isin, '[A-Z]{2}[A-Z0-9]{9}[0-9]') and list_sum(list_transform(range(1, len(expanded) + 1), lambda i:
  case when (len(expanded) - i) % 2 = 1 then (2 * cast(expanded[i] as int)) // 10 + (2 * cast(expanded[i] as int)) % 10 else cast(expanded[i] as int) end)) % 10 = 0)"""
CNPJ_W = {12: [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], 13: [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]}
CNPJ_SUM = {n: " + ".join(f"{w} * cast(cnpj[{i + 1}] as int)" for i, w in enumerate(ws)) for n, ws in CNPJ_W.items()}
CNPJ_SQL = "(len(cnpj) = 14 and len(list_distinct(string_split(cnpj, ''))) > 1 and " + " and ".join(
    f"(case when ({CNPJ_SUM[n]}) % 11 < 2 then 0 else 11 - ({CNPJ_SUM[n]}) % 11 end) = cast(cnpj[{n + 1}] as int)" for n in (12, 13)
) + ")"


@query(
    "identifier_format",
    f"""with {derived.NOTICES_SQL}, ex as (select *, array_to_string(list_transform(string_split(isin, ''), lambda c: case when c between '0' and '9' then c else cast(ascii(c) - 55 as varchar) end), '') as expanded from notices)
    select doc_id, {ISIN_SQL} as isin_ok, coalesce({CNPJ_SQL}, false) as cnpj_ok from ex""",
)
def identifier_format(spark, sf_dir):
    rows = validators.identifier_checks(derived.notices(spark, sf_dir))
    return rows.select("doc_id", "isin_ok", F.coalesce("cnpj_ok", F.lit(False)).alias("cnpj_ok"))


REASONS_SQL = f"""reasons as (
  select doc_id, 'DATE_INCOHERENCE' as code, unnest(['approval_date','com_date','ex_date','payment_date']) as field from dates where len(broken) > 0
  union all select doc_id, 'AMOUNT_MISMATCH', unnest(['gross_per_share','tax_rate','net_per_share']) from notices where {AMOUNT_SQL} = 'fail'
  union all select doc_id, unnest({TYPE_SQL}), 'event_type' from notices
  union all select doc_id, 'MISSING_REQUIRED_FIELD', unnest(missing) from lacking
  union all select doc_id, case outcome {' '.join(f"when '{k}' then '{x}'" for k, x in vocabulary.LOOKUP_REASON.items())} end, f.field
    from found left join (select doc_id as fd, unnest(differing) as field from found where outcome = 'MISMATCH') f on f.fd = found.doc_id where outcome <> 'MATCH')"""
BLOCKING_SQL = ", ".join(f"'{k}'" for k, x in vocabulary.REASONS.items() if x[0] == "block")
VERDICT_SQL = (
    f"verdicts as (select n.doc_id, case when count(code) = 0 then 'auto' when bool_or(code in ({BLOCKING_SQL})) then 'blocked' else "
    f"'review' end as disposition, count(code) as n_reasons from notices n left join reasons r on r.doc_id = n.doc_id group by n.doc_id)"
)
TRIAGE_SQL = (
    f"with {derived.NOTICES_SQL}, {derived.GOLDEN_SQL}, {DATES_SQL}, {LOOKUP_SQL}, {SPECS_SQL}, {LONG_SQL}, {MISSING_SQL}, {REASONS_SQL}, "
    f"{VERDICT_SQL} "
)


def _judged(spark, sf_dir):
    rows = validators.run_rows(derived.notices(spark, sf_dir), derived.golden(spark, sf_dir), window_days=730, as_of=AS_OF)
    return triage.judged(rows)


def _reasons(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", F.explode("reasons").alias("r")).select("doc_id", "r.*")


@query(
    "triage_summary",
    TRIAGE_SQL + "select count(*) as total, count(*) filter (disposition = 'auto') as n_auto, count(*) filter (disposition = 'review') as n_review, count(*) filter (disposition = 'blocked') as n_blocked, cast(round(count(*) filter (disposition = 'auto') / count(*), 4) as decimal(6,4)) as stp_rate, cast(1 - cast(round(count(*) filter (disposition = 'auto') / count(*), 4) as decimal(6,4)) as decimal(6,4)) as exception_rate from verdicts",
)
def triage_summary(spark, sf_dir):
    return triage.summary(_judged(spark, sf_dir))


@query("triage_documents", TRIAGE_SQL + "select doc_id, disposition, n_reasons from verdicts")
def triage_documents(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "disposition", "n_reasons")


@query("reasons_histogram", TRIAGE_SQL + "select code, count(*) as n from reasons group by code")
def reasons_histogram(spark, sf_dir):
    return triage.histogram(_reasons(_judged(spark, sf_dir)), "code")


LAYER_SQL = "case " + " ".join(f"when code = '{k}' then '{x[1]}'" for k, x in vocabulary.REASONS.items()) + " end"


@query("reasons_by_layer", TRIAGE_SQL + f"select doc_id, {LAYER_SQL} as layer, count(*) as n from reasons group by all")
def reasons_by_layer(spark, sf_dir):
    return triage.histogram(_reasons(_judged(spark, sf_dir)).withColumn("layer", triage.layer(F.col("code"))), "doc_id", "layer")


@query(
    "reasons_dedup",
    "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) "
    "as n from events) where n = 1",
)
def reasons_dedup(spark, sf_dir):
    return triage.dedupe(
        read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"),
        ["user_id", "event_type"],
        ["ts", "event_id"],
    ).drop("ts")


@query(
    "batch_id",
    "select 'AS-20240101-' || upper(left(sha256(array_to_string(list_sort(list(c_name)), '|')), 6)) as batch_id from customer",
)
def batch_id(spark, sf_dir):
    return triage.batch_id(read(spark, sf_dir, "customer"), "c_name", "20240101")


# --- classification ----------------------------------------------------------

MARKERS_SQL = "markers as (select * from (values " + ", ".join(
    f"({i}, '{t}', '{text.spaced_pattern(p)}', cast({w} as decimal(4,2)))" for i, (t, p, w, _) in enumerate(vocabulary.MARKERS)
) + ") m(ordinal, event_type, pattern, weight))"
NORMAL = "lower(strip_accents({}))"
SPLIT_SQL = """parts as (select doc_id, raw, string_split(raw, chr(10)) as lines, case when starts_with(raw, 'Aviso') then case when len(string_split(raw, chr(10))[2]) < 60 then 2 else 1 end else 4 end as upto from texts),
split as (select doc_id, raw as whole, array_to_string(lines[:upto], chr(10)) as title, array_to_string(lines[upto + 1:], chr(10)) as body from parts)"""


@query("title_body_split", f"with {derived.TEXTS_SQL}, {SPLIT_SQL} select doc_id, title, body from split")
def title_body_split(spark, sf_dir):
    part = text.split_title_body(F.col("raw"))
    return derived.texts(spark, sf_dir).select("doc_id", part["title"].alias("title"), part["body"].alias("body"))


@query(
    "marker_scores",
    f"with {derived.TEXTS_SQL}, {MARKERS_SQL} select doc_id, event_type, cast(sum(weight) as decimal(8,2)) as score from texts, markers "
    f"where regexp_matches({NORMAL.format('raw')}, pattern) group by doc_id, event_type",
)
def marker_scores(spark, sf_dir):
    return classify.marker_scores(derived.texts(spark, sf_dir), "raw").drop("ordinal")


def _prior_sql(part: str) -> str:
    return f"{part}_p as (select doc_id, event_type as {part}_prior from (select doc_id, event_type, row_number() over (partition by doc_id order by sum(weight) desc, min(ordinal)) as n from split, markers where regexp_matches({NORMAL.format(part)}, pattern) group by doc_id, event_type) where n = 1)"


PRIOR_SQL = f"{derived.TEXTS_SQL}, {MARKERS_SQL}, {SPLIT_SQL}, {_prior_sql('whole')}, {_prior_sql('title')}, {_prior_sql('body')}"


@query(
    "marker_prior",
    f"with {PRIOR_SQL} select doc_id, whole_prior, title_prior, body_prior, coalesce(title_prior <> body_prior, false) as conflict from "
    f"split left join whole_p using (doc_id) left join title_p using (doc_id) left join body_p using (doc_id)",
)
def marker_prior(spark, sf_dir):
    return classify.prior(derived.texts(spark, sf_dir), "raw")


VOTE_SQL = {
    k: derived.by_remainder(x, [f"'{t}'" for t in vocabulary.EVENT_TYPES]) for k, x in {
        "rule": "o_orderkey",
        "text": "(o_orderkey + case when o_orderkey % 5 = 0 then 1 else 0 end)",
    }.items()
}
VOTES_SQL = "votes as (" + " union all ".join(
    f"select o_orderkey as doc_id, {k} as modality_ord, o_orderkey % {7 + k} <> 0 as available, case when o_orderkey % {11 + k} = 0 then null else {x} end as event_type from orders" for k, x in enumerate(
        VOTE_SQL.values()
    )
) + f"), priors as (select o_orderkey as doc_id, case when o_orderkey % 10 = 0 then {VOTE_SQL['text']} else {VOTE_SQL['rule']} end as prior from orders)"


@query(
    "classifier_consensus",
    f"""with {VOTES_SQL}, counts as (select v.doc_id, event_type, count(*) as n, min(modality_ord) as o, any_value(prior) as prior from votes v join priors using (doc_id) where available and event_type is not null group by v.doc_id, event_type),
    won as (select *, row_number() over (partition by doc_id order by n desc, event_type = prior desc, o) as k, count(*) over (partition by doc_id) as types from counts)
    select p.doc_id, coalesce(w.event_type, 'outro') as event_type, coalesce(types = 1, false) as unanimous, coalesce(types = 1, false) or coalesce(p.prior = w.event_type, false) as agrees_with_prior,
    (select count(*) from votes v where v.doc_id = p.doc_id and available) as n_available from priors p left join won w on w.doc_id = p.doc_id and k = 1""",
)
def classifier_consensus(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    vote = lambda k, x: rows.selectExpr(
        "o_orderkey as doc_id",
        f"{k} as modality_ord",
        f"o_orderkey % {7 + k} <> 0 as available",
        f"case when o_orderkey % {11 + k} = 0 then null else {x} end as event_type",
    )
    votes = [vote(k, x) for k, x in enumerate(VOTE_SQL.values())]
    priors = rows.selectExpr(
        "o_orderkey as doc_id",
        f"case when o_orderkey % 10 = 0 then {VOTE_SQL['text']} else {VOTE_SQL['rule']} end as prior",
    )
    return classify.consensus(votes[0].unionByName(votes[1]), priors)


# --- readings ----------------------------------------------------------------

LEVEL_SQL = (
    "case when list_contains(kinds, 'text_layer') then case when len(kinds) > 1 then 'muito_alta' else 'alta' end when len(kinds) > 1 "
    "then 'media' else 'baixa' end"
)


@query(
    "reading_level",
    f"with {derived.READINGS_SQL}, g as (select doc_id, region_id, list_distinct(list(kind)) as kinds from readings group by doc_id, "
    f"region_id) select doc_id, region_id, {LEVEL_SQL} as level from g",
)
def reading_level(spark, sf_dir):
    return derived.readings(spark, sf_dir).groupBy("doc_id", "region_id").agg(reading.level_of(F.collect_set("kind")).alias("level"))


BAD_ISINS = r"list_filter(regexp_extract_all(upper(text), '\b([A-Z]{2}[A-Z0-9]{8,10}[0-9])\b', 1), lambda x: len(x) <> 12)"
BAD_DATES = (
    r"list_filter(regexp_extract_all(text, '\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b', 1), lambda x: try_cast(string_split(x, '/')[3] || '-' "
    r"|| string_split(x, '/')[2] || '-' || string_split(x, '/')[1] as date) is null)"
)
FLAW_SQL = f"len({BAD_ISINS}) + len({BAD_DATES}) > 0"
KEY_SQL = (
    "lower(regexp_replace(case when text like 'R$ %' then 'R$' || regexp_replace(regexp_replace(replace(replace(text, 'R$ ', ''), '.', "
    "''), '0+$', ''), ',', '·') else text end, '[\\s.,;:()/-]', '', 'g'))"
)
RESOLVE_SQL = f"""{derived.READINGS_SQL}, flagged as (select *, coalesce({FLAW_SQL}, false) as flawed, {KEY_SQL} as key, case kind when 'text_layer' then 0.02 when 'ocr_deterministic' then 0.1 else 0.25 end as err from readings),
sized as (select *, count(*) over r as n, count(*) filter (flawed) over r as bad from flagged window r as (partition by doc_id, region_id)),
groups as (select doc_id, region_id, key, any_value(n) as n, any_value(bad) as bad, list_distinct(list(kind)) as kinds, min(seq) as seq, arg_min(text, err) as text from sized where not flawed or bad = n group by doc_id, region_id, key),
ranked as (select *, list_position(['muito_alta','alta','media','baixa'], {LEVEL_SQL}) as place from groups),
resolved as (select *, case when bad = n then 'baixa' else ['muito_alta','alta','media','baixa'][least(place + bad, 4)] end as level from (select *, row_number() over (partition by doc_id, region_id order by place, seq) as k from ranked) where k = 1)"""


@query(
    "vote_resolution",
    f"with {RESOLVE_SQL} select doc_id, region_id, text, level, case when bad = n then 0 else bad end as n_eliminated from resolved",
)
def vote_resolution(spark, sf_dir):
    return reading.resolve(derived.readings(spark, sf_dir)).select("doc_id", "region_id", "text", "level", "n_eliminated")


@query(
    "weakest_level",
    f"with {RESOLVE_SQL} select region_id, "
    f"['muito_alta','alta','media','baixa'][max(list_position(['muito_alta','alta','media','baixa'], level))] as level, count(*) as n "
    f"from resolved group by region_id",
)
def weakest_level(spark, sf_dir):
    rows = reading.resolve(derived.readings(spark, sf_dir))
    return rows.groupBy("region_id").agg(reading.weakest(F.col("level")).alias("level"), F.count("*").alias("n"))


FLAWS_SQL = f"list_concat(list_transform({BAD_ISINS}, lambda x: 'isin:' || x), list_transform({BAD_DATES}, lambda x: 'date:' || x))"


@query("structural_flaws", f"with {derived.READINGS_SQL} select doc_id, reader, array_to_string({FLAWS_SQL}, ',') as flaws from readings")
def structural_flaws(spark, sf_dir):
    return derived.readings(spark, sf_dir).select("doc_id", "reader", joined(text.structural_flaws(F.col("text"))).alias("flaws"))


@query(
    "combined_error",
    f"with {derived.READINGS_SQL}, g as (select doc_id, list_distinct(list(kind)) as kinds from readings group by doc_id) select "
    f"doc_id, cast(case when len(kinds) = 1 then case kinds[1] when 'text_layer' then 0.02 when 'ocr_deterministic' then 0.1 else 0.25 "
    f"end when not list_contains(kinds, 'text_layer') then 0.05 else 0.02 * (case when list_contains(kinds, 'ocr_deterministic') then "
    f"0.1 else 1 end) * (case when list_contains(kinds, 'ocr_generative') then 0.25 else 1 end) end as decimal(8,5)) as error from g",
)
def combined_error(spark, sf_dir):
    return (
        derived.readings(spark, sf_dir)
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("k"))
        .select("doc_id", reading.combined_error(F.col("k")).cast("decimal(8,5)").alias("error"))
    )


REFERENCE_SQL = (
    "reference as (select doc_id, page, reader from (select doc_id, page, reader, row_number() over (partition by doc_id, page order by "
    "count(*) desc, reader) as n from boxes group by doc_id, page, reader) where n = 1)"
)
MATCH_SQL = f"""{derived.BOXES_SQL}, {REFERENCE_SQL},
paired as (select a.doc_id, a.page, a.block_order as anchor, b.reader, b.block_order, b.y0, b.x0,
  greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) as overlap
  from boxes a join reference r on a.doc_id = r.doc_id and a.page = r.page and a.reader = r.reader join boxes b on b.doc_id = a.doc_id and b.page = a.page and b.reader <> a.reader)"""


@query(
    "spatial_match",
    f"with {MATCH_SQL} select doc_id, anchor, reader, block_order, cast(round(overlap * 10000) as bigint) as overlap from (select *, "
    f"row_number() over (partition by doc_id, page, anchor, reader order by overlap desc, y0, x0, block_order) as n from paired where "
    f"overlap >= 0.15) where n = 1",
)
def spatial_match(spark, sf_dir):
    rows = reading.spatial_match(derived.boxes(spark, sf_dir), ["r0", "r1", "r2"])
    return rows.select("doc_id", "anchor", "reader", "block_order", F.round(F.col("overlap") * 10000).cast("long").alias("overlap"))


CELLS_SQL = (
    f"{derived.BOXES_SQL}, cells as materialized (select doc_id, page, reader, cast(substr(reader, 2) as int) as reader_ord, "
    f"cast(block_order // 10 as int) as row, 0 as col, x0, y0, x1, y1, (doc_id + block_order) % 4 = 0 as pending from boxes)"
)
SHARED_SQL = (
    "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / least((a.x1 - a.x0) "
    "* (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))"
)


@query(
    "cell_geometry_lending",
    f"""with {CELLS_SQL}, shape as (select doc_id, page, reader, max(row) + 1 as n_rows, max(col) + 1 as n_cols from cells group by doc_id, page, reader),
    placed as materialized (select c.*, n_rows, n_cols from cells c join shape using (doc_id, page, reader)),
    asks as materialized (select * from placed where pending), gives as materialized (select * from placed where not pending),
    offers as materialized (select a.doc_id, a.page, a.reader, a.row, a.col, b.x0, b.y0, dense_rank() over (partition by a.doc_id, a.page, a.reader order by b.reader_ord) as k
      from asks a join gives b on a.doc_id = b.doc_id and a.page = b.page and a.row = b.row and a.col = b.col and a.n_rows = b.n_rows and a.n_cols = b.n_cols
      where a.reader <> b.reader and {SHARED_SQL} >= 0.15), lent as materialized (select * from offers where k = 1)
    select doc_id, reader, row, cast(coalesce(o.x0, r.x0) as bigint) as x0, cast(coalesce(o.y0, r.y0) as bigint) as y0, pending and o.x0 is null as pending
    from placed r left join lent o using (doc_id, page, reader, row, col)""",
)
def cell_geometry_lending(spark, sf_dir):
    cells = derived.boxes(spark, sf_dir, by_page=True).selectExpr(
        "doc_id",
        "page",
        "reader",
        "cast(substr(reader, 2) as int) as reader_ord",
        "cast(block_order div 10 as int) as row",
        "0 as col",
        "x0",
        "y0",
        "x1",
        "y1",
        "(doc_id + block_order) % 4 = 0 as pending",
    )
    return reading.lend_geometry(cells).select(
        "doc_id",
        "reader",
        "row",
        F.col("box.x0").cast("long").alias("x0"),
        F.col("box.y0").cast("long").alias("y0"),
        "pending",
    )


def clusters_sql(order: str, chained: bool) -> str:
    """The rows of each page by a recursion over its blocks: a list of rows, each with the height that decides and its members."""
    height = "{'y0': y0, 'y1': y1}"
    member = "{'x0': x0, 'b': block_order}"
    seed = height if chained else "rows[p].seed"
    near = "greatest(least(r.seed.y1, i.y1) - greatest(r.seed.y0, i.y0), 0) / least(r.seed.y1 - r.seed.y0, i.y1 - i.y0) >= 0.5"
    return f"""{derived.BOXES_SQL}, items as materialized (select *, row_number() over (partition by doc_id, page, reader order by {order}) as k from boxes),
folded as (select doc_id, page, reader, cast(0 as bigint) as k, cast([] as struct(seed struct(y0 double, y1 double), members struct(x0 double, b int)[])[]) as rows from (select distinct doc_id, page, reader from items)
  union all select doc_id, page, reader, k + 1, case when p is null then list_append(rows, {{'seed': {height}, 'members': [{member}]}})
    else list_concat(list_concat(rows[:p - 1], [{{'seed': {seed}, 'members': list_append(rows[p].members, {member})}}]), rows[p + 1:]) end
  from (select f.*, i.block_order, i.x0, i.y0, i.y1, list_position(list_transform(f.rows, lambda r: {near}), true) as p from folded f join items i on i.doc_id = f.doc_id and i.page = f.page and i.reader = f.reader and i.k = f.k + 1)),
done as (select doc_id, page, reader, arg_max(rows, k) as rows from folded group by all),
each as (select doc_id, page, reader, unnest(range(0, len(rows))) as row_index, unnest(rows) as r from done),
clusters as (select doc_id, page, reader, unnest(list_sort(r.members)).b as block_order, cast(row_index as int) as row_index, cast(unnest(range(0, len(r.members))) as int) as col_index, cast(len(r.members) as int) as n_cols from each)"""


@query("row_clusters_seeded", f"with recursive {clusters_sql('y0, x0, block_order', False)} select * from clusters")
def row_clusters_seeded(spark, sf_dir):
    return reading.cluster_rows(derived.boxes(spark, sf_dir))


@query("row_clusters_chained", f"with recursive {clusters_sql('y0, block_order', True)} select * from clusters")
def row_clusters_chained(spark, sf_dir):
    return reading.cluster_rows(derived.boxes(spark, sf_dir), chained=True)


def _texted(spark, sf_dir):
    return derived.boxes(spark, sf_dir).withColumn("text", F.concat(F.lit("b"), F.col("block_order").cast("string")))


@query(
    "label_value_pairs",
    f"with recursive {clusters_sql('y0, block_order', True)} select doc_id, page, reader, row_index, 'b' || arg_min(block_order, "
    f"col_index) as label, 'b' || arg_max(block_order, col_index) as value from clusters where n_cols >= 2 group by doc_id, page, "
    f"reader, row_index",
)
def label_value_pairs(spark, sf_dir):
    return reading.label_value_pairs(_texted(spark, sf_dir))


@query(
    "table_roles",
    f"with recursive {clusters_sql('y0, block_order', True)} select doc_id, page, reader, block_order, case when n_cols >= 2 then "
    f"'table_cell' end as role, case when n_cols >= 2 then row_index end as row, case when n_cols >= 2 then col_index end as col from "
    f"clusters",
)
def table_roles(spark, sf_dir):
    return reading.table_roles(derived.boxes(spark, sf_dir))


@query(
    "visual_rows",
    f"""with recursive {clusters_sql('y0, x0, block_order', False)},
    r as (select c.doc_id, c.page, c.reader, c.row_index, string_agg('b' || c.block_order, ' ' order by c.col_index) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1,
      ['muito_alta','alta','media','baixa'][max(1 + (c.doc_id + c.block_order) % 4)] as level from clusters c join boxes b on b.doc_id = c.doc_id and b.page = c.page and b.reader = c.reader and b.block_order = c.block_order group by all)
    select doc_id, page, reader, text, level, cast(x0 as bigint) as x0, cast(y1 as bigint) as y1, cast(row_number() over (partition by doc_id, page, reader order by y0, x0, row_index) - 1 as int) as block_order from r""",
)
def visual_rows(spark, sf_dir):
    from ..operators import page

    level = F.get(F.array(*map(F.lit, vocabulary.LADDER)), ((F.col("doc_id") + F.col("block_order")) % 4).cast("int"))
    rows = page.visual_rows(_texted(spark, sf_dir).withColumn("kind", F.lit("text_layer")).withColumn("level", level))
    return rows.select(
        "doc_id",
        "page",
        "reader",
        "text",
        "level",
        F.col("x0").cast("long").alias("x0"),
        F.col("y1").cast("long").alias("y1"),
        "block_order",
    )


@query(
    "grid_shape",
    f"with {CELLS_SQL} select doc_id, page, reader, max(row) + 1 as n_rows, max(col) + 1 as n_cols from cells group by all",
)
def grid_shape(spark, sf_dir):
    return reading.grid_shape(
        derived.boxes(spark, sf_dir).selectExpr("doc_id", "page", "reader", "cast(block_order div 10 as int) as row", "0 as col")
    )


@query(
    "reader_concat",
    "select conv_id, role, string_agg(text, chr(10) order by turn, text) as text from conversations where trim(text) <> '' group by "
    "conv_id, role",
)
def reader_concat(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("role").alias("kind"),
        F.col("turn").alias("page"),
        F.lit(0).alias("block_order"),
        "text",
    )
    return reading.reads_by_kind(rows).select(F.col("doc_id").alias("conv_id"), F.col("kind").alias("role"), "text")


# --- fields ------------------------------------------------------------------

LABELS = [
    "'Valor bruto por ação ON'",
    "'Data-base (data com):'",
    "'Data de pagamento'",
    "'Fator de grupamento'",
    "'Observação'",
    "'IRRF na fonte'",
    "'Crédito das ações bonificadas'",
]
TIGHT = "' .,;:()/\"-'"
ANCHORS_SQL = "anchors as (select * from (values " + ", ".join(
    "({}, '{}', '{}')".format(i, f, a.replace("'", "''")) for i, (f, a) in enumerate(
        (f, a) for f, names in vocabulary.ANCHORS.items() for a in names
    )
) + ") a(ordinal, field, anchor))"


@query(
    "anchor_match",
    f"with {ANCHORS_SQL}, l as (select o_orderkey as doc_id, {derived.by_remainder('o_orderkey', LABELS)} as label from orders), hits "
    f"as (select doc_id, field, anchor, row_number() over (partition by doc_id order by len(anchor) desc, ordinal) as n from l, anchors "
    f"where contains(lower(strip_accents(label)), anchor) or contains(translate(lower(strip_accents(label)), {TIGHT}, ''), "
    f"translate(anchor, {TIGHT}, ''))) select l.doc_id, field, anchor from l left join hits h on h.doc_id = l.doc_id and n = 1",
)
def anchor_match(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"{derived.by_remainder('o_orderkey', LABELS)} as label")
    return fields.match_anchor(rows).select("doc_id", "field", "anchor")


@query(
    "disambiguate",
    f"with {derived.NOTICES_SQL}, c as (select doc_id, unnest(['01','02','11','12','21','22']) as dd, com_date, payment_date, "
    f"approval_date from notices), t as (select *, make_date(year(com_date), month(com_date), cast(dd as int)) as ex from c), g as "
    f"(select doc_id, count(*) as n, min(ex) as ex from t where coalesce(com_date < ex, true) and coalesce(ex <= payment_date, true) "
    f"and coalesce(approval_date <= com_date, true) and coalesce(com_date <= payment_date, true) group by doc_id) select n.doc_id, "
    f"coalesce(g.n, 0) as n_left, case when g.n = 1 then ex end as value from notices n left join g using (doc_id)",
)
def disambiguate(spark, sf_dir):
    notices = derived.notices(spark, sf_dir)
    days = F.array(*map(F.lit, ("01", "02", "11", "12", "21", "22")))
    rows = notices.select(
        "doc_id",
        F.lit("ex_date").alias("field"),
        F.transform(days, lambda x: F.concat(x, F.lit("/"), F.date_format("com_date", "MM/yyyy"))).alias("candidates"),
    )
    return fields.disambiguate(rows, notices, validators.date_rules(10**6, AS_OF)).drop("field")


@query(
    "ptbr_format",
    "select o_orderkey as doc_id, replace(replace(replace(format('{:,.2f}', cast(cast(o_totalprice as decimal(15,2)) as double)), ',', "
    "'#'), '.', ','), '#', '.') as shown from orders",
)
def ptbr_format(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        numbers.show_decimal(F.col("o_totalprice").cast("decimal(15,2)")).alias("shown"),
    )


@query("tax_rates", "select o_orderkey as doc_id, cast((o_orderkey % 400) * 0.1 * 0.01 as decimal(10,6)) as rate from orders")
def tax_rates(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        numbers.rate(
            F.concat(
                F.floor(F.col("o_orderkey") % 400 / 10).cast("string"),
                F.lit(","),
                (F.col("o_orderkey") % 10).cast("string"),
                F.lit("%"),
            )
        ).alias("rate"),
    )


RATIO_SQL = (
    f"r as ({{}} {derived.by_remainder('o_orderkey', [chr(39) + t + chr(39) for t in vocabulary.EVENT_TYPES])} as event_type, "
    f"cast(o_custkey % 10 as int) as a, cast(o_orderkey % 4 as int) as b from orders)"
)


@query(
    "ratio_order",
    f"with {RATIO_SQL.format('select o_orderkey as doc_id,')}, w as (select *, event_type in "
    f"('bonificacao','grupamento','desdobramento') and a <> b and case when event_type = 'grupamento' then a < b else a > b end as "
    f"swapped from r) select doc_id, case when swapped then b else a end as ratio_from, case when swapped then a else b end as "
    f"ratio_to, swapped from w",
)
def ratio_order(spark, sf_dir):
    rows = (
        derived.notices(spark, sf_dir)
        .select("doc_id", "event_type")
        .join(
            read(spark, sf_dir, "orders").selectExpr(
                "o_orderkey as doc_id",
                "cast(o_custkey % 10 as int) as a",
                "cast(o_orderkey % 4 as int) as b",
            ),
            "doc_id",
        )
    )
    return rows.select("doc_id", fields.order_ratio(F.col("event_type"), F.col("a"), F.col("b")).alias("r")).select("doc_id", "r.*")


@query(
    "derive_ex_date",
    f"with {derived.NOTICES_SQL} select doc_id, case when event_type in ('bonificacao','grupamento','desdobramento') and ex_date is "
    f"null then payment_date else ex_date end as ex_date from notices",
)
def derive_ex_date(spark, sf_dir):
    return derived.notices(spark, sf_dir).select(
        "doc_id",
        fields.derive_ex_date(F.col("event_type"), F.col("ex_date"), F.col("payment_date")).alias("ex_date"),
    )


@query(
    "missing_fields",
    f"with {derived.NOTICES_SQL}, {SPECS_SQL}, {LONG_SQL} select n.doc_id, s.field, s.required from notices n join specs s using "
    f"(event_type) where not exists (select 1 from long l where l.doc_id = n.doc_id and l.field = s.field and l.value is not null)",
)
def missing_fields(spark, sf_dir):
    notices = derived.notices(spark, sf_dir)
    return fields.missing_fields(validators.as_fields(notices), notices, vocabulary.field_specs(spark))


@query(
    "uncorroborated",
    f"with {derived.READINGS_SQL} select doc_id, 'f' || cast(region_id as varchar) as field from readings where (doc_id + seq) % 2 = 0 "
    f"group by doc_id, region_id having count(distinct kind) = 1 and min(kind) <> 'text_layer'",
)
def uncorroborated(spark, sf_dir):
    rows = (
        derived.readings(spark, sf_dir)
        .where("(doc_id + seq) % 2 = 0")
        .groupBy("doc_id", F.concat(F.lit("f"), F.col("region_id").cast("string")).alias("field"))
        .agg(F.collect_set("kind").alias("kinds"), F.first("text").alias("value"))
    )
    return fields.uncorroborated(rows)


# --- other tables ------------------------------------------------------------


@query(
    "turn_latest",
    "select conv_id, role, turn, text from (select *, row_number() over (partition by conv_id, role order by turn desc) as n from "
    "conversations) where n = 1",
)
def turn_latest(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("role").alias("field"),
        F.lit("x").alias("extractor"),
        F.col("turn").alias("seq"),
        "text",
    )
    return fields.latest(rows).select(F.col("doc_id").alias("conv_id"), F.col("field").alias("role"), F.col("seq").alias("turn"), "text")


@query(
    "page_text_blocks",
    "select page_id, cast(n - 1 as int) as block_order, block from (select page_id, unnest(b) as block, unnest(range(1, len(b) + 1)) "
    "as n from (select page_id, list_filter(list_transform(regexp_split_to_array(html, '<[^>]*>'), lambda x: trim(regexp_replace(x, '[ "
    "\\t\\n\\r]+', ' ', 'g'))), lambda x: x <> '') as b from pages))",
)
def page_text_blocks(spark, sf_dir):
    from ..sources.files import text_blocks

    return text_blocks(read(spark, sf_dir, "pages"), "page_id", "html")


@query("events_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def events_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(
    "cache_keys",
    "select user_id, event_type, left(sha256(event_type || chr(0) || cast(user_id as varchar) || chr(0)), 32) as key from (select "
    "distinct user_id, event_type from events)",
)
def cache_keys(spark, sf_dir):
    return (
        read(spark, sf_dir, "events")
        .select("user_id", "event_type")
        .distinct()
        .withColumn("key", text.cache_key(F.col("event_type"), F.col("user_id").cast("string")))
    )


@query(
    "stp_by_segment",
    TRIAGE_SQL + "select c_mktsegment as segment, count(*) as n, cast(round(count(*) filter (disposition = 'auto') / count(*), 4) as decimal(6,4)) as stp_rate from verdicts v join orders o on o.o_orderkey = v.doc_id join customer on c_custkey = o_custkey group by c_mktsegment",
)
def stp_by_segment(spark, sf_dir):
    segments = (
        read(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c_custkey"))
        .join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    )
    out = _judged(spark, sf_dir).select("doc_id", "disposition").join(segments, "doc_id")
    return out.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.expr("double(disposition = 'auto')")), 4).cast("decimal(6,4)").alias("stp_rate"),
    )
