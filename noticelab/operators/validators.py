"""The six deterministic validators, each a table of findings.

A finding is (doc_id, tool, status, reason_codes, fields_affected).  Notices
are wide rows; unknown event types follow the generic contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from .. import vocabulary as v

LOOKUP = ("outcome", "row_idx", "agreeing", "conflicting", "mismatched")
FINDING = ("doc_id", "tool", "status", "reason_codes", "fields_affected")


def _texts(*items: Column) -> Column:
    """The non-null items, as an array of strings."""
    return F.array_compact(F.array(*[x.cast("string") for x in items])) if items else F.array().cast("array<string>")


def _struct(tool: str, status: Column, reasons: Column, fields: Column) -> Column:
    return F.struct(F.lit(tool).alias("tool"), status.alias("status"), reasons.alias("reason_codes"), fields.alias("fields_affected"))


def _names(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def _finding(rows: DataFrame, found: Column) -> DataFrame:
    return rows.select("doc_id", found.alias("x")).select("doc_id", "x.*")


def lookup(notices: DataFrame, golden: DataFrame) -> DataFrame:
    """(doc_id, outcome, row_idx, agreeing, conflicting, mismatched) of each notice."""
    return _looked_up(notices, golden).select("doc_id", *LOOKUP)


def _looked_up(notices: DataFrame, golden: DataFrame) -> DataFrame:
    """Notices (a row for each doc_id) with the columns of LOOKUP. Several keys against the reference base: outcome, the row that most keys
    agree on (ties: the first row), and the keys that agree and conflict.

    Both sides are unpivoted to (key, value), so that it is one equi-join."""
    keys = {"isin": ("isin", "isin"), "ticker": ("ticker", "ticker"), "cnpj": ("cnpj", "cnpj"), "issuer": ("issuer", "emissor")}
    pairs = lambda side: F.explode(
        F.array(*[F.struct(F.lit(k).alias("key"), text.normalize(F.col(names[side])).alias("value")) for k, names in keys.items()])
    ).alias("kv")
    base = (
        golden.select("row_idx", pairs(1))
        .select("row_idx", "kv.*")
        .where("value <> ''")
        .groupBy("key", "value")
        .agg(F.min("row_idx").alias("row_idx"))
    )
    asked = notices.select("doc_id", pairs(0)).select("doc_id", "kv.*").where("value <> ''")
    hits = asked.join(base.hint("merge"), ["key", "value"]).groupBy("doc_id").agg(F.collect_list(F.struct("row_idx", "key")).alias("hits"))
    # a notice has as many hits as it has keys, so they are counted in its row
    of_row = lambda r: F.array_sort(F.transform(F.filter("hits", lambda h: h["row_idx"] == r), lambda h: h["key"]))
    ranked = lambda r: text.let(of_row(r), lambda k: F.struct(F.size(k).alias("n"), (-r).alias("up"), r.alias("row_idx"), k.alias("keys")))
    found = F.array_distinct(F.transform("hits", lambda h: h["row_idx"]))
    best = hits.select(
        "doc_id",
        F.array_max(F.transform(found, ranked)).alias("best"),
        F.array_sort(F.transform("hits", lambda h: h["key"])).alias("matched"),
    )
    # the reference row joins these few columns, not the whole notices
    best = best.withColumn("best_row", F.col("best.row_idx")).join(
        golden.select(
            F.col("row_idx").alias("best_row"),
            *[F.col(c).alias(f"g_{c}") for c in ("isin", "ticker", "cnpj", "classe", "status")],
        ).hint("merge"),
        "best_row",
        "left",
    )
    rows = notices.join(best.hint("merge"), "doc_id", "left")
    agreeing = F.col("best.keys")
    conflicting = F.array_except("matched", agreeing)
    differs = lambda a, b: F.coalesce(
        (F.col(a) != "") & (text.normalize(F.col(a)) != F.coalesce(text.normalize(F.col(b)), F.lit(""))),
        F.lit(False),
    )
    mismatched = F.array_compact(
        F.array(
            *[
                F.when(differs(a, f"g_{b}"), F.lit(a)) for a, b in (
                    ("share_class", "classe"),
                    ("isin", "isin"),
                    ("ticker", "ticker"),
                    ("cnpj", "cnpj"),
                )
            ]
        )
    )
    outcome = (
        F.when(F.col("best").isNull(), "NOT_FOUND")
        .when(F.size(conflicting) > 0, "KEY_CONFLICT")
        .when(F.size(agreeing) < 2, "WEAK_MATCH")
        .when(~text.normalize(F.coalesce("g_status", F.lit(""))).isin("ativo", "active"), "INACTIVE")
        .when(F.size(mismatched) > 0, "MISMATCH")
        .otherwise("MATCH")
    )
    empty = F.array().cast("array<string>")
    rows = rows.select(
        *[F.col(c) for c in notices.columns],
        outcome.alias("outcome"),
        F.col("best_row").alias("row_idx"),
        F.coalesce(agreeing, empty).alias("agreeing"),
        F.coalesce(conflicting, empty).alias("conflicting"),
        mismatched.alias("_differing"),
    )
    return rows.withColumn("mismatched", F.when(F.col("outcome") == "MISMATCH", F.col("_differing")).otherwise(empty)).drop("_differing")


def _golden_record() -> Column:
    pick = lambda table: F.coalesce(*[F.when(F.col("outcome") == k, F.lit(x)) for k, x in table.items()])
    return _struct("lookup_golden_record", pick(v.LOOKUP_SEVERITY), _texts(pick(v.LOOKUP_REASON)), F.col("mismatched"))


def golden_record(notices: DataFrame, golden: DataFrame) -> DataFrame:
    return _finding(lookup(notices, golden), _golden_record())


def date_rules(window_days: int = 2 * 365, as_of: str = "2024-01-01") -> Column:
    """Names of the chronology rules that a notice breaks; a rule with a null side is skipped."""
    col = F.col
    rules = [
        ("approval_after_com", col("approval_date") > col("com_date"), ("approval_date", "com_date")),
        ("com_not_before_ex", col("com_date") >= col("ex_date"), ("com_date", "ex_date")),
        ("ex_after_payment", col("ex_date") > col("payment_date"), ("ex_date", "payment_date")),
        ("com_after_payment", col("com_date") > col("payment_date"), ("com_date", "payment_date")),
    ]
    broken = [F.when(bad, F.lit(name)) for name, bad, _ in rules]
    far = [
        F.when(
            F.abs(F.datediff(col(f), F.lit(as_of).cast("date"))) > window_days,
            F.lit(f"window:{f}"),
        ) for f in ("approval_date", "com_date", "ex_date", "payment_date")
    ]
    return F.array_compact(F.array(*broken, *far))


def _date_coherence(window_days: int = 2 * 365, as_of: str = "2024-01-01") -> Column:
    def found(broken: Column) -> Column:
        bad = F.size(broken) > 0
        return _struct(
            "check_date_coherence",
            F.when(bad, "fail").otherwise("pass"),
            _texts(F.when(bad, F.lit("DATE_INCOHERENCE"))),
            _names("approval_date", "com_date", "ex_date", "payment_date"),
        )

    return text.let(date_rules(window_days, as_of), found)


def date_coherence(notices: DataFrame, window_days: int = 2 * 365, as_of: str = "2024-01-01") -> DataFrame:
    return _finding(notices, _date_coherence(window_days, as_of))


def amount_finding() -> Column:
    """Whether net = gross less tax, as a finding of one row."""
    good = numbers.net_matches(F.col("gross_per_share"), F.col("tax_rate"), F.col("net_per_share"))
    status = F.when(good.isNull(), "info").when(good, "pass").otherwise("fail")
    return _struct(
        "check_amount_coherence",
        status,
        _texts(F.when(~good, F.lit("AMOUNT_MISMATCH"))),
        _names("gross_per_share", "tax_rate", "net_per_share"),
    )


def amount_coherence(notices: DataFrame) -> DataFrame:
    return _finding(notices, amount_finding())


def _event_type_consistency() -> Column:
    title = F.when(F.col("title_prior") != F.col("body_prior"), F.lit("EVENT_TYPE_TITLE_CONFLICT"))
    body = F.when(F.col("body_prior") != F.col("event_type"), F.lit("CLASSIFIER_DISAGREEMENT"))
    return _struct(
        "check_event_type_consistency",
        F.when(title.isNotNull() | body.isNotNull(), "warn").otherwise("pass"),
        _texts(title, body),
        _names("event_type"),
    )


def event_type_consistency(notices: DataFrame) -> DataFrame:
    return _finding(notices, _event_type_consistency())


def identifier_checks(notices: DataFrame) -> DataFrame:
    """Form and check digits of the identifiers, and the class that the ticker's number stands for."""
    suffix = F.regexp_extract(F.col("ticker"), r"^[A-Z]{4}(\d{1,2})$", 1)
    named = F.coalesce(*[F.when(suffix == k, F.lit(x)) for k, x in v.TICKER_CLASSES.items()])
    return notices.select(
        "doc_id",
        numbers.isin_ok(F.col("isin")).alias("isin_ok"),
        numbers.cnpj_ok(F.col("cnpj")).alias("cnpj_ok"),
        named.alias("ticker_class"),
        (named == F.col("share_class")).alias("class_agrees"),
    )


def _identifier_format() -> Column:
    return _struct("check_identifier_format", F.lit("info"), _texts(), _names("isin", "cnpj", "ticker"))


def identifier_format(notices: DataFrame) -> DataFrame:
    return _finding(notices, _identifier_format())


def missing_required(fields: DataFrame, specs: DataFrame) -> DataFrame:
    """(doc_id, missing) for every document of fields (doc_id, event_type,
    field, value, absence_reason, candidates): required fields that are neither
    present nor excused by a declared absence or open candidates."""
    known = fields.select(
        "doc_id",
        F.when(F.col("event_type").isin(*v.EVENT_TYPES), F.col("event_type")).otherwise("outro").alias("event_type"),
    ).distinct()
    excused = F.col("absence_reason").isin("stated_undefined", "not_applicable") | (F.size("candidates") > 0)
    settled = fields.where(F.col("value").isNotNull() | F.coalesce(excused, F.lit(False))).select("doc_id", "field")
    wanted = known.join(F.broadcast(specs.where("required")), "event_type").select("doc_id", "field")
    lacking = (
        wanted.join(settled, ["doc_id", "field"], "left_anti")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("field")).alias("missing"))
    )
    return (
        known.select("doc_id")
        .join(lacking, "doc_id", "left")
        .withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    )


def _required_fields(missing: Column) -> Column:
    bad = F.size(missing) > 0
    return _struct(
        "check_required_fields",
        F.when(bad, "fail").otherwise("pass"),
        _texts(F.when(bad, F.lit("MISSING_REQUIRED_FIELD"))),
        missing,
    )


def required_fields(fields: DataFrame, specs: DataFrame) -> DataFrame:
    return _finding(missing_required(fields, specs), _required_fields(F.col("missing")))


def lacking(columns: list[str], specs: dict = v.FIELD_SPECS) -> Column:
    """Required fields of a wide notice's type that are null or no column; no shuffle."""
    wanted = {t: sorted(set(sides[0])) for t, sides in specs.items()}
    of_type = lambda names: F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) if f in columns else F.lit(f) for f in names]))
    kind = F.col("event_type")
    known = F.coalesce(*[F.when(kind == t, of_type(names)) for t, names in wanted.items()])
    return F.coalesce(known, of_type(wanted["outro"]))


#: The validators by name, in the order in which a record runs them.
TOOLS = {
    "lookup_golden_record": {"arguments": ["issuer", "cnpj", "isin", "ticker", "share_class"], "run": golden_record},
    "check_date_coherence": {"arguments": ["approval_date", "com_date", "ex_date", "payment_date", "event_type"], "run": date_coherence},
    "check_amount_coherence": {"arguments": ["gross_per_share", "tax_rate", "net_per_share"], "run": amount_coherence},
    "check_event_type_consistency": {"arguments": ["declared_type", "title_prior", "body_prior", "markers"], "run": event_type_consistency},
    "check_identifier_format": {"arguments": ["isin", "cnpj", "ticker", "share_class"], "run": identifier_format},
    "check_required_fields": {"arguments": ["event_type", "present", "absent"], "run": required_fields},
}
FIELDS = (
    "issuer",
    "cnpj",
    "isin",
    "ticker",
    "share_class",
    "approval_date",
    "com_date",
    "ex_date",
    "payment_date",
    "gross_per_share",
    "tax_rate",
    "net_per_share",
    "currency",
    "event_type_label",
)


def in_row(columns: list[str]) -> Column:
    """array(struct(field, value)) of a wide notice with these columns."""
    value = lambda f: F.col(f).cast("string") if f in columns else F.lit(None).cast("string")
    return F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in FIELDS])


def as_fields(notices: DataFrame) -> DataFrame:
    """The long form of wide notices: one row per document and field."""
    rows = notices.select("doc_id", "event_type", F.explode(in_row(notices.columns)).alias("x")).select("doc_id", "event_type", "x.*")
    return rows.withColumn("absence_reason", F.lit(None).cast("string")).withColumn("candidates", F.array().cast("array<string>"))


def spec_dict(specs: DataFrame | dict) -> dict:
    """Required and optional fields by type, from the table of the vocabulary's contracts or as they are."""
    if isinstance(specs, dict):
        return specs
    out: dict[str, tuple[list, list]] = {}
    for r in specs.collect():  # a row for each field of a type's contract
        out.setdefault(r["event_type"], ([], []))[0 if r["required"] else 1].append(r["field"])
    return out


def run_rows(notices: DataFrame, golden: DataFrame, specs: DataFrame | dict = v.FIELD_SPECS, tools: tuple | None = None, **window) -> DataFrame:
    """(doc_id, found) of every wide notice, found being the findings of the
    validators (all, or those named) in their order: what a row says by itself
    is one projection, beside one lookup if that is asked for."""
    parts = {
        "lookup_golden_record": _golden_record,
        "check_date_coherence": lambda: _date_coherence(**window),
        "check_amount_coherence": amount_finding,
        "check_event_type_consistency": _event_type_consistency,
        "check_identifier_format": _identifier_format,
        "check_required_fields": lambda: _required_fields(lacking(notices.columns, spec_dict(specs))),
    }
    asked = [k for k in parts if tools is None or k in tools]
    rows = _looked_up(notices, golden) if "lookup_golden_record" in asked else notices
    found = [F.struct(F.lit(seq).alias("seq"), parts[k]().alias("x")) for seq, k in enumerate(parts) if k in asked]
    return rows.select("doc_id", F.array(*found).alias("found"))


def run_all(notices: DataFrame, golden: DataFrame, specs: DataFrame | dict = v.FIELD_SPECS, tools: tuple | None = None, **window) -> DataFrame:
    """The findings of `run_rows`, a row each, with their place in the order."""
    rows = run_rows(notices, golden, specs, tools, **window)
    return rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.x.*", "f.seq")


def status_of(severity: Column, status: Column) -> Column:
    """A validator's status from its answer: a stated severity counts before the status; unknown words are information."""
    known = lambda x: F.when(F.lower(x).isin("pass", "warn", "fail", "info"), F.lower(x))
    return F.when(severity.isNotNull(), F.coalesce(known(severity), F.lit("info"))).otherwise(F.coalesce(known(status), F.lit("info")))


def codes_of(code: Column, codes: Column) -> Column:
    """The known reason codes of an answer that names one, several or both."""
    both = F.concat(F.array_compact(F.array(code)), F.coalesce(codes, F.array().cast("array<string>")))
    return F.filter(both, lambda x: x.isin(*v.REASONS))


def recorded(arguments: Column) -> Column:
    """The arguments (a map) of a call as the record keeps them, without empty ones."""
    return F.map_filter(arguments, lambda _, x: x.isNotNull())


def encode_fields(names: Column) -> Column:
    return F.array_join(names, ",")


def decode_fields(said: Column) -> Column:
    """Names from a comma-separated list, blanks and empty ones left out."""
    return F.filter(F.transform(F.split(said, ","), lambda x: F.trim(x)), lambda x: x != "")


def declarations() -> dict[str, dict]:
    """A JSON schema for each validator's arguments, as tools are declared to a model."""
    text_ = {"type": "string"}
    return {
        name: {
            "name": name,
            "parameters": {"type": "object", "properties": {a: text_ for a in tool["arguments"]}},
        } for name, tool in TOOLS.items()
    }
