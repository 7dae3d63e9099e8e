"""What an auditor sees of a field, and the routes a record takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .. import vocabulary as v
from . import fields as field_ops


def field_class(field: Column) -> Column:
    return F.coalesce(*[F.when(field.isin(*names), F.lit(c)) for c, names in v.FIELD_CLASSES.items()], F.lit("default"))


def is_critical(field: Column) -> Column:
    return field_class(field).isin("financial_critical", "identity")


def event_type_of(raw: Column) -> Column:
    """A known event type, or `outro`."""
    name = F.lower(F.trim(raw))
    return F.when(name.isin(*v.EVENT_TYPES), name).otherwise("outro")


def absence_of(raw: Column, value: Column) -> Column:
    """Why a value is missing; an unknown reason is `not_found`, a present value has none."""
    known = F.lower(F.trim(raw))
    return F.when(value.isNull(), F.when(known.isin("stated_undefined", "not_applicable", "not_found"), known).otherwise("not_found"))


def widen(x0: Column, x1: Column) -> Column:
    """The horizontal strip that a crop shows."""
    return F.struct(F.least(x0, F.lit(50.0)).alias("x0"), F.greatest(x1, x0 + 480).alias("x1"))


def ungrounded_critical(fields: DataFrame) -> DataFrame:
    return fields.where((F.col("grounding") == "absent") & F.col("value_raw").isNotNull() & is_critical(F.col("field")))


def routes(fields: DataFrame, has_model: bool) -> DataFrame:
    """Per document: whether to ask again (once) for ungrounded fields, and whether dates are open to settle (once)."""
    again = F.max((F.col("grounding") == "absent") & F.col("value_raw").isNotNull() & is_critical(F.col("field")))
    return fields.groupBy("doc_id").agg(
        (F.coalesce(again, F.lit(False)) & F.lit(has_model)).alias("reprompt"),
        F.coalesce(F.max(F.size("candidates") > 0), F.lit(False)).alias("disambiguate"),
    )


def cut_by(findings: DataFrame) -> DataFrame:
    """The validators that failed or warned about each field."""
    rows = findings.where(F.col("status").isin("warn", "fail")).select("doc_id", "tool", F.explode("fields_affected").alias("field"))
    return rows.groupBy("doc_id", "field").agg(F.array_sort(F.collect_set("tool")).alias("cut_by"))


def annotate(fields: DataFrame, findings: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Class, reading, cutting validators and reference check of each field."""
    out = (
        fields.join(cut_by(findings), ["doc_id", "field"], "left")
        .withColumn("field_class", field_class(F.col("field")))
        .withColumn("critical", is_critical(F.col("field")))
    )
    out = out.withColumn("cut_by", F.coalesce("cut_by", F.array().cast("array<string>")))
    if lookup is None:
        return out
    out = out.join(lookup.select("doc_id", "outcome", "agreeing", "mismatched", "row_idx"), "doc_id", "left")
    status = field_ops.golden_status(
        F.col("field"),
        F.col("outcome").isNotNull(),
        F.col("agreeing"),
        F.col("row_idx").isNotNull(),
        ~F.array_contains("mismatched", F.col("field")),
    )
    return out.withColumn("golden", status).drop("outcome", "agreeing", "mismatched", "row_idx")


def review_split(fields: DataFrame, specs: DataFrame, notices: DataFrame, for_review: DataFrame) -> DataFrame:
    """Each field of a type's contract is under review or accepted; both add up to the contract."""
    contract = notices.select("doc_id", "event_type").join(F.broadcast(specs), "event_type").select("doc_id", "field")
    rows = contract.join(fields.select("doc_id", "field", "value"), ["doc_id", "field"], "left").join(
        for_review.select("doc_id", "field", F.lit(True).alias("_r")),
        ["doc_id", "field"],
        "left",
    )
    side = F.when(F.col("value").isNull() | F.col("_r").isNotNull(), "review").otherwise("accepted")
    return rows.groupBy("doc_id", side.alias("side")).agg(F.count("*").alias("n"))


def curate_notes(notes: Column, evidence: Column) -> Column:
    """Notes worth reading: each once, without those that only repeat the evidence."""
    repeats = lambda n, tight: F.coalesce((tight != "") & text.squash(n).contains(tight), F.lit(False))
    once = F.array_distinct(notes)
    return text.let(text.squash(evidence), lambda tight: F.filter(once, lambda n: (F.trim(n) != "") & ~repeats(n, tight)))


def plain_form(c: Column) -> Column:
    """Lower case without accents and quotes; everything but letters, digits and a few marks is a blank."""
    bare = F.regexp_replace(text.fold_accents(F.regexp_replace(c, "[–—−]", " ")), "[\"']", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^a-z0-9\s()/\-]", " "), r"\s+", " "))


def html_text(c: Column) -> Column:
    """A text as HTML shows it."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def slug(event_type: Column, drafted: Column) -> Column:
    """A document's name in an index: type and drafting date."""
    return F.concat(event_type, F.lit("_"), F.coalesce(F.date_format(drafted, "dd-MM-yyyy"), F.lit("sem-data")))


def term(code: Column, terms: dict[str, str]) -> Column:
    """The word for a code; a code without one is an error, not a blank."""
    known = [F.when(code == k, F.lit(x)) for k, x in terms.items()]
    return F.coalesce(F.when(code.isNull(), F.lit(None).cast("string")), *known, F.raise_error(F.concat(F.lit("no term for "), code)))


def in_words(prose: Column, terms: dict[str, str]) -> Column:
    """A text with every code in it replaced by its word, longer codes first; a pattern is tried only where its code stands."""
    def put(prose: Column, code: str, word: str) -> Column:
        replaced = lambda said: F.regexp_replace(said, rf"\b{code}\b", word.replace("$", r"\$"))
        return text.let(prose, lambda said: F.when(said.contains(code), replaced(said)).otherwise(said))

    for code, word in sorted(terms.items(), key=lambda x: -len(x[0])):
        prose = put(prose, code, word)
    return prose


def short_name(name: Column) -> Column:
    """What stands before a dash between blanks."""
    return F.get(F.split(name, " — "), F.lit(0))


def glossary(codes: DataFrame, terms: dict[str, str]) -> DataFrame:
    """(code, word) of the codes in use, by word whatever its case."""
    rows = codes.select("code").distinct()
    return rows.withColumn("word", term(F.col("code"), terms)).orderBy(F.lower("word"), "code")


def box_order(rows: DataFrame) -> DataFrame:
    """Fields as a page shows them: those with a box first, from the top."""
    return rows.orderBy("doc_id", F.col("y0").isNull(), "y0", "field")


def grade(kinds: Column, n_eliminated: Column, values: Column) -> Column:
    """Grade of a field that several readers gave: agreement, a lone reading, or a conflict."""
    many, pixels = F.size(kinds) >= 2, F.size(F.array_except(kinds, F.array(*map(F.lit, v.PIXEL_KINDS)))) == 0
    return (
        F.when(values == 0, F.when(n_eliminated > 0, "no_valid_reading").otherwise("absent")).when(values > 1, "conflict").when(many & pixels, "medium_high").when(many, "high").when(n_eliminated > 0, "resolved").when(pixels, "single_reader").otherwise("medium")
    )


def unknown_codes(narrative: Column, assigned: Column) -> Column:
    """Reason codes that a narrative cites and the record does not have."""
    cited = F.filter(F.regexp_extract_all(narrative, F.lit(r"\b([A-Z]+(?:_[A-Z]+)+)\b"), F.lit(1)), lambda c: c.isin(*v.REASONS))
    return F.array_sort(F.array_except(F.array_distinct(cited), assigned))


def narrative(disposition: Column, codes: Column) -> Column:
    """The plain account of a verdict, where no model writes one."""
    return F.when(disposition == "auto", F.lit("No reason against automatic processing.")).otherwise(
        F.concat(F.lit("Disposition "), disposition, F.lit(": "), F.array_join(codes, ", "), F.lit("."))
    )
