"""Operators on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from noticelab.operators import classify, fields, reading, triage, validators
from noticelab import vocabulary
from noticelab.sources import files

D = datetime.date
NOTICE = "doc_id long, event_type string, issuer string, cnpj string, isin string, ticker string, share_class string, approval_date date, com_date date, ex_date date, payment_date date, gross_per_share decimal(20,10), tax_rate decimal(10,6), net_per_share decimal(20,10), title_prior string, body_prior string"


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(0, "Alfa SA", "11", "BRALFAACNOR1", "ALFA3", "ON", "ativo"), (1, "Beta SA", "22", "BRBETAACNOR2", "BETA3", "ON", "ativo"), (2, "Gama SA", "33", "BRGAMAACNOR3", "GAMA3", "ON", "suspenso")]
    return spark.createDataFrame(rows, "row_idx int, emissor string, cnpj string, isin string, ticker string, classe string, status string")


@pytest.mark.parametrize(
    "issuer, cnpj, isin, ticker, share, want",
    [
        ("Alfa SA", "11", "BRALFAACNOR1", "ALFA3", "ON", "MATCH"), ("Nada", None, None, None, None, "NOT_FOUND"), ("Alfa SA", "22", None, None, None, "KEY_CONFLICT"),
        ("ALFA  sa", None, None, None, None, "WEAK_MATCH"), ("Gama SA", "33", None, None, None, "INACTIVE"), ("Alfa SA", "11", None, None, "PN", "MISMATCH"),
        ("Alfa SA", "11", "BRALF4ACN0R1", None, None, "MISMATCH"), (None, None, None, None, None, "NOT_FOUND"),
    ],
)
def test_lookup(spark, golden, issuer, cnpj, isin, ticker, share, want):
    rows = spark.createDataFrame([(1, issuer, cnpj, isin, ticker, share)], "doc_id long, issuer string, cnpj string, isin string, ticker string, share_class string")
    assert validators.lookup(rows, golden).first()["outcome"] == want


@pytest.mark.parametrize(
    "approval, com, ex, pay, bad",
    [(None, D(2026, 7, 15), D(2026, 7, 16), D(2026, 7, 10), True), (None, D(2026, 7, 15), D(2026, 7, 15), None, True), (None, D(2026, 7, 15), D(2026, 7, 16), None, False), (None, None, None, None, False), (D(2026, 8, 1), D(2026, 7, 15), None, None, True)],
)
def test_dates(spark, approval, com, ex, pay, bad):
    rows = spark.createDataFrame([(1, approval, com, ex, pay)], "doc_id long, approval_date date, com_date date, ex_date date, payment_date date")
    assert (validators.date_coherence(rows, as_of="2026-07-01").first()["status"] == "fail") is bad


def test_missing_required(spark):
    rows = spark.createDataFrame([(1, "jcp", f, "x", None, []) for f in ("issuer", "isin", "ticker")] + [(2, "reducao", "issuer", "x", None, [])], "doc_id long, event_type string, field string, value string, absence_reason string, candidates array<string>")
    got = {r[0]: r[1] for r in validators.missing_required(rows, vocabulary.field_specs(spark)).collect()}
    assert "com_date" in got[1] and got[2] == []


def test_excused_fields_are_not_missing(spark):
    rows = spark.createDataFrame([(1, "outro", "issuer", None, "stated_undefined", [])], "doc_id long, event_type string, field string, value string, absence_reason string, candidates array<string>")
    assert validators.missing_required(rows, vocabulary.field_specs(spark)).first()["missing"] == []


def test_levels(spark):
    sets = {("text_layer", "ocr_deterministic"): "muito_alta", ("text_layer",): "alta", ("ocr_deterministic", "ocr_generative"): "media", ("ocr_deterministic",): "baixa"}
    for kinds, want in sets.items():
        assert spark.createDataFrame([(list(kinds),)], "k array<string>").select(reading.level_of(F.col("k"))).first()[0] == want


def _readings(spark, rows):
    return spark.createDataFrame([(1, 1, r, k, i, t) for i, (r, k, t) in enumerate(rows)], "doc_id long, region_id int, reader string, kind string, seq int, text string")


def test_a_flawed_reading_is_out(spark):
    got = reading.resolve(_readings(spark, [("ocr", "ocr_deterministic", "BRTLNRACNPR2"), ("vlm", "ocr_generative", "BRTLNRACPR2")])).first()
    assert got["text"] == "BRTLNRACNPR2" and got["n_eliminated"] == 1


def test_an_elimination_costs_a_level(spark):
    got = reading.resolve(_readings(spark, [("p", "text_layer", "BRTLNRACNPR2"), ("ocr", "ocr_deterministic", "BRTLNRACNPR2"), ("vlm", "ocr_generative", "BRTLNRACPR2")])).first()
    assert got["level"] == "alta"


def test_only_flawed_readings_are_lowest(spark):
    got = reading.resolve(_readings(spark, [("p", "text_layer", "31/02/2026"), ("ocr", "ocr_deterministic", "31/02/2026")])).first()
    assert got["level"] == "baixa" and got["n_eliminated"] == 0


def _slow_rows(blocks, chained):
    """An own reading of the rule, block by block."""
    rows = []
    for b in sorted(blocks, key=(lambda b: (b[1], b[0], b[4])) if not chained else (lambda b: (b[1], b[4]))):
        for row in rows:
            a = row[-1] if chained else row[0]
            shared, least = min(a[3], b[3]) - max(a[1], b[1]), min(a[3] - a[1], b[3] - b[1])
            if least > 0 and max(shared, 0) / least >= 0.5:
                row.append(b)
                break
        else:
            rows.append([b])
    return sorted(tuple(b[4] for b in sorted(r, key=lambda b: (b[0], b[4]))) for r in rows)


@pytest.mark.parametrize("chained", [False, True])
def test_rows_of_random_pages(spark, chained):
    import random

    rng, pages, rows = random.Random(5), {}, []
    for page in range(40):
        pages[page] = [(x := rng.randrange(100), y := rng.randrange(60), x + 20, y + rng.randrange(5, 20), i) for i in range(rng.randrange(1, 14))]
        rows += [(page, 1, "r", i, float(x0), float(y0), float(x1), float(y1)) for x0, y0, x1, y1, i in pages[page]]
    df = spark.createDataFrame(rows, "doc_id long, page int, reader string, block_order int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in reading.cluster_rows(df, chained).orderBy("col_index").collect():
        got.setdefault(r["doc_id"], {}).setdefault(r["row_index"], []).append(r["block_order"])
    for page, blocks in pages.items():
        assert sorted(tuple(x) for x in got[page].values()) == _slow_rows(blocks, chained)


def test_evidence_ties(spark):
    blocks = spark.createDataFrame([(1, 0, "Valor bruto por acao"), (1, 1, "R$ 0,42")], "doc_id long, block_order int, text string")
    ev = spark.createDataFrame([(1, 1, "Valor bruto por acao R$ 0,42", "R$ 0,42"), (1, 2, "Valor bruto por acao R$ 0,42", None), (1, 3, " ", None)], "doc_id long, evidence_id int, evidence string, value string")
    got = {r["evidence_id"]: r["block_order"] for r in fields.locate(ev, blocks).collect()}
    assert got == {1: 1, 2: 0}


def test_grounding_with_a_last_chance(spark):
    rows = spark.createDataFrame([(1, "f", "valor bruto por acao", "o valor brufo por acao e", "ocr_deterministic"), (2, "f", "valor bruto por acao", "o valor brufo por acao e", "text_layer"), (3, "f", "AB10", "xx ABlO", "ocr_generative")], "doc_id long, field string, evidence string, raw string, reader_kind string")
    assert {r["doc_id"]: r["status"] for r in fields.ground(rows).collect()} == {1: "fuzzy", 2: "absent", 3: "fuzzy"}


def test_fuzzy_anchor(spark):
    rows = spark.createDataFrame([(1, "Data de pagamemto"), (2, "outra coisa qualquer"), (3, "Valor bruto"), (4, None)], "doc_id long, label string")
    got = {r["doc_id"]: r["field"] for r in fields.match_anchor_fuzzy(rows).collect()}
    assert got == {1: "payment_date", 2: None, 3: "gross_per_share", 4: None}


def test_repair_of_a_weak_day(spark):
    """Only what an optical reader alone has read may have lost a digit, wherever in the text the date stands."""
    make = lambda raw, level, kind: fields.repair_date(F.lit(raw), F.lit(level), F.lit(kind))
    cases = {"a": ("em 12 dias, 2/08/2026", "baixa", "ocr_deterministic"), "b": ("2/08/2026", "media", "ocr_deterministic"), "c": ("2/08/2026", "baixa", "ocr_generative"), "d": ("3/08/2026", "baixa", "ocr_deterministic")}
    row = spark.range(1).select(*[make(*x).alias(k) for k, x in cases.items()]).first()
    want = ["02/08/2026", "12/08/2026", "22/08/2026", *(f"2{i}/08/2026" for i in range(10) if i != 2)]
    assert row["a"]["value"] is None and row["a"]["candidates"] == want
    assert row["b"]["value"] == row["c"]["value"] == D(2026, 8, 2)
    assert row["d"]["candidates"] == ["03/08/2026", "13/08/2026", "23/08/2026", "30/08/2026", "31/08/2026"]


def test_field_reasons(spark):
    rows = [(1, "com_date", False, None, "stated_undefined", [], None, []), (1, "ex_date", True, None, None, ["1"], None, []), (1, "cnpj", False, None, None, [], None, []), (1, "isin", True, "x", None, [], "absent", ["text_layer"]), (1, "ticker", True, "x", None, [], "exact", ["ocr_generative"]), (1, "issuer", True, "x", None, [], "exact", ["text_layer"])]
    df = spark.createDataFrame(rows, "doc_id long, field string, required boolean, value string, absence_reason string, candidates array<string>, grounding string, kinds array<string>")
    got = {r["field"]: r["code"] for r in triage.field_reasons(df).collect()}
    assert got == {"com_date": "FIELD_STATED_UNDEFINED", "ex_date": "AMBIGUOUS_DATE_PARSE", "cnpj": "FIELD_NOT_FOUND", "isin": "UNGROUNDED_CRITICAL_FIELD", "ticker": "NO_CORROBORATION"}


def test_consensus_without_votes(spark):
    votes = spark.createDataFrame([(1, 0, False, "jcp"), (1, 1, True, None)], "doc_id long, modality_ord int, available boolean, event_type string")
    priors = spark.createDataFrame([(1, None)], "doc_id long, prior string")
    got = classify.consensus(votes, priors).first()
    assert got["event_type"] == "outro" and got["unanimous"] is False and got["n_available"] == 1


def test_markdown_pairs(spark):
    docs = spark.createDataFrame([(1, "| Ticker | ABCD3 |\n|---|---|\nValor ........ R$ 1,00\nData com:\n\n15/06/2026")], "doc_id long, text string")
    got = {(r["label"], r["value"]) for r in files.markdown_pairs(docs).collect()}
    assert got == {("Ticker", "ABCD3"), ("Valor", "R$ 1,00"), ("Data com", "15/06/2026")}


def test_golden_csv_with_mark(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("﻿emissor,cnpj\nÁgua SA,011\nB,022\n".encode())
    rows = files.golden(spark, str(tmp_path / "g.csv")).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["emissor"], r["cnpj"]) for r in rows] == [(0, "Água SA", "011"), (1, "B", "022")]


def test_report_and_records(spark, golden, tmp_path):
    rows = spark.createDataFrame([(1, "jcp", "Alfa SA", "11", "BRALFAACNOR1", "ALFA3", "ON", None, D(2026, 7, 15), D(2026, 7, 15), None, None, None, None, "jcp", "jcp")], NOTICE)
    findings = validators.run_all(rows, golden, vocabulary.field_specs(spark), as_of="2026-07-01")
    reasons = triage.reasons_of(findings)
    verdicts = triage.disposition(reasons, rows)
    assert verdicts.first()["disposition"] == "blocked"
    assert "DATE_INCOHERENCE" in files.exceptions_report(verdicts, reasons)
    files.write_records(files.records(rows, validators.as_fields(rows), findings, reasons, verdicts), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["disposition"] == "blocked"


def test_stream_equals_batch(spark, golden, tmp_path):
    from noticelab.streaming.drop_folder import triage_stream

    rows = spark.createDataFrame([(i, "jcp", "Alfa SA", "11", "BRALFAACNOR1", "ALFA3", "ON", None, D(2026, 7, 15), D(2026, 7, 15 + i % 3), None, None, None, None, "jcp", "jcp") for i in range(6)], NOTICE)
    rows.write.parquet(str(tmp_path / "in"))
    specs = vocabulary.field_specs(spark)
    triage_stream(spark, str(tmp_path / "in"), rows.schema, golden, specs, str(tmp_path / "out"), str(tmp_path / "cp"), window=lambda: {"as_of": "2026-07-01"}).awaitTermination(120)
    want = triage.disposition(triage.reasons_of(validators.run_all(rows, golden, specs, as_of="2026-07-01")), rows)
    pick = lambda df: sorted((r["doc_id"], r["disposition"], r["n_reasons"]) for r in df.collect())
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(want)
