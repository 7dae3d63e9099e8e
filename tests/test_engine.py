"""The whole way, on small pages that three readers have read."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticelab import cli
from noticelab.operators import audit, page
from noticelab import vocabulary
from noticelab.plans import engine
from noticelab.sources import files, staging

LINES = [
    ("Alfa SA", None), ("Aviso aos Acionistas", None), ("Juros sobre o Capital Próprio", None), ("Código de negociação", "ALFA3"), ("ISIN", "BRALFAACNOR1"), ("CNPJ", "11.222.333/0001-81"),
    ("Valor bruto por ação ON", "R$ 0,1000000000"), ("IRRF na fonte", "17,5%"), ("Valor líquido por ação ON", "R$ 0,0825000000"), ("Data de aprovação", "01/06/2026"), ("Data-base (data com)", "15/06/2026"), ("Data ex-jcp", "16/06/2026"), ("Data de pagamento", "30 de junho de 2026"),
]
READERS = {"parser": "text_layer", "ocr": "ocr_deterministic", "vlm": "ocr_generative"}


def blocks_of(doc, lines=LINES, readers=READERS, damage=lambda reader, text: text):
    rows = []
    for reader, kind in readers.items():
        n = 0
        for i, (label, value) in enumerate(lines):
            for k, t in enumerate(x for x in (label, value) if x):
                rows.append({"doc_id": doc, "page": 1, "reader": reader, "kind": kind, "block_order": n, "text": damage(reader, t), "x0": 60.0 + 200 * k, "y0": 50.0 + 30 * i, "x1": 200.0 + 200 * k, "y1": 64.0 + 30 * i, "role": None, "row": None, "col": None, "level": None, "pending": False})
                n += 1
    return rows


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    late = [(a, "10/06/2026" if b == "16/06/2026" else b) for a, b in LINES]
    undefined = [(a, "A definir" if b == "30 de junho de 2026" else b) for a, b in LINES]
    rows = blocks_of(1) + blocks_of(2, late) + blocks_of(3, undefined) + blocks_of(4, damage=lambda r, t: t.replace("BRALFAACNOR1", "BRALFAACNR1") if r == "vlm" else t) + blocks_of(5, [("Comunicado", None)], {"ocr": "ocr_deterministic"})
    (folder / "blocks.json").write_text("\n".join(json.dumps(r) for r in rows))
    (folder / "golden.csv").write_text("emissor,cnpj,isin,ticker,classe,segmento_listagem,status\nAlfa SA,11.222.333/0001-81,BRALFAACNOR1,ALFA3,ON,NM,Ativo\n")
    return folder


@pytest.fixture(scope="module")
def result(spark, inputs):
    return engine.run(files.blocks(spark, str(inputs / "blocks.json")), files.golden(spark, str(inputs / "golden.csv")), vocabulary.field_specs(spark), engine.Config("2026-06-20"))


def test_fields(result):
    got = {r["field"]: r["value"] for r in result.fields.where("doc_id = 1").collect()}
    want = {"issuer": "Alfa SA", "isin": "BRALFAACNOR1", "ticker": "ALFA3", "cnpj": "11.222.333/0001-81", "gross_per_share": "0,10", "tax_rate": "0,175", "net_per_share": "0,0825", "com_date": "15/06/2026", "ex_date": "16/06/2026", "payment_date": "30/06/2026", "currency": "BRL"}
    assert {k: got.get(k) for k in want} == want


def test_verdicts(result):
    got = {r["doc_id"]: (r["disposition"], r["codes"]) for r in result.verdicts.collect()}
    assert got[1] == ("auto", []) and got[4] == ("auto", [])
    assert got[2][0] == "blocked" and "DATE_INCOHERENCE" in got[2][1]
    assert got[3] == ("review", ["FIELD_STATED_UNDEFINED"])
    assert got[5][0] == "review" and "UNKNOWN_EVENT_TYPE" in got[5][1] and "ISSUER_NOT_IN_GOLDEN" in got[5][1]


def test_a_flawed_reader_costs_a_level(result):
    rows = result.blocks.where("doc_id in (1, 4) and text like 'BRALFA%'").select("doc_id", "level", "text").collect()
    assert {(r["doc_id"], r["level"], r["text"]) for r in rows} == {(1, "muito_alta", "BRALFAACNOR1"), (4, "alta", "BRALFAACNOR1")}


def test_other_votes_and_candidates(spark, inputs):
    votes = spark.createDataFrame([(1, 1, True, "dividendo"), (4, 1, True, "jcp")], "doc_id long, modality_ord int, available boolean, event_type string")
    candidates = spark.createDataFrame([(4, "com_date", "text", 1, "14/06/2026")], "doc_id long, field string, extractor string, seq int, value_raw string")
    got = engine.run(files.blocks(spark, str(inputs / "blocks.json")), files.golden(spark, str(inputs / "golden.csv")), vocabulary.field_specs(spark), engine.Config("2026-06-20"), votes, candidates)
    codes = {r["doc_id"]: r["codes"] for r in got.verdicts.collect()}
    assert "CLASSIFIER_DISAGREEMENT" in codes[1] and codes[4] == ["EXTRACTOR_DISAGREEMENT"]


def test_sweep_and_failed_documents(spark, inputs):
    """What a sweep returns counts if some reader's text holds it; what nobody read has failed."""
    returned = spark.createDataFrame([(5, "issuer", "Comunicado"), (5, "isin", "BRXXXXACNOR9")], "doc_id long, field string, value string")
    asked = spark.createDataFrame([(1,), (9,)], "doc_id long")
    args = (files.blocks(spark, str(inputs / "blocks.json")), files.golden(spark, str(inputs / "golden.csv")), vocabulary.field_specs(spark))
    got = engine.run(*args, engine.Config("2026-06-20"), asked=asked, returned=returned)
    verdicts = {r["doc_id"]: r for r in got.verdicts.collect()}
    assert verdicts[9]["disposition"] == "failed" and verdicts[1]["disposition"] == "auto"
    values = {(r["field"], r["value"], r["absence_reason"]) for r in got.fields.where("doc_id = 5").collect()}
    assert ("isin", None, "not_found") in values
    assert "isin" in verdicts[5]["for_review"] and verdicts[1]["for_review"] == [] and verdicts[1]["weakest_level"] == "muito_alta"


def test_a_block_stands_in_each_row_it_shares(spark):
    """A tall block of the winner beside two rows of the reference is in both; alternatives and notes go along."""
    row = lambda reader, kind, n, text, y0, y1: (1, 1, reader, kind, n, text, 10.0, y0, 100.0, y1, "cell", None, None, None, False)
    rows = [row("parser", "text_layer", 0, "A 1", 0.0, 10.0), row("parser", "text_layer", 1, "B 2", 12.0, 22.0), row("ocr", "ocr_deterministic", 0, "A 1", 0.0, 10.0), row("ocr", "ocr_deterministic", 1, "31/02/2026", 12.0, 22.0)]
    got = page.page_consensus(spark.createDataFrame(rows, files.BLOCKS)).orderBy("block_order").collect()
    assert [(r["text"], r["level"], r["role"]) for r in got] == [("A 1", "muito_alta", "cell"), ("B 2", "media", "cell")]
    assert got[1]["notes"] == ["ocr out: date:31/02/2026"] and got[1]["alternatives"][0]["text"] == "31/02/2026"
    regions = page.many_readers(page.page_consensus(spark.createDataFrame(rows, files.BLOCKS))).first()
    assert (regions["n_regions"], regions["n_agreed"]) == (2, 2)


def test_command_line_options(spark, inputs, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    common = ["run", "--blocks", str(inputs / "blocks.json"), "--golden", str(inputs / "golden.csv"), "--as-of", "2026-06-20"]
    assert cli.main([*common, "--out", str(tmp_path / "none"), "--docs", str(docs)]) == 1
    for name in ("1.pdf", "7.pdf"):
        (docs / name).write_bytes(b"%PDF")
    (tmp_path / "contracts.json").write_text(json.dumps({"jcp": {"required": ["issuer"], "optional": []}, "outro": {"required": ["issuer"]}}))
    out, before = tmp_path / "out", len(staging.MADE)
    assert cli.main([*common, "--out", str(out), "--docs", str(docs), "--config", str(tmp_path / "contracts.json"), "--by-document", "--trace", "--offline"]) == 0
    assert "| 7 | failed |" in (out / "exceptions.md").read_text() and "== verdicts" in (out / "trace.txt").read_text()
    assert {r["doc_id"] for r in spark.read.json(str(out / "summary_documents")).collect()} == {1, 2, 3, 4, 5, 7}
    assert len(staging.MADE) == before and all(Path(x.removeprefix("file:")).exists() for x in staging.MADE)
    assert (out / "records" / "doc_id=1").exists() and spark.read.json(str(out / "summary")).first()["elapsed_seconds"] > 0


def test_command_line(spark, inputs, tmp_path):
    assert cli.main(["run", "--blocks", str(inputs / "blocks.json"), "--golden", str(inputs / "golden.csv"), "--out", str(tmp_path), "--as-of", "2026-06-20"]) == 0
    assert spark.read.json(str(tmp_path / "records")).count() == 5 and "DATE_INCOHERENCE" in (tmp_path / "exceptions.md").read_text()
    assert spark.read.json(str(tmp_path / "summary")).first()["total"] == 5


def test_coverage(spark, inputs):
    rows = page.coverage(files.blocks(spark, str(inputs / "blocks.json"))).groupBy("doc_id").agg(F.max("n_readers").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {1: 3, 2: 3, 3: 3, 4: 3, 5: 1}


def test_pending_cells_borrow_a_box(spark):
    cell = lambda reader, kind, pending, box: (1, 1, reader, kind, 0, "R$ 1,00", *box, None, 0, 0, None, pending)
    rows = spark.createDataFrame([cell("parser", "text_layer", True, (0.0, 0.0, 100.0, 100.0)), cell("ocr", "ocr_deterministic", False, (10.0, 10.0, 30.0, 20.0))], files.BLOCKS)
    assert {(r["reader"], r["x0"], r["y1"]) for r in page.lent(rows).collect()} == {("parser", 10.0, 20.0), ("ocr", 10.0, 20.0)}


def test_audit_expressions(spark):
    row = spark.range(1).select(
        audit.field_class(F.lit("isin")).alias("a"), audit.event_type_of(F.lit(" JCP ")).alias("b"), audit.event_type_of(F.lit("x")).alias("c"), audit.absence_of(F.lit("??"), F.lit(None)).alias("d"),
        audit.unknown_codes(F.lit("por DATE_INCOHERENCE e AMOUNT_MISMATCH"), F.array(F.lit("DATE_INCOHERENCE"))).alias("e"), audit.curate_notes(F.array(F.lit("a"), F.lit("a"), F.lit("leu R$ 1,00"), F.lit(" ")), F.lit("R$ 1,00")).alias("f"),
        audit.grade(F.array(F.lit("text_layer"), F.lit("ocr_deterministic")), F.lit(0), F.lit(1)).alias("g"),
    ).first()
    assert tuple(row) == ("identity", "jcp", "outro", "not_found", ["AMOUNT_MISMATCH"], ["a"], "high")
