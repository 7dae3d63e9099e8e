"""Expressions on single values."""

import datetime
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticelab.functions import dates, numbers, text
from noticelab.functions.similarity import lcs, partial_ratio, ratio
from noticelab import vocabulary


def value(spark, make, *inputs):
    row = spark.createDataFrame([tuple(inputs)], ", ".join(f"c{i} {'string' if isinstance(x, str) or x is None else 'int' if isinstance(x, int) else 'decimal(20,10)'}" for i, x in enumerate(inputs)))
    return row.select(make(*[F.col(c) for c in row.columns]).alias("x")).first()[0]


@pytest.mark.parametrize("raw, want", [("Ação  Nº ½ ﬁm", "acao no 1⁄2 fim"), (" “A” – b ", '"a" - b'), ("", "")])
def test_normalize(spark, raw, want):
    assert value(spark, text.normalize, raw) == want


def test_normalize_null(spark):
    assert value(spark, text.normalize, None) is None


def test_squash_keeps_currency(spark):
    assert value(spark, text.squash, "R$ 1.234,50 (um)") == "r$123450um"


@pytest.mark.parametrize("a, b, same", [("R$ 1.234,50", "R$ 1234,5", True), ("1,50", "1,500", True), ("1,50", "15,0", False), ("1,0", "10", False), ("1,00", "1", True)])
def test_vote_key(spark, a, b, same):
    assert (value(spark, text.vote_key, a) == value(spark, text.vote_key, b)) is same


@pytest.mark.parametrize("raw, want", [("15/06/2026", (2026, 6, 15)), ("28 de maio de 2026", (2026, 5, 28)), ("22062026", (2026, 6, 22)), ("31/02/2026", None), ("nada", None), ("31/02/2026 e 22062026", None)])
def test_written_date(spark, raw, want):
    got = value(spark, dates.written_date, raw)
    assert got["value"] == (datetime.date(*want) if want else None)


def test_year_candidates(spark):
    got = value(spark, dates.year_candidates, "21/08/22026")
    assert "21/08/2026" in got and "21/08/2202" in got and len(got) == len(set(got))
    assert value(spark, dates.year_candidates, "21/08/2026") is None


def test_day_candidates(spark):
    got = value(spark, dates.day_candidates, "2/08.2026")
    assert {"02/08/2026", "12/08/2026", "22/08/2026", "21/08/2026"} <= set(got)


@pytest.mark.parametrize("raw, want", [("R$ 0,4275000000", "0.4275"), ("R$ 50.000,00", "50000"), ("-1,5", "1.5"), ("0.175", "175"), ("x", None)])
def test_ptbr_number(spark, raw, want):
    assert value(spark, numbers.ptbr_number, raw) == (Decimal(want) if want else None)


@pytest.mark.parametrize("raw, want", [("0.175", "0.175"), ("-1.234,5", "-1234.5")])
def test_decimal_number(spark, raw, want):
    assert value(spark, numbers.decimal_number, raw) == Decimal(want)


@pytest.mark.parametrize("x, want", [("1000.0000000000", "1.000,00"), ("0.4275000000", "0,4275"), ("-1234567.8900000000", "-1.234.567,89")])
def test_show_decimal(spark, x, want):
    assert value(spark, numbers.show_decimal, Decimal(x)) == want


def test_rate(spark):
    assert value(spark, numbers.rate, "17,5%") == Decimal("0.175")


@pytest.mark.parametrize("isin, good", [("US0378331005", True), ("US0378331006", False), ("BRXX", False)])
def test_isin(spark, isin, good):
    assert value(spark, numbers.isin_ok, isin) is good


@pytest.mark.parametrize("cnpj, good", [("09.888.999/0001-21", True), ("11.111.111/0001-11", False), ("1", False)])
def test_cnpj(spark, cnpj, good):
    assert value(spark, numbers.cnpj_ok, cnpj) is good


@pytest.mark.parametrize("raw, flawed", [("BRTLNRACPR2", True), ("31/02/2026", True), ("BRTLNRACNPR2", False), ("15/06/2026", False)])
def test_structural_flaws(spark, raw, flawed):
    assert bool(value(spark, text.structural_flaws, raw)) is flawed


def test_identifiers(spark):
    raw = "Código ABCD3, NIRE35, ISIN（BRABCDACNOR5）CNPJ 12.345.678/0001-95"
    assert value(spark, text.find_tickers, raw) == ["ABCD3"]
    assert value(spark, text.find_isins, raw) == ["BRABCDACNOR5"]
    assert value(spark, text.find_cnpjs, raw) == ["12.345.678/0001-95"]


def test_split_label_value(spark):
    assert value(spark, text.split_label_value, "Valor bruto ..... R$ 1,00") == ["Valor bruto", "R$ 1,00"]
    assert value(spark, text.split_label_value, "Data com  15/06/2026") == ["Data com", "15/06/2026"]
    assert value(spark, text.split_label_value, "um  dois") is None


def _slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    assert lcs(a, b) == _slow_lcs(a, b)


def test_ratios():
    assert ratio("abc", "abc") == 1.0 and ratio("", "") == 1.0 and ratio("a", "b") == 0.0
    assert partial_ratio("valor", "o valor bruto") == 1.0 and partial_ratio("", "x") == 0.0


def test_every_reason_is_placed():
    assert len(vocabulary.REASONS) == 17
    assert all(s in ("block", "review") and layer in vocabulary.LAYERS and kind for s, layer, kind in vocabulary.REASONS.values())


def test_every_anchor_field_is_known():
    known = {f for a, b in vocabulary.FIELD_SPECS.values() for f in a + b} | {"ratio"}
    assert set(vocabulary.ANCHORS) <= known


@given(st.text("abcde", max_size=9), st.text("abcde", max_size=30))
def test_partial_ratio_by_brute_force(a, b):
    """Stretches that share too few characters are skipped, and none that counts."""
    short, long = sorted((a, b), key=len)
    windows = [long[max(i, 0) : i + len(short)] for i in range(1 - len(short), len(long))]
    want = max((ratio(short, w) for w in windows if w), default=1.0 if not long else 0.0)
    assert partial_ratio(a, b) == want
    assert partial_ratio(a, b, 0.85) == (want if want >= 0.85 else 0.0)
