"""What plans must not do: go through the driver, compute a text again in a loop, move rows that could stay."""

import re
from pathlib import Path

import pytest

from noticelab import vocabulary
from noticelab.functions import text
from noticelab.operators import classify
from noticelab.plans import catalogue as queries
from noticelab.plans import queries_record

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


def plan(spark, name, executed=True):
    made = queries.ALL[name](spark, SF)._jdf.queryExecution()
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return (made.executedPlan() if executed else made.optimizedPlan()).toString()


def test_evidence_locate_does_not_broadcast_blocks(spark):
    assert "BroadcastExchange" not in plan(spark, "evidence_locate")


def test_fuzzy_anchors_moves_no_rows(spark):
    assert "Exchange" not in plan(spark, "fuzzy_anchors")


def test_curated_notes_folds_evidence_once(spark):
    assert plan(spark, "curated_notes", executed=False).count("translate(") == 2


def test_prose_words_tries_a_pattern_where_its_code_stands(spark):
    shown = plan(spark, "prose_words", executed=False)
    assert len(re.findall(r"Contains\(", shown)) >= len(queries_record.TERMS)


def test_a_marker_needs_one_of_its_words():
    said = {"lei n? 9.249|lei no 9249": "", **{p: "" for _, p, _, _ in vocabulary.MARKERS}}
    assert all(classify._words(classify._parsed(p)) for p in said)
    words = lambda p: classify._words(classify._parsed(p))
    assert words(r"art(?:igo)?\.? ?9[º°o]?\b") == ["art"] and words("irrf|retencao de imposto") == ["irrf", "retencao"]
    assert words("a?b*") == [] and words("JCP") == [] and words("(?:xy|z?)") == [] and words("(ab){0,2}c") == ["c"]
    for pattern in said:
        for example in ("juros  sobreo capital proprio", "lei no 9.249", "tjlp", "artigo 9", "reserva de lucros", "resultadodo exercicio"):
            if re.search(text.spaced_pattern(pattern), example):
                assert any(w in example for w in words(pattern))



@pytest.mark.parametrize("name", ["triage_documents", "failed_documents", "records", "document_lines", "justifications"])
def test_verdicts_come_from_one_lookup_without_a_row_for_each_reason(spark, name):
    """The two lists that are unfolded are the keys of notices and of the reference base."""
    assert len(re.findall(r"\bGenerate\b", plan(spark, name, executed=False))) == 2


def test_cut_by_looks_nothing_up(spark):
    assert "row_idx" not in plan(spark, "cut_by", executed=False)


def test_lending_shuffles_lines_once(spark):
    assert len(re.findall(r"\bExchange\b", plan(spark, "cell_geometry_lending"))) == 1
