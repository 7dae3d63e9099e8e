"""Every query against its SQL on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from noticelab.plans import catalogue as queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def shown(value):
    return format(value.normalize(), "f") if isinstance(value, decimal.Decimal) else "" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, con, name):
    got = queries.ALL[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(map(shown, r)) for r in got.select(*names).collect())
    assert rows == sorted(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.ALL) - set(queries.ORACLE)))
def test_query_without_sql(spark, name):
    assert queries.ALL[name](spark, SF).count() > 0


def test_ranked_types_tries_each_marker_once(spark):
    """The optimizer must not write out the list of found markers wherever it is used."""
    from noticelab import vocabulary

    plan = queries.ALL["ranked_types"](spark, SF)._jdf.queryExecution().optimizedPlan()
    tried = 0
    while not plan.children().isEmpty():  # texts are folded with two patterns more
        shown = [plan.expressions().apply(i).sql() for i in range(plan.expressions().size())]
        tried += sum(x.upper().count("RLIKE") for x in shown)
        plan = plan.children().head()
    assert len(vocabulary.MARKERS) <= tried <= len(vocabulary.MARKERS) + 4


def plain_partial(a, b):
    from noticelab.functions.similarity import ratio

    short, long = sorted((a, b), key=len)
    windows = [long[max(i, 0) : i + len(short)] for i in range(1 - len(short), len(long))]
    return max((ratio(short, w) for w in windows if w), default=1.0 if not long else 0.0)


def plain_squash(t):
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFKD", t.replace("—", "-")) if not unicodedata.combining(c))
    return "".join(c for c in bare.lower() if not c.isspace() and c not in ".,;:()[]/\\|\"'–-")


def test_fuzzy_evidence_by_brute_force(spark):
    """Held against every window of every text, where the query skips those that share too few characters."""
    from noticelab.plans import queries_record

    got = queries.ALL["fuzzy_evidence"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    cust = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows) and queries_record is not None
    for r in got[::25]:
        k, c = r["doc_id"], cust[r["doc_id"]]
        raw = plain_squash(f"Foi aprovado o pagament0 de dividend0s no valor de R$ {c},50 por ação em 10/05/2026")
        said = [f"pagamento de dividendos no valor de R$ {c},50", f"pagamnto de dividendos n valor de R$ {c}", "grupamento de ações na razão"][k % 3]
        tight, strict = plain_squash(said), k % 2 == 0
        confused = str.maketrans("0158|", "olsbl")
        if tight in raw:
            want = "normalized"
        elif not strict and tight.translate(confused) in raw.translate(confused):
            want = "fuzzy"
        else:
            want = "fuzzy" if not strict and plain_partial(tight, raw) >= 0.85 else "absent"
        assert r["status"] == want


def test_fuzzy_anchors_by_brute_force(spark):
    from noticelab import vocabulary
    from noticelab.functions.similarity import ratio

    anchors = [(f, a) for f, names in vocabulary.ANCHORS.items() for a in names]
    for r in queries.ALL["fuzzy_anchors"](spark, SF).select("label", "field").distinct().collect():
        tight = plain_squash(r["label"])
        held = [(-len(a), i) for i, (_, a) in enumerate(anchors) if plain_squash(a) in tight]
        score, i = max((ratio(tight, plain_squash(a)), -i) for i, (_, a) in enumerate(anchors))
        want = anchors[min(held)[1]][0] if held else anchors[-i][0] if score >= 0.85 else None
        assert r["field"] == want
