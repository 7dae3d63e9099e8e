"""Notices, readings and texts derived from the order tables.

Each column is an expression that Spark and DuckDB read alike, so that a query
and its oracle start from the same rows; the operators under test are not used here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def slashed(d: str) -> str:
    return f"lpad(cast(day({d}) as string), 2, '0') || '/' || lpad(cast(month({d}) as string), 2, '0') || '/' || cast(year({d}) as string)"


def by_remainder(key: str, values: list[str], otherwise: str = "null") -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {x}" for i, x in enumerate(values)) + f" else {otherwise} end"


def isin_of(key: str) -> str:
    """Letters and digits of an ISIN; the last digit is right for some keys only."""
    return f"'BRTK' || lpad(cast({key} as string), 7, '0') || cast({key} % 10 as string)"


# A step's columns may use those of the steps before.
STEPS = [
    {
        "doc_id": "o_orderkey", "cust": "o_custkey", "issuer": "c_name", "d": "cast(o_orderdate as date)",
        "event_type": by_remainder("o_orderkey", [f"'{t}'" for t in ("dividendo", "jcp", "bonificacao", "grupamento", "desdobramento", "subscricao", "outro")]),
        "gross_per_share": "case when o_orderkey % 29 = 0 then null else cast(cast(o_totalprice as decimal(15,2)) * cast('0.001' as decimal(4,3)) as decimal(20,10)) end",
        "tax_rate": "cast(case when o_orderkey % 2 = 0 then '0.175' else '0' end as decimal(10,6))",
    },
    {
        "*": "*",
        "isin": f"case when doc_id % 37 = 0 then {isin_of('(cust + 1)')} when doc_id % 41 = 0 then 'BRXX' else {isin_of('cust')} end",
        "ticker": "case when doc_id % 5 = 0 then null when doc_id % 43 = 0 then 'ZZZZ3' else 'TK' || lpad(cast(cust as string), 7, '0') || '3' end",
        "cnpj": "case when doc_id % 3 = 0 then null else lpad(cast(cust as string), 14, '0') end",
        "share_class": "case when doc_id % 11 = 0 then 'PN' else 'ON' end",
        "approval_date": "case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then d + 40 else d - 5 end",
        "com_date": "case when doc_id % 17 = 0 then d + 1 else d end",
        "ex_date": "case when doc_id % 53 = 0 then null else d + 1 end",
        "payment_date": "case when doc_id % 23 = 0 then null when doc_id % 19 = 0 then d - 3 else d + 20 end",
        "net_per_share": "cast(gross_per_share * (cast('1' as decimal(10,6)) - tax_rate) + cast(case when doc_id % 31 = 0 then '0.01' else '0' end as decimal(4,2)) as decimal(20,10))",
        "currency": "case when doc_id % 47 = 0 then null else 'BRL' end",
        "event_type_label": "event_type",
        "title_prior": "case when doc_id % 59 = 0 then null else event_type end",
        "body_prior": "case when doc_id % 61 = 0 then 'outro' when doc_id % 67 = 0 then null else event_type end",
    },
]
GOLDEN = {
    "row_idx": "c_custkey", "emissor": "c_name", "cnpj": "lpad(cast(c_custkey as string), 14, '0')", "isin": isin_of("c_custkey"),
    "ticker": "'TK' || lpad(cast(c_custkey as string), 7, '0') || '3'", "classe": "'ON'", "status": "case when c_mktsegment = 'BUILDING' then 'suspenso' else 'ativo' end",
}
TITLES = [
    "'Distribuição de dividendos intercalares'",
    "'Juros sobre o Capital Próprio'",
    "'Bonificação em ações'",
    "'Grupamento de ações'",
    "'Desdobramento de ações'",
    "'Direito de subscrição'",
    "'Comunicado ao mercado'",
]
MONTHS = [
    "'janeiro'",
    "'fevereiro'",
    "'março'",
    "'abril'",
    "'maio'",
    "'junho'",
    "'julho'",
    "'agosto'",
    "'setembro'",
    "'outubro'",
    "'novembro'",
    "'dezembro'",
]
TEXTS = {
    "doc_id": "o_orderkey",
    "d": "cast(o_orderdate as date)",
    "raw": "case when o_orderkey % 9 = 0 then 'Fato relevante' else 'Aviso aos Acionistas' end || chr(10) || "
    + by_remainder("o_orderkey", TITLES)
    + " || chr(10) || 'Em reunião realizada em ' || "
    + f"case o_orderkey % 4 when 0 then {slashed('cast(o_orderdate as date)')} when 1 then cast(day(cast(o_orderdate as date)) as string) || ' de ' || "
    + "case month(cast(o_orderdate as date)) " + " ".join(f"when {i + 1} then {m}" for i, m in enumerate(MONTHS)) + " end || ' de ' || cast(year(cast(o_orderdate as date)) as string)"
    + " when 2 then '31/02/2026' else 'data a definir' end || ', foi aprovado o ' || "
    + by_remainder("(o_orderkey + o_custkey)", ["'grupamento'", "'dividendo intermediário'", "'desdobramento'", "'aumento'"])
    + f" || '.' || chr(10) || 'ISIN: ' || {isin_of('o_custkey')} || chr(10) || 'CNPJ 12.345.678/0001-' || lpad(cast(o_custkey % 100 as string), 2, '0') || chr(10) || 'Código ABCD' || cast(3 + o_orderkey % 4 as string) || ' e CNPJ12'",
}


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = (
        read("orders")
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .join(read("customer").selectExpr("c_custkey as o_custkey", "c_name"), "o_custkey")
    )
    for step in STEPS:
        rows = rows.selectExpr(*[x if n == "*" else f"{x} as {n}" for n, x in step.items()])
    return rows.drop("d", "cust")


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*[f"{x} as {n}" for n, x in GOLDEN.items()])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*[f"{x} as {n}" for n, x in TEXTS.items()])


def _columns(step: dict[str, str]) -> str:
    return ", ".join(x if n == "*" else f"{x} as {n}" for n, x in step.items())


#: The same rows in SQL, as the head of a WITH clause.
NOTICES_SQL = f"""notices0 as (select {_columns(STEPS[0])} from orders join customer on c_custkey = o_custkey),
notices as (select {_columns(STEPS[1])} from notices0)"""
GOLDEN_SQL = f"golden as (select {_columns(GOLDEN)} from customer)"
TEXTS_SQL = f"texts as (select {_columns(TEXTS)} from orders)"

#: Three readers' texts of a region: an identifier or a date, damaged at fixed keys.
KINDS = ("text_layer", "ocr_deterministic", "ocr_generative")
READING = {
    0: f"case when o_orderkey % 4 = 0 then null when o_orderkey % 2 = 0 then {isin_of('o_custkey')} else 'R$ 1.234,50' end",
    1: f"case when o_orderkey % 2 = 0 then case when o_orderkey % 6 = 0 then 'BRTK' || lpad(cast(o_custkey as string), 6, '0') || '1' when o_orderkey % 10 = 0 then 'ISIN US037833100' else {isin_of('o_custkey')} end else case when o_orderkey % 5 = 0 then 'R$ 1234,5' when o_orderkey % 7 = 0 then 'XS12345678901, PARTICIPACOES' else 'R$ 1.284,50' end end",
    2: f"case when o_orderkey % 2 = 0 then case when o_orderkey % 8 = 0 then 'em 31/02/2026' else {isin_of('o_custkey')} end else 'R$ 1.234,500' end",
}


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = [
        rows.selectExpr(
            "o_orderkey as doc_id",
            "cast(o_orderkey % 3 as int) as region_id",
            f"'r{k}' as reader",
            f"'{KINDS[k]}' as kind",
            f"{k} as seq",
            f"{x} as text",
        ) for k, x in READING.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("text is not null")


READINGS_SQL = "readings as (select * from (" + " union all ".join(
    f"select o_orderkey as doc_id, cast(o_orderkey % 3 as int) as region_id, 'r{k}' as reader, '{KINDS[k]}' as kind, {k} as seq, {x} as text from orders" for k, x in READING.items()
) + ") where text is not null)"

#: Boxes of three readers on a page for each order, from its lines: whole numbers, so that areas are exact.
BOX = {
    "doc_id": "l_orderkey",
    "page": "1",
    "reader": "'r' || cast(reader as string)",
    "block_order": "cast(l_linenumber * 10 + reader as int)",
    "x0": "cast(l_partkey % 40 + reader * (l_suppkey % 7) as double)",
    "y0": "cast(l_linenumber * 30 + reader * (l_partkey % 9) as double)",
    "x1": "cast(l_partkey % 40 + reader * (l_suppkey % 7) + 60 as double)",
    "y1": "cast(l_linenumber * 30 + reader * (l_partkey % 9) + 20 as double)",
}
BOXES_SQL = f"""boxes as materialized (
  select {", ".join(f"{x} as {n}" for n, x in BOX.items())}
  from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by l_orderkey, l_linenumber)
  cross join (select 0 as reader union all select 1 union all select 2)
  where (l_orderkey + l_linenumber + reader) % 5 <> 0)"""


def boxes(spark: SparkSession, sf_dir: str, by_page: bool = False) -> DataFrame:
    """by_page: all of a page is in one task, so that what is done by page needs no other shuffle."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    if by_page:
        lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    lines = (
        lines.groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    )
    rows = lines.withColumn("reader", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.where("(l_orderkey + l_linenumber + reader) % 5 <> 0")
    return rows.selectExpr(*[f"{x} as {n}" for n, x in BOX.items()])
