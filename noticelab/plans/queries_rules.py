"""Queries on texts, dates, identifiers and votes over varied rows, with SQL that computes each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocabulary
from ..functions import dates, numbers, text
from ..operators import fields, reading
from . import derived
from .registry import SHORT_DAY, firsts_sql, joined, normal_sql, ptbr_sql, query, read, squash_sql, written_sql

# --- dates ---------------------------------------------------------------------

D = "cast(o_orderdate as date)"
LONG_FORM = f"cast(day({D}) as string) || '{{}}' || case month({D}) " + " ".join(
    f"when {i + 1} then {m}" for i, m in enumerate(derived.MONTHS)
) + f" end || ' de ' || cast(year({D}) as string)"
RAW_DATES = derived.by_remainder(
    "o_orderkey",
    [
        derived.slashed(D),
        "'21/08/2' || cast(2000 + o_orderkey % 30 as string)",
        "'A  definir'",
        f"'assembleia para definir em ' || {derived.slashed(D)}",
        "cast(1 + o_orderkey % 9 as string) || '/08/2026'",
        LONG_FORM.format("de "),
        "'1º de maio de 2026'",
        "'após 12 pregões, em ' || cast(1 + o_orderkey % 3 as string) || ' . 8 - 2026'",
        "'31/02/2026'",
        f"'em 5 de algum de 2020 ou 0' || cast(1 + o_orderkey % 9 as string) || '082026'",
        "'Oportunamente, em 10/05/2026'",
        "cast(o_orderkey % 10 as string) || '/13/20261'",
    ],
)
YEARS = dates.LONG_YEAR
REPAIRED_SQL = rf"""raws as (select o_orderkey as doc_id, {RAW_DATES} as raw from orders),
parts as (select *, {normal_sql('raw')} as n, regexp_matches(raw, '(?i)\ba\s+definir\b|oportunamente|a\s+ser\s+divulgad') as undefined,
  regexp_extract(raw, '{YEARS}', 3) as y, lpad(regexp_extract(raw, '{YEARS}', 1), 2, '0') || '/' || lpad(regexp_extract(raw, '{YEARS}', 2), 2, '0') || '/' as head,
  regexp_extract(raw, '{SHORT_DAY}', 1) as day, '/' || lpad(regexp_extract(raw, '{SHORT_DAY}', 2), 2, '0') || '/' || regexp_extract(raw, '{SHORT_DAY}', 3) as tail from raws),
lists as (select *, list_filter(list_transform(range(1, len(y) + 1), lambda i: y[:i - 1] || y[i + 1:]), lambda x: len(x) = 4) as ys,
  case when day <> '' then list_concat(['0' || day, '1' || day, '2' || day], list_filter(list_transform(range(0, 10), lambda o: day || cast(o as varchar)), lambda x: cast(x as int) <= 31)) else [] end as ds from parts),
open as (select *, case when undefined then [] when len(ys) > 0 then list_transform({firsts_sql('ys')}, lambda x: head || x) else list_transform({firsts_sql('ds')}, lambda x: x || tail) end as candidates from lists)"""


def _raw_dates(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"{RAW_DATES} as raw")


@query(
    "date_repair",
    f"""with {REPAIRED_SQL} select doc_id, case when not undefined and len(candidates) = 0 then {written_sql('n')} end as value,
    array_to_string(candidates, ',') as candidates, case when undefined then 'stated_undefined' end as absence_reason from open""",
)
def date_repair(spark, sf_dir):
    fixed = fields.repair_date(F.col("raw"), F.lit("baixa"), F.lit("ocr_deterministic"))
    return (
        _raw_dates(spark, sf_dir)
        .withColumn("f", fixed)
        .select("doc_id", "f.value", joined("f.candidates").alias("candidates"), "f.absence_reason")
    )


@query("ambiguous_dates", f"with {REPAIRED_SQL} select doc_id, head || unnest({firsts_sql('ys')}) as candidate from lists")
def ambiguous_dates(spark, sf_dir):
    return _raw_dates(spark, sf_dir).select("doc_id", F.explode(dates.year_candidates(F.col("raw"))).alias("candidate"))


@query(
    "written_dates",
    f"with {REPAIRED_SQL} select doc_id, {written_sql('n')} as value, nullif(regexp_extract(n, '{dates.ANY_DATE}', 1), '') as first "
    f"from parts",
)
def written_dates(spark, sf_dir):
    return _raw_dates(spark, sf_dir).select(
        "doc_id",
        dates.written_date(F.col("raw"))["value"].alias("value"),
        dates.first_date(F.col("raw")).alias("first"),
    )


LENIENT = derived.by_remainder(
    "o_orderkey",
    [f"{derived.slashed(D)} || ' às 10h'", f"cast({D} as string) || 'T00:00'", "'31/02/2026'", "'2026-02-30'", "'x 01/02/2026'", "''"],
)


@query(
    "lenient_dates",
    rf"""with r as (select o_orderkey as doc_id, {LENIENT} as raw from orders), p as (select *, regexp_extract(raw, '^([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})', 1) as s, regexp_extract(raw, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) as iso from r),
    v as (select doc_id, case when s <> '' then try_cast(string_split(s, '/')[3] || '-' || string_split(s, '/')[2] || '-' || string_split(s, '/')[1] as date) when iso <> '' then try_cast(iso as date) end as value from p)
    select doc_id, value, strftime(value, '%d/%m/%Y') as shown from v""",
)
def lenient_dates(spark, sf_dir):
    value = dates.iso_or_slashed(F.col("raw"))
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"{LENIENT} as raw").withColumn("value", value)
    return rows.select("doc_id", "value", dates.show(F.col("value")).alias("shown"))


PROSE_SQL = ", ".join(
    f"nullif(regexp_extract(n, '{p.replace('(DATE)', dates.ANY_DATE)}', 1), '')" for p in vocabulary.PROSE["approval_date"]
)


@query(
    "prose_dates",
    f"with {derived.TEXTS_SQL}, t as (select doc_id, {normal_sql('raw')} as n from texts), f as (select doc_id, coalesce({PROSE_SQL}) "
    f"as found from t) select doc_id, found as raw, {written_sql('found')} as value from f",
)
def prose_dates(spark, sf_dir):
    rows = derived.texts(spark, sf_dir).withColumn("found", fields.prose_field(F.col("raw"), "approval_date"))
    return rows.select("doc_id", F.col("found").alias("raw"), dates.written_date(F.col("found"))["value"].alias("value"))


SIGNED = derived.by_remainder(
    "o_orderkey",
    [
        f"'Rio de Janeiro (RJ), 1 de maio de 1990. São Paulo (SP), ' || {LONG_FORM.format(' de ')} || '.'",
        f"'Belo Horizonte (MG) , ' || {LONG_FORM.format('  de ')}",
        f"'Osasco (SP), ' || {LONG_FORM.format(' de ')} || ', e Natal (RN), 30 de fevereiro de 2020'",
        f"'Em ' || {derived.slashed(D)} || ', sem cidade'",
        "'Recife (PE), 3 de algum de 2020'",
    ],
)
DRAFTED = r"(?i)[A-ZÀ-Ú][\pL\pN_\s.''-]{2,40}\s*\([A-Z]{2}\)\s*,\s*([0-9]{1,2})\s+de\s+([a-zç]+)\s+de\s+([0-9]{4})"


@query(
    "drafting_dates",
    f"""with t as (select o_orderkey as doc_id, regexp_extract_all(regexp_replace({SIGNED}, '\\s+', ' ', 'g'), '{DRAFTED}', 0)[-1] as last from orders),
    p as (select doc_id, {normal_sql(f"regexp_extract(last, '{DRAFTED}', 1) || ' de ' || regexp_extract(last, '{DRAFTED}', 2) || ' de ' || regexp_extract(last, '{DRAFTED}', 3)")} as n from t)
    select doc_id, {written_sql('n')} as drafted from p""",
)
def drafting_dates(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"{SIGNED} as raw")
    return rows.select("doc_id", dates.drafting_date(F.col("raw")).alias("drafted"))


# --- numbers ---------------------------------------------------------------------

RAW_NUMBERS = derived.by_remainder(
    "o_orderkey",
    [
        "'R$ ' || cast(o_custkey as string) || '.' || lpad(cast(o_orderkey % 1000 as string), 3, '0') || ',5'",
        "cast(o_custkey as string) || ',' || cast(o_orderkey % 100 as string) || '%'",
        "'-' || cast(o_custkey as string) || '.25'",
        "'1.7,5'",
        "'sem valor'",
        "cast(o_orderkey as string) || ' para ' || cast(o_custkey as string)",
    ],
)


@query(
    "ptbr_numbers",
    f"""with r as (select o_orderkey as doc_id, {RAW_NUMBERS} as raw from orders), k as (select *, regexp_replace(raw, '[^0-9.,-]', '', 'g') as kept from r)
    select doc_id, {ptbr_sql('raw')} as ptbr, try_cast(case when contains(kept, ',') then replace(replace(kept, '.', ''), ',', '.') else kept end as decimal(20,10)) as plain,
    try_cast(nullif(regexp_extract(raw, '([0-9]+)', 1), '') as int) as whole from k""",
)
def ptbr_numbers(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"{RAW_NUMBERS} as raw")
    raw = F.col("raw")
    return rows.select(
        "doc_id",
        numbers.ptbr_number(raw).alias("ptbr"),
        numbers.decimal_number(raw).alias("plain"),
        numbers.first_int(raw).alias("whole"),
    )


MONEY_TEXT = derived.by_remainder(
    "o_orderkey",
    [
        "'Pago R$ ' || cast(o_custkey as string) || ',50 por ação'",
        "'IRRF de ' || cast(o_orderkey % 30 as string) || ',5 % na fonte'",
        "'nada'",
        "'r$1.000,00. e 3%'",
    ],
)


@query(
    "money_and_percent",
    rf"""with t as (select o_orderkey as doc_id, {normal_sql(MONEY_TEXT)} as n from orders)
    select doc_id, nullif(upper(regexp_extract(n, 'r\$\s*[0-9.,]+', 0)), '') as money, nullif(regexp_extract(n, '[0-9][0-9.,\s]*%', 0), '') as percent from t""",
)
def money_and_percent(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.normalize(F.expr(MONEY_TEXT)).alias("n"))
    return rows.select("doc_id", fields.money_in(F.col("n")).alias("money"), fields.percent_in(F.col("n")).alias("percent"))


# --- identifiers -----------------------------------------------------------------

ID_TEXT = f"{derived.TEXTS['raw']} || " + derived.by_remainder(
    "o_orderkey",
    [
        "' ISIN: US03783310051 x'",
        "' isin（BRAAAAACNOR4） e ABCD3'",
        "' 12345678000195/ABCD11 ISIN12'",
        "''",
        "' BRAAAAACNOR4 ISINBRBBBBACNOR40'",
    ],
)
IDS_SQL = rf"""t as (select o_orderkey as doc_id, upper(replace(replace({ID_TEXT}, '（', ' ('), '）', ') ')) as up from orders),
ids as (select doc_id, regexp_extract_all(up, 'ISIN[^A-Z0-9]{{0,4}}([A-Z]{{2}}[A-Z0-9]{{9}}[0-9])', 1) as named, regexp_extract_all(up, '[A-Z0-9]+') as words,
  regexp_extract_all(up, '([0-9]{{2}}\.?[0-9]{{3}}\.?[0-9]{{3}}/?[0-9]{{4}}-?[0-9]{{2}})', 1) as tax from t),
found as (select doc_id, list_concat(named, list_filter(words, lambda w: regexp_full_match(w, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]'))) as isins,
  list_filter(words, lambda w: regexp_full_match(w, '[A-Z]{{4}}[0-9]{{1,2}}') and w[:4] not in ('NIRE', 'CNPJ', 'ISIN')) as tickers,
  list_transform(tax, lambda x: regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '([0-9]{{2}})([0-9]{{3}})([0-9]{{3}})([0-9]{{4}})([0-9]{{2}})', '\1.\2.\3/\4-\5')) as cnpjs from ids)"""


@query(
    "identifier_extract",
    f"with {IDS_SQL} select doc_id, array_to_string({firsts_sql('isins')}, ',') as isins, array_to_string({firsts_sql('tickers')}, ',') "
    f"as tickers, array_to_string({firsts_sql('cnpjs')}, ',') as cnpjs from found",
)
def identifier_extract(spark, sf_dir):
    c = F.col("raw")
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"{ID_TEXT} as raw")
    return rows.select(
        "doc_id",
        joined(text.find_isins(c)).alias("isins"),
        joined(text.find_tickers(c)).alias("tickers"),
        joined(text.find_cnpjs(c)).alias("cnpjs"),
    )


WORDS = {
    "isin": derived.by_remainder("o_orderkey", ["' br tk 0000001a2 '", "'xBRTKAAACNOR4y'", "'us 0378'"]),
    "ticker": derived.by_remainder("o_orderkey", ["'abcd 3'", "' ab 1'", "'(XYZW11)'"]),
    "cnpj": derived.by_remainder("o_orderkey", ["'12345678000195'", "'12.345.678/0001-95 '", "'123'"]),
    "currency": derived.by_remainder("o_orderkey", ["'R$'", "' '", "'usd '", "'em brl'"]),
    "share_class": derived.by_remainder("o_orderkey", ["'ordinárias'", "'Preferencial'", "'PN e ON'", "'unit'"]),
    "issuer": "' Alfa SA '",
}
WORDS_SQL = "w as (" + " union all ".join(
    f"select o_orderkey as doc_id, '{f}' as field, {x} as raw from orders" for f, x in WORDS.items()
) + ")"


@query(
    "identifier_repair",
    rf"""with {WORDS_SQL}, p as (select *, trim(raw) as plain, upper(trim(raw)) as up, replace(upper(trim(raw)), ' ', '') as tight, regexp_replace(raw, '[^0-9]', '', 'g') as digits from w)
    select doc_id, field, case field when 'isin' then coalesce(nullif(regexp_extract(tight, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]', 0), ''), tight) when 'ticker' then coalesce(nullif(regexp_extract(tight, '[A-Z]{{4}}[0-9]{{1,2}}', 0), ''), tight)
      when 'cnpj' then case when len(digits) = 14 then regexp_replace(digits, '(..)(...)(...)(....)(..)', '\1.\2.\3/\4-\5') else plain end
      when 'currency' then case when up = '' or contains(up, 'R$') or contains(up, 'BRL') then 'BRL' else up end
      when 'share_class' then case when contains(up, 'PREFERENC') or contains(up, 'PN') then 'PN' when contains(up, 'ORDIN') or contains(up, 'ON') then 'ON' else plain end else plain end as value from p""",
)
def identifier_repair(spark, sf_dir):
    rows = (
        read(spark, sf_dir, "orders")
        .selectExpr(
            "o_orderkey as doc_id",
            f"explode(array({', '.join(f'struct({chr(39)}{f}{chr(39)} as field, {x} as raw)' for f, x in WORDS.items())})) as x",
        )
        .select("doc_id", "x.*")
    )
    return rows.select("doc_id", "field", fields.repair_identifier(F.col("field"), F.col("raw")).alias("value"))


CLASS_TEXT = derived.by_remainder(
    "o_orderkey",
    ["'ações ordinárias e preferenciais'", "'ação ON'", "'Ordinária'", "'conta pn.'", "'once upon'"],
)


@query(
    "share_classes",
    rf"""with t as (select o_orderkey as doc_id, {normal_sql(CLASS_TEXT)} as n from orders)
    select doc_id, case when contains(n, 'preferencia') or regexp_matches(n, '\bpn\b') then 'PN' when contains(n, 'ordinaria') or regexp_matches(n, '\bon\b') then 'ON' end as share_class from t""",
)
def share_classes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        text.share_class(F.expr(CLASS_TEXT)).alias("share_class"),
    )


# --- labels, evidence ----------------------------------------------------------------

FUSED = derived.by_remainder(
    "o_orderkey",
    [
        "'Valor bruto ..... R$ ' || cast(o_custkey as string) || ',00'",
        "'Texto corrido de ' || cast(o_orderkey as string) || ' palavras'",
        "'Data ex    ' || cast(o_custkey as string)",
        "'IRRF na fonte  17,5%'",
        "'código  abcd3'",
        "'um,,dois,,três  4'",
        "'prosa  com dois brancos'",
    ],
)
SPLIT_SQL = rf"""f as (select o_orderkey as doc_id, {FUSED} as text from orders),
w as (select *, list_filter(list_transform(regexp_split_to_array(text, '[.,·•…]{{2,}}|\s{{3,}}'), lambda x: trim(x)), lambda x: x <> '') as wide, list_filter(list_transform(regexp_split_to_array(trim(text), '\s{{2,}}'), lambda x: trim(x)), lambda x: x <> '') as narrow from f),
p as (select *, case when len(wide) = 2 then wide when len(wide) = 1 and len(narrow) = 2 and regexp_matches(narrow[2], '(?i)^(?:R\$|[0-9]|[A-Z]{{4}}[0-9])') then narrow end as parts from w)"""


@query(
    "split_fused",
    f"""with {SPLIT_SQL} select doc_id, 0 as piece, coalesce(parts[1], text) as text, case when parts is null then 100000 else cast(floor(100000.0 * (cast(len(parts[1]) as double) / (len(parts[1]) + len(parts[2])))) as bigint) end as x1 from p
    union all select doc_id, 1, parts[2], 100000 from p where parts is not null""",
)
def split_fused(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as doc_id",
        "1 as page",
        "'r' as reader",
        "0 as block_order",
        f"{FUSED} as text",
        "0D as x0",
        "0D as y0",
        "100000D as x1",
        "10D as y1",
    )
    return reading.split_fused(rows).select("doc_id", "piece", "text", F.floor(F.col("x1")).cast("long").alias("x1"))


EVIDENCE = derived.by_remainder(
    "doc_id",
    [
        "regexp_extract(raw, 'ISIN: (BRTK[0-9]+)', 1)",
        "replace(upper(split_part(raw, chr(10), 2)), ' ', '')",
        "split_part(raw, chr(10), 1) || ', ' || split_part(raw, chr(10), 2)",
        "'não consta'",
        "' '",
    ],
)
LOCATE_SQL = f"""{derived.TEXTS_SQL}, l as (select doc_id, string_split(raw, chr(10)) as lines, {EVIDENCE} as evidence, case when doc_id % 2 = 0 then 'ações' end as value from texts),
b as (select doc_id, unnest(range(0, len(lines))) as block_order, unnest(lines) as block, evidence, value from l where trim(evidence) <> ''),
s as (select doc_id, block_order, {normal_sql('block')} as nb, {squash_sql('block')} as sb, {normal_sql('evidence')} as ne, {squash_sql('evidence')} as se, {squash_sql('value')} as sv from b),
q as (select doc_id, block_order, case when contains(nb, ne) then 1.0 when contains(sb, se) then 0.85 when sb <> '' and contains(se, sb)
  then case when coalesce(sv <> '' and contains(sb, sv), false) then greatest(0.6 * len(sb) / greatest(len(se), 1), 0.9) else 0.6 * len(sb) / greatest(len(se), 1) end end as quality from s)"""


@query(
    "evidence_locate",
    f"""with {LOCATE_SQL} select doc_id, 1 as evidence_id, cast(block_order as int) as block_order, cast(round(quality, 4) as decimal(6,4)) as quality
    from (select *, row_number() over (partition by doc_id order by quality desc, block_order) as n from q where quality > 0) where n = 1""",
)
def evidence_locate(spark, sf_dir):
    rows = derived.texts(spark, sf_dir)
    blocks = rows.select("doc_id", F.posexplode(F.split("raw", "\n")).alias("block_order", "text"))
    evidence = rows.selectExpr(
        "doc_id",
        "1 as evidence_id",
        f"{EVIDENCE} as evidence",
        "case when doc_id % 2 = 0 then 'ações' end as value",
    )
    return fields.locate(evidence, blocks).withColumn("quality", F.col("quality").cast("decimal(6,4)"))


LOOSE = "translate({}, '0158|', 'olsbl')"


@query(
    "grounding_status",
    f"""with i as materialized (select item_id, {normal_sql('text')} as e, {squash_sql('text')} as se from benchmark), d as materialized (select doc_id, {normal_sql('text')} as r, {squash_sql('text')} as sr from documents)
    select item_id, doc_id, case when contains(r, e) then 'exact' when contains(sr, se) then 'normalized' else 'fuzzy' end as status
    from d, i where se <> '' and contains({LOOSE.format('sr')}, {LOOSE.format('se')})""",
)
def grounding_status(spark, sf_dir):
    return fields.find_evidence(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


# --- votes on values ---------------------------------------------------------------------

CANDIDATES = {
    "rule": "case when o_orderkey % 7 = 0 then null else 'R$ ' || cast(o_orderkey % 100 as string) || ',50' end",
    "text": "case when o_orderkey % 3 = 0 then cast(o_orderkey % 90 as string) || ',5' else cast(o_orderkey % 100 as string) || ',500' end",
}
CANDIDATES_SQL = "said as (" + " union all ".join(
    f"select o_orderkey as doc_id, '{e}' as extractor, {place} as place, {seq} as seq, {x if seq else chr(39) + 'old' + chr(39)} as value_raw from orders" for place, (e, x) in enumerate(
        CANDIDATES.items(),
        1,
    ) for seq in (0, 1)
) + ")"


@query(
    "candidate_merge",
    f"""with {CANDIDATES_SQL}, last as (select * from (select *, row_number() over (partition by doc_id, extractor order by seq desc) as k from said) where k = 1 and value_raw is not null),
    g as (select doc_id, coalesce(cast({ptbr_sql('value_raw')} as varchar), {squash_sql('value_raw')}) as key, count(*) as votes, min(place) as place, arg_min(value_raw, place) as value_raw from last group by all)
    select doc_id, value_raw, votes, readings > 1 as disputed from (select *, count(*) over (partition by doc_id) as readings, row_number() over (partition by doc_id order by votes desc, place) as n from g) where n = 1""",
)
def candidate_merge(spark, sf_dir):
    items = [
        f"struct('gross_per_share' as field, '{e}' as extractor, {seq} as seq, {x if seq else chr(39) + 'old' + chr(39)} as value_raw)" for e, x in CANDIDATES.items() for seq in (
            0,
            1,
        )
    ]
    rows = (
        read(spark, sf_dir, "orders")
        .selectExpr("o_orderkey as doc_id", f"explode(array({', '.join(items)})) as x")
        .select("doc_id", "x.*")
    )
    return fields.merge(rows, ["rule", "text"]).select("doc_id", "value_raw", "votes", "disputed")


HALVES = [
    ("rule", "ratio_from", "cast(o_orderkey % 4 + 1 as string) || ' ações'", "true"),
    ("rule", "ratio_to", "'1'", "o_orderkey % 11 <> 0"),
    ("text", "ratio_from", "'1 (uma)'", "o_orderkey % 13 <> 0"),
    ("text", "ratio_to", "cast(case when o_orderkey % 3 = 0 then o_orderkey % 4 + 1 else 2 end as string)", "o_orderkey % 5 <> 0"),
]
HALVES_SQL = "halves as (" + " union all ".join(
    f"select o_orderkey as doc_id, '{e}' as extractor, {x} as value_raw from orders where {w}" for e, _, x, w in HALVES
) + ")"


@query(
    "ratio_pair",
    f"""with {HALVES_SQL}, p as (select doc_id, extractor, list_sort(list(cast(regexp_extract(value_raw, '([0-9]+)', 1) as int))) as pair from halves group by all)
    select doc_id, case when count(*) >= 2 and min(len(pair)) = 2 then count(distinct pair) = 1 end as agrees from p group by doc_id""",
)
def ratio_pair(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    parts = [
        rows.where(w).selectExpr(
            "o_orderkey as doc_id",
            f"'{f}' as field",
            f"'{e}' as extractor",
            "0 as seq",
            f"{x} as value_raw",
        ) for e, f, x, w in HALVES
    ]
    return fields.ratio_pair_agrees(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


READS = {
    "text_layer": "case when o_orderkey % 2 = 0 then 'Pago R$ ' || cast(o_custkey % 50 as string) || ',50 por acao' else 'nada' end",
    "ocr_deterministic": "case when o_orderkey % 3 = 0 then 'pago r$' || cast(o_custkey % 50 as string) || ',50' else 'R$ ' || cast(o_custkey % 7 as string) || ',50' end",
    "ocr_generative": "case when o_orderkey % 5 = 0 then 'R$ ' || cast(o_custkey % 50 as string) || ' , 50' else '' end",
}
ASKED = "'R$ ' || cast(o_custkey % 50 as string) || ',50'"
HOLDS_SQL = f"""h as (select o_orderkey as doc_id, o_custkey, {ASKED} as value, list_filter([{', '.join(f"case when contains({squash_sql(x)}, {squash_sql(ASKED)}) then '{k}' end" for k, x in READS.items())}], lambda k: k is not null) as kinds from orders)"""
LEVEL_SQL = (
    "case when list_contains(kinds, 'text_layer') then case when len(kinds) > 1 then 'muito_alta' else 'alta' end when len(kinds) > 1 "
    "then 'media' else 'baixa' end"
)


def _reads(spark, sf_dir):
    pairs = ", ".join(f"'{k}', {x}" for k, x in READS.items())
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", "o_custkey", f"map({pairs}) as reads", f"{ASKED} as value")


@query("sweep_accept", f"with {HOLDS_SQL} select doc_id, value, {LEVEL_SQL} as level from h where len(kinds) > 0 and doc_id % 7 <> 0")
def sweep_accept(spark, sf_dir):
    reads = _reads(spark, sf_dir)
    returned = reads.select("doc_id", F.lit("gross_per_share").alias("field"), "value")
    return fields.sweep_accept(
        returned,
        returned.where("doc_id % 7 <> 0"),
        reads.select("doc_id", "reads"),
        reading.level_of,
    ).select("doc_id", "value", "level")


@query(
    "sweep_confirm",
    f"with {HOLDS_SQL} select doc_id, array_to_string(list_filter(['text_layer','ocr_deterministic','ocr_generative'], lambda k: k = "
    f"'ocr_generative' or list_contains(kinds, k)), ',') as kinds from h where o_custkey % 50 = o_custkey % 60",
)
def sweep_confirm(spark, sf_dir):
    rows = _reads(spark, sf_dir)
    kept = rows.select("doc_id", F.lit("gross_per_share").alias("field"), "value", F.array(F.lit("ocr_generative")).alias("kinds"))
    again = F.concat((F.col("o_custkey") % 60).cast("string"), F.lit(",5"))
    returned = rows.select("doc_id", F.lit("gross_per_share").alias("field"), again.alias("value"))
    return fields.sweep_confirm(returned, kept, rows.select("doc_id", "reads")).select("doc_id", joined("kinds").alias("kinds"))


SAID = (
    "'valor de R$ ' || cast(o_custkey % 50 as string) || ',50 em ' || cast(o_orderkey % 7 as string) || ' de 10.05.2026, ver ' || "
    "cast(o_orderkey % 3 * 100 as string)"
)
KNOWN = "array(cast(o_custkey % 40 as string) || ',5000', '10/05/2026', '3')"
PLAIN_SQL = "regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '0+$', '')"


@query(
    "narrative_guard",
    rf"""with s as (select o_orderkey as doc_id, list_filter(list_transform(regexp_extract_all({SAID}, '[0-9][0-9.,/]*[0-9]|[0-9]', 0), lambda x: {PLAIN_SQL}), lambda x: x <> '') as cited, list_transform([cast(o_custkey % 40 as varchar) || ',5000', '10/05/2026', '3'], lambda x: {PLAIN_SQL}) as known from orders)
    select doc_id, array_to_string(list_sort(list_distinct(list_filter(cited, lambda x: not list_contains(known, x)))), ',') as unknown from s""",
)
def narrative_guard(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"{SAID} as said", f"{KNOWN} as known")
    return rows.select("doc_id", joined(fields.unknown_figures(F.col("said"), F.col("known"))).alias("unknown"))
