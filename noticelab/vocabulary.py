"""Fixed vocabularies of the notice domain, and as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Event types in the order that breaks ties, and their families.
EVENT_TYPES = ("dividendo", "jcp", "bonificacao", "grupamento", "desdobramento", "subscricao", "outro")
CASH, RATIO = ("dividendo", "jcp"), ("bonificacao", "grupamento", "desdobramento")

# Reading mechanisms with assumed error rates, strongest first, and the ladder of levels.
KINDS = {"text_layer": 0.02, "ocr_deterministic": 0.10, "ocr_generative": 0.25}
PIXEL_KINDS = ("ocr_deterministic", "ocr_generative")
LADDER = ("muito_alta", "alta", "media", "baixa")

# Required and optional fields of each event type.
IDENTITY_REQUIRED = ("issuer", "isin", "ticker", "event_type_label")
IDENTITY_OPTIONAL = ("cnpj", "share_class")
FIELD_SPECS = {
    "dividendo": (IDENTITY_REQUIRED + ("currency", "gross_per_share", "com_date", "ex_date"), IDENTITY_OPTIONAL + ("approval_date", "payment_date", "tax_rate", "net_per_share")),
    "jcp": (IDENTITY_REQUIRED + ("currency", "gross_per_share", "com_date", "ex_date"), IDENTITY_OPTIONAL + ("approval_date", "payment_date", "tax_rate", "net_per_share")),
    "bonificacao": (IDENTITY_REQUIRED + ("ratio_from", "ratio_to", "com_date", "ex_date", "currency"), IDENTITY_OPTIONAL + ("approval_date", "ratio_text", "cost_basis", "credit_date", "trading_start", "fraction_period")),
    "grupamento": (IDENTITY_REQUIRED + ("ratio_from", "ratio_to", "com_date"), IDENTITY_OPTIONAL + ("approval_date", "ex_date", "ratio_text", "trading_start", "fraction_period", "credit_date")),
    "desdobramento": (IDENTITY_REQUIRED + ("ratio_from", "ratio_to", "com_date"), IDENTITY_OPTIONAL + ("approval_date", "ex_date", "ratio_text", "trading_start", "fraction_period", "credit_date")),
    "subscricao": (IDENTITY_REQUIRED, IDENTITY_OPTIONAL + ("approval_date", "com_date", "ex_date", "currency")),
    "outro": (("issuer",), ("isin", "ticker", "event_type_label", "approval_date", "com_date", "ex_date", "currency")),
}
FIELD_CLASSES = {
    "financial_critical": ("gross_per_share", "net_per_share", "ratio_from", "ratio_to", "cost_basis", "com_date", "ex_date", "payment_date"),
    "identity": ("isin", "ticker", "cnpj", "issuer"),
    "contextual": ("share_class", "approval_date", "currency", "tax_rate", "trading_start", "credit_date", "fraction_period"),
}
CRITICAL = FIELD_CLASSES["financial_critical"] + FIELD_CLASSES["identity"]
DATE_FIELDS = ("approval_date", "com_date", "ex_date", "payment_date", "trading_start", "credit_date")
MONEY_FIELDS = ("gross_per_share", "net_per_share", "cost_basis")

# Reason -> severity, layer, kind of error.
REASONS = {
    "DATE_INCOHERENCE": ("block", "validacao", "incoerencia"),
    "UNGROUNDED_CRITICAL_FIELD": ("block", "extracao", "fabricacao"),
    "ISSUER_INACTIVE": ("block", "validacao", "identidade"),
    "MISSING_REQUIRED_FIELD": ("block", "validacao", "ausencia"),
    "ISSUER_NOT_IN_GOLDEN": ("review", "validacao", "identidade"),
    "IDENTIFIER_MISMATCH": ("review", "validacao", "identidade"),
    "IDENTIFIER_KEY_CONFLICT": ("review", "validacao", "identidade"),
    "IDENTIFIER_WEAK_MATCH": ("review", "validacao", "identidade"),
    "AMOUNT_MISMATCH": ("review", "validacao", "incoerencia"),
    "EVENT_TYPE_TITLE_CONFLICT": ("review", "classificacao", "divergencia"),
    "CLASSIFIER_DISAGREEMENT": ("review", "classificacao", "divergencia"),
    "UNKNOWN_EVENT_TYPE": ("review", "classificacao", "ausencia"),
    "EXTRACTOR_DISAGREEMENT": ("review", "extracao", "divergencia"),
    "AMBIGUOUS_DATE_PARSE": ("review", "extracao", "legibilidade"),
    "FIELD_STATED_UNDEFINED": ("review", "extracao", "ausencia"),
    "FIELD_NOT_FOUND": ("review", "extracao", "ausencia"),
    "NO_CORROBORATION": ("review", "consenso", "ausencia"),
}
LAYERS = ("consenso", "classificacao", "extracao", "validacao")
LOOKUP_SEVERITY = {
    "MATCH": "pass",
    "MISMATCH": "warn",
    "WEAK_MATCH": "warn",
    "KEY_CONFLICT": "warn",
    "NOT_FOUND": "info",
    "INACTIVE": "info",
}
LOOKUP_REASON = {
    "NOT_FOUND": "ISSUER_NOT_IN_GOLDEN",
    "KEY_CONFLICT": "IDENTIFIER_KEY_CONFLICT",
    "WEAK_MATCH": "IDENTIFIER_WEAK_MATCH",
    "INACTIVE": "ISSUER_INACTIVE",
    "MISMATCH": "IDENTIFIER_MISMATCH",
}
TICKER_CLASSES = {"3": "ON", "4": "PN", "5": "PNA", "6": "PNB", "11": "UNIT"}

# Event type, pattern, weight, whether it defines the type.
MARKERS = [
    ("jcp", "juros sobre o capital proprio", 3.0, True), ("jcp", r"\bjcp\b", 2.5, True), ("jcp", "remuneracao do capital proprio", 3.0, True), ("jcp", r"lei n?[º°o]?\s*9\.?249", 3.0, True),
    ("jcp", r"taxa de juros de longo prazo|\btjlp\b", 3.0, True), ("jcp", "imputad[oa]s? ao[s]? dividendo", 2.5, True), ("jcp", "patrimonio liquido", 1.5, True), ("jcp", r"art(?:igo)?\.? ?9[º°o]?\b", 1.0, True), ("jcp", "retencao de imposto de renda|irrf", 0.3, False),
    ("dividendo", "dividendos? intercalar", 3.0, True), ("dividendo", "dividendos? intermediari", 3.0, True), ("dividendo", "reservas? de lucros", 2.0, True), ("dividendo", "lucro do exercicio|resultado do exercicio", 1.5, True), ("dividendo", "distribuicao de dividendos", 1.5, True), ("dividendo", r"\bdividendos?\b", 0.4, False),
    ("bonificacao", "bonificacao em acoes", 3.0, True), ("bonificacao", "capitalizacao de reservas", 3.0, True), ("bonificacao", "acao nova para cada", 3.0, True), ("bonificacao", "aumento do capital social mediante capitalizacao", 2.5, True), ("bonificacao", "custo atribuido", 1.0, False),
    ("grupamento", "grupamento", 3.0, True), ("grupamento", r"\binplit\b", 3.0, True), ("grupamento", "acoes existentes para", 2.5, True), ("grupamento", "sem modificacao do valor do capital social|sem alteracao do capital social", 1.5, True), ("grupamento", "fracoes de acoes|ajustar suas posicoes em lotes", 0.8, False),
    ("desdobramento", "desdobramento", 3.0, True), ("desdobramento", r"\bsplit\b", 2.5, True), ("desdobramento", "acao existente para .{0,20} acoes", 2.0, True),
    ("subscricao", "direito de subscricao", 3.0, True), ("subscricao", "bonus de subscricao", 3.0, True), ("subscricao", "preco de emissao", 1.5, True),
]

# The labels that announce a field, in their order.
ANCHORS = {
    "event_type_label": ["tipo de evento", "natureza do provento", "especie do provento", "natureza do provento (conforme corpo do aviso)"],
    "gross_per_share": ["valor bruto por acao ordinaria", "valor bruto por acao preferencial", "valor bruto por acao on", "valor bruto por acao pn", "valor bruto por acao", "valor bruto", "provento bruto por acao"],
    "net_per_share": ["valor liquido por acao ordinaria", "valor liquido por acao preferencial", "valor liquido por acao on", "valor liquido por acao pn", "valor liquido por acao", "valor liquido"],
    "tax_rate": ["imposto de renda retido na fonte", "irrf na fonte", "irrf", "aliquota de irrf"],
    "ratio": ["proporcao", "fator de grupamento", "fator de desdobramento"],
    "cost_basis": ["custo atribuido (base fiscal)", "custo unitario atribuido", "custo atribuido"],
    "approval_date": ["data de aprovacao (rca)", "data de aprovacao", "data da rca", "data da assembleia"],
    "com_date": ["data-base do grupamento", "data-base do desdobramento", 'data-base ("data com")', "data-base (data com)", "data-base", "data base", "data com", "ultimo dia com"],
    "ex_date": ['data "ex-dividendos"', "data (ex-dividendos)", "data ex-dividendos", "data ex-bonificacao", "data ex-jcp", 'data "ex"', "data ex"],
    "payment_date": ["data de pagamento", "data do pagamento", "data do credito"],
    "trading_start": ["inicio da negociacao grupada", "inicio da negociacao desdobrada", "inicio da negociacao"],
    "credit_date": ["credito das acoes bonificadas", "credito aos acionistas", "credito das acoes"],
    "fraction_period": ["periodo de ajuste de fracoes", "periodo para ajuste de fracoes", "tratamento de fracoes"],
}
# Sentences that hold a date; the first that matches counts.
PROSE = {
    "approval_date": ["reuniao realizada em (DATE)", "reuniao de (DATE)", "assembleia geral extraordinaria(?: de| realizada em) (DATE)", "assembleia geral extraordinaria de (DATE)"],
    "com_date": ["ao final do dia (DATE)", "final do pregao de (DATE)", "posicao acionaria final do dia (DATE)", "inscritos nos registros da companhia ao final do dia (DATE)"],
    "ex_date": ['negociadas "?ex[^"]{0,20}"? a partir de (DATE)', 'negociando-se as acoes "?ex"? a partir de (DATE)', 'passarao a ser negociadas "?ex[^"]{0,20}"? a partir de (DATE)'],
}
GROUNDING_FACTOR = {"exact": 1.0, "normalized": 0.85, "fuzzy": 0.5, "absent": 0.0, "not_applicable": 1.0}


def field_specs(spark: SparkSession) -> DataFrame:
    rows = [(t, f, k == 0, i) for t, sides in FIELD_SPECS.items() for k, side in enumerate(sides) for i, f in enumerate(side)]
    return spark.createDataFrame(rows, "event_type string, field string, required boolean, ordinal int")


def reasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REASONS.items()], "code string, severity string, layer string, error_type string")
