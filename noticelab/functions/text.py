"""Text expressions: normal forms, splitting, and identifiers inside a text."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic marks and what they stand for; what a squashed text
# lacks; words that look like tickers; the forms of values and identifiers.
MARKS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " "}
SQUASHED = r"[\s.,;:()\[\]/\\|\"'—–-]"
SQUASHED_ASCII = r"[ \t\n\x0B\f\r.,;:()\[\]/\\|\"'\-]+"  # of these and \s, what ASCII has: one lookup a character
BLANKS = "\t\n\x0b\f\r"
TICKER_STOPWORDS = ("NIRE", "CNPJ", "ISIN")
LEADER, GAP = r"(?U)[.,·•…]{2,}|\s{3,}", r"(?U)\s{2,}"
VALUE_LIKE = r"(?i)^(?:R\$|\d|[A-Z]{4}\d)"
ISIN_ANCHORED = r"ISIN[^A-Z0-9]{0,4}([A-Z]{2}[A-Z0-9]{9}\d)"
ISIN_STRUCTURAL = r"(?<![A-Z0-9])([A-Z]{2}[A-Z0-9]{9}\d)(?![A-Z0-9])"
ISIN_LIKE = r"(?U)\b([A-Z]{2}[A-Z0-9]{8,10}[0-9])\b"
TICKER_STRUCTURAL = r"(?<![A-Z0-9])([A-Z]{4}\d{1,2})(?![A-Z0-9])"
CNPJ_STRUCTURAL = r"(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})"
DATE_LIKE = r"(?U)\b(\d{1,2}/\d{1,2}/\d{4})\b"


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Compatibility forms of the Latin blocks without marks: one to one, and one to many."""
    source, target, longer = "", "", {}
    for code in [*range(0xA0, 0x1C4), *range(0x1CD, 0x1F0), *range(0x1F4, 0x250), *range(0x1E00, 0x1E9A), *range(0x1EA0, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", MARKS.get(char, char)) if not unicodedata.combining(c))
        if plain == char:
            continue
        if len(plain) == 1:
            source, target = source + char, target + plain
        else:
            longer[char] = plain
    for mark, plain in MARKS.items():
        if mark not in source:
            source, target = source + mark, target + plain
    return source, target, longer


_SOURCE, _TARGET, _LONGER = _foldings()


def let(c: Column, use) -> Column:
    """use(c), with c evaluated, and written into the plan, once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _ascii(c: Column) -> Column:
    """Whether a text has as many characters as bytes; read without decoding it."""
    return F.octet_length(c) == F.char_length(c)


def fold_accents(c: Column) -> Column:
    """Letters without marks.  ASCII texts stay as they are, and most others are
    ASCII once letters are folded one to one; ligatures and the like are looked for in the rest."""
    pairs = F.array(*[F.struct(F.lit(char).alias("char"), F.lit(instead).alias("instead")) for char, instead in _LONGER.items()])
    longer = lambda t: F.aggregate(pairs, t, lambda made, x: F.replace(made, x["char"], x["instead"]))
    rest = lambda t: F.when(_ascii(t), t).otherwise(F.regexp_replace(longer(t), r"\p{M}", ""))
    return F.when(_ascii(c), c).otherwise(let(F.translate(c, _SOURCE, _TARGET), rest))


def collapse(folded: Column) -> Column:
    """The normal form of a text whose accents are folded: blanks collapsed, small
    letters.  An ASCII text has few kinds of blanks, and seldom two in a row."""
    single = lambda t: reduce(lambda made, x: F.replace(made, F.lit(x), F.lit(" ")), BLANKS, t)
    few = lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
    blank = lambda t: F.when(_ascii(t), let(single(t), few)).otherwise(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.lower(F.trim(let(folded, blank)))


def normalize(c: Column) -> Column:
    """Lower case without accents, blanks collapsed."""
    return collapse(fold_accents(c))


def _without_marks(c: Column) -> Column:
    plain = F.regexp_replace(c, SQUASHED_ASCII, "")
    return F.when(_ascii(c), plain).otherwise(F.regexp_replace(c, "(?U)" + SQUASHED + "+", ""))


def tighten(normal: Column) -> Column:
    """The squashed form of a text in normal form."""
    return let(normal, _without_marks)


def squash(c: Column) -> Column:
    """The normal form without blanks and punctuation."""
    return let(F.lower(fold_accents(c)), _without_marks)


def fold_ocr(c: Column) -> Column:
    """The squashed form in which characters that readers confuse are one."""
    return F.translate(squash(c), "0158|", "olsbl")


def vote_key(c: Column) -> Column:
    """The squashed form in which pt-BR decimals are written without grouping and trailing zeros."""
    plain = F.regexp_replace(c, r"(?<=\d)\.(?=\d{3}(\.\d{3})*,\d)", "")
    plain = F.regexp_replace(plain, r"(\d),(\d*?)0+(?!\d)", "$1,$2")
    plain = F.regexp_replace(plain, r"(\d),(?!\d)", "$1")
    return squash(F.regexp_replace(plain, r"(\d),(\d)", "$1·$2"))


def spaced_pattern(pattern: str) -> str:
    """A marker's pattern: any blanks, or none, wherever it has a blank."""
    return "(?i)" + pattern.replace(" ", r"\s*")


def title_lines(c: Column, folded: Column, opening: str = "aviso aos acionistas", short: int = 60, otherwise: int = 4) -> Column:
    """How many lines the title of a text has, from the text and its folded form,
    which has the same lines.  The title ends with the first line that holds the
    opening words, or the line after it if that is short; without such a line
    it is the first lines."""
    words = r"[^\S\n]+".join(opening.split())
    before = F.regexp_extract(F.lower(folded), rf"(?sU)^(.*?){words}", 0)
    first = F.when(before != "", F.size(F.split(before, "\n")) - 1)
    lines = F.split(c, "\n")

    def count(first: Column) -> Column:
        after = F.get(lines, first + 1)
        most = F.when(first.isNull(), F.least(F.lit(otherwise), F.size(lines)))
        return most.when(after.isNotNull() & (F.length(after) < short), first + 2).otherwise(first + 1)

    return let(first, count)


def first_lines(c: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), F.lit(1), n), "\n")


def further_lines(c: Column, n: Column) -> Column:
    lines = F.split(c, "\n")
    return F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n")


def split_title_body(c: Column) -> Column:
    """struct(title, body) of a text."""
    parts = lambda n: F.struct(first_lines(c, n).alias("title"), further_lines(c, n).alias("body"))
    return let(title_lines(c, fold_accents(c)), parts)


def split_label_value(c: Column) -> Column:
    """array(label, value), or null: two parts around a leader run, or around two blanks before a value."""
    parts = lambda t, pattern: F.filter(F.transform(F.split(t, pattern), lambda x: F.trim(x)), lambda x: x != "")
    wide, narrow = parts(c, LEADER), parts(F.trim(c), GAP)
    gap = (F.size(wide) == 1) & (F.size(narrow) == 2) & F.get(narrow, F.lit(1)).rlike(VALUE_LIKE)
    return F.when(F.size(wide) == 2, wide).when(gap, narrow)


def format_cnpj(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 14, F.regexp_replace(digits, r"(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})", "$1.$2.$3/$4-$5")).otherwise(c)


def clean_for_ids(c: Column) -> Column:
    return F.upper(F.replace(F.replace(c, F.lit("（"), F.lit(" (")), F.lit("）"), F.lit(") ")))


def find_isins(c: Column) -> Column:
    """Named ISINs first, then all that have the form, each once."""
    text = clean_for_ids(c)
    named, formed = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (ISIN_ANCHORED, ISIN_STRUCTURAL))
    return F.array_distinct(F.concat(named, formed))


def find_tickers(c: Column) -> Column:
    found = F.regexp_extract_all(clean_for_ids(c), F.lit(TICKER_STRUCTURAL), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~F.substring(x, 1, 4).isin(*TICKER_STOPWORDS)))


def find_cnpjs(c: Column) -> Column:
    found = F.regexp_extract_all(clean_for_ids(c), F.lit(CNPJ_STRUCTURAL), F.lit(1))
    return F.array_distinct(F.transform(found, format_cnpj))


def share_class(c: Column) -> Column:
    return let(
        normalize(c),
        lambda n: F.when(
            n.contains("preferencia") | n.rlike(r"\bpn\b"),
            F.lit("PN"),
        ).when(n.contains("ordinaria") | n.rlike(r"\bon\b"), F.lit("ON")),
    )


def structural_flaws(c: Column) -> Column:
    """Why a reading cannot be right: an ISIN of a wrong length, of any country, or a date that no calendar has."""
    from .dates import calendar_date

    isins = F.regexp_extract_all(F.upper(c), F.lit(ISIN_LIKE), F.lit(1))
    dates = F.regexp_extract_all(c, F.lit(DATE_LIKE), F.lit(1))
    bad, wrong = F.filter(isins, lambda x: F.length(x) != 12), F.filter(dates, lambda x: calendar_date(x).isNull())
    return F.concat(F.transform(bad, lambda x: F.concat(F.lit("isin:"), x)), F.transform(wrong, lambda x: F.concat(F.lit("date:"), x)))


def clip(c: Column, most: int = 6000) -> Column:
    """Head and tail of a long text."""
    half = most // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit("\n...\n"), F.right(c, F.lit(half))))


def cache_key(*parts: Column) -> Column:
    """32 hex digits over the parts, each ended by NUL."""
    joined = F.concat(*[F.concat(p, F.lit("\0")) for p in parts])
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)
