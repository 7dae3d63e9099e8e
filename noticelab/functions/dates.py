"""Dates as notices write them, and the ambiguities that readers cause."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize

# The months' names in normal form, in order; the forms in which
# notices write dates; the words for a value that is still open; a signature's place and date.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
LONG = r"(\d{1,2})\s*de\s+([a-z]+)\s+de\s+(\d{4})"
SEPARATED = r"(\d{1,2})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(\d{4})(?!\d)"
BARE = r"\b(\d{2})(\d{2})(\d{4})\b"
LONG_YEAR = r"(\d{1,2})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(\d{5,})"
SHORT_DAY = r"(?<!\d)(\d)\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(\d{4})(?!\d)"
ANY_DATE = r"(\d{1,2}\s+de\s+[a-z]+\s+de\s+\d{4}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4,}|\b\d{8}\b)"
UNDEFINED = r"(?iU)\ba\s+definir\b|oportunamente|a\s+ser\s+divulgad"
DRAFTED = r"(?iU)[A-ZÀ-Ú][\w\s.'-]{2,40}\s*\([A-Z]{2}\)\s*,\s*(\d{1,2})\s+de\s+([a-zç]+)\s+de\s+(\d{4})"


def calendar_date(c: Column) -> Column:
    """d/M/yyyy, or null if the calendar has no such day."""
    return F.try_to_date(c, "d/M/yyyy")


def iso_or_slashed(c: Column) -> Column:
    """The lenient form: d/m/yyyy or yyyy-mm-dd at the start, whatever follows."""
    slashed, iso = F.regexp_extract(c, r"^(\d{1,2}/\d{1,2}/\d{4})", 1), F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(slashed != "", calendar_date(slashed)).when(iso != "", F.try_to_date(iso, "yyyy-MM-dd"))


def written_date(c: Column) -> Column:
    """struct(value, rule) by the first form that matches, even if it names no
    day: an invalid first match does not fall through to the next form (a word
    that is no month's name is no match)."""
    return let(normalize(c), _written)


def _written(n: Column) -> Column:
    part = lambda pattern, k: F.regexp_extract(n, pattern, k)
    slashed = F.concat_ws("/", part(SEPARATED, 1), part(SEPARATED, 2), part(SEPARATED, 3))
    month = month_number(part(LONG, 2))
    named = F.concat_ws("/", part(LONG, 1), month.cast("string"), part(LONG, 3))
    bare = F.concat_ws("/", part(BARE, 1), part(BARE, 2), part(BARE, 3))
    found = F.when(n.rlike(SEPARATED), F.struct(calendar_date(slashed).alias("value"), F.lit("separated").alias("rule")))
    found = found.when(month > 0, F.struct(calendar_date(named).alias("value"), F.lit("long").alias("rule")))
    found = found.when(n.rlike(BARE), F.struct(calendar_date(bare).alias("value"), F.lit("eight_digits").alias("rule")))
    return let(found, lambda x: F.struct(x["value"].alias("value"), F.when(x["value"].isNotNull(), x["rule"]).alias("rule")))


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name in normal form, 0 for another word."""
    return F.array_position(F.array(*map(F.lit, MONTHS)), name)


def first_date(c: Column) -> Column:
    """The first date-like stretch of a text, in normal form, or null."""
    return F.nullif(F.regexp_extract(normalize(c), ANY_DATE, 1), F.lit(""))


def show(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def year_candidates(c: Column) -> Column:
    """Dates that remain when one digit of a year of five or more is dropped; null if there is no such year."""
    day, month = (F.lpad(F.regexp_extract(c, LONG_YEAR, k), 2, "0") for k in (1, 2))
    head = F.concat(day, F.lit("/"), month, F.lit("/"))
    year = F.regexp_extract(c, LONG_YEAR, 3)
    # the empty text must not make an empty range, so at least one place is tried
    places = F.sequence(F.lit(1), F.greatest(F.length(year), F.lit(1)))
    cut = F.transform(places, lambda i: F.concat(F.substr(year, F.lit(1), i - 1), F.substr(year, i + 1)))
    four = F.array_distinct(F.filter(cut, lambda y: F.length(y) == 4))
    return F.when((year != "") & (F.size(four) > 0), F.transform(four, lambda y: F.concat(head, y)))


def day_candidates(c: Column) -> Column:
    """Days that a single digit may be the rest of; null if no day has a single digit."""
    digit, month, year = (F.regexp_extract(c, SHORT_DAY, k) for k in (1, 2, 3))
    rest = F.concat(F.lit("/"), F.lpad(month, 2, "0"), F.lit("/"), year)
    tens = F.transform(F.array(*map(F.lit, "012")), lambda t: F.concat(t, digit))
    ones = F.filter(F.transform(F.array(*map(F.lit, "0123456789")), lambda o: F.concat(digit, o)), lambda d: d.try_cast("int") <= 31)
    return F.when(digit != "", F.transform(F.array_distinct(F.concat(tens, ones)), lambda d: F.concat(d, rest)))


def drafting_date(c: Column) -> Column:
    """The date of the last `City (UF), day de month de year` of a text."""
    found = F.regexp_extract_all(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(DRAFTED), F.lit(0))
    last = F.get(found, F.size(found) - 1)
    month = month_number(normalize(F.regexp_extract(last, DRAFTED, 2)))
    return calendar_date(F.concat_ws("/", F.regexp_extract(last, DRAFTED, 1), month.cast("string"), F.regexp_extract(last, DRAFTED, 3)))
