"""Amounts, rates, check digits and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT, RATE = "decimal(20,10)", "decimal(10,6)"
TOLERANCE = "0.000001"


def ptbr_number(c: Column) -> Column:
    """Digits, dots and commas only: dots group, the comma is the point; a sign is dropped."""
    kept = F.regexp_replace(c, "[^0-9.,]", "")
    return F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(AMOUNT)


def decimal_number(c: Column) -> Column:
    """With a comma dots group, without one the dot is the point; a sign is kept."""
    kept = F.regexp_replace(c, "[^0-9.,-]", "")
    return (
        F.when(F.contains(kept, F.lit(",")), F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .otherwise(kept)
        .try_cast(AMOUNT)
    )


def show_decimal(c: Column, least: int = 2) -> Column:
    """pt-BR form with grouped thousands and at least so many decimals, none cut off."""
    plain = c.cast("string")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_extract(plain, r"(\d+)", 1)
    part = F.regexp_replace(F.regexp_extract(plain, r"\.(\d+)", 1), "0+$", "")
    part = F.rpad(part, F.greatest(F.length(part), F.lit(least)), F.lit("0"))
    return F.concat(
        sign,
        F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", "."),
        F.when(part == "", F.lit("")).otherwise(F.concat(F.lit(","), part)),
    )


def rate(c: Column) -> Column:
    """A percentage as a fraction."""
    return (ptbr_number(c) * F.lit("0.01").cast("decimal(3,2)")).cast(RATE)


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def net_matches(gross: Column, tax_rate: Column, net: Column) -> Column:
    """gross x (1 - rate) = net within the tolerance; exact decimals of scale 16."""
    kept = F.lit(1).cast(RATE) - tax_rate.cast(RATE)
    return F.abs(gross.cast(AMOUNT) * kept.cast(RATE) - net.cast(AMOUNT)) <= F.lit(TOLERANCE).cast("decimal(10,6)")


def isin_ok(c: Column) -> Column:
    """The Luhn check over digits, letters written as 10 to 35."""
    form = c.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")
    expand = lambda x: F.when(x.between("0", "9"), x).otherwise((F.ascii(x) - 55).cast("string"))
    digits = F.reverse(F.split(F.array_join(F.transform(F.split(c, ""), expand), ""), ""))
    doubled = lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int"))
    terms = F.transform(digits, lambda d, i: F.floor(doubled(d, i) / 10).cast("int") + doubled(d, i) % 10)
    return F.when(form, F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))


def cnpj_ok(c: Column) -> Column:
    """Two check digits by modulus 11; equal digits throughout are no number."""
    digits = F.regexp_replace(c, r"\D", "")
    each = F.transform(F.split(digits, ""), lambda x: x.cast("int"))

    def check(count: int) -> Column:
        weights = [(count - 1 - i) % 8 + 2 for i in range(count)]
        rest = sum((F.get(each, F.lit(i)) * w for i, w in enumerate(weights)), F.lit(0)) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest)

    good = (check(12) == F.get(each, F.lit(12))) & (check(13) == F.get(each, F.lit(13)))
    return F.when((F.length(digits) == 14) & (F.size(F.array_distinct(each)) > 1), good).otherwise(F.lit(False))


def overlap(a: str | Column, b: str | Column) -> Column:
    """Shared area of two boxes (structs x0, y0, x1, y1) over the smaller one's."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    least = F.least(area(a), area(b))
    return F.when(least > 0, side("x0", "x1") * side("y0", "y1") / least).otherwise(F.lit(0.0))


def row_overlap(a: Column, b: Column) -> Column:
    """Shared height of two boxes over the lower one's."""
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    least = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.when(least > 0, F.greatest(shared, F.lit(0.0)) / least).otherwise(F.lit(0.0))
