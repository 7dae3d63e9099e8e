"""Where queries are registered, and pieces of SQL that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text

ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if it has one."""

    def add(f):
        ALL[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(c) -> Column:
    return F.array_join(c, ",")


def normal_sql(x: str) -> str:
    """The normal form; right for texts whose only odd letters are accented ones."""
    return rf"trim(regexp_replace(lower(strip_accents({x})), '\s+', ' ', 'g'))"


def squash_sql(x: str) -> str:
    pattern = text.SQUASHED.replace("'", "''")
    return f"regexp_replace({normal_sql(x)}, '{pattern}', '', 'g')"


def day_sql(day: str, month: str, year: str) -> str:
    return f"try_cast({year} || '-' || lpad(cast({month} as varchar), 2, '0') || '-' || lpad({day}, 2, '0') as date)"


# the patterns of the dates module without look-ahead, which this SQL has not
SEPARATED = r"([0-9]{1,2})\s*[/.\-]\s*([0-9]{1,2})\s*[/.\-]\s*([0-9]{4})(?:[^0-9]|$)"
SHORT_DAY = r"(?:^|[^0-9])([0-9])\s*[/.\-]\s*([0-9]{1,2})\s*[/.\-]\s*([0-9]{4})(?:[^0-9]|$)"
MONTHS = "[" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "]"


def written_sql(n: str) -> str:
    """The date that a text in normal form names first."""
    part = lambda pattern, k: f"regexp_extract({n}, '{pattern}', {k})"
    month = f"list_position({MONTHS}, {part(dates.LONG, 2)})"
    return f"""case when regexp_matches({n}, '{SEPARATED}') then {day_sql(part(SEPARATED, 1), part(SEPARATED, 2), part(SEPARATED, 3))}
      when coalesce({month}, 0) > 0 then {day_sql(part(dates.LONG, 1), month, part(dates.LONG, 3))}
      when regexp_matches({n}, '{dates.BARE}') then {day_sql(part(dates.BARE, 1), part(dates.BARE, 2), part(dates.BARE, 3))} end"""


def ptbr_sql(x: str) -> str:
    """A number in pt-BR form as an exact decimal."""
    return f"try_cast(replace(replace(regexp_replace({x}, '[^0-9.,]', '', 'g'), '.', ''), ',', '.') as decimal(20,10))"


def firsts_sql(items: str) -> str:
    """A list without what it has had before, in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"
