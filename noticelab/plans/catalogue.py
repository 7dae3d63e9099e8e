"""Every query of the notice engine and its SQL, by name."""

from . import queries, queries_record, queries_rules  # noqa: F401  they register theirs
from .registry import ALL, ORACLE

__all__ = ["ALL", "ORACLE"]
