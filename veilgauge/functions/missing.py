"""Values that mean "no value"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-case markers that stand for a missing value.
MISSING_MARKERS = ("unknown", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "not stated", "not known", "not available", "not given", "not specified", "unspecified", "missing", "-", "--", "---", "?", "??", "???", ".", "..", "...")

#: White space as Python's str.strip sees it, for the ends of a text.
_ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """`c` without white space of any kind at its ends; null stays null."""
    return F.regexp_replace(c, _ENDS, "")


def is_missing(c: Column) -> Column:
    """True for null, blanks and markers; never null."""
    return c.isNull() | F.lower(strip(c)).isin("", *MISSING_MARKERS)


def sql_missing(c: str) -> str:
    """The same as DuckDB SQL over the expression `c`."""
    marks = ", ".join(f"'{m}'" for m in ("", *MISSING_MARKERS))
    return f"({c} IS NULL OR lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) IN ({marks}))"
