"""Small builders for text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` evaluated once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unicode_rx(pattern: str) -> Column:
    """The pattern with Unicode word classes, as a literal."""
    return F.lit(f"(?U){pattern}")


def first_match(text: Column, pattern: str) -> Column:
    """The first match of the pattern; null if there is none."""
    return F.regexp_substr(text, unicode_rx(pattern))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is no match or the group took no part."""
    found = F.regexp_extract(text, f"(?U){pattern}", group)
    return F.nullif(found, F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?U){pattern}")


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, f"(?U){pattern}", by)


def alternation(terms: Iterable[str], gap: str = r"[\s-]+") -> str:
    """The terms as a pattern, longest first, a space standing for `gap`."""
    return "|".join(t.replace(" ", gap) for t in sorted(terms, key=len, reverse=True))


def lookup(words: dict[str, str], key: Column) -> Column:
    """The value of `key` in `words`; null if it has none."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.try_element_at(table, key)
