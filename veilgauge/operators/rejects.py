"""Delivered lines into typed rows, and the lines that are no valid record with the reasons.

Every field is taken as nullable text first; cast and constraint rules are
evaluated as columns into an array of reasons, and rows are split by whether
that array is empty. All of it stays in the JVM and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.missing import is_missing, strip

_ESC = "\x01"
_PLAIN = r"^ *([0-9]+(\.[0-9]*)?|\.[0-9]+) *$"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def plain_number(c: Column) -> Column:
    """A plain number as double, spaces around allowed; null for anything else, signs, exponents and `nan` too."""
    return F.when(c.rlike(_PLAIN), F.trim(c).try_cast("double"))


def long_date(c: Column) -> Column:
    """A date such as `June 3, 1971`; null if it is no day of the calendar."""
    own = strip(c)
    return F.when(own.rlike(rf"^({MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}$"), F.try_to_timestamp(own, F.lit("MMMM d, yyyy")).cast("date"))


@dataclass(frozen=True)
class Rule:
    """`ok(text column)` must hold for `column`, else `reason` is reported; null counts as not held."""

    column: str
    reason: str
    ok: Callable[[Column], Column]


@dataclass(frozen=True)
class RecordSpec:
    """Columns of a record in order, the rules, and typed outputs (name to a function of the text column)."""

    columns: tuple[str, ...]
    rules: tuple[Rule, ...] = ()
    typed: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` evaluated once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _parts(line: Column) -> Column:
    return F.split(line, '"', -1)


def _quoting_ok(p: Column) -> Column:
    """Of the parts between quotes: double quotes stand only around whole fields, doubled inside.

    Outside and inside alternate; outside parts may only be empty (a doubled
    quote) or end and begin at commas.
    """
    n = F.size(p)
    wrong = F.exists(
        F.transform(p, lambda x, i: (i % 2 == 0) & (x != "") & (((i > 0) & ~x.startswith(",")) | ((i < n - 1) & ~x.endswith(",")))), lambda w: w
    )
    return (n % 2 == 1) & ~wrong


def _one_record(p: Column) -> Column:
    """No line break outside quotes."""
    return ~F.exists(F.transform(p, lambda x, i: (i % 2 == 0) & x.rlike("[\r\n]")), lambda w: w)


def _fields(p: Column) -> Column:
    """The fields, unquoted, of a well quoted line's parts."""
    last = F.size(p) - 1
    marked = F.transform(
        p,
        lambda x, i: F.when(i % 2 == 1, F.replace(F.replace(x, F.lit(_ESC), F.lit(_ESC + "s")), F.lit(","), F.lit(_ESC + "c")))
        .when((i > 0) & (i < last) & (x == ""), F.lit('"'))
        .otherwise(F.replace(x, F.lit(_ESC), F.lit(_ESC + "s"))),
    )
    back = lambda x: F.replace(F.replace(x, F.lit(_ESC + "c"), F.lit(",")), F.lit(_ESC + "s"), F.lit(_ESC))
    return F.transform(F.split(F.array_join(marked, ""), ",", -1), back)


def parse_lines(df: DataFrame, spec: RecordSpec, line: str = "raw_line", ids: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Rows of `df` with `ids`, the struct `rec` (text fields by name) and the array `errors`.

    Null and empty lines have the reason `empty line`. Badly quoted lines and
    lines with another number of fields get that one reason and null fields.
    Only `ids` of the other columns are kept, so names cannot clash. A final
    carriage return is dropped. Repeated rows stay; an empty table gives none.
    """
    width = len(spec.columns)
    names = {c: k for k, c in enumerate(spec.columns)}
    blank = F.struct(*[F.lit(None).cast("string").alias(c) for c in spec.columns])

    def failed(reason: Column) -> Column:
        return F.struct(blank.alias("rec"), F.array(reason).alias("errors"))

    def ruled(f: Column) -> Column:
        rules = [F.when(~F.coalesce(r.ok(F.get(f, F.lit(names[r.column]))), F.lit(False)), F.lit(f"{r.column}: {r.reason}")) for r in spec.rules]
        rec = F.struct(*[F.get(f, F.lit(k)).alias(c) for c, k in names.items()])
        good = F.struct(rec.alias("rec"), F.array_compact(F.array(F.lit(None).cast("string"), *rules)).alias("errors"))
        return F.when(F.size(f) != width, failed(F.concat(F.lit("wrong number of fields: "), F.size(f).cast("string")))).otherwise(good)

    def shaped(p: Column) -> Column:
        return (
            F.when(~_quoting_ok(p), failed(F.lit("broken quoting"))).when(~_one_record(p), failed(F.lit("more than one record"))).otherwise(_let(_fields(p), ruled))
        )

    text = F.regexp_replace(F.col(f"`{line}`"), "\r$", "")
    whole = F.when(text.isNull() | (F.trim(text) == ""), failed(F.lit("empty line"))).otherwise(_let(_parts(text), shaped))
    # explode of one element keeps later filters from evaluating all this again
    kept = [F.col(f"`{i}`") for i in ids]
    return df.select(*kept, F.explode(F.array(whole)).alias("_p")).select(*kept, "_p.rec", "_p.errors")


def split_rows(parsed: DataFrame, spec: RecordSpec) -> tuple[DataFrame, DataFrame]:
    """Valid rows with typed columns, and rejected rows with `errors`."""
    ids = [c for c in parsed.columns if c not in ("rec", "errors")]
    typed = [spec.typed.get(c, lambda x: x)(F.col(f"rec.{c}")).alias(c) for c in spec.columns]
    return parsed.where(F.size("errors") == 0).select(*ids, *typed), parsed.where(F.size("errors") > 0).select(*ids, "errors")


def _between(lo: float, hi: float | None) -> Callable[[Column], Column]:
    return lambda c: (plain_number(c) >= lo) if hi is None else plain_number(c).between(lo, hi)


PERSON_SPEC = RecordSpec(
    ("SERIALNO", "SPORDER", "PWGTP", "AGEP", "SEX", "MAR", "RAC1P", "HISP", "CIT", "OCCP"),
    (Rule("AGEP", "no plain number from 0 to 120", _between(0, 120)), Rule("PWGTP", "no plain number of at least 0", _between(0, None))),
    {"AGEP": plain_number, "PWGTP": plain_number},
)

_BENCH = ("state_of_residence", "gender", "date_of_birth", "race", "marital_status", "education_level", "employment_status", "occupation", "citizenship_status")
BENCHMARK_SPEC = RecordSpec(
    _BENCH,
    (
        *(Rule(c, "blank", lambda x: strip(x) != "") for c in _BENCH),
        Rule("date_of_birth", "no date such as June 3, 1971", lambda x: long_date(x).isNotNull()),
        Rule("occupation", "no letters", lambda x: x.rlike(r"\p{L}")),
        Rule("occupation", "marker for a missing value", lambda x: ~is_missing(x)),
    ),
    {"date_of_birth": long_date} | {c: strip for c in _BENCH if c != "date_of_birth"},
)
