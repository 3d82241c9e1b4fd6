"""Cleaning of values, and quasi-identifiers brought to the population table's vocabulary. All of it is idempotent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgauge.functions import vocabulary as V
from veilgauge.functions.missing import strip
from veilgauge.functions.text import let, lookup

_TRIM = F.btrim


def _core(text: Column) -> Column:
    return F.btrim(text, F.lit(V.SURROUNDING))


def clean_value(value: Column) -> Column:
    """The stripped value; `unknown` if it is null, empty or a placeholder, also a masked or bracketed one. Partly masked values stay."""

    def cleaned(text: Column) -> Column:
        return let(_core(text), lambda core: let(F.trim(F.regexp_replace(F.lower(core), r"[\s_-]+", " ")), lambda key: judged(text, core, key)))

    def judged(text: Column, core: Column, key: Column) -> Column:
        masked = text.rlike(r"\A[xX*#•\s\-./()]+\z") & ~text.rlike(r"(?<![xX])[xX](?![xX])") & text.rlike(r"[xX*#•]")
        placeholder = key.isin(*V.PLACEHOLDERS) | key.rlike(V.NOT_GIVEN) | key.rlike(r"^redacted( |$)|(^| )redacted$") | core.rlike(r"\A(?:\[+[^\[\]]*\]+|<+[^<>]*>+|\{+[^{}]*\}+)\z") | masked
        return F.when(placeholder, V.UNKNOWN).otherwise(text)

    return F.when(value.isNull(), V.UNKNOWN).otherwise(let(strip(value), cleaned))


def phrase(value: Column) -> Column:
    """Lower case without parentheses, surrounding punctuation and a leading article, with single spaces."""
    text = F.regexp_replace(F.regexp_replace(F.lower(value), r"\([^()]*\)", " "), r"[\s_-]+", " ")
    return F.regexp_replace(_core(text), r"^(?:a|an|the)\s+", "")


def age_range(value: Column) -> Column:
    """The decade of an age or an age phrase; `unknown` across decades; the value itself if it can't be read."""
    text = F.regexp_replace(F.regexp_replace(F.lower(value), r"\([^()]*\)", " "), r"[-–—,]", " ")
    words = F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*V.AGE_FILLER))

    def decade(w: Column) -> Column:
        number = F.regexp_extract(w, r"^~?(\d{1,3})(?:yo|y/o|yrs?|years?)?$", 1).try_cast("int")
        tens = F.regexp_extract(w, r"^([1-9])0'?s$", 1).try_cast("int")
        return F.when(number.isNotNull(), F.when(number <= 120, F.floor(number / 10).cast("int"))).otherwise(F.coalesce(tens, lookup({k: str(v) for k, v in V.DECADE_WORDS.items()}, w).try_cast("int")))

    def read(decades: Column) -> Column:
        distinct = F.array_distinct(decades)
        low = F.get(distinct, F.lit(0)) * 10
        readable = (F.size(decades) > 0) & ~F.exists(decades, lambda d: d.isNull())
        return F.when(~readable, value).when(F.size(distinct) > 1, V.UNKNOWN).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))

    return let(F.transform(words, decade), read)


def _synonym(words: dict[str, str], value: Column, key: Column | None = None) -> Column:
    return F.coalesce(lookup(words, phrase(value) if key is None else key), F.lower(strip(value)))


def gender(value: Column) -> Column:
    return _synonym(V.GENDER_WORDS, value)


def nationality(value: Column) -> Column:
    return _synonym(V.NATIONALITY_WORDS, value, F.regexp_replace(F.replace(phrase(value), F.lit("."), F.lit("")), r"\s+(?:citizen|national)$", ""))


def marital_status(value: Column) -> Column:
    return _synonym(V.MARITAL_WORDS, value)


def ethnicity(value: Column) -> Column:
    return _synonym(V.ETHNICITY_WORDS, value)


def occupation(value: Column) -> Column:
    """Lower snake case, with a few synonyms folded."""
    return let(F.btrim(F.regexp_replace(phrase(value), r"(?U)[\W_]+", "_"), F.lit("_")), lambda k: F.coalesce(lookup(V.OCCUPATION_WORDS, k), k))


def postcode_district(value: Column) -> Column:
    """The area letters of a British postcode or district, the five digits of a ZIP code; other values as they are."""
    text = strip(value)
    uk = F.nullif(F.regexp_extract(text, r"^([A-Za-z]{1,2})\d[A-Za-z\d]?(?:\s*\d[A-Za-z]{2})?$", 1), F.lit(""))
    us = F.nullif(F.regexp_extract(text, r"^(\d{5})(?:-\d{4})?$", 1), F.lit(""))
    return F.coalesce(uk, us, text)


_BY_ATTRIBUTE = {"age_range": age_range, "gender": gender, "nationality": nationality, "marital_status": marital_status, "ethnicity": ethnicity, "occupation": occupation, "postcode_district": postcode_district}


def quasi_value(attribute: Column, value: Column) -> Column:
    """A cleaned quasi-identifier value in the population's vocabulary; what comes out empty is `unknown`."""
    out = F.when(value == V.UNKNOWN, value)
    for name, f in _BY_ATTRIBUTE.items():
        out = out.when(attribute == name, F.coalesce(F.nullif(f(value), F.lit("")), F.lit(V.UNKNOWN)))
    return out.otherwise(value)
