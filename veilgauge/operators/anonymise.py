"""Anonymisers, a registry of them, and a rule-based attacker that guesses attributes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgauge.functions import vocabulary as V
from veilgauge.functions.text import first_group, first_match, matches, replaced
from veilgauge.registry import Registry

TOKEN = "XXX"


def identity(text: Column) -> Column:
    return text


def redact_patterns(text: Column, token: str = TOKEN) -> Column:
    """Emails, phone numbers, personal numbers and card numbers, in that order."""
    for pattern in (V.EMAIL, V.PHONE_NANP, V.SSN, V.CARD):
        text = replaced(text, pattern, token)
    return text


def redact_capitalised(text: Column, token: str = TOKEN) -> Column:
    """Every run of capitalised words and every number of two digits or more."""
    return replaced(replaced(text, V.CAPITALISED_RUN, token), r"\b\d{2,}\b", token)


@dataclass(frozen=True)
class Anonymiser:
    name: str
    apply: Callable[[Column], Column]


ANONYMISERS: Registry[Anonymiser] = Registry(
    "anonymiser",
    {"identity": Anonymiser("No anonymization", identity), "regex": Anonymiser("Regex redactor", redact_patterns), "capitalised": Anonymiser("Capitalised-word redactor", redact_capitalised)},
    {"none": "identity", "llm": "regex", "presidio_like": "regex", "gpt_like": "regex", "azure_like": "capitalised"},
)


def register(key: str, anonymiser: Anonymiser, replace: bool = False) -> None:
    """Adds an anonymiser: any function of a text column (wrap a pandas UDF for Python code)."""
    ANONYMISERS.register(key, anonymiser, replace)


def get(key: str) -> Anonymiser:
    return ANONYMISERS.get(key)


def default_set() -> list[Anonymiser]:
    return [get(k) for k in ("identity", "regex", "capitalised")]


def guess(text: Column, attribute: Column) -> Column:
    """What a simple attacker reads off the text for an attribute; `unknown` if nothing."""
    low = F.lower(text)
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    first = lambda words: F.coalesce(*[F.when(low.contains(w), F.lit(w)) for w in words])
    rules = {
        "email": first_match(text, V.EMAIL),
        "ssn": first_match(text, V.SSN),
        "credit_card": F.translate(first_match(text, V.CARD), " -", ""),
        "phone_number": first_match(text, V.PHONE_NANP),
        "address": first_match(text, r"(?i)\b\d{2,5}\s+[A-Za-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd)\b"),
        "name": first_group(text, V.CAPITALISED_PAIR),
        "state_of_residence": F.initcap(F.coalesce(first(V.ATTACK_STATES), F.when(has("bart"), "california"))),
        "gender": F.when(has("female") | padded.contains(" she "), "Female").when(has("male") | padded.contains(" he "), "Male"),
        "date_of_birth": first_match(text, r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},\s*\d{4}\b"),
        "race": F.when(has("white"), "White"),
        "marital_status": F.when(has("divorced", "split up"), "Divorced").when(has("married"), "Married"),
        "education_level": F.when(has("bachelor"), "Bachelor's degree"),
        "employment_status": F.when(has("unemployed"), "Unemployed").when(has("employed"), "Employed"),
        "occupation": F.initcap(first(V.ATTACK_ROLES)),
        "citizenship_status": F.when(has("born in the u.s", "born in the us"), "Born in the U.S."),
    }
    out = None
    for name, rule in rules.items():
        out = F.when(attribute == name, rule) if out is None else out.when(attribute == name, rule)
    return F.coalesce(out, F.lit(V.UNKNOWN))


__all__ = ["ANONYMISERS", "Anonymiser", "default_set", "get", "guess", "identity", "matches", "redact_capitalised", "redact_patterns", "register"]
