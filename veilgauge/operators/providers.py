"""Attackers other than the rules: a prompt per text, any function as provider, parsing with a fallback to the rules."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions import vocabulary as V
from veilgauge.operators import detect, score
from veilgauge.operators.attributes import cleaned, deduplicated, parse_any
from veilgauge.registry import Registry
from veilgauge.session import cut

#: How the value of an attribute is to be written.
VALUE_FORMATS = {
    "full_name": "as it stands in the text", "email": "as it stands in the text", "phone": "as it stands in the text", "ssn_or_nin": "as it stands in the text", "address": "as it stands in the text", "date_of_birth": "as it stands in the text",
    "age_range": "a decade such as 30-39", "gender": "male, female or another word in lower case", "ethnicity": "one of white, black, asian, hispanic, mixed, other", "occupation": "snake_case, singular, such as marine_biologist",
    "employer": "the name of the organisation", "education_level": "snake_case, such as bachelors_degree", "postcode_district": "the letters of a British postcode's area, or the five digits of a ZIP code", "marital_status": "one of single, married, divorced, widowed, separated",
    "nationality": "an adjective in lower case, such as british", "medical_conditions": "a condition in lower case", "legal_involvement": "a few words", "financial_status": "a few words", "religion": "a religion in lower case", "sexual_orientation": "one word in lower case",
}
#: What providers are asked; the text follows the last line.
TEMPLATE = (
    "List what the text below gives away about the person it is about. Answer with JSON only: {\"attributes\": [{\"attribute\": ..., \"inferred_value\": ..., \"confidence\": 0 to 1, \"evidence\": the words that show it, \"category\": direct, quasi or contextual}]}.\n"
    "Attributes and how to write their values:\n" + "".join(f"- {a} ({V.CATEGORY[a]}): {f}\n" for a, f in VALUE_FORMATS.items()) + "Leave out what the text does not give away, or give it the value unknown. Placeholders such as [NAME] or XXX give nothing away.\nText:\n"
)


def prompt(text: Column) -> Column:
    return F.concat(F.lit(TEMPLATE), text)


#: A provider answers a block of prompts: (answers, tokens used), a null answer being a failure; an exception fails the whole block.
Provider = Callable[[list[str]], list[tuple[str | None, int]]]


@dataclass(frozen=True)
class Wire:
    """How a kind of service is asked and answers: fixed values of its interface."""

    url: str
    body: Callable[[str, str], dict]
    answer: Callable[[dict], tuple[str, int]]
    key_variable: str | None = None
    key_header: tuple[str, str] = ("Authorization", "Bearer ")
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 30.0


_SAID = lambda p: [{"role": "user", "content": p}]
WIRES = {
    "openai": Wire(
        "https://api.openai.com/v1/chat/completions", lambda m, p: {"model": m, "temperature": 0, "messages": _SAID(p)},
        lambda d: (d["choices"][0]["message"]["content"] or "", int((d.get("usage") or {}).get("total_tokens", 0))), "OPENAI_API_KEY",
    ),
    "anthropic": Wire(
        "https://api.anthropic.com/v1/messages", lambda m, p: {"model": m, "max_tokens": 2048, "temperature": 0, "messages": _SAID(p)},
        lambda d: (d["content"][0].get("text") or "", sum(int((d.get("usage") or {}).get(k, 0)) for k in ("input_tokens", "output_tokens"))), "ANTHROPIC_API_KEY", ("x-api-key", ""), {"anthropic-version": "2023-06-01"},
    ),
    "ollama": Wire(
        "http://localhost:11434/api/generate", lambda m, p: {"model": m, "prompt": p, "stream": False, "format": "json", "options": {"temperature": 0}},
        lambda d: (str(d.get("response") or ""), sum(int(d.get(k) or 0) for k in ("eval_count", "prompt_eval_count"))), timeout=60.0,
    ),
}


@dataclass(frozen=True)
class HttpProvider:
    """One POST per prompt at temperature 0, from inside each task; the key is read from the environment there.

    A failed call answers null with the reason in its place, so one text never
    fails another.
    """

    kind: str
    model: str
    url: str | None = None

    def __call__(self, prompts: list[str]) -> list[tuple[str | None, int]]:
        wire = WIRES[self.kind]
        head = {"Content-Type": "application/json", **wire.headers}
        if wire.key_variable:
            key = os.environ.get(wire.key_variable)
            if not key and self.url is None:
                raise ValueError(f"{wire.key_variable} is not set")
            head[wire.key_header[0]] = f"{wire.key_header[1]}{key or ''}"
        out: list[tuple[str | None, int]] = []
        for p in prompts:
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url or wire.url, json.dumps(wire.body(self.model, p)).encode(), head), timeout=wire.timeout) as r:  # noqa: S310
                    out.append(wire.answer(json.loads(r.read())))
            except (OSError, ValueError, KeyError, IndexError, TypeError, AttributeError):
                out.append((None, 0))
        return out


#: Providers by name beside the rules; each is a function of the model's name.
PROVIDERS: Registry[Callable[[str], Provider]] = Registry("provider", {k: (lambda m, k=k: HttpProvider(k, m)) for k in WIRES}, {"local": "ollama", "heuristic": "rule_based", "mock": "rule_based"})
RULE_MODEL = "heuristic-v1"


def canonical(name: str) -> str:
    """A provider's own name; ValueError if there is none."""
    key = PROVIDERS._key(name)
    if key != "rule_based":
        PROVIDERS.get(key)
    return key


def model_of(name: str, model: str | None) -> str:
    """The model to ask: the rules have one of their own, services need one, other providers may do without."""
    key = canonical(name)
    if key in WIRES and not model:
        raise ValueError(f"the provider {name!r} needs the name of a model")
    return model or (RULE_MODEL if key == "rule_based" else "")


def register(name: str, provider: Provider, replace: bool = False) -> None:
    """Adds a provider that needs no model."""
    PROVIDERS.register(name, lambda _: provider, replace)


def get(name: str, model: str | None = None) -> Provider | None:
    """The provider of a name; None for the rules; ValueError for unknown names."""
    key = canonical(name)
    return None if key == "rule_based" else PROVIDERS.get(key)(model_of(name, model))


def infer(df: DataFrame, provider: Provider | str, text_col: str = "text", strict: bool = False, names: bool = True, model: str | None = None) -> DataFrame:
    """`df` with attributes, tokens_used, attacker_used, fallback_reason and error.

    Output that can't be parsed falls back to the rules with the reason, or
    with `strict` leaves the row without attributes and the reason as its
    error; other rows are not touched by it. Prompts are answered batch by
    batch and the answers written once; only failed rows go through the rules.
    """
    call = get(provider, model) if isinstance(provider, str) else provider
    label = canonical(provider) if isinstance(provider, str) else getattr(provider, "__name__", type(provider).__name__)
    nothing = F.lit(None).cast("string")
    if call is None:
        return score.infer(df, text_col, names=names).withColumns({"attacker_used": F.lit("rule_based"), "fallback_reason": nothing, "error": nothing})

    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            asked = [p for p in prompts if p is not None]
            try:
                told, why = iter(call(asked) if asked else []), None
            except Exception as e:  # noqa: BLE001  the block fails with its reason, the others go on
                told, why = iter([(None, 0)] * len(asked)), f"{type(e).__name__}: {e}"
            yield pd.DataFrame([(None, 0, None) if p is None else (*next(told), why) for p in prompts], columns=["raw", "tokens", "why"])

    ask.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    told = df.withColumn("_answer", F.pandas_udf(ask, "struct<raw:string,tokens:int,why:string>")(prompt(F.col(f"`{text_col}`"))))
    told = cut(told.withColumn("_items", parse_any(F.col("_answer.raw"))))
    failed = F.col("_items").isNull() & F.col(f"`{text_col}`").isNotNull()
    reason = F.when(F.col("_answer.raw").isNull(), F.coalesce(F.concat(F.lit("the provider failed: "), F.col("_answer.why")), F.lit("the provider gave no answer"))).otherwise("the provider's answer held no list of attributes")
    own = [F.col(f"`{c}`") for c in df.columns]
    done = told.where(~failed).select(*own, deduplicated(cleaned(F.col("_items"))).alias("attributes"), F.col("_answer.tokens").alias("tokens_used"), F.lit(label).alias("attacker_used"), nothing.alias("fallback_reason"), nothing.alias("error"))
    left = told.where(failed).withColumns({"_reason": reason, "_asked": F.col("_answer.tokens")}).drop("_answer", "_items")
    if strict:
        empty = F.lit(None).cast(done.schema["attributes"].dataType)
        return done.unionByName(left.select(*own, empty.alias("attributes"), F.col("_asked").alias("tokens_used"), F.lit(label).alias("attacker_used"), nothing.alias("fallback_reason"), F.concat(F.lit("strict: "), F.col("_reason")).alias("error")))
    ruled = score.infer(left, text_col, names=names)
    return done.unionByName(ruled.select(*own, "attributes", (F.col("_asked") + F.col("tokens_used")).alias("tokens_used"), F.lit("rule_based").alias("attacker_used"), F.col("_reason").alias("fallback_reason"), nothing.alias("error")))


__all__ = ["HttpProvider", "PROVIDERS", "TEMPLATE", "VALUE_FORMATS", "WIRES", "Wire", "canonical", "detect", "get", "infer", "model_of", "prompt", "register"]
