"""Provider output to clean attributes: parsing, filtering, normalising, one value per attribute."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgauge.functions import vocabulary as V
from veilgauge.functions.missing import strip
from veilgauge.functions.normalise import clean_value, quasi_value
from veilgauge.functions.text import let, lookup

_ITEM = "struct<attribute:string,inferred_value:string,confidence:string,evidence:string,category:string>"


def parse_json(raw: Column) -> Column:
    """array of raw items from `{"attributes": [...]}` or a bare array; null if it is neither. Native, for output that is JSON and nothing else."""
    text = strip(raw)
    bare = F.from_json(text, f"array<{_ITEM}>")
    wrapped = F.from_json(text, f"struct<attributes:array<{_ITEM}>>")["attributes"]
    return F.when(text.startswith("["), bare).when(text.startswith("{"), wrapped)


def _items(raw: str | None) -> list[dict] | None:
    """The items of output with JSON somewhere in it: fenced, bare, or within prose."""
    if not raw or not raw.strip():
        return None
    listed = lambda x: x if isinstance(x, list) else x.get("attributes") if isinstance(x, dict) and isinstance(x.get("attributes"), list) else None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S | re.I)
    for part in ([fenced.group(1)] if fenced else []) + [raw.strip()]:
        try:
            found = listed(json.loads(part))
        except ValueError:
            found = None
        if found is not None:
            return found
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", raw):
        try:
            found = listed(decoder.raw_decode(raw, m.start())[0])
        except ValueError:
            continue
        if found is not None and all(isinstance(x, dict) for x in found):
            return found
    return None


def parse_any(raw: Column) -> Column:
    """As `parse_json`, but also for JSON in fences or prose (an Arrow UDF). Null where no list of items is found."""
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else str(v)

    def parse(texts: pd.Series) -> pd.Series:
        names = ("attribute", "inferred_value", "confidence", "evidence", "category")
        return pd.Series([None if (found := _items(t)) is None else [{n: text(x.get(n)) for n in names} for x in found if isinstance(x, dict)] for t in texts])

    return F.pandas_udf(parse, f"array<{_ITEM}>")(raw)


def confidence(raw: Column) -> Column:
    """A number between 0 and 1; what is none is 0."""
    number = F.when(raw.rlike(r"(?i)^\s*[+-]?(?:\d[\d_]*\.?\d*|\.\d+)(?:e[+-]?\d+)?\s*$"), F.trim(F.replace(raw, F.lit("_"), F.lit(""))).try_cast("double")).when(F.lower(F.trim(raw)).isin("nan", "inf", "infinity", "+inf"), 1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(number, F.lit(0.0))))


def cleaned(items: Column) -> Column:
    """Raw items to {attribute, value, confidence, evidence, category}, unknown attributes left out."""
    known = F.filter(items, lambda x: strip(x["attribute"]).isin(*V.CATEGORY))

    def one(x: Column) -> Column:
        name = strip(x["attribute"])
        category = lookup(V.CATEGORY, name)
        return F.struct(
            name.alias("attribute"),
            let(clean_value(x["inferred_value"]), lambda v: F.when(category == "quasi", quasi_value(name, v)).otherwise(v)).alias("value"),
            confidence(x["confidence"]).alias("confidence"),
            F.coalesce(strip(x["evidence"]), F.lit("")).alias("evidence"),
            category.alias("category"),
        )

    return F.transform(known, one)


def deduplicated(items: Column) -> Column:
    """One item per attribute, sorted by attribute: known values first, then confidence, then the smallest value and evidence."""

    def order(a: Column, b: Column) -> Column:
        def by(x: Column, y: Column, then: Column) -> Column:
            return F.when(x < y, -1).when(x > y, 1).otherwise(then)

        known = lambda x: (x["value"] == V.UNKNOWN).cast("int")
        return by(a["attribute"], b["attribute"], by(known(a), known(b), by(-a["confidence"], -b["confidence"], by(a["value"], b["value"], by(a["evidence"], b["evidence"], F.lit(0))))))

    return let(F.array_sort(items, order), lambda ordered: F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["attribute"] != x["attribute"])))


def best_per_attribute(long: DataFrame, key: str) -> DataFrame:
    """The same over rows (key, attribute, value, confidence, evidence): one row for each key and attribute."""
    order = Window.partitionBy(key, "attribute").orderBy(F.col("value").isNull() | (F.col("value") == V.UNKNOWN), F.desc("confidence"), F.asc_nulls_last("value"), "evidence")
    return long.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
