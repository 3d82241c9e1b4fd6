"""Types shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from veilgauge.functions.vocabulary import CONFIDENCE_THRESHOLD, POPULATION_COLUMNS

ATTRIBUTE = T.StructType(
    [
        T.StructField("attribute", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)
POPULATION = T.StructType([T.StructField("geography", T.StringType()), *[T.StructField(c, T.StringType()) for c in POPULATION_COLUMNS], T.StructField("count", T.LongType())])


@dataclass(frozen=True)
class Settings:
    """What scoring depends on."""

    geography: str = "US"
    confidence_threshold: float = CONFIDENCE_THRESHOLD
    attacker: str = "rule_based"
    model: str | None = None
    strict: bool = False
