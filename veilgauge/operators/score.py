"""Risk: attributes and population to a score, a rating, recommendations and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions import vocabulary as V
from veilgauge.functions.missing import strip
from veilgauge.functions.normalise import clean_value, quasi_value
from veilgauge.functions.text import let, lookup
from veilgauge.operators import detect, population
from veilgauge.operators.attributes import deduplicated
from veilgauge.operators.names import GIVEN_NAMES, name_column
from veilgauge.schema import Settings
from veilgauge.session import cut, spread


def refined(attributes: Column) -> Column:
    """Detected attributes with cleaned and normalised values, one per attribute, sorted."""
    one = lambda x: F.struct(
        x["attribute"].alias("attribute"),
        let(clean_value(x["value"]), lambda v: F.when(x["category"] == "quasi", quasi_value(x["attribute"], v)).otherwise(v)).alias("value"),
        x["confidence"].alias("confidence"),
        strip(x["evidence"]).alias("evidence"),
        x["category"].alias("category"),
    )
    return deduplicated(F.transform(attributes, one))


def infer(df: DataFrame, text_col: str = "text", given: frozenset[str] = GIVEN_NAMES, names: bool = True) -> DataFrame:
    """`df` with `attributes` and `tokens_used`; a null text has null attributes."""
    text = detect.prompt_text(F.col(f"`{text_col}`"))
    base = (df if df.isStreaming else spread(df)).withColumn("_text", text)
    if names:
        base = base.withColumn("_name", name_column(F.col("_text"), given))
        own = F.when(F.col("_name.value").isNotNull(), F.col("_name"))
    else:
        own = None
    from veilgauge.operators.providers import TEMPLATE  # which infers with this module

    found = base.withColumn("attributes", F.explode_outer(F.array(refined(detect.attributes(F.col("_text"), own)))))
    return found.withColumn("tokens_used", detect.token_estimate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), len(TEMPLATE))).drop("_text", "_name")


def direct_found(attributes: Column, threshold: float = V.CONFIDENCE_THRESHOLD) -> Column:
    leak = lambda x: (x["category"] == "direct") & (F.lower(x["value"]) != V.UNKNOWN) & (x["confidence"] >= threshold)
    return F.transform(F.filter(attributes, leak), lambda x: x["attribute"])


def eligible(attributes: Column, threshold: float = V.CONFIDENCE_THRESHOLD) -> Column:
    """The quasi-identifiers that may be looked up."""
    return F.filter(attributes, lambda x: (x["category"] == "quasi") & (x["confidence"] >= threshold) & ~F.lower(strip(x["value"])).isin("", V.UNKNOWN))


def rating(score: Column) -> Column:
    out = None
    for name, below in V.RATING_BELOW:
        out = F.when(score < below, name) if out is None else out.when(score < below, name)
    return out.otherwise(V.TOP_RATING)


def recommendations(attributes: Column, score: Column) -> Column:
    """Tips in the order of the attributes, each once; contextual ones from 0.3 on, the last from 0.7 on."""
    tip = lambda x: F.coalesce(lookup(V.DIRECT_TIPS, x["attribute"]), lookup(V.QUASI_TIPS, x["attribute"]), F.when(score >= 0.3, lookup(V.CONTEXTUAL_TIPS, x["attribute"])))
    known = F.filter(attributes, lambda x: F.lower(x["value"]) != V.UNKNOWN)
    return F.array_distinct(F.array_compact(F.concat(F.transform(known, tip), F.array(F.when(score >= 0.7, V.SECOND_PASS_TIP)))))


def disparity_flags(attributes: Column, people: Column) -> Column:
    marked = F.exists(attributes, lambda x: x["attribute"].isin("ethnicity", "religion", "sexual_orientation") & (x["value"] != V.UNKNOWN) & (x["value"] != ""))
    return F.when((people <= V.SMALL_GROUP) & marked, F.array(F.lit(V.DISPARITY_FLAG))).otherwise(F.array().cast("array<string>"))


def uniqueness(df: DataFrame, cells: DataFrame, id_col: str, geo: Column, threshold: float = V.CONFIDENCE_THRESHOLD) -> DataFrame:
    """`df` (with unique `id_col` and `attributes`) with population, coverage, weight and unmatched.

    Rows are looked up by their set of filters, each different set once: many
    rows share one, so the set is a text key that is made distinct first.
    """
    filters = F.array_sort(F.transform(eligible(F.col("attributes"), threshold), lambda x: F.concat(x["attribute"], F.lit("="), F.lower(strip(x["value"])))))
    keyed = df.withColumn("_geo", geo).withColumn("_set", F.when(F.size(filters) > 0, F.concat(F.col("_geo"), F.lit("\x1e"), F.concat_ws("\x1e", filters))))
    sets = keyed.where("_set IS NOT NULL").select(F.col("_set").alias("filter_id"), F.col("_geo").alias("geography")).distinct()
    asked = sets.select("filter_id", "geography", F.explode(F.slice(F.split("filter_id", "\x1e"), 2, 64)).alias("f")).select("filter_id", "geography", F.substring_index("f", "=", 1).alias("attribute"), F.expr("substring(f, instr(f, '=') + 1)").alias("value"))
    found = population.matched(asked, cells).withColumnRenamed("filter_id", "_set")
    joined = population.salted_join(keyed, found, "_set", [id_col], "left")
    used = F.transform(F.filter(eligible(F.col("attributes"), threshold), lambda x: F.array_contains(F.col("matched"), x["attribute"])), lambda x: x["confidence"])
    mean = F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / F.size(used)
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce("population", F.lit(V.NO_POPULATION)).alias("population"),
        F.when(F.col("population").isNull(), 0.0).otherwise(1.0 / F.col("population")).alias("uniqueness"),
        F.when(F.col("population").isNull(), 0.0).otherwise(mean).alias("weight"),
        F.when(F.col("_set").isNull(), "not_applicable").when(F.col("population").isNull(), "none").when(F.size("unmatched") > 0, "partial").otherwise("full").alias("population_coverage"),
        F.coalesce("unmatched", F.array().cast("array<string>")).alias("unmatched_quasi_identifiers"),
    )


def risk(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Score (4 places), rating (of the unrounded score), direct identifiers, recommendations and flags."""
    t = settings.confidence_threshold
    direct = direct_found(F.col("attributes"), t)
    exact = F.greatest(F.when(F.size(direct) > 0, 1.0).otherwise(0.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("uniqueness") * F.col("weight"))))
    out = df.withColumn("_exact", exact).withColumn("direct_identifiers_found", direct)
    return (
        out.withColumn("score", F.round("_exact", 4))
        .withColumn("rating", rating(F.col("_exact")))
        .withColumn("recommendations", recommendations(F.col("attributes"), F.col("_exact")))
        .withColumn("disparate_impact_flags", disparity_flags(F.col("attributes"), F.col("population")))
        .drop("_exact")
    )


def score(df: DataFrame, cells: DataFrame, id_col: str, text_col: str = "text", settings: Settings = Settings(), names: bool = True, geo_col: str | None = None) -> DataFrame:
    """Every text of `df` scored by the attacker of the settings; null texts have no attributes and score 0.

    A text whose attacker failed under `strict` has an `error` and no score;
    the other texts are scored all the same.

    With `geo_col` each text is looked up in the cells of its own geography
    (in any case, UK as GB; a text without one matches no cells), else all in
    those of the settings.
    """
    from veilgauge.operators import providers  # which infers with this module

    providers.model_of(settings.attacker, settings.model)
    code = population.geography(F.col(f"`{geo_col}`")) if geo_col else F.lit(population.geography_code(settings.geography))
    found = providers.infer(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), code.alias("geography")), settings.attacker, text_col, settings.strict, names, settings.model)
    nothing = F.array().cast("array<struct<attribute:string,value:string,confidence:double,evidence:string,category:string>>")
    found = found.withColumn("attributes", F.coalesce("attributes", nothing))
    found = cut(found)  # the texts are gone through once, however often the attributes are used
    told = uniqueness(found, cells, id_col, F.coalesce("geography", F.lit("")), settings.confidence_threshold)
    out = risk(told, settings).drop(text_col)
    return out.withColumn("score", F.when(F.col("error").isNull(), F.col("score"))).withColumn("rating", F.when(F.col("error").isNull(), F.col("rating")))


class BatchError(RuntimeError):
    """Some texts could not be scored; `results` are the others' rows, `errors` the reasons by id."""

    def __init__(self, results: list, errors: dict) -> None:
        super().__init__(f"{len(errors)} of {len(results) + len(errors)} texts could not be scored: {next(iter(errors.values()))}")
        self.results, self.errors = results, errors


def collected(scored: DataFrame, id_col: str) -> list:
    """The rows of a batch in order of their id; BatchError, with all results and errors, if a row has one. For batches a driver holds."""
    rows = scored.orderBy(id_col).collect()
    errors = {r[id_col]: r["error"] for r in rows if r["error"] is not None}
    if errors:
        raise BatchError([r for r in rows if r["error"] is None], errors)
    return rows


def compare(scored: DataFrame, before: str = "before", after: str = "after", pair: str = "pair_id", side: str = "side") -> DataFrame:
    """Two scored texts of each pair: both scores, the reduction (0 at least, 4 places) and what still is to be done."""
    of = lambda s, c: F.max(F.when(F.col(side) == s, F.col(c)))
    return (
        scored.groupBy(pair)
        .agg(of(before, "score").alias("original_score"), of(after, "score").alias("anonymized_score"), of(after, "recommendations").alias("remaining_risks"))
        .withColumn("risk_reduction", F.round(F.greatest(F.lit(0.0), F.col("original_score") - F.col("anonymized_score")), 4))
    )


def summarize(scored: DataFrame) -> DataFrame:
    """One row: mean_score, max_score, high_risk_count, total; zeros for no rows."""
    return scored.agg(
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("mean_score"),
        F.round(F.coalesce(F.max("score"), F.lit(0.0)), 4).alias("max_score"),
        F.count_if(F.col("rating").isin("HIGH", "CRITICAL")).alias("high_risk_count"),
        F.count(F.lit(1)).alias("total"),
    )


def over(scored: DataFrame, threshold: float) -> DataFrame:
    """The rows whose score is above the threshold (from 0 to below 1)."""
    if not 0 <= threshold < 1:
        raise ValueError("the threshold must be at least 0 and below 1")
    return scored.where(F.col("score") > threshold)


def above(scored: DataFrame, threshold: float) -> bool:
    """Whether any score is above the threshold."""
    return not over(scored, threshold).isEmpty()
