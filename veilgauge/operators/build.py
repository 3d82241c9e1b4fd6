"""Weighted person rows to population cells."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions import vocabulary as V
from veilgauge.functions.missing import strip
from veilgauge.functions.text import lookup
from veilgauge.operators.population import COLUMNS, geography_code


def code_key(c: Column) -> Column:
    """Codes that are equal as numbers compare equal (01, 1, 1.0); others compare in lower case."""
    text = strip(c)
    number = F.when(text.rlike(r"^[+-]?\d+(\.0*)?$"), text.try_cast("double"))
    return F.when(number.isNotNull() & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(F.lower(text))


def number(c: Column) -> Column:
    """A finite number of at least 0; null for anything else."""
    text = strip(c)
    n = F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when((n >= 0) & (n < float("inf")), n)


def label(attribute: str, c: Column) -> Column:
    """A stored label: single spaces, upper case for postcodes, else lower; occupations in snake case; blank is unknown."""
    text = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    if attribute == "postcode_district":
        out = F.upper(text)
    elif attribute == "occupation":
        out = F.btrim(F.regexp_replace(F.lower(text), r"(?U)[\W_]+", "_"), F.lit("_"))
    else:
        out = F.lower(text)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(V.UNKNOWN))


def survey_ethnicity(race: Column, hispanic: Column) -> Column:
    """From survey codes; null if either is blank."""
    blank = (F.coalesce(strip(race), F.lit("")) == "") | (F.coalesce(strip(hispanic), F.lit("")) == "")
    return F.when(blank, None).when(code_key(hispanic) != "1", "hispanic").otherwise(F.coalesce(lookup({"1": "white", "2": "black", "6": "asian", "9": "mixed"}, code_key(race)), F.lit("other")))


@dataclass(frozen=True)
class Recipe:
    """How columns of person rows become attributes."""

    columns: dict[str, str] = field(default_factory=dict)
    age: str | None = None
    weight: str | None = None
    value_maps: dict[str, dict[str, str]] = field(default_factory=dict)
    ethnicity_from: tuple[str, str] | None = None

    def merged(self, columns: dict[str, str] | None = None, age: str | None = None, weight: str | None = None, value_maps: dict[str, dict[str, str]] | None = None) -> Recipe:
        """This recipe under explicit arguments: a column given for ethnicity replaces the derived one."""
        named = {**self.columns, **(columns or {})}
        unknown = sorted(set(named) - set(COLUMNS) | set(value_maps or {}) - set(COLUMNS))
        if unknown:
            raise ValueError(f"no such population column: {', '.join(unknown)}")
        if "age_range" in named and (age or self.age):
            raise ValueError("give either an age column or a column for age_range")
        derived = None if "ethnicity" in named else self.ethnicity_from
        maps = {**self.value_maps, **(value_maps or {})}
        return Recipe(named, age or self.age, weight or self.weight, maps, derived)


#: Person rows of the American survey.
# Columns and codes of the public-use person survey.
SURVEY = Recipe(
    {"gender": "SEX", "marital_status": "MAR", "nationality": "CIT"},
    "AGEP",
    "PWGTP",
    {
        "gender": {"1": "male", "2": "female"},
        "marital_status": {"1": "married", "2": "widowed", "3": "divorced", "4": "separated", "5": "single"},
        "nationality": {"1": "american", "2": "american", "3": "american", "4": "american", "5": "non_citizen"},
    },
    ("RAC1P", "HISP"),
)


@dataclass
class BuildSummary:
    input_rows: int
    rows_used: int
    skipped_invalid_age: int
    skipped_invalid_weight: int
    cells: int
    total_population: int
    zero_count_cells: int
    values_not_in_map: dict[str, int]
    unmapped_attributes: list[str]


def prepared(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per person: the seven columns, `_weight`, `_bad` (weight before age) and `_miss_` flags of values outside their map."""
    needed = [*recipe.columns.values(), *(recipe.ethnicity_from or ()), *[c for c in (recipe.age, recipe.weight) if c]]
    missing = sorted(set(needed) - set(rows.columns))
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    col = lambda c: F.col(f"`{c}`").cast("string")
    # the values of the row are read once, behind an explode, and only then turned into labels
    raw = lambda c: F.coalesce(strip(col(c)), F.lit(""))
    read = {"weight": number(col(recipe.weight)) if recipe.weight else F.lit(1.0)}
    if recipe.age:
        read |= {"age_text": raw(recipe.age), "age": number(col(recipe.age))}
    for a, source in recipe.columns.items():
        read |= {f"raw_{a}": raw(source), f"code_{a}": code_key(col(source))}
    if recipe.ethnicity_from:
        read |= {"ethnicity": survey_ethnicity(*[col(c) for c in recipe.ethnicity_from])}
    rows = rows.select(F.explode(F.array(F.struct(*[v.alias(k) for k, v in read.items()]))).alias("r"))
    at = lambda k: F.col(f"r.{k}")
    weight = at("weight")
    values: dict[str, Column] = {c: F.lit(V.UNKNOWN) for c in COLUMNS}
    flags = []
    bad_age = F.lit(False)
    if recipe.age:
        low = F.floor(at("age") / 10).cast("bigint") * 10
        values["age_range"] = F.when(at("age_text") == "", V.UNKNOWN).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))
        bad_age = (at("age_text") != "") & at("age").isNull()
    for a in recipe.columns:
        typed = at(f"raw_{a}")
        got = typed
        if a in recipe.value_maps:
            # of codes that are equal as numbers the last counts
            mapped = F.coalesce(*[F.when(at(f"code_{a}") == code_key(F.lit(k)), F.lit(v)) for k, v in reversed(recipe.value_maps[a].items())], F.lit(None).cast("string"))
            flags.append(((typed != "") & mapped.isNull()).alias(f"_miss_{a}"))
            got = F.coalesce(mapped, typed)
        values[a] = F.when(typed == "", V.UNKNOWN).otherwise(label(a, got))
    if recipe.ethnicity_from:
        derived = at("ethnicity")
        names = {k.lower(): v for k, v in recipe.value_maps.get("ethnicity", {}).items()}
        named = F.coalesce(lookup(names, derived), derived) if names else derived
        values["ethnicity"] = F.when(derived.isNull(), V.UNKNOWN).otherwise(label("ethnicity", named))
    bad = F.when(weight.isNull(), "weight").when(bad_age, "age")
    return rows.select(*[v.alias(c) for c, v in values.items()], weight.alias("_weight"), bad.alias("_bad"), *flags)


def cells(rows: DataFrame, recipe: Recipe, geo: str) -> DataFrame:
    """Population cells of one geography: weights summed and rounded half to even, cells of 0 left out."""
    good = prepared(rows, recipe).where("_bad IS NULL")
    summed = good.groupBy(*COLUMNS).agg(F.bround(F.sum("_weight")).cast("bigint").alias("count"))
    return summed.where("count > 0").select(F.lit(geography_code(geo)).alias("geography"), *COLUMNS, "count")


def build(rows: DataFrame, recipe: Recipe, geo: str, path: str | None = None, overwrite: bool = False, source: str = "", notes: tuple[str, ...] = ()) -> tuple[DataFrame, BuildSummary]:
    """Cells and counters; written as Parquet by geography, with a metadata table (source and notes included) beside them, if a path is given."""
    from datetime import datetime, timezone

    people = prepared(rows, recipe)
    missed = [c for c in people.columns if c.startswith("_miss_")]
    count = people.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_bad") == "age").alias("age"),
        F.count_if(F.col("_bad") == "weight").alias("weight"),
        *[F.count_if(F.col(c) & F.col("_bad").isNull()).alias(c) for c in missed],
    ).first()
    summed = people.where("_bad IS NULL").groupBy(*COLUMNS).agg(F.bround(F.sum("_weight")).cast("bigint").alias("count"))
    total = summed.agg(F.count_if(F.col("count") > 0).alias("cells"), F.count_if(F.col("count") <= 0).alias("zero"), F.coalesce(F.sum(F.when(F.col("count") > 0, F.col("count"))), F.lit(0)).alias("people")).first()
    if not total["cells"]:
        raise ValueError(f"no population rows to write: {count['n']} rows read, {count['age']} with an invalid age and {count['weight']} with an invalid weight, the rest of zero weight")
    out = cells(rows, recipe, geo)
    mapped = {*recipe.columns, *(["age_range"] if recipe.age else []), *(["ethnicity"] if recipe.ethnicity_from else [])}
    summary = BuildSummary(
        count["n"], count["n"] - count["age"] - count["weight"], count["age"], count["weight"], total["cells"], total["people"], total["zero"], {c[6:]: count[c] for c in missed if count[c]}, [c for c in COLUMNS if c not in mapped]
    )
    if path:
        out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("geography").parquet(f"{path}/cells")
        meta = {"geography": geography_code(geo), "built_at": datetime.now(timezone.utc).replace(microsecond=0).isoformat(), "input_rows": str(count["n"]), "rows_used": str(summary.rows_used), "weight_column": recipe.weight or "", "schema_version": "1", "source": source, "notes": "\n".join(notes), "unmapped": ", ".join(summary.unmapped_attributes)}
        rows.sparkSession.createDataFrame(list(meta.items()), "key string, value string").write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/metadata")
    return out, summary

