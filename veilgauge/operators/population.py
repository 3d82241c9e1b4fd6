"""Population cells: reading, checking, and how many people share a set of quasi-identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.functions import vocabulary as V
from veilgauge.functions.missing import strip
from veilgauge.schema import POPULATION
from veilgauge.session import cut, spread

COLUMNS = V.POPULATION_COLUMNS


def geography(c: Column) -> Column:
    """Upper case without white space around, UK as GB."""
    g = F.upper(strip(c))
    return F.when(g == "UK", "GB").otherwise(g)


def geography_code(value: str) -> str:
    code = value.strip().upper()
    return "GB" if code == "UK" else code


def sample(spark: SparkSession) -> DataFrame:
    """The illustrative cells of both geographies."""
    return spark.createDataFrame([(g, *row) for g, rows in V.SAMPLE_POPULATION.items() for row in rows], POPULATION)


def sample_for(spark: SparkSession, geo: str) -> DataFrame:
    code = geography_code(geo)
    if code not in V.SAMPLE_POPULATION:
        raise ValueError(f"no illustrative population for {geo!r}; give a population table")
    return sample(spark).where(F.col("geography") == code)


def checked(cells: DataFrame, geo: str | None = None) -> DataFrame:
    """`cells` with the columns of a population table; ValueError if one is missing or the geography has no rows."""
    missing = [f.name for f in POPULATION.fields if f.name not in cells.columns]
    if missing:
        raise ValueError(f"the population table lacks the column(s) {', '.join(missing)}")
    out = cells.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in POPULATION.fields])
    if geo is not None:
        out = out.where(F.col("geography") == geography_code(geo))
        if out.isEmpty():
            raise ValueError(f"the population table has no rows for {geo!r}")
    return out


def known_values(cells: DataFrame) -> DataFrame:
    """(geography, attribute, value): distinct values in lower case."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.lower(c).alias("value")) for c in COLUMNS])
    return cells.select("geography", F.explode(pairs).alias("p")).select("geography", "p.attribute", "p.value").where("value IS NOT NULL").distinct()


def _mask(columns: dict[str, Column]) -> Column:
    return sum((F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(columns.values())), F.lit(0))


def _keys(values: list[Column]) -> list[Column]:
    """Two independent 64-bit hashes of the values, nulls included: equal for different values with a chance of about 2^-128."""
    return [F.xxhash64(F.lit(seed), *[F.coalesce(v, F.lit("\0")) for v in values]).alias(f"_h{seed}") for seed in (1, 2)]


#: Filter sets that are shipped to all tasks to keep only the cells they ask for.
SHIPPED_FILTERS = 200_000


def sums_by_masks(filters: DataFrame, cells: DataFrame) -> DataFrame:
    """`filters` (geography and the seven columns, null where not set) with `total`, the summed counts; 0 where no cell fits.

    The cells are summed for each set of columns that occurs among the filters
    (127 at most) and joined by equality. Where the filter sets are few by
    count, cells nobody asks for are dropped before they are summed; else all
    are summed, with partial sums before the shuffle.
    """
    own = {c: F.col(c) for c in COLUMNS}
    asked = filters.withColumn("_mask", _mask(own)).select("*", *_keys([F.col("geography"), F.col("_mask").cast("string"), *own.values()]))
    told = {r["_mask"]: r["n"] for r in asked.groupBy("_mask").agg(F.count(F.lit(1)).alias("n")).collect()}
    shown = [F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.coalesce(F.col(c), F.lit("\1"))) for i, c in enumerate(COLUMNS)]
    low = spread(cells.select("geography", *[F.lower(c).alias(c) for c in COLUMNS], "count"))
    each = low.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in told] or [F.lit(0)])))
    each = each.select("count", *_keys([F.col("geography"), F.col("_mask").cast("string"), *shown]))
    if sum(told.values()) <= SHIPPED_FILTERS:
        each = each.join(F.broadcast(asked.select("_h1", "_h2").distinct()), ["_h1", "_h2"])
    summed = each.groupBy("_h1", "_h2").agg(F.sum("count").alias("total"))
    return asked.join(summed, ["_h1", "_h2"], "left").fillna(0, ["total"]).drop("_mask", "_h1", "_h2")


def matched(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """Population matches of filter sets.

    `asked`: (filter_id, geography, attribute, value), one row per filter.
    Result per filter_id: `population` (null where no filter could be used,
    else at least 1), `matched` and `unmatched` attributes, sorted. Blank and
    unknown values are no filters; values the population does not know, and
    attributes it does not have, are unmatched.
    """
    given = asked.select("filter_id", "geography", "attribute", F.lower(strip(F.col("value"))).alias("value")).where("value IS NOT NULL AND value NOT IN ('', 'unknown')")
    known = known_values(cells).withColumn("_known", F.lit(True))
    told = given.join(known, ["geography", "attribute", "value"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    value = lambda c: F.max(F.when(F.col("_known") & (F.col("attribute") == c), F.col("value"))).alias(c)
    names = lambda used: F.array_sort(F.collect_set(F.when(F.col("_known") == used, F.col("attribute"))))  # noqa: E731 at most one name per attribute
    wide = cut(told.groupBy("filter_id", "geography").agg(*[value(c) for c in COLUMNS], names(True).alias("matched"), names(False).alias("unmatched")))  # read three times
    combos = wide.select("geography", *COLUMNS).distinct()
    sums = sums_by_masks(combos, cells)
    same = [F.col("a.geography") == F.col("b.geography"), *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in COLUMNS]]
    out = wide.alias("a").join(sums.alias("b"), same, "left")
    return out.select("a.filter_id", F.when(F.size("a.matched") > 0, F.greatest(F.lit(1), F.col("b.total"))).alias("population"), "a.matched", "a.unmatched")


def query_counts(filters: DataFrame, cells: DataFrame) -> DataFrame:
    """`filters` with `total` floored at 1, whether or not the population knows the values."""
    plain = filters.select("geography", *[F.nullif(F.nullif(F.lower(strip(F.col(c))), F.lit("")), F.lit(V.UNKNOWN)).alias(c) for c in COLUMNS])
    return sums_by_masks(plain, cells).withColumn("total", F.greatest(F.lit(1), "total"))


def class_sizes(rows: DataFrame, attributes: list[str], out: str = "class_size") -> DataFrame:
    """`rows` with the number of rows equal to it in all `attributes`, by an aggregate and a join.

    Unlike a window, the counts are combined before they are shuffled, so a
    group of a third of all rows is no single task.
    """
    if not attributes:
        return rows.withColumn(out, F.lit(rows.count()))
    values = [F.coalesce(F.trim(F.col(a).cast("string")), F.lit("")) for a in attributes]
    keyed = rows.withColumn("_k", F.concat_ws("\x1f", *values))
    sizes = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias(out))
    return salted_join(keyed, sizes, "_k", [c for c, t in rows.dtypes if not t.startswith("map")] or ["_k"]).drop("_k")


#: Parts into which the rows of each key are spread before a join with one row per key.
SALTS = 16


def salted_join(rows: DataFrame, per_key: DataFrame, key: str, by: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with a table of one row per key, the rows of a key spread over SALTS parts by a hash of the columns `by`, so that a key of a third of all rows is no single task."""
    spread_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(SALTS)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread_rows.join(copies, [key, "_salt"], how).drop("_salt")
