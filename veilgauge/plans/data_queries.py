"""Registered queries over delivered tables (column profiles, rejected lines) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.functions.missing import sql_missing
from veilgauge.operators import profile as P
from veilgauge.operators import rejects as R
from veilgauge.session import table

_LINES = {"population_pums_synthetic": R.PERSON_SPEC, "rat_bench_pums_sample": R.BENCHMARK_SPEC}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof, counts = P.profile(table(spark, sf_dir, "cross_tab"), P.cell_checks())
    return P.standing_out(prof, counts).select(F.col("load").alias("load_id"), "column_name")


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof, _ = P.profile(table(spark, sf_dir, "cross_tab"), P.all_cell_checks())
    return prof.select(F.col("load").alias("load_id"), "column_name", "n_rows", "n_null", "n_missing", "n_distinct", "n_ill", "median")


def p3_footer_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keyed_extrema(spark, f"{sf_dir}/cross_tab.parquet", ("cell_id", "load_id", "count"))


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        R.split_rows(R.parse_lines(table(spark, sf_dir, t), spec), spec)[1].select(F.lit(t).alias("src_table"), "line_id", "errors") for t, spec in _LINES.items()
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejected(spark, sf_dir).select("src_table", "line_id")


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejected(spark, sf_dir).select("src_table", "line_id", F.explode("errors").alias("reason"))


def p4_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = R.PERSON_SPEC
    return R.split_rows(R.parse_lines(table(spark, sf_dir, "population_pums_synthetic"), spec), spec)[0]


def p4_benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = R.BENCHMARK_SPEC
    return R.split_rows(R.parse_lines(table(spark, sf_dir, "rat_bench_pums_sample"), spec), spec)[0]


QUERIES = {f.__name__: f for f in (p3_found, p3_profile, p3_footer_extrema, p4_found, p4_reasons, p4_persons, p4_benchmark_rows)}

_SNAKE = "'[a-z]+(_[a-z]+)*'"
_FORM = {
    "occupation": f"NOT regexp_full_match(occupation, {_SNAKE})",
    "postcode_district": "NOT (CASE WHEN geography = 'GB' THEN regexp_full_match(postcode_district, '[A-Z]{1,2}') ELSE regexp_full_match(postcode_district, '[0-9]{5}') END)",
    "age_range": "NOT regexp_full_match(age_range, '0-9|[1-9]0-[1-9]9')",
    **{c: f"NOT regexp_full_match({c}, {_SNAKE})" for c in ("gender", "ethnicity", "marital_status", "nationality")},
    "geography": "geography NOT IN ('US', 'GB')",
}


def _long(columns: tuple[str, ...]) -> str:
    text = [
        f"SELECT load_id, geography AS g, '{c}' AS column_name, {c} AS v, CAST(NULL AS BIGINT) AS k, {sql_missing(c)} AS missing, coalesce({_FORM[c]}, false) AND NOT {sql_missing(c)} AS ill FROM cross_tab"
        for c in columns
    ]
    number = "SELECT load_id, geography AS g, 'count' AS column_name, CAST(\"count\" AS VARCHAR) AS v, \"count\" AS k, \"count\" IS NULL AS missing, coalesce(\"count\" <= 0, false) AS ill FROM cross_tab"
    return " UNION ALL ".join([*text, number])


_FOUND3 = f"""
WITH u AS ({_long(("occupation", "postcode_district"))}),
p AS (SELECT load_id, max(g) AS g, column_name, count(*) AS n, avg(missing::INT) AS m, avg(ill::INT) AS i, quantile_cont(k, 0.5) AS med FROM u GROUP BY load_id, column_name),
s AS (SELECT g, column_name, median(m) AS um, median(i) AS ui, median(med) AS uc FROM p GROUP BY ALL),
v AS (SELECT u.load_id, u.column_name, p.g, v, count(*) / max(p.n) AS share FROM u JOIN p USING (load_id, column_name) WHERE v IS NOT NULL GROUP BY ALL),
h AS (SELECT g, column_name, v FROM v GROUP BY ALL HAVING max(share) >= 0.15),
f AS (SELECT p.load_id, h.g, h.column_name, h.v, coalesce(v.share, 0) AS share FROM h JOIN p ON p.g = h.g AND p.column_name = h.column_name LEFT JOIN v ON v.load_id = p.load_id AND v.column_name = h.column_name AND v.v = h.v),
e AS (SELECT g, column_name, v, median(share) AS us FROM f GROUP BY ALL)
SELECT load_id, column_name FROM p JOIN s USING (g, column_name) WHERE m - um >= 0.15 OR i - ui >= 0.15 OR med >= 5 * uc OR med * 5 <= uc
UNION SELECT load_id, column_name FROM f JOIN e USING (g, column_name, v) WHERE abs(share - us) >= 0.15"""

_PROFILE = f"""
SELECT load_id, column_name, count(*) AS n_rows, count(*) - count(v) AS n_null, sum(missing::INT)::BIGINT AS n_missing, count(DISTINCT v) AS n_distinct, sum(ill::INT)::BIGINT AS n_ill, quantile_cont(k, 0.5) AS median
FROM ({_long(tuple(_FORM))}) GROUP BY load_id, column_name"""

_EXTREMA = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count(\"{c}\") AS n_null, min(\"{c}\") AS lo, max(\"{c}\") AS hi FROM cross_tab" for c in ("cell_id", "load_id", "count"))

_F = '(?:"(?:[^"]|"")*"|[^",\\r\\n]*)'


def _split(table_name: str, columns: tuple[str, ...]) -> str:
    take = ", ".join(f"CASE WHEN f[{k}] LIKE '\"%' THEN replace(substr(f[{k}], 2, length(f[{k}]) - 2), '\"\"', '\"') ELSE f[{k}] END AS {c}" for k, c in enumerate(columns, 1))
    return f"""(SELECT line_id, coalesce(trim(l) <> '' AND regexp_full_match(l, '{_F}(?:,{_F}){{{len(columns) - 1}}}'), false) AS shaped, {take} FROM
(SELECT line_id, l, regexp_extract_all(',' || l, ',("(?:[^"]|"")*"|[^",]*)', 1) AS f FROM (SELECT line_id, regexp_replace(raw_line, '\\r$', '') AS l FROM {table_name})))"""


_NUM = "CASE WHEN regexp_full_match({0}, ' *([0-9]+(\\.[0-9]*)?|\\.[0-9]+) *') THEN CAST(trim({0}) AS DOUBLE) END"
_AGE, _WEIGHT = _NUM.format("AGEP"), _NUM.format("PWGTP")
_P = _split("population_pums_synthetic", R.PERSON_SPEC.columns)
_B = _split("rat_bench_pums_sample", R.BENCHMARK_SPEC.columns)
_P_OK = f"shaped AND coalesce(({_AGE}) BETWEEN 0 AND 120, false) AND coalesce(({_WEIGHT}) >= 0, false)"
_DATE = f"CASE WHEN regexp_full_match(trim(date_of_birth), '({R.MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}') THEN CAST(try_strptime(trim(date_of_birth), '%B %-d, %Y') AS DATE) END"
_B_OK = "shaped AND " + " AND ".join(f"trim({c}) <> ''" for c in R.BENCHMARK_SPEC.columns) + f" AND ({_DATE}) IS NOT NULL AND regexp_matches(occupation, '\\p{{L}}') AND NOT {sql_missing('occupation')}"

SQL = {
    "p3_found": _FOUND3,
    "p3_profile": _PROFILE,
    "p3_footer_extrema": _EXTREMA,
    "p4_found": f"SELECT 'population_pums_synthetic' AS src_table, line_id FROM {_P} WHERE NOT ({_P_OK}) UNION ALL SELECT 'rat_bench_pums_sample' AS src_table, line_id FROM {_B} WHERE NOT ({_B_OK})",
    "p4_persons": f"SELECT line_id, {', '.join({'AGEP': f'{_AGE} AS AGEP', 'PWGTP': f'{_WEIGHT} AS PWGTP'}.get(c, c) for c in R.PERSON_SPEC.columns)} FROM {_P} WHERE {_P_OK}",
    "p4_benchmark_rows": f"SELECT line_id, {', '.join(f'{_DATE} AS date_of_birth' if c == 'date_of_birth' else f'trim({c}) AS {c}' for c in R.BENCHMARK_SPEC.columns)} FROM {_B} WHERE {_B_OK}",
}


def _reasons(name: str, spec: R.RecordSpec, rules: list[tuple[str, str]]) -> str:
    """SQL for (src_table, line_id, reason); `rules`: reason and the condition under which it is given."""
    width = len(spec.columns)
    parts = [f"SELECT '{name}' AS src_table, line_id, '{reason}' AS reason FROM {_split(name, spec.columns)} WHERE shaped AND {when}" for reason, when in rules]
    shape = f"CASE WHEN l IS NULL OR trim(l) = '' THEN 'empty line' WHEN NOT regexp_full_match(l, '{_F}(?:,{_F})*') THEN 'broken quoting' WHEN len(f) <> {width} THEN 'wrong number of fields: ' || len(f) END"
    lines = f"(SELECT line_id, l, regexp_extract_all(',' || l, ',(\"(?:[^\"]|\"\")*\"|[^\",]*)', 1) AS f FROM (SELECT line_id, regexp_replace(raw_line, '\\r$', '') AS l FROM {name}))"
    return " UNION ALL ".join([f"SELECT * FROM (SELECT '{name}' AS src_table, line_id, {shape} AS reason FROM {lines}) WHERE reason IS NOT NULL", *parts])


SQL["p4_reasons"] = " UNION ALL ".join(
    [
        _reasons("population_pums_synthetic", R.PERSON_SPEC, [("AGEP: no plain number from 0 to 120", f"NOT coalesce(({_AGE}) BETWEEN 0 AND 120, false)"), ("PWGTP: no plain number of at least 0", f"NOT coalesce(({_WEIGHT}) >= 0, false)")]),
        _reasons(
            "rat_bench_pums_sample",
            R.BENCHMARK_SPEC,
            [
                *[(f"{c}: blank", f"trim({c}) = ''") for c in R.BENCHMARK_SPEC.columns],
                ("date_of_birth: no date such as June 3, 1971", f"({_DATE}) IS NULL"),
                ("occupation: no letters", "NOT regexp_matches(occupation, '\\p{L}')"),
                ("occupation: marker for a missing value", sql_missing("occupation")),
            ],
        ),
    ]
)
