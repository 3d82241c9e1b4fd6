"""Sources and sinks: texts, populations, person rows, benchmark rows, results."""

from __future__ import annotations

import re
import sqlite3
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.functions import vocabulary as V
from veilgauge.functions.missing import strip
from veilgauge.operators import population
from veilgauge.registry import Registry
from veilgauge.session import shared_dir


def text_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, text): one row per whole file; ValueError for files that are no UTF-8."""
    raw = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source"), "content")
    told = raw.select("source", F.is_valid_utf8(F.col("content").cast("string")).alias("ok"), F.col("content").cast("string").alias("text"))
    bad = [r["source"] for r in told.where(~F.col("ok")).select("source").take(5)]
    if bad:
        raise ValueError(f"no UTF-8 text: {', '.join(bad)}")
    return told.select("source", "text")


def texts(spark: SparkSession, values: list[str | None]) -> DataFrame:
    """(idx, text) in the order given."""
    return spark.createDataFrame(list(enumerate(values)), "idx bigint, text string")


def population_parquet(spark: SparkSession, path: str, geo: str | None = None) -> DataFrame:
    return population.checked(spark.read.parquet(path), geo)


def population_csv(spark: SparkSession, path: str, geo: str | None = None) -> DataFrame:
    return population.checked(spark.read.csv(path, header=True, mode="FAILFAST"), geo)


def population_sqlite(spark: SparkSession, path: str, geo: str | None = None, batch: int = 100_000) -> DataFrame:
    """The table cross_tab of an SQLite file, read in blocks through the driver; every failure is a ValueError."""
    wanted = ["geography", *V.POPULATION_COLUMNS, "count"]
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as conn:
            names = [r[1] for r in conn.execute("PRAGMA table_info(cross_tab)")]
            missing = [c for c in wanted if c not in names]
            if missing:
                raise ValueError(f"the population file lacks {', '.join(missing)}")
            schema = ", ".join([*[f"{c} string" for c in wanted[:-1]], "count bigint"])
            return population.checked(_in_blocks(spark, conn.execute(f"SELECT {', '.join(wanted)} FROM cross_tab"), schema, batch), geo)
    except sqlite3.Error as e:
        raise ValueError(f"the population file can't be read: {e}") from e


def metadata(table: DataFrame) -> DataFrame:
    """One row with the map of a (key, value) table; an empty map for an empty one."""
    return table.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def person_csv(spark: SparkSession, path: str, needed: list[str] | None = None) -> DataFrame:
    """Person rows, all text; malformed lines end the read, missing columns are a ValueError, a byte order mark is dropped."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST", encoding="UTF-8", multiLine=False)
    rows = rows.withColumnsRenamed({c: c.lstrip("\ufeff").strip() for c in rows.columns if c != c.lstrip("\ufeff").strip()})
    missing = [c for c in needed or [] if c not in rows.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return rows


def benchmark_rows(rows: DataFrame) -> DataFrame:
    """The nine columns, stripped; ValueError if one is missing or a value blank."""
    missing = [c for c in V.BENCH_INDIRECT if c not in rows.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    out = rows.select(*[strip(F.col(f"`{c}`").cast("string")).alias(c) for c in V.BENCH_INDIRECT])
    blank = out.agg(*[F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(c) for c in V.BENCH_INDIRECT]).first()
    bad = [c for c in V.BENCH_INDIRECT if blank[c]]
    if bad:
        raise ValueError(f"blank values in {', '.join(bad)}")
    return out


def benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    return benchmark_rows(spark.read.csv(path, header=True, mode="FAILFAST"))


def benchmark_sqlite(spark: SparkSession, path: str, table: str = "population") -> DataFrame:
    """Benchmark rows from a table of an SQLite file opened read-only; only the nine columns are read.

    Rows go through the driver in blocks to a Parquet table in the shared
    folder, so neither the plan nor the driver grows with them.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", table):
        raise ValueError(f"{table!r} is no name of a table")
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as source:
            cursor = source.execute(f"SELECT {', '.join(V.BENCH_INDIRECT)} FROM {table}")  # noqa: S608  the name is checked
            return benchmark_rows(_in_blocks(spark, cursor, ", ".join(f"{c} string" for c in V.BENCH_INDIRECT)))
    except sqlite3.Error as e:
        raise ValueError(f"{path} cannot be read: {e}") from e


def _in_blocks(spark: SparkSession, cursor, schema: str, block: int = 100_000) -> DataFrame:
    """The rows of a database cursor, written to the shared folder a block at a time and read from there."""
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    kinds = [x.rsplit(" ", 1)[1] for x in schema.split(", ")]
    while True:
        rows = cursor.fetchmany(block)
        own = [tuple(None if v is None else str(v) if k == "string" else v for v, k in zip(r, kinds)) for r in rows]
        spark.createDataFrame(own, schema).write.mode("append").parquet(path)
        if len(rows) < block:
            return spark.read.schema(schema).parquet(path)


#: Sources of benchmark records by name, functions of a session and what they need.
BENCHMARK_SOURCES: Registry = Registry("source of benchmark records")


def benchmark_records(spark: SparkSession, records: list[dict[str, str]]) -> DataFrame:
    if not records:
        raise ValueError("no records")
    missing = [c for c in V.BENCH_INDIRECT if c not in records[0]]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return benchmark_rows(spark.createDataFrame([tuple(str(r.get(c) or "") for c in V.BENCH_INDIRECT) for r in records], ", ".join(f"{c} string" for c in V.BENCH_INDIRECT)))


def as_json(results: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_population(cells: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet by geography; an existing path is an error unless `overwrite`."""
    cells.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("geography").parquet(path)


for _name, _source in (("csv", benchmark_csv), ("sqlite", benchmark_sqlite), ("records", benchmark_records)):
    BENCHMARK_SOURCES.register(_name, _source)
