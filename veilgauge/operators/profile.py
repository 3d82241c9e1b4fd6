"""Column profiles per load, from file footers and dictionaries as far as they are exact, else from a scan of single chunks.

Three steps, at the grain of a chunk (a column of a row group):

1. `footers`: the files' footers are read once, in parallel, one row per chunk
   with exact null counts and extrema. Of a chunk whose pages are all
   dictionary-encoded (their headers are walked, their data is not read) the
   dictionary page is decoded: its values are the chunk's distinct candidates.
2. A chunk is settled if its row group belongs to one load (the load column
   has no nulls and one value) and it holds one value at most, or only nulls.
   Its counts follow from the footer, and its data is never read.
3. Files without a settled chunk are scanned by Spark, only in the columns
   that need it, and counted by load and value before anything is shuffled. Of
   files that also have settled chunks only the others are read, chunk by
   chunk and a batch at a time, counted in Arrow.

Whether a value is ill-formed and which group a load belongs to is decided on
the counted values, not on rows.

All columns of the result are defined for null load keys (one group), empty
tables (no rows) and constant columns. Values are compared as text; columns of
text, whole numbers, booleans and dates are covered.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.functions.missing import is_missing
from veilgauge.session import cut, slots

_FOOTER = "file string, row_group int, n_rows bigint, column_name string, nulls bigint, lo string, hi string, candidates bigint, listed array<string>"
#: Text extrema may be shortened by a writer from this length on; shorter ones are exact.
EXACT_TEXT = 32
#: Loads and columns up to which a table with a row for each is sent to all tasks; a larger one is joined by shuffle.
SHIPPED_LOADS = 200_000


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (raw[at] & 0x7F) << shift
        shift += 7
        at += 1
        if raw[at - 1] < 0x80:
            return out, at


def _read_struct(raw: bytes, at: int) -> tuple[dict, int]:
    """A struct of the Thrift compact protocol, as {field: value}: what Parquet's page headers are written in."""

    def value(kind: int, at: int):
        if kind in (1, 2):
            return kind == 1, at
        if kind == 3:
            return raw[at], at + 1
        if kind in (4, 5, 6):
            v, at = _varint(raw, at)
            return (v >> 1) ^ -(v & 1), at
        if kind == 7:
            return None, at + 8
        if kind == 8:
            n, at = _varint(raw, at)
            return raw[at : at + n], at + n
        if kind in (9, 10):
            n, inner = raw[at] >> 4, raw[at] & 15
            at += 1
            if n == 15:
                n, at = _varint(raw, at)
            items = []
            for _ in range(n):
                v, at = value(inner, at)
                items.append(v)
            return items, at
        if kind == 12:
            return _read_struct(raw, at)
        raise ValueError(f"unknown kind {kind}")

    out, last = {}, 0
    while raw[at]:
        kind, step = raw[at] & 15, raw[at] >> 4
        at += 1
        if step:
            last += step
        else:
            v, at = _varint(raw, at)
            last = (v >> 1) ^ -(v & 1)
        out[last], at = value(kind, at)
    return out, at + 1


def _dictionary(source, chunk) -> list | None:
    """The values of a chunk's dictionary; None unless all its pages are encoded by it. Reads page headers and the dictionary page only."""
    import pyarrow as pa

    if not chunk.has_dictionary_page or chunk.physical_type not in ("BYTE_ARRAY", "INT32", "INT64"):
        return None
    at, values = chunk.dictionary_page_offset or chunk.data_page_offset, None
    end = at + chunk.total_compressed_size
    while at < end:
        size = 1 << 10
        while True:
            source.seek(at)
            raw = source.read(min(size, end - at))
            try:
                head, length = _read_struct(raw, 0)
                break
            except IndexError:  # a header with long extrema
                if size >= end - at:
                    return None
                size *= 8
        kind = head[1]
        if kind == 2:
            source.seek(at + length)
            page = source.read(head[3])
            if chunk.compression != "UNCOMPRESSED":
                if chunk.compression not in ("SNAPPY", "GZIP", "ZSTD", "BROTLI"):
                    return None
                page = pa.Codec(chunk.compression.lower()).decompress(page, head[2]).to_pybytes()
            n = head[7][1]
            if chunk.physical_type == "BYTE_ARRAY":
                values, k = [], 0
                for _ in range(n):
                    (m,) = struct.unpack_from("<I", page, k)
                    values.append(page[k + 4 : k + 4 + m].decode("utf-8", "replace"))
                    k += 4 + m
            else:
                values = list(struct.unpack_from(f"<{n}{'i' if chunk.physical_type == 'INT32' else 'q'}", page))
        elif kind in (0, 3) and head[5 if kind == 0 else 8][2 if kind == 0 else 4] not in (2, 8):
            return None  # the writer gave the dictionary up
        at += length + head[3]
    return values


def _read_footers(columns: tuple[str, ...], dictionary: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for uri in batch["file"]:
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_file(path) as source:
                    meta, rows = pq.read_metadata(source), []
                    index = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        for c in columns:
                            if c not in index:
                                continue
                            chunk = group.column(index[c])
                            s = chunk.statistics
                            nulls = s.null_count if s is not None and s.has_null_count else None
                            lo, hi = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                            if lo is not None and chunk.physical_type == "BYTE_ARRAY" and max(len(lo), len(hi)) >= EXACT_TEXT:
                                lo = hi = None
                            found = _dictionary(source, chunk) if c in dictionary else None
                            listed = None if found is None else sorted({str(v) for v in found})
                            rows.append((uri, g, group.num_rows, c, nulls, lo, hi, None if listed is None else len(listed), listed))
                yield pd.DataFrame(rows, columns=["file", "row_group", "n_rows", "column_name", "nulls", "lo", "hi", "candidates", "listed"]).astype({"nulls": "Int64", "candidates": "Int64"})

    return run


def footers(table: DataFrame, columns: tuple[str, ...], dictionary: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk of the Parquet table's files for `columns`; dictionaries are decoded for those in `dictionary`."""
    spark = table.sparkSession
    files = spark.createDataFrame([(f,) for f in table.inputFiles()], "file string")
    return files.repartition(max(1, min(len(table.inputFiles()), 4 * slots(spark)))).mapInPandas(_read_footers(columns, dictionary), _FOOTER)


@dataclass(frozen=True)
class ColumnCheck:
    """A column to profile by its values. `ill(column, table row)` is true for an ill-formed or out-of-range value.

    numeric: nulls alone are missing, and the median is profiled.
    """

    name: str
    ill: Column | None = None
    numeric: bool = False


def chunk_plan(table: DataFrame, load: str, names: tuple[str, ...]) -> DataFrame:
    """(file, row_group, column_name, load, n_rows, nulls, value, settled): every chunk of `names`, read from the footers once.

    `load` is the row group's one load, or null; `value` a settled chunk's one value, or null.
    """
    chunks = cut(footers(table, (load, *names), names))
    one = F.when((F.col("nulls") == 0) & (F.col("lo") == F.col("hi")), F.col("lo"))
    loads = chunks.where(F.col("column_name") == load).select("file", "row_group", one.alias("load"))
    value = F.coalesce(F.when(F.col("candidates") == 1, F.get("listed", F.lit(0))), F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    settled = F.col("load").isNotNull() & F.col("nulls").isNotNull() & ((F.col("nulls") == F.col("n_rows")) | value.isNotNull())
    own = chunks.where(F.col("column_name").isin(*names)).join(loads, ["file", "row_group"], "left")
    return own.select("file", "row_group", "column_name", "load", "n_rows", "nulls", value.alias("value"), F.coalesce(settled, F.lit(False)).alias("settled"))


def _count_chunks(load: str):
    """Counts of (load, column, value) over batches of row groups, columns named."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for uri, g, names in zip(batch["file"], batch["row_group"], batch["names"]):
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_file(path) as source:
                    for part in pq.ParquetFile(source).iter_batches(1 << 18, [int(g)], [load, *names]):
                        rows = pa.table(part)
                        keys = rows[load]
                        for c in names:
                            counted = pa.table({"load": keys, "v": rows[c]}).group_by(["load", "v"], use_threads=False).aggregate([([], "count_all")])
                            yield pd.DataFrame({"load": pc.cast(counted["load"], pa.string()).to_pandas(), "column_name": c, "v": pc.cast(counted["v"], pa.string()).to_pandas(), "n": counted["count_all"].to_pandas()})

    return run


def value_counts(table: DataFrame, checks: tuple[ColumnCheck, ...], load: str = "load_id", group: str = "geography") -> DataFrame:
    """(load, group, column_name, value, n, ill): how often each value stands in each load; a load's group is the largest it has.

    ill is a property of value and group. Rows are counted before they are
    shuffled, so a load or a value that holds a third of all rows costs one row
    per batch.
    """
    kinds = dict(table.dtypes)
    names = tuple(dict.fromkeys((*[c.name for c in checks], group)))
    plan = chunk_plan(table, load, names)
    per_file = plan.groupBy("file").agg(F.max("settled").alias("any"))
    whole = [r["file"] for r in per_file.where("NOT any").select("file").collect()]  # names of files only, as the table lists them anyway
    pairs = F.array(F.struct(F.lit(None).cast("string").alias("v"), F.col("nulls").alias("n")), F.struct(F.col("value").alias("v"), (F.col("n_rows") - F.col("nulls")).alias("n")))
    sure = plan.where("settled").select("load", "column_name", F.explode(pairs).alias("x")).select("load", "column_name", "x.v", "x.n").where("n > 0")
    left = plan.join(per_file.where("any").select("file"), "file").where("NOT settled").groupBy("file", "row_group").agg(F.collect_set("column_name").alias("names"))
    single = left.repartition(4 * slots(table.sparkSession), "file", "row_group").mapInPandas(_count_chunks(load), "load string, column_name string, v string, n bigint")
    code = {c: i for i, c in enumerate(names)}
    short = F.coalesce(*[F.when(F.col("column_name") == c, F.lit(i).cast("tinyint")) for c, i in code.items()])
    each = sure.unionByName(single).select(F.col("load").cast(kinds[load]).alias("load"), short.alias("c"), "v", "n")
    if whole:
        values = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c, i in code.items()])
        scan = table.sparkSession.read.schema(table.schema).parquet(*whole).select(F.col(f"`{load}`").alias("load"), F.explode(values).alias("x"))
        each = each.unionByName(scan.select("load", "x.c", "x.v", F.lit(1).cast("bigint").alias("n")))
    counted = cut(each.groupBy("load", "c", "v").agg(F.sum("n").alias("n")))
    loads = counted.where(F.col("c") == code[group]).groupBy("load").agg(F.max("v").alias("group"))
    own = joined_by_load(counted, loads, ["load"], small=loads.count() <= SHIPPED_LOADS)
    column = F.coalesce(*[F.when(F.col("c") == i, F.lit(c)) for c, i in code.items()])
    rows = own.select(F.col("load").alias("_load"), F.col("c").alias("_c"), F.col("v").alias("_v"), F.col("n").alias("_n"), F.col("group").alias("_group"), column.alias("_column"))
    rows = rows.where(F.col("_c").isin(*[code[c.name] for c in checks]))
    # the checked columns under their own names, each with a value in its own rows only
    for c in names:
        rows = rows.withColumn(c, F.when(F.col("_c") == code[c], F.col("_v")).cast(kinds[c]) if c != group else F.when(F.col("_c") == code[c], F.col("_v")).otherwise(F.col("_group")).cast(kinds[c]))
    ill = F.coalesce(*[F.when(F.col("_c") == code[c.name], c.ill) for c in checks if c.ill is not None], F.lit(False))
    return rows.select(F.col("_load").alias("load"), F.col("_group").alias("group"), F.col("_column").alias("column_name"), F.col("_v").alias("value"), ill.alias("ill"), F.col("_n").alias("n"))


def joined_by_load(rows: DataFrame, per_load: DataFrame, keys: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """`rows` with what `per_load` has for each load (or load and column), null keys being equal; broadcast only where the caller counted it."""
    other = per_load.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(F.broadcast(other) if small else other, same, how).drop(*[f"_k_{k}" for k in keys])


def _bin(v: Column) -> Column:
    """A number's bin, growing with it: some sixteen for each factor of e, so that the middle of a load is sought in one or two of them."""
    return (F.signum(v) * F.floor(16 * F.log1p(F.abs(v)))).cast("int")


def medians(numbers: DataFrame, small: bool = False) -> DataFrame:
    """(load, column_name, median), exact, of (load, column_name, x, n).

    The bins are summed first; then only the values of the bins that hold the
    one or two middle numbers are shuffled and put in order.
    """
    from pyspark.sql.window import Window

    keys = ["load", "column_name"]
    binned = numbers.where("x IS NOT NULL").withColumn("b", _bin(F.col("x")))
    bins = binned.groupBy(*keys, "b").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("b"))  # some hundred bins a load
    total = F.sum("n").over(Window.partitionBy(*keys))
    told = bins.select(*keys, "b", (upto - F.col("n")).alias("below"), upto.alias("upto"), F.floor((total - 1) / 2).alias("r1"), F.floor(total / 2).alias("r2"))
    middle = told.where("(r1 >= below AND r1 < upto) OR (r2 >= below AND r2 < upto)").drop("upto")
    own = joined_by_load(binned, middle, [*keys, "b"], "inner", small).groupBy(*keys, "b", "x", "below", "r1", "r2").agg(F.sum("n").alias("n"))
    last = F.col("below") + F.sum("n").over(Window.partitionBy(*keys, "b").orderBy("x"))
    placed = own.withColumn("last", last)
    hits = lambda r: F.when((F.col(r) < F.col("last")) & (F.col(r) >= F.col("last") - F.col("n")), F.col("x"))
    return placed.groupBy(*keys).agg(((F.max(hits("r1")) + F.max(hits("r2"))) / 2).alias("median"))


def profile(table: DataFrame, checks: tuple[ColumnCheck, ...], load: str = "load_id", group: str = "geography") -> tuple[DataFrame, DataFrame]:
    """(profile per load and column, value counts it was made from).

    Profile: n_rows, n_null, n_missing (nulls, blanks and markers), n_distinct,
    n_ill, lo, hi, top_value with top_n, and the exact median of numeric columns.
    Ties of the top value go to the smallest value.
    """
    counts = value_counts(table, checks, load, group)
    numeric = F.col("column_name").isin(*[c.name for c in checks if c.numeric])
    missing = F.when(numeric, F.col("value").isNull()).otherwise(is_missing(F.col("value")))
    number = F.when(numeric, F.col("value").try_cast("double"))
    marked = counts.withColumn("_missing", missing).withColumn("_number", number)
    shape = marked.groupBy("load", "column_name").agg(
        F.max("group").alias("group"),
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(F.col("_missing"), F.col("n")).otherwise(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),  # a value has one row
        F.sum(F.when(F.col("ill") & ~F.col("_missing"), F.col("n")).otherwise(0)).alias("n_ill"),
        F.coalesce(F.min("_number").cast("string"), F.min(F.when(~numeric, F.col("value")))).alias("lo"),
        F.coalesce(F.max("_number").cast("string"), F.max(F.when(~numeric, F.col("value")))).alias("hi"),
        F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value"))).alias("_top"),
    )
    shape = cut(shape.withColumn("top_value", F.col("_top.value")).withColumn("top_n", -F.col("_top.n")).drop("_top"))
    small = shape.count() <= SHIPPED_LOADS
    middle = medians(marked.where(numeric).select("load", "column_name", F.col("_number").alias("x"), "n"), small)
    return joined_by_load(shape, middle, ["load", "column_name"], small=small), counts


def standing_out(prof: DataFrame, counts: DataFrame, share: float = 0.15, factor: float = 5.0) -> DataFrame:
    """Columns of loads that differ from the median load of the same group.

    By at least `share` of the load's rows in missing or ill values or in the
    share of one value, or by `factor` in the median. A value's usual share
    counts loads without it as 0.
    """
    own = cut(prof.withColumn("g", F.coalesce("group", F.lit(""))))
    small = own.count() <= SHIPPED_LOADS
    p = own.withColumn("_m", F.col("n_missing") / F.col("n_rows")).withColumn("_i", F.col("n_ill") / F.col("n_rows"))
    usual = p.groupBy("g", "column_name").agg(F.percentile("_m", 0.5).alias("um"), F.percentile("_i", 0.5).alias("ui"), F.percentile("median", 0.5).alias("uc"))
    p = p.join(usual, ["g", "column_name"])
    shapes = p.select(
        "load",
        "column_name",
        F.array_compact(
            F.array(
                F.when(F.col("_m") - F.col("um") >= share, "missing values"),
                F.when(F.col("_i") - F.col("ui") >= share, "ill-formed values"),
                F.when((F.col("median") >= factor * F.col("uc")) | (F.col("median") * factor <= F.col("uc")), "typical size"),
            )
        ).alias("reasons"),
    )
    loads = own.select("load", "column_name", "g", "n_rows")
    v = joined_by_load(counts.where("value IS NOT NULL").select("load", "column_name", "value", "n"), loads, ["load", "column_name"], "inner", small).withColumn("s", F.col("n") / F.col("n_rows"))
    often = v.where(F.col("s") >= share).select("g", "column_name", "value").distinct()  # at most 1/share values a load
    own = joined_by_load(v.select("g", "load", "column_name", "value", "s"), often, ["g", "column_name", "value"], "left_semi", small)
    full = often.join(loads, ["g", "column_name"]).drop("n_rows").join(own.drop("g"), ["load", "column_name", "value"], "left").fillna(0.0, ["s"])
    mid = full.groupBy("g", "column_name", "value").agg(F.percentile("s", 0.5).alias("us"))
    single = (
        full.join(mid, ["g", "column_name", "value"])
        .where(F.abs(F.col("s") - F.col("us")) >= share)
        .select("load", "column_name", F.array(F.concat(F.lit("share of "), F.col("value"))).alias("reasons"))
    )
    return shapes.unionByName(single).where(F.size("reasons") > 0).groupBy("load", "column_name").agg(F.array_sort(F.flatten(F.collect_set("reasons"))).alias("reasons"))


_SNAKE = "^[a-z]+(_[a-z]+)*$"


def cell_checks() -> tuple[ColumnCheck, ...]:
    """The three checked columns of the population cells."""
    area = F.when(F.col("geography") == "GB", F.col("postcode_district").rlike("^[A-Z]{1,2}$")).otherwise(F.col("postcode_district").rlike("^[0-9]{5}$"))
    return (
        ColumnCheck("occupation", ~F.col("occupation").rlike(_SNAKE)),
        ColumnCheck("count", F.col("count") <= 0, numeric=True),
        ColumnCheck("postcode_district", ~area),
    )


def all_cell_checks() -> tuple[ColumnCheck, ...]:
    """Every descriptive column of the population cells."""
    decade = "^(0-9|[1-9]0-[1-9]9)$"
    plain = [ColumnCheck(c, ~F.col(c).rlike(_SNAKE)) for c in ("gender", "ethnicity", "marital_status", "nationality")]
    return (*cell_checks(), ColumnCheck("age_range", ~F.col("age_range").rlike(decade)), *plain, ColumnCheck("geography", ~F.col("geography").isin("US", "GB")))


def keyed_extrema(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Nulls and extrema of fixed-width columns of the whole table from footers alone, without reading any data."""
    chunks = footers(spark.read.parquet(path), columns)  # no dictionaries, no data
    number = lambda c: F.col(c).try_cast("bigint")
    return chunks.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("n_null"), F.min(number("lo")).alias("lo"), F.max(number("hi")).alias("hi"))
