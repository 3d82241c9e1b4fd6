import os
from collections import Counter, defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from veilgauge.operators import profile as P

SCHEMA = "cell_id bigint, load_id bigint, geography string, occupation string, postcode_district string, count bigint, extra string"


def rows(loads=6, n=60):
    out = []
    for load in range(1, loads + 1):
        for i in range(n):
            occupation, code, count = ["nurse", "teacher", "cook", None, "Bad Form", "unknown"][i % 6], ["SW", "E", "N", "LS"][i % 4], 100 + i
            if load == 2 and i % 2:
                occupation = "0110"
            if load == 3 and i % 3 == 0:
                code = None
            if load == 4:
                count *= 10
            if load == 5 and i % 4 == 0:
                count = 7
            out.append((load * 1000 + i, load, "GB", occupation, code, count, "x"))
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    spark.createDataFrame(rows(), SCHEMA).repartitionByRange(3, "load_id").write.mode("overwrite").parquet(path)
    return path


def test_counts_against_brute_force(spark, table):
    prof, _ = P.profile(spark.read.parquet(table), P.cell_checks())
    got = {(r["load"], r["column_name"]): r for r in prof.collect()}
    by = defaultdict(list)
    for r in rows():
        by[r[1]].append(r)
    for load, own in by.items():
        values = [r[3] for r in own]
        r = got[(load, "occupation")]
        assert (r["n_rows"], r["n_null"], r["n_distinct"]) == (len(own), values.count(None), len(set(values) - {None}))
        assert r["n_missing"] == values.count(None) + values.count("unknown")
        assert r["n_ill"] == values.count("Bad Form") + values.count("0110")
        assert r["top_n"] == max(Counter(v for v in values if v).values())
        assert got[(load, "count")]["median"] == median(x[5] for x in own)


def test_loads_that_stand_out(spark, table):
    found = P.standing_out(*P.profile(spark.read.parquet(table), P.cell_checks()))
    assert {(r["load"], r["column_name"]) for r in found.collect()} == {(2, "occupation"), (3, "postcode_district"), (4, "count"), (5, "count")}


def test_settled_chunks_are_never_read(spark, tmp_path):
    """The pages of settled chunks are overwritten with rubbish, and the counts still come out; other chunks of the file are read."""
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "constant")
    for load, value in ((1, "nurse"), (2, "cook"), (3, None)):
        spark.createDataFrame([(i, load, "GB", value, ["SW", "E"][i % 2], 5, "x") for i in range(50)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    checks = (P.ColumnCheck("occupation", F.col("occupation") == "cook"), P.ColumnCheck("postcode_district"))
    settled = {(r["load"], r["column_name"]): r["settled"] for r in P.chunk_plan(df, "load_id", ("occupation", "postcode_district", "geography")).collect()}
    assert settled == {(str(k), c): c != "postcode_district" for k in (1, 2, 3) for c in ("occupation", "postcode_district", "geography")}
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.read_metadata(f)
        raw = bytearray(open(f, "rb").read())
        for i in range(meta.num_columns):
            chunk = meta.row_group(0).column(i)
            if chunk.path_in_schema in ("occupation", "geography") and chunk.statistics.null_count < 50:
                end = (chunk.dictionary_page_offset or chunk.data_page_offset) + chunk.total_compressed_size
                raw[end - 2 : end] = b"\xff\xff"  # the end of the last data page
        open(f, "wb").write(raw)
        for crc in glob.glob(f"{path}/.*.crc"):
            os.remove(crc)
    with pytest.raises(Exception):  # noqa: B017, PT011
        df.select("occupation").collect()
    counts = [r for r in P.value_counts(df, checks).collect() if r["column_name"] == "occupation"]
    assert sorted((r["load"], r["group"], r["value"] or "", r["n"], r["ill"]) for r in counts) == [(1, "GB", "nurse", 50, False), (2, "GB", "cook", 50, True), (3, "GB", "", 50, False)]


def test_dictionaries_given_up_are_no_candidates(tmp_path):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(1)
    many = pa.table({"v": ["%030x" % r.getrandbits(120) for _ in range(60_000)], "w": ["a", "b", None] * 20_000, "x": [7] * 60_000})
    for codec in ("snappy", "zstd", "gzip", "none"):
        for version in ("1.0", "2.0"):
            f = str(tmp_path / f"{codec}{version}.parquet")
            pq.write_table(many, f, compression=codec, data_page_version=version, dictionary_pagesize_limit=100_000)
            meta = pq.read_metadata(f)
            with open(f, "rb") as source:
                v, w, x = (P._dictionary(source, meta.row_group(0).column(i)) for i in range(3))
            assert v is None and sorted(w) == ["a", "b"] and x == [7]


def test_footer_extrema_equal_the_data(spark, table):
    got = {r["column_name"]: (r["n_rows"], r["n_null"], r["lo"], r["hi"]) for r in P.keyed_extrema(spark, table, ("cell_id", "count")).collect()}
    own = rows()
    assert got == {"cell_id": (len(own), 0, 1000, 6059), "count": (len(own), 0, min(r[5] for r in own), max(r[5] for r in own))}


def test_dictionaries_list_distinct_candidates(spark, table):
    chunks = P.footers(spark.read.parquet(table), ("occupation",), ("occupation",)).collect()
    assert set().union(*[set(r["listed"]) for r in chunks if r["listed"] is not None]) == {"nurse", "teacher", "cook", "Bad Form", "unknown", "0110"}


def test_null_keys_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "odd")
    spark.createDataFrame([(1, None, None, "nurse", None, None, "x"), (2, 1, "GB", "nurse", "SW", 3, "x")], SCHEMA).write.parquet(path)
    prof, counts = P.profile(spark.read.parquet(path), P.cell_checks())
    assert prof.count() == 6 and P.standing_out(prof, counts).count() == 0
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    prof, counts = P.profile(spark.read.parquet(empty), P.cell_checks())
    assert prof.count() == 0 and P.standing_out(prof, counts).count() == 0
