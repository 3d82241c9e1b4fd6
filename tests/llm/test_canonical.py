import random

import duckdb
import pytest

from veilgauge.llm import canonical as C
from veilgauge.llm import wordings as W

ENTRIES = [(1, "occupation", "nurse", ["RN", "staff nurse"]), (2, "occupation", "police_officer", ["cop"]), (3, "occupation", "zookeeper", None), (4, "occupation", "accountant", ["bookkeeper"]), (5, "occupation", "warehouse_operative", None), (6, "nationality", "british", ["GB"]), (7, "nationality", "american", None), (8, "education_level", "doctorate", ["PhD", "D.Phil."]), (9, "occupation", "truck_driver", None), (10, "occupation", "chef", None)]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "ref_id bigint, attribute string, canonical_value string, alt_labels array<string>")


@pytest.mark.parametrize(
    "attribute, value, ref",
    [
        ("occupation", "Nurse ", 1), ("occupation", "rn", 1), ("occupation", "Senior nurse", 1), ("occupation", "ex-nurse", 1), ("occupation", "nurse (part-time)", 1), ("occupation", "nurse at a trust", 1), ("occupation", "nurse / full time", 1), ("occupation", "nusre", 1), ("occupation", "nurses", 1), ("occupation", "Nｕｒｓｅ", 1),
        ("occupation", "Nu​rse.", 1), ("occupation", "Pоlіce Officer", 2), ("occupation", "police_ofifcer", 2), ("occupation", "zookkeeper", 3), ("occupation", "Operative, warehouse", 5), ("occupation", "warehuose operatvie", 5), ("occupation", "trucker", 9), ("occupation", "Chéf", 10),
        ("occupation", "4010", 0), ("occupation", "dragon tamer", 0), ("occupation", "retired", 0), ("occupation", "british", 0), ("nationality", "Britsh", 6), ("nationality", "gb", 6), ("nationality", "martian", 0), ("education_level", "d.phil.", 8), ("education_level", "docotrate", 8),
    ],
)
def test_values(spark, entries, attribute, value, ref):
    got = C.mapped(spark.createDataFrame([(attribute, value), (attribute, value)], "attribute string, value string"), entries, W.table(spark)).collect()
    assert [(r["value"], r["ref_id"]) for r in got] == [(value, ref)]


def test_missing_values_are_no_values(spark, entries):
    rows = [("occupation", v) for v in (None, "", "  ", "N/A", "unknown", "not stated", "-", " ")]
    assert C.mapped(spark.createDataFrame(rows, "attribute string, value string"), entries).count() == 0


def test_pigeonhole_join_finds_all_that_brute_force_finds(spark, entries):
    r = random.Random(5)
    names = [(a, v.replace("_", " ")) for _, a, v, _ in ENTRIES]
    values = []
    for _ in range(400):
        a, v = r.choice(names)
        s = list(v)
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(s))
            s = {0: s[:k] + s[k + 1 :], 1: s[:k] + [r.choice("aeinst")] + s[k:], 2: s[:k] + [r.choice("aeinst")] + s[k + 1 :], 3: s[:k] + s[k + 1 : k + 2] + s[k : k + 1] + s[k + 2 :]}[r.randrange(4)] or ["x"]
        values.append((a, "".join(s)))
    inferred = spark.createDataFrame([(i, a, v) for i, (a, v) in enumerate(values)], "attr_id bigint, attribute string, inferred_value string")
    results = spark.createDataFrame([(1, ["occupation=Nusre", "employer", "nationality=gb", "gender=f"]), (2, None), (3, [])], "result_id bigint, unmatched_quasi_identifiers array<string>")
    cells = spark.createDataFrame([(1, "nurse"), (2, "Nurse"), (3, None), (4, "unknown"), (5, "4010")], "cell_id bigint, occupation string")
    got = {tuple(r) for r in C.mapped_rows(C.typed_values(inferred, results, cells, entries), entries, W.table(spark)).select("src_table", "row_id", "item_no", "ref_id").collect()}
    db = duckdb.connect()
    for name, df in (("inferred_attributes", inferred), ("score_results", results), ("cross_tab", cells), ("canonical_values", entries)):
        db.register(f"_{name}", df.toArrow())
        db.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    assert got == set(db.execute(C.duckdb_sql(W.SYNONYMS)).fetchall()) and {x for x in got if x[0] != "inferred_attributes"} == {("score_results", 1, 1, 1), ("score_results", 1, 3, 6), ("cross_tab", 2, 1, 1), ("cross_tab", 5, 1, 0)}


def test_empty_and_clashing_columns(spark, entries):
    empty = spark.createDataFrame([], "attribute string, value string, form string, rank int")
    assert C.mapped(empty, entries).count() == 0
    long = spark.createDataFrame([("occupation", "x" * 20_000)], "attribute string, value string")
    assert C.mapped(long, entries).first()["ref_id"] == 0


def test_wordings_of_any_length_keep_all_segments(spark):
    """A hundred and fifty characters with four slips, one in each of the first four segments."""
    words = "senior inspector of historic bridges and tunnels in the northern river districts with special duties for flood gates, locks and weirs of the old canals"
    entries = spark.createDataFrame([(1, "occupation", words, None)], "ref_id bigint, attribute string, canonical_value string, alt_labels array<string>")
    slips = list(words)
    for k in (5, 40, 70):
        slips[k] = "z"
    df = spark.createDataFrame([("occupation", "".join(slips)), ("occupation", "trucker")], "attribute string, value string")
    assert {r["value"][:3]: r["ref_id"] for r in C.mapped(df, entries).collect()} == {"sen": 1, "tru": 0}
