import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilgauge.functions import similarity as S
from veilgauge.operators import anonymise, attributes, benchmark, build, population, score
from veilgauge.plans import reports
from veilgauge.schema import Settings
from veilgauge.sources import tables


def scored(spark, texts, geo="US"):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: r for r in score.score(df, population.sample(spark), "id", settings=Settings(geo)).collect()}


def test_documented_examples(spark):
    got = scored(spark, ["A 45 year old male engineer.", "A 45 year old male teacher.", "She is 72 years old.", "A 72 year old.", None, ""])
    assert [(got[i]["population_coverage"], got[i]["population"], got[i]["rating"]) for i in range(6)] == [
        ("full", 12100, "LOW"), ("full", 1, "HIGH"), ("partial", 32549, "LOW"), ("none", 1_000_000, "LOW"), ("not_applicable", 1_000_000, "LOW"), ("not_applicable", 1_000_000, "LOW")
    ]
    assert got[1]["score"] == 0.85 and got[2]["unmatched_quasi_identifiers"] == ["age_range"]
    gb = scored(spark, ["The 34-year-old female marine biologist from SW1A 1AA has diabetes.", "Emma Doe, age 34, emma@post.example.org"], "UK")
    assert (gb[0]["score"], gb[0]["population"], gb[0]["rating"]) == (0.1705, 5, "MEDIUM")
    assert (gb[1]["score"], gb[1]["rating"], gb[1]["direct_identifiers_found"]) == (1.0, "CRITICAL", ["email", "full_name"])
    assert "Remove full names and replace with role-based placeholders." in gb[1]["recommendations"] and gb[1]["recommendations"][-1].startswith("Consider a second")


def test_sums_against_brute_force(spark):
    cells = population.sample(spark)
    filters = spark.createDataFrame([("US", "30-39", "female", None, "nurse", None, None, None), ("US", "40-49", "male", None, "teacher", None, None, None), ("GB", None, "female", None, None, None, None, None), ("GB",) + (None,) * 7], "geography string, age_range string, gender string, ethnicity string, occupation string, postcode_district string, marital_status string, nationality string")
    total = lambda df: {tuple(r)[:-1]: r["total"] for r in df.select("geography", *population.COLUMNS, "total").collect()}
    a = total(population.sums_by_masks(filters, cells))
    every = [r.asDict() for r in cells.collect()]
    brute = {tuple(f): sum(c["count"] for c in every if c["geography"] == f["geography"] and all(f[k] is None or c[k] == f[k] for k in population.COLUMNS)) for f in filters.collect()}
    assert a == brute and sorted(a.values()) == [0, 12925, 15800, 19545]
    assert min(r["total"] for r in population.query_counts(filters, cells).collect()) == 1


def test_population_checks(spark):
    with pytest.raises(ValueError, match="lacks"):
        population.checked(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError, match="no rows"):
        population.checked(population.sample(spark), "FR")
    with pytest.raises(ValueError):
        population.sample_for(spark, "FR")


def test_class_sizes(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", None), (4, "b", "x")], "i int, p string, class string")
    assert {r["i"]: r["class_size"] for r in population.class_sizes(df, ["p", "class"]).collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    assert {r["class_size"] for r in population.class_sizes(df, []).collect()} == {4}


def test_summary_gate_and_compare(spark):
    df = spark.createDataFrame([(1, "before", 0.85, "HIGH", ["a"]), (1, "after", 0.1, "MEDIUM", ["b"])], "pair_id int, side string, score double, rating string, recommendations array<string>")
    assert score.summarize(df).first().asDict() == {"mean_score": 0.475, "max_score": 0.85, "high_risk_count": 1, "total": 2}
    assert score.summarize(df.limit(0)).first().asDict() == {"mean_score": 0.0, "max_score": 0.0, "high_risk_count": 0, "total": 0}
    assert score.above(df, 0.8) and not score.above(df, 0.9)
    with pytest.raises(ValueError):
        score.above(df, 1.0)
    r = score.compare(df).first()
    assert (r["risk_reduction"], r["remaining_risks"]) == (0.75, ["b"])


def test_ratings_and_flags(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,), (0.3,), (0.9,)], "s double")
    assert [r["r"] for r in df.select(score.rating(F.col("s")).alias("r")).collect()] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


@pytest.mark.parametrize(
    "raw, n",
    [
        ('{"attributes": [{"attribute": "email", "inferred_value": "a@b.example", "confidence": "0.9"}]}', 1), ('[{"attribute": "gender", "inferred_value": "F", "confidence": 2}]', 1), ("```json\n[{\"attribute\": \"email\", \"inferred_value\": \"x\"}]\n```", 1),
        ('I [REDACTED] found {"attributes": [{"attribute": "email", "inferred_value": "x"}]} so', 1), ('[{"attribute": "shoe_size", "inferred_value": "9"}]', 0), ("no list", None), ("", None), (None, None), ('{"other": 1}', None),
    ],
)
def test_provider_output(spark, raw, n):
    df = spark.createDataFrame([(raw,)], "raw string")
    got = df.withColumn("items", attributes.parse_any(F.col("raw"))).select(attributes.deduplicated(attributes.cleaned(F.col("items"))).alias("a")).first()["a"]
    assert (None if got is None else len(got)) == n


def test_native_parse_and_deduplication(spark):
    items = [{"attribute": "gender", "inferred_value": v, "confidence": c, "evidence": e} for v, c, e in (("unknown", "1.0", "z"), ("man", "0.4", "b"), ("F", "0.4", "a"), ("boy", "0.3", ""))]
    df = spark.createDataFrame([(json.dumps(items),), (json.dumps({"attributes": items}),)], "raw string")
    for r in df.select(attributes.deduplicated(attributes.cleaned(attributes.parse_json(F.col("raw")))).alias("a")).collect():
        assert [(x["value"], x["confidence"]) for x in r["a"]] == [("female", 0.4)]
    conf = spark.createDataFrame([("0.5",), ("2",), ("-1",), ("1d",), (None,), ("nan",)], "c string").select(attributes.confidence(F.col("c")).alias("c")).collect()
    assert [r["c"] for r in conf] == [0.5, 1.0, 0.0, 0.0, 0.0, 1.0]


def jaro(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, seen = max(len(a), len(b)) // 2 - 1, [], []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if j not in used and b[j] == ch:
                used.append(j)
                seen.append(ch)
                break
    if not used:
        return 0.0
    t = sum(x != b[j] for x, j in zip(seen, sorted(used))) // 2
    return (len(used) / len(a) + len(used) / len(b) + (len(used) - t) / len(used)) / 3


def test_similarity_against_brute_force(spark):
    import random

    r = random.Random(1)
    words = ["", "a", "martha", "marhta", "dixon", "dicksonx", "josé", "éa"] + ["".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(60)]
    pairs = [(a, b) for a in words[:20] for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", S.jaro(F.col("a"), F.col("b")).alias("j"), S.jaro_winkler(F.col("a"), F.col("b")).alias("w")).collect():
        j = jaro(x["a"], x["b"])
        k = next((i for i, (p, q) in enumerate(zip(x["a"][:4], x["b"][:4])) if p != q), min(4, len(x["a"]), len(x["b"])))
        assert x["j"] == pytest.approx(j) and x["w"] == pytest.approx(j + k * 0.1 * (1 - j))


def bleu(ref, cand):
    a, b = ref.split(), cand.split()
    if not a or not b:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        x, y = Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1)), Counter(tuple(b[i : i + n]) for i in range(len(b) - n + 1))
        logs += math.log((sum(min(c, x[g]) for g, c in y.items()) + 1) / (max(1, sum(y.values())) + 1)) / 4
    return (1.0 if len(b) > len(a) else math.exp(1 - len(a) / len(b))) * math.exp(logs)


def test_bleu_against_brute_force(spark):
    texts = ["", "a", "the cat sat on the mat", "the the the cat", "a b c d e f g h a b", "the cat sat on a mat today"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", S.bleu(F.col("a"), F.col("b")).alias("v")).collect():
        assert r["v"] == pytest.approx(bleu(r["a"], r["b"])), (r["a"], r["b"])


def test_correct_guesses(spark):
    df = spark.createDataFrame([("ssn", "123-45-6789", "123456789"), ("occupation", "Engineer", "engineers"), ("occupation", "", "x"), ("gender", "Male", "Female"), ("date_of_birth", "May 29, 1994", "September 29, 1994"), ("name", "Bo", None)], "a string, t string, g string")
    assert [r["c"] for r in df.select(S.is_correct_guess(F.col("a"), F.col("t"), F.col("g")).alias("c")).collect()] == [True, True, False, False, True, False]


def test_survey_build(spark):
    rows = [("1", "100", "34", "2", "1", "1", "01", "1"), ("1", "50.5", "34.0", "02", "1", "1", "1", "1"), ("1", "x", "abc", "1", "", "2", "01", "5"), ("1", "5", "abc", "1", "1", "2", "01", "5"), ("1", "0.2", "", "9", "5", "", "01", "5"), ("1", "2.5", "7", "1", "5", "9", "24", "5")]
    df = spark.createDataFrame(rows, "SERIALNO string, PWGTP string, AGEP string, SEX string, MAR string, RAC1P string, HISP string, CIT string")
    cells, s = build.build(df, build.SURVEY, "us")
    assert (s.input_rows, s.rows_used, s.skipped_invalid_age, s.skipped_invalid_weight, s.zero_count_cells, s.values_not_in_map) == (6, 4, 1, 1, 1, {"gender": 1})
    got = {(r["age_range"], r["gender"], r["ethnicity"]): r["count"] for r in cells.collect()}
    assert got == {("30-39", "female", "white"): 150, ("0-9", "male", "hispanic"): 2} and s.total_population == 152
    with pytest.raises(ValueError, match="missing"):
        build.prepared(df.drop("SEX"), build.SURVEY)
    with pytest.raises(ValueError, match="no population rows"):
        build.build(df.where("AGEP = 'abc'"), build.SURVEY, "us")


def test_build_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([("nurse", "2.4"), ("Nurse", "2.4"), ("  ", "1")], "job string, w string")
    recipe = build.Recipe().merged({"occupation": "job"}, weight="w")
    path = str(tmp_path / "pop")
    build.build(df, recipe, "GB", path)
    back = tables.population_parquet(spark, f"{path}/cells", "GB")
    assert {r["occupation"]: r["count"] for r in back.collect()} == {"nurse": 5, "unknown": 1}
    with pytest.raises(Exception):
        build.build(df, recipe, "GB", path)
    build.build(df, recipe, "GB", path, overwrite=True)
    assert tables.metadata(spark.read.parquet(f"{path}/metadata")).first()["metadata"]["input_rows"] == "3"


def test_redaction_and_guesses(spark):
    text = "Ann Lee (415) 555-0101, ann@post.example.org, 123-45-6789, 4111 1111 1111 1111, José Pérez 42"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(anonymise.redact_patterns(F.col("t")).alias("a"), anonymise.redact_capitalised(F.col("t")).alias("b"), anonymise.guess(F.col("t"), F.lit("email")).alias("e"), anonymise.guess(F.col("t"), F.lit("name")).alias("n"), anonymise.guess(F.col("t"), F.lit("shoe")).alias("s")).first()
    assert "555" not in r["a"] and "@" not in r["a"] and "123-45" not in r["a"] and "1111 1111" not in r["a"]
    assert "José" not in r["b"] and "42" not in r["b"] and (r["e"], r["n"], r["s"]) == ("ann@post.example.org", "Ann Lee", "unknown")
    assert anonymise.get("presidio_like").name == "Regex redactor"
    with pytest.raises(ValueError):
        anonymise.get("nope")


def people(spark):
    states = ["California"] * 5 + ["Texas"] * 4 + ["Ohio"] * 3
    rows = [(i, s, "Male" if i % 2 else "Female", f"May {i + 1}, 1980", "White", "Married", "Doctorate", "Employed", "Mechanical engineers", "Born in the U.S.") for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"{c} string" for c in benchmark.INDIRECT))


def test_benchmark_entries(spark):
    p = benchmark.get_profile("paper", n_records=12)
    a, b = benchmark.entries(people(spark), p).collect(), benchmark.entries(people(spark).repartition(7), p).collect()
    key = lambda rows: {r["entry_id"]: (r["targets"], r["text"]) for r in rows}
    assert key(a) == key(b) and len(a) == 12
    for r in a:
        assert r["text"].startswith("[START OF TRANSCRIPT]\n") and len(r["targets"]) == (5 if r["difficulty"] == "implicit" else 6)
    with pytest.raises(ValueError):
        benchmark.get_profile("other")


def test_records_are_drawn_by_class(spark):
    """Where people are rare enough each of them is as likely; where nobody is, each class is; more entries than people may be drawn."""
    blank = {a: "x" for a in benchmark.INDIRECT}
    rows = [(i, {**blank, "occupation": f"rare{i}"}) for i in range(20)] + [(i, {**blank, "occupation": "common"}) for i in range(20, 60)]
    frame = lambda rows: spark.createDataFrame([(i, *[r[a] for a in benchmark.INDIRECT]) for i, r in rows], f"row_id bigint, {', '.join(a + ' string' for a in benchmark.INDIRECT)}")
    n = 3000
    p = benchmark.get_profile("paper", n_records=n)
    wanted = spark.range(n).select(F.col("id").alias("entry"), F.array(F.lit("occupation")).alias("indirect"))
    drawn = lambda rows: Counter(r["row_id"] for r in benchmark.chosen_records(frame(rows), wanted, p).collect())
    got = drawn(rows)
    assert sum(got.values()) == n and set(got) <= set(range(20)) and all(90 < got[i] < 220 for i in range(20))
    # classes of 10 and 30 people: as likely as each other, and their people as likely as each other
    got = drawn([(i, {**blank, "occupation": "few" if i < 10 else "many"}) for i in range(40)])
    few = sum(got[i] for i in range(10))
    assert sum(got.values()) == n and 1380 < few < 1620 and all(got[i] > 90 for i in range(10)) and all(got[i] > 20 for i in range(10, 40))
    assert benchmark.chosen_records(frame(rows).limit(0), wanted, p).count() == 0


def test_risk_is_strict_and_uses_true_values(spark):
    hits = spark.createDataFrame([(1, "x", "t", "state_of_residence", "California", "California", True), (1, "x", "t", "gender", "Male", "unknown", False), (2, "x", "t", "email", "a@b", "a@b", True), (3, "x", "t", "race", "White", "unknown", False)], "entry int, anonymiser string, anonymised string, attribute string, truth string, guess string, hit boolean")
    at = lambda theta: {r["entry"]: (r["risk"], r["success"]) for r in benchmark.risks(hits, people(spark), theta).collect()}
    assert at(0.2)[1] == (0.2, False) and at(0.199999)[1] == (0.2, True) and at(0.2)[2] == (1.0, True) and at(0.2)[3] == (round(1 / 12, 6), False)


def test_evaluation(spark):
    p = benchmark.get_profile("production", n_records=8, seed=3)
    summary, recall = benchmark.evaluated(benchmark.entries(people(spark), p), people(spark))
    by = {r["anonymiser"]: r for r in summary.collect()}
    assert by["No anonymization"]["avg_bleu"] == 1.0 and by["Regex redactor"]["mean_risk"] <= by["No anonymization"]["mean_risk"]
    assert all(0 <= r["recall"] <= 1 for r in recall.collect())


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.85, "HIGH", 1, ["email"], ["a </script>", "b", "c", "d"])], "idx int, score double, rating string, population bigint, direct_identifiers_found array<string>, recommendations array<string>")
    summary = score.summarize(df).first().asDict()
    assert json.loads(reports.generate(df, summary, "gdpr", "json"))["summary"]["total"] == 1
    page = reports.generate(df, summary, "hipaa", "html", str(tmp_path / "r.html"))
    assert "</script>" not in page.split("<script")[1].split(">", 1)[1].removesuffix("</script></body></html>")
    pdf = reports.pdf_report("x\n" * 120 + "naïve 漢 (a)")
    assert pdf.startswith(b"%PDF-1.4") and pdf.count(b"/Type /Page ") == 3 and pdf.rstrip().endswith(b"%%EOF")
    with pytest.raises(ValueError):
        reports.generate(df, summary, "gdpr", "doc")


def test_sources(spark, tmp_path):
    good, bad = tmp_path / "a.txt", tmp_path / "b.txt"
    good.write_text("naïve", encoding="utf-8")
    bad.write_bytes(b"\xff\xfe\xff")
    assert tables.text_files(spark, [str(good)]).first()["text"] == "naïve"
    with pytest.raises(ValueError):
        tables.text_files(spark, [str(bad)])
    (tmp_path / "p.csv").write_text("﻿a,b\n01,2\n", encoding="utf-8")
    assert tables.person_csv(spark, str(tmp_path / "p.csv"), ["a"]).first().asDict() == {"a": "01", "b": "2"}
    with pytest.raises(ValueError):
        tables.person_csv(spark, str(tmp_path / "p.csv"), ["z"])
    assert tables.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first()["json"] == '{"a":1,"b":null}'
    with pytest.raises(ValueError, match="blank"):
        tables.benchmark_records(spark, [dict.fromkeys(benchmark.INDIRECT, " ")])


def test_sqlite_population(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "p.sqlite")
    with sqlite3.connect(path) as conn:
        conn.execute("CREATE TABLE cross_tab (geography TEXT, age_range TEXT, gender TEXT, ethnicity TEXT, occupation TEXT, postcode_district TEXT, marital_status TEXT, nationality TEXT, count INTEGER)")
        conn.execute("INSERT INTO cross_tab VALUES ('GB', '30-39', 'female', NULL, 'nurse', 'SW', 'single', 'british', 7)")
    assert tables.population_sqlite(spark, path, "uk").first()["count"] == 7
    with pytest.raises(ValueError):
        tables.population_sqlite(spark, str(tmp_path / "none.sqlite"))


def test_streaming(spark, tmp_path):
    from veilgauge.streaming import score_stream

    spark.createDataFrame([(1, "mail a@b.example", "2024-01-01 10:00:00"), (2, "nothing", "2024-01-01 10:30:00")], "id int, text string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string, t timestamp").parquet(str(tmp_path / "in"))
    q = score_stream.rating_counts(stream, "t").writeStream.outputMode("complete").format("memory").queryName("ratings").start()
    q.processAllAvailable()
    q.stop()
    assert {r["rating"]: r["n"] for r in spark.table("ratings").collect()} == {"CRITICAL": 1, "LOW": 1}
    q = score_stream.score_batches(stream.select("id", "text"), population.sample_for(spark, "US"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
