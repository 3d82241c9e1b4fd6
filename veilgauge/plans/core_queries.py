"""Registered queries of the risk engine over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.functions import normalise, similarity
from veilgauge.functions import vocabulary as V
from veilgauge.functions.text import lookup
from veilgauge.operators import anonymise, attributes, benchmark, build, detect, population, rejects, score
from veilgauge.plans import reports
from veilgauge.session import cut, spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Texts beside the documents for detectors that seldom find anything there, each with wordings that count and that don't.
CASES = (
    (-1, "She was born on 3 March 1980 in Leeds."), (-2, "DOB: 03/04/1981"), (-3, "d.o.b. 1975-12-01, seen today"), (-4, "Born in London. Seen 3 March 1980"), (-5, "date of birth is July 4th, 1990"), (-6, "His birthday; 4 July 1990"), (-7, "b. 12.11.1969"), (-8, "reborn 3 March 1980"),
    (-11, "He works at Acme & Co daily"), (-12, "employed by Northern Rail, he said"), (-13, "an employee at the mill"), (-14, "works in a mill"), (-15, "EMPLOYED BY B-Line 4 Kids"),
    (-21, "from SW1A 1AA"), (-22, "Boise, ID 83702"), (-23, "Patient ID 12345"), (-24, "zip code: 94105-1234"), (-25, "M25 2nd exit"), (-26, "moved to New York 10001"), (-27, "Austin TX 78701 and M1 1AE"), (-28, "postal code is 606011"), (-29, "sw1a 1aa"), (-30, "EC1A 1BB, then W1A 0AX"),
)


def _docs_and_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).unionByName(spark.createDataFrame(list(CASES), "doc_id bigint, text string"))


def _detected(column, texts=_docs):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = texts(spark, sf_dir).select("doc_id", F.explode(F.array(column(F.col("text")))).alias("value"))
        return found.where("value IS NOT NULL")

    return query


detect_email = _detected(detect.email)
detect_phone_nanp = _detected(lambda t: detect.first_match(t, V.PHONE_NANP))
detect_phone = _detected(detect.phone)
detect_personal_number = _detected(detect.personal_number)
detect_ssn = _detected(lambda t: detect.first_match(t, V.SSN))
detect_address = _detected(detect.address)
detect_birth_date = _detected(lambda t: detect.birth_date(t)["date"], _docs_and_cases)
detect_age = _detected(lambda t: detect.age_range(t)["range"])
detect_gender = _detected(lambda t: detect.gender(F.lower(t)))
detect_occupation = _detected(lambda t: detect.occupation(F.lower(t)))
detect_employer = _detected(lambda t: detect.employer(t)["name"], _docs_and_cases)
detect_marital_status = _detected(lambda t: detect.marital_status(F.lower(t)))
detect_postcode = _detected(lambda t: detect.postcode(t)["district"], _docs_and_cases)
detect_condition = _detected(lambda t: detect.condition(F.lower(t)))
detect_ethnicity = _detected(lambda t: detect.GROUPS[0].found(t)["value"])
detect_religion = _detected(lambda t: detect.GROUPS[1].found(t)["value"])
detect_orientation = _detected(lambda t: detect.GROUPS[2].found(t)["value"])


def detect_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilgauge.operators.names import name_column

    return _docs(spark, sf_dir).select("doc_id", name_column(F.col("text")).alias("n")).where("n.value IS NOT NULL").select("doc_id", F.col("n.value").alias("value"), F.col("n.confidence").alias("confidence"))


def attributes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute of every document, names included."""
    return score.infer(_docs(spark, sf_dir)).select("doc_id", F.explode("attributes").alias("a")).select("doc_id", "a.*")


def _leaks(text: Column) -> dict[str, Column]:
    return {"email": detect.email(text), "phone": detect.first_match(text, V.PHONE_NANP), "ssn_or_nin": detect.first_match(text, V.SSN)}


def direct_leak_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether an email address, a phone or a social security number gives somebody away."""
    flags = F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(k)) for k, v in _leaks(F.col("text")).items()]))
    told = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(flags)).alias("found"))
    exact = F.when(F.size("found") > 0, 1.0).otherwise(0.0)
    return told.select("doc_id", F.array_join("found", ",").alias("identifiers"), exact.alias("score"), score.rating(exact).alias("rating"))


def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direct_leak_rating(spark, sf_dir).groupBy("rating").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("score").alias("mean_score"))


def redact_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", anonymise.redact_patterns(F.col("text")).alias("redacted"))


def redact_capitalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", anonymise.redact_capitalised(F.col("text")).alias("redacted"))


def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scored-text vectors through the whole pipeline, each against all delivered population cells of its geography."""
    texts = table(spark, sf_dir, "known_high_risk").select("text_id", "text", "geography").unionByName(table(spark, sf_dir, "known_low_risk").select("text_id", "text", "geography"))
    out = score.score(texts, _cells(spark, sf_dir), "text_id", geo_col="geography")
    return out.select("text_id", "score", "rating", "population", "population_coverage", F.array_join("direct_identifiers_found", ",").alias("direct"), F.array_join("unmatched_quasi_identifiers", ",").alias("unmatched"), F.size("recommendations").alias("n_recommendations"))


def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.summarize(table(spark, sf_dir, "score_results"))


def fail_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results that make a run with --fail-above 0.3 fail."""
    return score.over(table(spark, sf_dir, "score_results"), 0.3).select("result_id", "score")


def score_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "score_results").select("result_id", score.rating(F.col("score")).alias("rating"))


def compare_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct-identifier scores of each vector before and after pattern redaction."""
    texts = table(spark, sf_dir, "known_high_risk").select("text_id", "text")
    sides = F.array(F.struct(F.lit("before").alias("side"), F.col("text").alias("t")), F.struct(F.lit("after").alias("side"), anonymise.redact_patterns(F.col("text")).alias("t")))
    both = texts.select("text_id", F.explode(sides).alias("s")).select("text_id", "s.side", "s.t")
    leak = F.coalesce(*_leaks(F.col("t")).values()).isNotNull()
    scored = both.select("text_id", "side", F.when(leak, 1.0).otherwise(0.0).alias("score"), F.array().cast("array<string>").alias("recommendations"))
    return score.compare(scored, pair="text_id").select("text_id", "original_score", "anonymized_score", "risk_reduction")


def normalise_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value of the attribute table, cleaned and normalised."""
    a = table(spark, sf_dir, "inferred_attributes")
    cleaned = normalise.clean_value(F.col("inferred_value"))
    return a.select("attr_id", "attribute", F.when(F.col("category").isNotNull() & (F.lower("category") == "quasi"), normalise.quasi_value(F.col("attribute"), cleaned)).otherwise(cleaned).alias("value"))


def occupation_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalise.occupation(F.col("p_name")).alias("label"))


def nationality_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", normalise.nationality(F.col("n_name")).alias("nationality"))


def age_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalise.age_range(F.col("p_size").cast("string")).alias("age_range"))


def clean_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalise.clean_value(F.col("source")).alias("source"))


def dedupe_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per result and attribute."""
    a = table(spark, sf_dir, "inferred_attributes").select("result_id", "attribute", F.coalesce("inferred_value", F.lit(V.UNKNOWN)).alias("value"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"), F.coalesce("evidence", F.lit("")).alias("evidence"))
    return attributes.best_per_attribute(a, "result_id").select("result_id", "attribute", "value", "confidence")


def parse_json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute table written as provider output per result, and read back natively."""
    a = table(spark, sf_dir, "inferred_attributes")
    item = F.struct("attribute", "inferred_value", F.col("confidence").cast("string").alias("confidence"), "evidence", "category")
    raw = a.groupBy("result_id").agg(F.to_json(F.struct(F.collect_list(item).alias("attributes"))).alias("raw"))  # a result has at most some twenty attributes
    kept = attributes.deduplicated(attributes.cleaned(attributes.parse_json(F.col("raw"))))
    return raw.select("result_id", F.explode(F.array(kept)).alias("k")).select("result_id", F.size("k").alias("n_attributes"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = rejects.PERSON_SPEC
    return rejects.split_rows(rejects.parse_lines(table(spark, sf_dir, "population_pums_synthetic"), spec), spec)[0]


def build_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population cells from the delivered person rows."""
    return build.cells(_people(spark, sf_dir), build.SURVEY, "US")


def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = build.prepared(_people(spark, sf_dir), build.SURVEY)
    return people.agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("_bad").isNull()).alias("rows_used"), F.round(F.sum(F.when(F.col("_bad").isNull(), F.col("_weight"))), 3).alias("weight"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.checked(table(spark, sf_dir, "cross_tab")).where("count > 0")


def population_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result's quasi-identifiers matched to all delivered population cells of its geography."""
    r = table(spark, sf_dir, "score_results").select("result_id", population.geography(F.col("geography")).alias("geography"))
    a = table(spark, sf_dir, "inferred_attributes").where("category IS NOT NULL AND lower(category) = 'quasi'").select("result_id", "attribute", F.col("inferred_value").alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit("").alias("evidence"))
    asked = attributes.best_per_attribute(a, "result_id").join(r, "result_id").select(F.col("result_id").alias("filter_id"), "geography", "attribute", "value")
    out = population.matched(asked, _cells(spark, sf_dir))
    return out.select(F.col("filter_id").alias("result_id"), "population", F.array_join("matched", ",").alias("matched"), F.array_join("unmatched", ",").alias("unmatched"))


def known_population_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.known_values(_cells(spark, sf_dir)).groupBy("geography", "attribute").agg(F.count(F.lit(1)).alias("n_values"))


def _bench_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = rejects.RecordSpec(rejects.BENCHMARK_SPEC.columns, rejects.BENCHMARK_SPEC.rules, {c: F.trim for c in rejects.BENCHMARK_SPEC.columns})
    rows = rejects.split_rows(rejects.parse_lines(table(spark, sf_dir, "rat_bench_pums_sample"), spec), spec)[0]
    return rows.withColumnRenamed("line_id", "row_id")


_QI = ["state_of_residence", "gender", "race", "marital_status", "occupation"]


def k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class size and correctness of every benchmark person over five attributes."""
    sized = population.class_sizes(_bench_people(spark, sf_dir), _QI)
    return sized.select("row_id", "class_size", F.round(1.0 / F.col("class_size"), 6).alias("kappa"))


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k_anonymity(spark, sf_dir).groupBy("class_size").agg(F.count(F.lit(1)).alias("n_rows"))


def small_class_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k_anonymity(spark, sf_dir).select("row_id", (F.col("class_size") <= V.SMALL_GROUP).alias("small"))


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaro similarity of each entry's name to its own alternative labels."""
    pairs = table(spark, sf_dir, "canonical_values").select("ref_id", "canonical_value", F.explode("alt_labels").alias("label")).where("label IS NOT NULL")
    return pairs.select("ref_id", "label", F.round(similarity.jaro(F.col("canonical_value"), F.lower("label")), 6).alias("jaro"))


def correct_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed occupations that count as a right guess, with the entry they are nearest to by Jaro-Winkler (of equally near ones the first).

    Every different value is compared with every entry of the reference list, which is fixed.
    """
    typed = table(spark, sf_dir, "inferred_attributes").where("attribute = 'occupation' AND inferred_value IS NOT NULL").select(F.lower("inferred_value").alias("value")).distinct()
    entries = table(spark, sf_dir, "canonical_values").where("attribute = 'occupation'").select("ref_id", F.translate("canonical_value", "_", " ").alias("entry"))
    kind = F.lit("occupation")
    near = spread(typed).crossJoin(F.broadcast(entries)).where(similarity.is_correct_guess(kind, F.col("entry"), F.col("value")))
    close = similarity.jaro_winkler(similarity.comparable(kind, F.col("entry")), similarity.comparable(kind, F.col("value")))
    return near.groupBy("value").agg(F.max_by("ref_id", F.struct(close, -F.col("ref_id"))).alias("ref_id"))


def bleu_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of every vector text against its redacted form."""
    texts = table(spark, sf_dir, "known_high_risk").select("text_id", "text")
    return texts.select("text_id", F.round(similarity.bleu(F.col("text"), anonymise.redact_patterns(F.col("text"))), 6).alias("bleu"))


def bleu_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of every document against its redacted form."""
    return _docs(spark, sf_dir).select("doc_id", F.round(similarity.bleu(F.col("text"), anonymise.redact_patterns(F.col("text"))), 6).alias("bleu"))


def benchmark_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = benchmark.entries(cut(_bench_people(spark, sf_dir)), benchmark.get_profile("paper"))
    return made.select("entry_id", "scenario", "difficulty", F.array_join("targets", ",").alias("targets"), "text")


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cut(_bench_people(spark, sf_dir))
    made = cut(benchmark.entries(people, benchmark.get_profile("paper")))
    return benchmark.evaluated(made, people)[0]


def benchmark_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cut(_bench_people(spark, sf_dir))
    made = cut(benchmark.entries(people, benchmark.get_profile("paper")))
    return benchmark.evaluated(made, people)[1]


def direct_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented identifiers of every customer."""
    made = benchmark.direct_identifiers(F.col("c_custkey"), F.lit("male"), F.col("c_mktsegment"), F.lit("California"))
    return table(spark, sf_dir, "customer").select("c_custkey", *[made[k].alias(k) for k in ("ssn", "credit_card", "phone_number", "address")])


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of a report of every result, with the tips for its direct identifiers."""
    r = table(spark, sf_dir, "score_results").withColumn("direct_identifiers_found", F.coalesce("direct_identifiers_found", F.array().cast("array<string>")))
    tips = F.array_compact(F.transform("direct_identifiers_found", lambda x: lookup(V.DIRECT_TIPS, x)))
    full = r.select("result_id", "score", F.coalesce("rating", F.lit("none")).alias("rating"), F.coalesce("population_match_estimate", F.lit(V.NO_POPULATION)).alias("population"), "direct_identifiers_found", tips.alias("recommendations"))
    return full.select("result_id", reports.record_lines(F.col("result_id")).alias("line"))


def recommendation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tip is due over the delivered attributes and scores."""
    a = table(spark, sf_dir, "inferred_attributes").select("result_id", "attribute", F.coalesce("inferred_value", F.lit(V.UNKNOWN)).alias("value"))
    per = a.groupBy("result_id").agg(F.array_sort(F.collect_set(F.struct("attribute", "value"))).alias("attributes"))  # some twenty per result
    tips = per.join(table(spark, sf_dir, "score_results").select("result_id", "score"), "result_id").select(F.explode(score.recommendations(F.col("attributes"), F.col("score"))).alias("tip"))
    return tips.groupBy("tip").agg(F.count(F.lit(1)).alias("n"))


_NAMES = (
    "detect_email detect_phone_nanp detect_phone detect_personal_number detect_ssn detect_address detect_birth_date detect_age detect_gender detect_occupation detect_employer detect_marital_status detect_postcode "
    "detect_condition detect_ethnicity detect_religion detect_orientation detect_name attributes_long direct_leak_rating rating_histogram redact_regex redact_capitalised score_texts risk_summary fail_above score_ratings "
    "compare_before_after normalise_values occupation_snake nationality_words age_bucket clean_sources dedupe_attributes parse_json_items build_cross_tab build_counters population_match known_population_values k_anonymity "
    "class_histogram small_class_flag similarity_pairs correct_guesses bleu_redacted bleu_documents benchmark_entries benchmark_summary benchmark_recall direct_identifiers report_lines recommendation_counts"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ---- SQL ---------------------------------------------------------------------------------------------------------
from veilgauge.plans import data_queries as D  # noqa: E402


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _first(pattern: str, group: int = 0, text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, {group}), '')"


def _found(expression: str) -> str:
    return f"SELECT doc_id, value FROM (SELECT doc_id, {expression} AS value FROM documents) WHERE value IS NOT NULL"


_LOW, _PAD = "lower(text)", "(' ' || lower(text) || ' ')"
_EMAIL, _NANP, _SSN = _first(V.EMAIL), _first(V.PHONE_NANP), _first(V.SSN)
_GENDER = f"CASE WHEN regexp_matches({_LOW}, '\\bfemale\\b') OR contains({_PAD}, ' she ') OR contains({_PAD}, ' her ') THEN 'female' WHEN regexp_matches({_LOW}, '\\bmale\\b') OR contains({_PAD}, ' he ') OR contains({_PAD}, ' his ') THEN 'male' END"
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches({_LOW}, '\\b{r}s?\\b') THEN '{r}'" for r in V.ROLES) + " END"
_MARITAL = (
    f"CASE WHEN contains({_LOW}, 'widowed') THEN 'widowed' WHEN contains({_LOW}, 'divorced') THEN 'divorced' WHEN contains({_LOW}, 'separated') THEN 'separated' "
    f"WHEN regexp_matches({_LOW}, '\\b(?:never|not) married\\b|\\bunmarried\\b') THEN 'single' WHEN regexp_matches({_LOW}, '\\bmarried\\b') THEN 'married' WHEN contains({_PAD}, ' single ') THEN 'single' END"
)
_PLAIN = f"regexp_replace({_LOW}, {_q(V.ZODIAC)}, ' ', 'g')"
_CONDITION = "CASE " + " ".join(f"WHEN regexp_matches({_PLAIN}, '\\b{c}s?\\b') THEN '{c}'" for c in V.CONDITIONS) + " END"
_AGE_E = _first(V.AGE)
_AGE = f"CASE WHEN age BETWEEN 10 AND 100 THEN CAST(age // 10 * 10 AS VARCHAR) || '-' || CAST(age // 10 * 10 + 9 AS VARCHAR) END"
_REDACT = "text"
for _p in (V.EMAIL, V.PHONE_NANP, V.SSN, V.CARD):
    _REDACT = f"regexp_replace({_REDACT}, {_q(_p)}, 'XXX', 'g')"
_RATING = "CASE WHEN score < 0.1 THEN 'LOW' WHEN score < 0.3 THEN 'MEDIUM' WHEN score < 0.9 THEN 'HIGH' ELSE 'CRITICAL' END"
_LEAK = f"SELECT doc_id, concat_ws(',', CASE WHEN {_EMAIL} IS NOT NULL THEN 'email' END, CASE WHEN {_NANP} IS NOT NULL THEN 'phone' END, CASE WHEN {_SSN} IS NOT NULL THEN 'ssn_or_nin' END) AS identifiers FROM documents"
_LEAK = f"SELECT doc_id, identifiers, score, {_RATING} AS rating FROM (SELECT *, CASE WHEN identifiers <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM ({_LEAK}))"
_KNOWN = "known(geography, attribute, value) AS (" + " UNION ".join(f"SELECT geography, '{c}', lower({c}) FROM cells WHERE {c} IS NOT NULL" for c in V.POPULATION_COLUMNS) + ")"
_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id, attribute ORDER BY value IS NULL OR value = 'unknown', confidence DESC, value NULLS LAST, evidence) AS rn FROM quasi) WHERE rn = 1)"
_MATCH = f"""
WITH cells AS (SELECT geography, {', '.join(V.POPULATION_COLUMNS)}, "count" AS n FROM cross_tab WHERE "count" > 0), {_KNOWN},
quasi AS (SELECT result_id, attribute, inferred_value AS value, coalesce(confidence, 0) AS confidence, '' AS evidence FROM inferred_attributes WHERE lower(category) = 'quasi'), {_BEST},
asked AS (SELECT b.result_id, CASE WHEN upper(trim(r.geography)) = 'UK' THEN 'GB' ELSE upper(trim(r.geography)) END AS geography, b.attribute, lower(regexp_replace(b.value, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS value FROM best b JOIN score_results r USING (result_id)),
told AS (SELECT a.*, k.value IS NOT NULL AS used FROM asked a LEFT JOIN known k ON k.geography = a.geography AND k.attribute = a.attribute AND k.value = a.value WHERE a.value IS NOT NULL AND a.value NOT IN ('', 'unknown')),
wide AS (SELECT result_id, geography, {', '.join(f"max(CASE WHEN used AND attribute = '{c}' THEN value END) AS {c}" for c in V.POPULATION_COLUMNS)}, coalesce(string_agg(CASE WHEN used THEN attribute END, ',' ORDER BY attribute), '') AS matched, coalesce(string_agg(CASE WHEN NOT used THEN attribute END, ',' ORDER BY attribute), '') AS unmatched FROM told GROUP BY result_id, geography),
combos AS (SELECT DISTINCT geography, {', '.join(V.POPULATION_COLUMNS)} FROM wide),
sums AS (SELECT {', '.join(f'f.{c}' for c in ('geography', *V.POPULATION_COLUMNS))}, coalesce(sum(c.n), 0) AS total FROM combos f LEFT JOIN cells c ON c.geography = f.geography AND {' AND '.join(f'(f.{c} IS NULL OR lower(c.{c}) = f.{c})' for c in V.POPULATION_COLUMNS)} GROUP BY ALL)
SELECT w.result_id, CASE WHEN w.matched <> '' THEN CAST(greatest(1, s.total) AS BIGINT) END AS population, w.matched, w.unmatched FROM wide w LEFT JOIN sums s ON w.geography IS NOT DISTINCT FROM s.geography AND {' AND '.join(f'w.{c} IS NOT DISTINCT FROM s.{c}' for c in V.POPULATION_COLUMNS)}"""
_ETH = "CASE WHEN trim(RAC1P) = '' OR trim(HISP) = '' THEN 'unknown' WHEN CAST(HISP AS INT) <> 1 THEN 'hispanic' ELSE CASE CAST(RAC1P AS INT) WHEN 1 THEN 'white' WHEN 2 THEN 'black' WHEN 6 THEN 'asian' WHEN 9 THEN 'mixed' ELSE 'other' END END"
_CODED = lambda c, m: f"CASE WHEN trim({c}) = '' THEN 'unknown' ELSE CASE CAST({c} AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in m.items()) + f" ELSE lower(trim({c})) END END"
_PEOPLE = f"(SELECT * REPLACE ({D._AGE} AS AGEP, {D._WEIGHT} AS PWGTP) FROM {D._P} WHERE {D._P_OK})"
_CELLS = f"""SELECT 'US' AS geography, age_range, gender, ethnicity, 'unknown' AS occupation, 'unknown' AS postcode_district, marital_status, nationality, CAST(round_even(sum(PWGTP), 0) AS BIGINT) AS "count" FROM (
SELECT PWGTP, CAST(CAST(floor(AGEP / 10) AS INT) * 10 AS VARCHAR) || '-' || CAST(CAST(floor(AGEP / 10) AS INT) * 10 + 9 AS VARCHAR) AS age_range, {_CODED('SEX', build.SURVEY.value_maps['gender'])} AS gender, {_ETH} AS ethnicity, {_CODED('MAR', build.SURVEY.value_maps['marital_status'])} AS marital_status, {_CODED('CIT', build.SURVEY.value_maps['nationality'])} AS nationality FROM {_PEOPLE})
GROUP BY ALL HAVING round_even(sum(PWGTP), 0) > 0"""
_K = f"SELECT line_id AS row_id, count(*) OVER (PARTITION BY {', '.join(f'trim({c})' for c in _QI)}) AS class_size FROM {D._B} WHERE {D._B_OK}"

SQL = {
    "detect_email": _found(_EMAIL),
    "detect_phone_nanp": _found(_NANP),
    "detect_ssn": _found(_SSN),
    "detect_age": f"SELECT doc_id, {_AGE} AS value FROM (SELECT doc_id, TRY_CAST(coalesce({_first(V.AGE, 1, 'e')}, {_first(V.AGE, 2, 'e')}) AS INT) AS age FROM (SELECT doc_id, {_AGE_E} AS e FROM documents)) WHERE age BETWEEN 10 AND 100",
    "detect_gender": _found(_GENDER),
    "detect_occupation": _found(_ROLE),
    "detect_marital_status": _found(_MARITAL),
    "detect_condition": _found(_CONDITION),
    "direct_leak_rating": _LEAK,
    "rating_histogram": f"SELECT rating, count(*) AS n_docs, avg(score) AS mean_score FROM ({_LEAK}) GROUP BY rating",
    "redact_regex": f"SELECT doc_id, {_REDACT} AS redacted FROM documents",
    "risk_summary": "SELECT round(avg(score), 4) AS mean_score, round(max(score), 4) AS max_score, count(*) FILTER (rating IN ('HIGH', 'CRITICAL')) AS high_risk_count, count(*) AS total FROM score_results",
    "fail_above": "SELECT result_id, score FROM score_results WHERE score > 0.3",
    "score_ratings": f"SELECT result_id, {_RATING} AS rating FROM score_results",
    "occupation_snake": "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '^(?:a|an|the)\\s+', ''), '[\\W_]+', '_', 'g'), '_') AS label FROM part",
    "nationality_words": "SELECT n_nationkey, coalesce(CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.NATIONALITY_WORDS.items()) + " END, lower(trim(n_name))) AS nationality FROM (SELECT n_nationkey, n_name, regexp_replace(regexp_replace(lower(n_name), '[\\s_-]+', ' ', 'g'), '^(?:a|an|the)\\s+', '') AS k FROM nation)",
    "age_bucket": "SELECT p_partkey, CAST(p_size // 10 * 10 AS VARCHAR) || '-' || CAST(p_size // 10 * 10 + 9 AS VARCHAR) AS age_range FROM part",
    "dedupe_attributes": "SELECT result_id, attribute, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY result_id, attribute ORDER BY value = 'unknown', confidence DESC, value, evidence) AS rn FROM (SELECT result_id, attribute, coalesce(inferred_value, 'unknown') AS value, least(1.0, greatest(0.0, coalesce(confidence, 0.0))) AS confidence, coalesce(evidence, '') AS evidence FROM inferred_attributes)) WHERE rn = 1",
    "parse_json_items": "SELECT result_id, count(DISTINCT attribute) AS n_attributes FROM inferred_attributes GROUP BY result_id",
    "build_cross_tab": _CELLS,
    "build_counters": f"SELECT count(*) AS input_rows, count(*) AS rows_used, round(sum(PWGTP), 3) AS weight FROM {_PEOPLE}",
    "population_match": _MATCH,
    "known_population_values": f"WITH cells AS (SELECT * FROM cross_tab WHERE \"count\" > 0), {_KNOWN} SELECT geography, attribute, count(*) AS n_values FROM known GROUP BY ALL",
    "k_anonymity": f"SELECT row_id, class_size, round(1.0 / class_size, 6) AS kappa FROM ({_K})",
    "class_histogram": f"SELECT class_size, count(*) AS n_rows FROM ({_K}) GROUP BY class_size",
    "small_class_flag": f"SELECT row_id, class_size <= {V.SMALL_GROUP} AS small FROM ({_K})",
    "direct_identifiers": "SELECT c_custkey, printf('%03d-%02d-%04d', 200 + c_custkey % 700, 10 + c_custkey % 90, 1000 + c_custkey * 17 % 9000) AS ssn, substr('4' || lpad(CAST(c_custkey + 12345678901234 AS VARCHAR), 15, '0'), 1, 16) AS credit_card, '(415) ' || CAST(200 + c_custkey % 700 AS VARCHAR) || '-' || CAST(1000 + c_custkey % 9000 AS VARCHAR) AS phone_number, CAST(100 + c_custkey AS VARCHAR) || ' Market Street, California' AS address FROM customer",
}

_NIN = _first(V.NIN)
_EMPLOYER = _first(V.EMPLOYER, 1)
_TIPS = {**V.DIRECT_TIPS, **V.QUASI_TIPS, **V.CONTEXTUAL_TIPS}
SQL |= {
    "detect_personal_number": _found(f"coalesce({_SSN}, {_NIN})"),
    "recommendation_counts": f"""
WITH a AS (SELECT DISTINCT result_id, attribute FROM inferred_attributes WHERE lower(coalesce(inferred_value, 'unknown')) <> 'unknown'),
t AS (SELECT CASE attribute {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TIPS.items())} END AS tip FROM a JOIN score_results USING (result_id) WHERE score >= 0.3 OR attribute NOT IN ({', '.join(f"'{k}'" for k in V.CONTEXTUAL_TIPS)})
UNION ALL SELECT '{V.SECOND_PASS_TIP}' FROM (SELECT DISTINCT result_id FROM inferred_attributes) JOIN score_results USING (result_id) WHERE score >= 0.7)
SELECT tip, count(*) AS n FROM t WHERE tip IS NOT NULL GROUP BY tip""",
}

_CASES = ", ".join(f"({i}, {_q(t)})" for i, t in CASES)
_BOTH = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_CASES}) AS c(doc_id, text))"


def _found_in_both(expression: str) -> str:
    return f"SELECT doc_id, value FROM (SELECT doc_id, {expression} AS value FROM {_BOTH}) WHERE value IS NOT NULL"


# RE2 has no look-around: what must not stand beside a match is taken along and left out of the group
_UK_PHONE = _first(f"(?:^|[^0-9])({V.PHONE_UK.removeprefix('(?<!' + chr(92) + 'd)').removesuffix('(?!' + chr(92) + 'd)')})(?:[^0-9]|$)", 1)
_ZIP_STATE = _first(detect.ZIP_STATE.removesuffix(r"(?!\d)") + "(?:[^0-9]|$)", 1)
_ZIP_LABEL = _first(V.ZIP_LABEL.removesuffix(r"(?!\d)") + "(?:[^0-9]|$)", 1)
_PLAIN_DATE = V.DATE.removesuffix(r"(?!\d))")
_CUE = r"(?:(?i:\b(?:born|d\.?\s?o\.?\s?b|date\s+of\s+birth|birth\s*date|birthday))(?:\.|[^A-Za-z;!?\n.]|\b)|(?:^|[^\w.])b\.\s)"
_BIRTH = _first(rf"(?s){_CUE}(?:[^;!?\n.]|\.[^\s;!?\n]){{0,29}}?({_PLAIN_DATE}))(?:[^0-9]|$)", 1)
_STRIPPED = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_ENDS = _q(V.SURROUNDING)


def _cleaned(c: str) -> str:
    """`clean_value` as SQL."""
    t = _STRIPPED(c)
    core = f"trim({t}, {_ENDS})"
    key = f"trim(regexp_replace(lower({core}), '[\\s_-]+', ' ', 'g'))"
    marks = ", ".join(_q(m) for m in V.PLACEHOLDERS)
    masked = f"(regexp_matches({t}, '\\A[xX*#•\\s\\-./()]+\\z') AND NOT regexp_matches({t}, '(?:^|[^xX])[xX](?:[^xX]|$)') AND regexp_matches({t}, '[xX*#•]'))"
    bracketed = f"regexp_matches({core}, '\\A(?:\\[+[^\\[\\]]*\\]+|<+[^<>]*>+|\\{{+[^{{}}]*\\}}+)\\z')"
    return f"CASE WHEN {c} IS NULL OR {key} IN ({marks}) OR regexp_matches({key}, {_q(V.NOT_GIVEN)}) OR regexp_matches({key}, '^redacted( |$)|(^| )redacted$') OR {bracketed} OR {masked} THEN 'unknown' ELSE {t} END"


def _words(words: dict[str, str], key: str, otherwise: str) -> str:
    return f"coalesce(CASE {key} {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in words.items())} END, {otherwise})"


_V = "v"
_LOWV = f"lower({_STRIPPED(_V)})"
_PHRASE = f"regexp_replace(trim(regexp_replace(regexp_replace(lower({_V}), '\\([^()]*\\)', ' ', 'g'), '[\\s_-]+', ' ', 'g'), {_ENDS}), '^(?:a|an|the)\\s+', '')"
_SNAKE = f"trim(regexp_replace({_PHRASE}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '_', 'g'), '_')"
_NATION = f"regexp_replace(replace({_PHRASE}, '.', ''), '\\s+(?:citizen|national)$', '')"
_AREA = f"CASE WHEN regexp_matches({_STRIPPED(_V)}, '^([A-Za-z]{{1,2}})\\d[A-Za-z\\d]?(?:\\s*\\d[A-Za-z]{{2}})?$') THEN regexp_extract({_STRIPPED(_V)}, '^([A-Za-z]{{1,2}})', 1) WHEN regexp_matches({_STRIPPED(_V)}, '^\\d{{5}}(?:-\\d{{4}})?$') THEN substr({_STRIPPED(_V)}, 1, 5) ELSE {_STRIPPED(_V)} END"
_AGE_WORDS = f"list_filter(string_split_regex({_STRIPPED(f'regexp_replace(regexp_replace(lower({_V}), {_q(r'\([^()]*\)')}, {_q(' ')}, {_q('g')}), {_q('[-–—,]')}, {_q(' ')}, {_q('g')})')}, '[\\s\\p{{Z}}]+'), lambda w: w <> '' AND w NOT IN ({', '.join(_q(w) for w in V.AGE_FILLER)}))"
_DECADE = (
    "CASE WHEN regexp_matches(w, '^~?\\d{1,3}(?:yo|y/o|yrs?|years?)?$') THEN (CASE WHEN CAST(regexp_extract(w, '(\\d{1,3})', 1) AS INT) <= 120 THEN CAST(regexp_extract(w, '(\\d{1,3})', 1) AS INT) // 10 END) "
    f"WHEN regexp_matches(w, '^[1-9]0''?s$') THEN CAST(substr(w, 1, 1) AS INT) ELSE CASE w {' '.join(f'WHEN {_q(k)} THEN {v}' for k, v in V.DECADE_WORDS.items())} END END"
)
_AGES = f"list_transform({_AGE_WORDS}, lambda w: {_DECADE})"
_AGE_VALUE = f"(SELECT CASE WHEN len(d) = 0 OR list_contains(list_transform(d, lambda x: x IS NULL), true) THEN {_V} WHEN len(list_distinct(d)) > 1 THEN 'unknown' ELSE CAST(d[1] * 10 AS VARCHAR) || '-' || CAST(d[1] * 10 + 9 AS VARCHAR) END FROM (SELECT {_AGES} AS d))"
_QUASI = (
    f"CASE WHEN v = 'unknown' THEN v ELSE coalesce(nullif(CASE attribute WHEN 'age_range' THEN {_AGE_VALUE} WHEN 'gender' THEN {_words(V.GENDER_WORDS, _PHRASE, _LOWV)} WHEN 'nationality' THEN {_words(V.NATIONALITY_WORDS, _NATION, _LOWV)} "
    f"WHEN 'marital_status' THEN {_words(V.MARITAL_WORDS, _PHRASE, _LOWV)} WHEN 'ethnicity' THEN {_words(V.ETHNICITY_WORDS, _PHRASE, _LOWV)} WHEN 'occupation' THEN {_words(V.OCCUPATION_WORDS, _SNAKE, _SNAKE)} WHEN 'postcode_district' THEN {_AREA} ELSE v END, ''), 'unknown') END"
)
# DuckDB's Jaro goes by bytes; the entries are ASCII, so any other character is one that equals none of theirs
_ASCII = lambda c: f"regexp_replace({c}, '[^\\x00-\\x7f]', chr(1), 'g')"
_SPACED = f"regexp_replace({_STRIPPED('lower(inferred_value)')}, '[\\s\\p{{Z}}]+', ' ', 'g')"
_TIP = "CASE x " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in V.DIRECT_TIPS.items()) + " END"
SQL |= {
    "detect_phone": _found(f"coalesce({_NANP}, {_UK_PHONE})"),
    "detect_employer": _found_in_both(f"trim({_EMPLOYER})"),
    "detect_postcode": _found_in_both(f"coalesce({_first(V.POSTCODE_UK, 1)}, {_ZIP_STATE}, {_ZIP_LABEL})"),
    "detect_birth_date": _found_in_both(_BIRTH),
    "clean_sources": f"SELECT doc_id, {_cleaned('source')} AS source FROM documents",
    "normalise_values": f"SELECT attr_id, attribute, CASE WHEN lower(category) = 'quasi' THEN {_QUASI} ELSE v END AS value FROM (SELECT attr_id, attribute, category, {_cleaned('inferred_value')} AS v FROM inferred_attributes)",
    "similarity_pairs": f"SELECT ref_id, label, round(jaro_similarity({_ASCII('canonical_value')}, {_ASCII('lower(label)')}), 6) AS jaro FROM (SELECT ref_id, canonical_value, unnest(alt_labels) AS label FROM canonical_values) WHERE label IS NOT NULL",
    "correct_guesses": f"""
WITH typed AS (SELECT DISTINCT lower(inferred_value) AS value, {_ASCII(_SPACED)} AS c FROM inferred_attributes WHERE attribute = 'occupation' AND inferred_value IS NOT NULL),
entries AS (SELECT ref_id, replace(canonical_value, '_', ' ') AS e FROM canonical_values WHERE attribute = 'occupation'),
pairs AS (SELECT value, ref_id, j + 0.1 * p * (1 - j) AS s FROM (SELECT value, ref_id, jaro_similarity(e, c) AS j, CASE WHEN substr(e, 1, 4) = substr(c, 1, 4) AND length(e) >= 4 AND length(c) >= 4 THEN 4 WHEN substr(e, 1, 3) = substr(c, 1, 3) AND length(e) >= 3 AND length(c) >= 3 THEN 3 WHEN substr(e, 1, 2) = substr(c, 1, 2) AND length(e) >= 2 AND length(c) >= 2 THEN 2 WHEN substr(e, 1, 1) = substr(c, 1, 1) AND length(c) >= 1 THEN 1 ELSE 0 END AS p FROM typed, entries))
SELECT value, arg_max(ref_id, (round(s, 12), -ref_id)) AS ref_id FROM pairs WHERE s >= {V.MATCH_THRESHOLD['occupation']} GROUP BY value""",
    "report_lines": f"""
SELECT result_id, printf('Record %d: score %.3f (%s), population %d, direct identifiers: ', result_id, CAST(round(CAST(score AS DECIMAL(12, 6)), 3) AS DOUBLE), coalesce(rating, 'none'), coalesce(population_match_estimate, {V.NO_POPULATION})) || coalesce(nullif(array_to_string(d, ', '), ''), 'none') || CASE WHEN len(tips) > 0 THEN chr(10) || array_to_string(list_transform(tips[1:3], lambda t: '  - ' || t), chr(10)) ELSE '' END AS line
FROM (SELECT *, list_filter(list_transform(d, lambda x: {_TIP}), lambda t: t IS NOT NULL) AS tips FROM (SELECT result_id, score, rating, population_match_estimate, coalesce(direct_identifiers_found, []) AS d FROM score_results))""",
}

_SPLIT = lambda c: f"list_filter(string_split_regex({_STRIPPED(c)}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"
_GRAMS = lambda side: f"SELECT doc_id, n, array_to_string({side}[i:i + n - 1], chr(31)) AS g, count(*) AS k FROM (SELECT doc_id, n, {side}, unnest(generate_series(1, len({side}) - n + 1)) AS i FROM t, n) GROUP BY ALL"
SQL["bleu_documents"] = f"""
WITH t AS (SELECT doc_id, text IS NULL AS none, {_SPLIT('text')} AS r, {_SPLIT('after')} AS c FROM (SELECT doc_id, text, {_REDACT} AS after FROM documents)),
n AS (SELECT unnest([1, 2, 3, 4]) AS n), rg AS ({_GRAMS('r')}), cg AS ({_GRAMS('c')}),
shared AS (SELECT doc_id, n, sum(least(rg.k, cg.k)) AS o FROM rg JOIN cg USING (doc_id, n, g) GROUP BY ALL),
logs AS (SELECT doc_id, sum(ln((coalesce(o, 0) + 1) / (greatest(1, len(c) - n + 1) + 1))) AS s FROM t CROSS JOIN n LEFT JOIN shared USING (doc_id, n) GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN none THEN NULL WHEN len(r) = 0 OR len(c) = 0 THEN 0 ELSE exp(CASE WHEN len(c) > len(r) THEN 0 ELSE 1 - len(r) / len(c) END + s / 4) END, 6) AS bleu FROM t JOIN logs USING (doc_id)"""
