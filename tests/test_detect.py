import pytest
from pyspark.sql import functions as F

from veilgauge.functions import normalise as N
from veilgauge.operators import detect as D
from veilgauge.operators.names import GIVEN_NAMES, given_names_of, name_column


def run(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", column(F.col("t")).alias("v")).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize(
    "column, text, expected",
    [
        (D.email, "mail kim.lee+x@post.example.org now", "kim.lee+x@post.example.org"), (D.email, "no address @ all", None), (D.email, None, None), (D.email, "", None),
        (D.phone, "ring 415-555-0101 today", "415-555-0101"), (D.phone, "ring 07911 123456", "07911 123456"), (D.phone, "ring 020 7946 0958", "020 7946 0958"), (D.phone, "room 12", None),
        (D.personal_number, "SSN 123-45-6789", "123-45-6789"), (D.personal_number, "NI ab 12 34 56 c", "ab 12 34 56 c"), (D.personal_number, "FD 12 34 56 C", None),
        (D.address, "at 42 Elm Street today", "42 Elm Street"), (D.address, "1600 Pennsylvania Avenue NW", "1600 Pennsylvania Avenue NW"), (D.address, "to P.O. Box 44", "P.O. Box 44"), (D.address, "Ward 7 Consultant Dr Patel", None), (D.address, "7 days on the road", None),
        (lambda t: D.birth_date(t)["date"], "She was born on 3 March 1980.", "3 March 1980"), (lambda t: D.birth_date(t)["date"], "DOB: 03/04/1981", "03/04/1981"), (lambda t: D.birth_date(t)["date"], "born in London. Seen 3 March 1980", None),
        (lambda t: D.age_range(t)["range"], "aged 34", "30-39"), (lambda t: D.age_range(t)["range"], "a 45-year-old", "40-49"), (lambda t: D.age_range(t)["range"], "aged 07", None), (lambda t: D.age_range(t)["range"], "30 years", None),
        (lambda t: D.gender(F.lower(t)), "and she left", "female"), (lambda t: D.gender(F.lower(t)), "a male nurse", "male"), (lambda t: D.gender(F.lower(t)), "Then she, too", None),
        (lambda t: D.occupation(F.lower(t)), "two teachers", "teacher"), (lambda t: D.occupation(F.lower(t)), "a nursery", None), (lambda t: D.occupation(F.lower(t)), "a marine biologist", "marine biologist"),
        (lambda t: D.employer(t)["name"], "she works at Acme & Co daily", "Acme & Co daily"), (lambda t: D.marital_status(F.lower(t)), "was married, now divorced", "divorced"), (lambda t: D.marital_status(F.lower(t)), "never married", "single"), (lambda t: D.marital_status(F.lower(t)), "a single bed is", "single"),
        (lambda t: D.postcode(t)["district"], "from SW1A 1AA", "SW"), (lambda t: D.postcode(t)["district"], "Boise, ID 83702", "83702"), (lambda t: D.postcode(t)["district"], "Patient ID 12345", None), (lambda t: D.postcode(t)["district"], "zip code: 94105-1234", "94105"), (lambda t: D.postcode(t)["district"], "M25 2nd exit", None),
        (lambda t: D.condition(F.lower(t)), "has Asthma", "asthma"), (lambda t: D.condition(F.lower(t)), "her sign is cancer", None),
        (lambda t: D.GROUPS[0].found(t)["value"], "a Black woman came", "black"), (lambda t: D.GROUPS[0].found(t)["value"], "a black car", None), (lambda t: D.GROUPS[0].found(t)["value"], "of Indian descent", "asian"), (lambda t: D.GROUPS[0].found(t)["value"], "identifies as Latina", "hispanic"),
        (lambda t: D.GROUPS[1].found(t)["value"], "He is a practising Catholic.", "christian"), (lambda t: D.GROUPS[1].found(t)["value"], "the school is Catholic", None), (lambda t: D.GROUPS[1].found(t)["value"], "is Jewish-owned", None),
        (lambda t: D.GROUPS[2].found(t)["value"], "came out as gay", "gay"), (lambda t: D.GROUPS[2].found(t)["value"], "straight ahead", None),
    ],
)
def test_detectors(spark, column, text, expected):
    assert run(spark, column, [text]) == [expected]


NAMES = [
    # honorifics (N2), runs (N7) and trimming (N8)
    ("Seen by Dr. José Pérez today", "José Pérez", 0.9), ("Dr Smith Monday", "Smith", 0.9), ("St Dr Smith", None, None), ("Mrs SMITH left", "SMITH", 0.9), ("Mr J. R. Stone", "J. R. Stone", 0.9), ("Dr Smith. Jones came", "Smith", 0.9),
    ("Prof Anna Stone Ohio", "Anna Stone", 0.9), ("Mr Stone New York", "Stone", 0.9), ("Mr Xxxx", None, None), ("Dr Acme Labs", None, None), ("Mr Abel Bond Carr Dent Eden", "Abel Bond Carr Dent", 0.9), ("Mr Stone's car", "Stone", 0.9), ("Mr de la", None, None), ("Dr A.", None, None),
    # labels (N3)
    ("Name: Ludwig van Beethoven", "Ludwig van Beethoven", 0.9), ("my name is Zed Quill", "Zed Quill", 0.9), ("the patient's name was Zed Quill", "Zed Quill", 0.9), ("brand name: Zed Quill", None, None), ("Surname = QUILL", "QUILL", 0.9), ("file name - Quill", None, None),
    # patient and client (N4, N9)
    ("Patient Mary Jones came", "Mary Jones", 0.9), ("the Patient Zed Quill", None, None), ("Well. Patient Zed Quill", "Zed Quill", 0.9), ("Patient ZED QUILL", None, None), ("Patient MARY QUILL", "MARY QUILL", 0.9), ("the Patient Safety Board", None, None), ("a client, Zed Quill", "Zed Quill", 0.9),
    # named and called (N5)
    ("a man named Zed Stone", "Zed Stone", 0.9), ("a boat named Zed Stone", None, None), ("a boat called Mary Stone", "Mary Stone", 0.9), ("a patient named ZED STONE", None, None),
    # known given names (N6, N10)
    ("Then Emma O'Brien said", "Emma O'Brien", 0.8), ("St John Ambulance", None, None), ("St. John Stone", None, None), ("Mary Hospital opened", None, None), ("EMMA STONE left", "EMMA STONE", 0.8), ("Mary-Jane Quill", "Mary-Jane Quill", 0.8), ("to James Ward", None, None), ("James Ward", "James Ward", 0.8), ("x.Emma Stone", None, None), ("Emma B.", None, None),
    # selection (N11) and addresses (N1)
    ("Emma Stone met Dr Quill", "Quill", 0.9), ("Emma Stone met Paul Quill", "Emma Stone", 0.8), ("at 42 Emma Stone Street", None, None), ("PO Box 12 Emma Stone", "Emma Stone", 0.8),
    ("", None, None), (None, None, None), ("a quiet day", None, None), ("mr smith", None, None), ("Mr", None, None),
]


def test_names(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(NAMES)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", name_column(F.col("t")).alias("n")).collect()}
    for i, (t, name, confidence) in enumerate(NAMES):
        assert (got[i] and (got[i]["value"], got[i]["confidence"])) == (name and (name, confidence)), t
    assert got[0]["evidence"] == "Dr. José Pérez" and got[14]["evidence"] == "Name: Ludwig van Beethoven"


def test_given_names_are_a_parameter(spark):
    df = spark.createDataFrame([("Zed Quill came",)], "t string")
    value = lambda **k: df.select(name_column(F.col("t"), **k)["value"].alias("v")).first()["v"]
    assert value() is None and value(given=["Zed"]) == "Zed Quill" and value(given=[]) is None
    full = spark.createDataFrame([("Zed Quill",), ("Dr Zed Stone",), ("Quill, Zed",), ("Ada Lee",), (None,), ("",)], "full string")
    assert [tuple(r) for r in given_names_of(full, "full").collect()] == [("Zed", 3)]
    assert "Mary" in GIVEN_NAMES and "Virginia" not in GIVEN_NAMES


def test_name_column_and_whole_array(spark):
    df = spark.createDataFrame([(1, "Emma Stone, aged 34, emma@post.example.org", "clash"), (2, None, "x"), (3, "nothing", "x")], "i int, t string, attributes string")
    named = df.withColumn("n", name_column(F.col("t")))
    got = {r["i"]: r["a"] for r in named.select("i", D.attributes(F.col("t"), F.when(F.col("n.value").isNotNull(), F.col("n"))).alias("a")).collect()}
    assert [x["attribute"] for x in got[1]] == ["email", "full_name", "age_range"] and got[2] is None
    assert [(x["attribute"], x["value"], x["confidence"]) for x in got[3]] == [("age_range", "unknown", 0.0)]


def test_very_long_text(spark):
    assert run(spark, D.email, ["word " * 300_000 + "a@b.example"]) == ["a@b.example"]


def test_prompt_text_and_tokens(spark):
    assert run(spark, D.prompt_text, ["Do it.\nText: \n hi Text: there ", "plain"]) == ["hi Text: there", "plain"]
    assert run(spark, lambda t: D.token_estimate(t, 0), ["", "x" * 40]) == [1, 10]


@pytest.mark.parametrize(
    "value, expected",
    [
        (None, "unknown"), ("", "unknown"), (" N/A ", "unknown"), ("not mentioned in the text", "unknown"), ("[REDACTED]", "unknown"), ("<PERSON>", "unknown"), ("{{EMAIL}}", "unknown"), ("XXX", "unknown"), ("***", "unknown"), ("###-##-####", "unknown"), ("XXX-XX-1234", "XXX-XX-1234"),
        ("not married", "not married"), ("redacted name", "unknown"), ("x", "x"), (" kept ", "kept"),
    ],
)
def test_clean_value(spark, value, expected):
    assert run(spark, N.clean_value, [value]) == [expected]


@pytest.mark.parametrize(
    "attribute, value, expected",
    [
        ("age_range", "34", "30-39"), ("age_range", "mid-thirties", "30-39"), ("age_range", "30s", "30-39"), ("age_range", "35-45", "unknown"), ("age_range", "30-39", "30-39"), ("age_range", "middle-aged", "middle-aged"), ("age_range", "about 34 years old", "30-39"),
        ("gender", "Woman", "female"), ("gender", "other", "other"), ("nationality", "U.S. citizen", "american"), ("nationality", "the United Kingdom", "british"), ("nationality", "Martian", "martian"), ("marital_status", "Widower", "widowed"), ("ethnicity", "African-American", "black"),
        ("occupation", "Registered Nurse", "nurse"), ("occupation", "Marine Biologist (senior)", "marine_biologist"), ("postcode_district", "SW1A 1AA", "SW"), ("postcode_district", "94105-1234", "94105"), ("postcode_district", "SW", "SW"), ("employer", "Acme", "Acme"), ("gender", "unknown", "unknown"),
    ],
)
def test_normalised_and_idempotent(spark, attribute, value, expected):
    own = lambda t: N.quasi_value(F.lit(attribute), t)
    assert run(spark, own, [value, expected]) == [expected, expected]
