from veilgauge.plans import core_queries


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_guesses_are_compared_with_every_entry(spark, tmp_path):
    """Other first characters and white space are no hindrance, and the nearest entry is given, not the first."""
    entries = [(1, "occupation", "software_developers"), (2, "occupation", "software_developer"), (3, "occupation", "hairdresser"), (4, "occupation", "journalist"), (5, "nationality", "hairdresser")]
    values = [" Software  developer", "a hairdresser", "​journalist.", "software developer", "astronaut", None]
    folder = written(
        spark,
        tmp_path,
        inferred_attributes=([("occupation", v) for v in values], "attribute string, inferred_value string"),
        canonical_values=(entries, "ref_id bigint, attribute string, canonical_value string"),
    )
    got = {r["value"]: r["ref_id"] for r in core_queries.correct_guesses(spark, folder).collect()}
    assert got == {" software  developer": 2, "a hairdresser": 3, "​journalist.": 4, "software developer": 2}


def test_texts_are_scored_against_the_delivered_cells_of_their_geography(spark, tmp_path):
    text = "She is a married nurse."
    cell = lambda geo, job, n: (geo, "30-39", "female", "white", job, "unknown", "married", "unknown", n)
    cells = [cell("US", "nurse", 4), cell("GB", "nurse", 50), cell("GB", "nurse", 3), cell("GB", "baker", 9), cell("GB", "nurse", -7)]
    schema = "text_id bigint, text string, geography string"
    folder = written(
        spark,
        tmp_path,
        known_high_risk=([(1, text, "GB"), (2, text, " gb "), (3, text, "US"), (4, text, "uk")], schema),
        known_low_risk=([(5, text, None), (6, text, "us"), (7, None, "GB")], schema),
        cross_tab=(cells, "geography string, age_range string, gender string, ethnicity string, occupation string, postcode_district string, marital_status string, nationality string, count bigint"),
    )
    got = {r["text_id"]: r for r in core_queries.score_texts(spark, folder).collect()}
    assert [got[i]["population"] for i in (1, 2, 3, 4, 6)] == [53, 53, 4, 53, 4]
    assert got[5]["population_coverage"] == "none" and got[5]["unmatched"] == "gender,marital_status,occupation" and got[5]["score"] == 0
    assert got[7]["population_coverage"] == "not_applicable"


def test_labels_with_any_characters_are_compared(spark, tmp_path):
    """By code points: seven of eight characters are the same, in order."""
    entries = [(1, "espanola", ["española", "espanol", None]), (2, "josé", ["JOSÉ"]), (3, "x", None)]
    folder = written(spark, tmp_path, canonical_values=(entries, "ref_id bigint, canonical_value string, alt_labels array<string>"))
    got = {(r["ref_id"], r["label"]): r["jaro"] for r in core_queries.similarity_pairs(spark, folder).collect()}
    assert got == {(1, "española"): round((7 / 8 + 7 / 8 + 1) / 3, 6), (1, "espanol"): round((7 / 8 + 1 + 1) / 3, 6), (2, "JOSÉ"): 1.0}
