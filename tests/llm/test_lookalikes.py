import unicodedata

from veilgauge.llm import lookalikes as L

TEXTS = [
    "The café near Record K12", "The café near Record K12", "Тhe café near Rec​ord K12", "The café near Ｒｅｃｏｒｄ K12", "The cafe near Record K12", "the café near Record K12", "The café near Rеcοrd К12", "Привет мир", "Привeт мир", "Привет миру", "", None, "The café near Record K12",
    "ﬁle re‑identified", "file re-identified", "fi\xadle re‐identified",
]


def brute(texts):
    like = L.CYRILLIC_LOOKALIKES | L.GREEK_LOOKALIKES

    def form(t):
        t = "".join(c for c in t if unicodedata.category(c) != "Cf")
        t = unicodedata.normalize("NFKC", t).replace("‐", "-").replace("‑", "-")
        words = []
        for w in t.split(" "):
            latin = "".join(like.get(c, c) for c in w)
            words.append(latin if any("a" <= c.lower() <= "z" or c.isdigit() for c in w) and "П" not in w else w.replace("e", "е") if "П" in w else w)
        return unicodedata.normalize("NFC", " ".join(words))

    keyed = [(i, t, form(t)) for i, t in enumerate(texts) if t]
    return {(i, j) for i, t, f in keyed for j, u, g in keyed if i < j and f == g and t != u}


def test_pairs_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "text_id bigint, text string, form string")
    forms = L.consistent_form(df, "text_id")
    got = {tuple(r) for r in L.alike_pairs(forms, "text_id").collect()}
    assert got == brute(TEXTS) and len(got) >= 15
    by = {r["text_id"]: r["form"] for r in forms.collect()}
    assert by[11] is None and by[10] == "" and by[7] == by[8] == "Привет мир" and by[4] != by[0] != by[5]


def test_classes_and_forms_are_stable(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "text_id bigint, text string")
    forms = L.consistent_form(df, "text_id")
    again = L.consistent_form(forms.select("text_id", forms["form"].alias("text")), "text_id")
    assert {r["text_id"]: r["form"] for r in forms.collect()} == {r["text_id"]: r["form"] for r in again.collect()}
    sizes = {r["text_id"]: (r["class_id"], r["n_rows"], r["n_spellings"]) for r in L.classes(forms, "text_id").collect()}
    assert sizes[12] == sizes[0] and sizes[0][0] == 0 and sizes[0][1] == sizes[0][2] + 1


def test_repair_needs_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "a zоrg came"), (2, "an ехit sign")], "text_id bigint, text string")
    by = {r["text_id"]: r["form"] for r in L.consistent_form(df, "text_id").collect()}
    assert by[1] == "a zоrg came"  # nobody else writes the word, in whatever script
    both = spark.createDataFrame([(1, "a zоrg came"), (2, "the zorg left")], "text_id bigint, text string")
    assert {r["form"] for r in L.consistent_form(both, "text_id").collect()} == {"a zorg came", "the zorg left"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "text_id bigint, text string")
    assert L.alike_pairs(L.consistent_form(df, "text_id"), "text_id").count() == 0
