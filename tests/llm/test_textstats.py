import random
import re

import pytest
from pyspark.sql import functions as F

from veilgauge.llm import textstats as T

R = random.Random(4)
NOUNS = "letter garden meeting window report doctor river station teacher morning ticket kitchen bottle office market bridge".split()


def sentence():
    a, b, c = R.sample(NOUNS, 3)
    return R.choice([f"The {a} was near the {b}, and we left it by the {c} before noon.", f"I think that my {a} is in the {b} because of the {c}.", f"She said the {a} had to go to the {b} with a new {c}."])


def prose(n=12):
    return " ".join(sentence() for _ in range(n))


KINDS = {
    "prose": lambda: prose(),
    "transcript": lambda: "\n".join(f"{'Ann' if k % 2 else 'Bob'}: {sentence()}" for k in range(10)),
    "wrapped": lambda: re.sub(r"(.{40}\S*) ", r"\1\n", prose()),
    "hurried": lambda: re.sub(r"[.,]", "", prose()).lower(),
    "list": lambda: "\n".join(f"- {R.choice(NOUNS)} {R.choice(NOUNS)}" for _ in range(25)),
    "table": lambda: "\n".join(f"{R.choice(NOUNS)}\t{R.randint(1, 999)}\t{R.randint(1, 99)}.{R.randint(0, 9)}" for _ in range(25)),
    "commas": lambda: ", ".join(R.choice(NOUNS) for _ in range(60)),
    "symbols": lambda: "".join(R.choice("@#$%^&*_=~<> ") for _ in range(400)),
    "repeated": lambda: "click here now " * 90,
    "salad": lambda: " ".join(R.choice("the of and to a in is was for that it with as on be".split()) for _ in range(120)),
}
GOOD = {"prose", "transcript", "wrapped", "hurried"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k in range(400):
        kind = list(KINDS)[k % 4] if k % 3 else list(KINDS)[4 + k // 3 % 6]
        rows.append((k, KINDS[kind](), kind))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang_found string")


def test_prose_is_told_from_the_rest(docs):
    flagged = {r["doc_id"] for r in T.not_prose(docs).collect()}
    kinds = {r["doc_id"]: r["lang_found"] for r in docs.collect()}
    assert flagged == {i for i, k in kinds.items() if k not in GOOD}


def test_statistics_against_plain_counts():
    m = T.Measure()
    text = "The cat sat on the mat. It ran!\n\nA 2nd line, 40% done"
    n, words, lang, mean, symbol, digit, lines, ends, common, *_ = m(text)
    own = re.findall(r"[^\W\d_]+", text)
    seen = len(re.sub(r"\s", "", text))
    assert (n, words, lang, lines) == (len(text), len(own), "en", 2) and mean == pytest.approx(sum(map(len, own)) / len(own))
    assert digit == pytest.approx(sum(c.isdigit() for c in text) / seen) and symbol == 0 and ends == 0.5
    assert common == pytest.approx(sum(w.lower() in set(T.COMMON_WORDS["en"]) | set(T.COMMON_WORDS["es"]) for w in own) / len(own))


@pytest.mark.parametrize("text, lang", [("这是我的一个大问题，我们在这里。", "zh"), ("La casa de mi hermano es muy grande y no tiene luz.", "es"), ("xyz qrs", "und"), ("", "und"), (None, "und"), ("\n\n\t", "und"), ("𝒜" * 5, "und")])
def test_languages(text, lang):
    assert T.Measure()(text)[2] == lang


def test_sketches_merge(spark, docs):
    stats = T.document_statistics(docs)
    whole = {(r["lang_found"], r["statistic"]): r["n"] for r in T.sketches(stats).select("lang_found", "statistic", F.expr("kll_sketch_get_n_double(sketch)").alias("n")).collect()}
    assert whole[("all", "common_share")] == stats.where("lang_found <> 'und'").count()


def test_null_empty_long_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, prose(12_000)), (3, prose(4))], "doc_id bigint, text string")
    got = T.with_tails(df).collect()
    assert sorted((r["doc_id"], "no words" in r["reasons"]) for r in got) == [(1, True), (2, True), (3, False), (3, False)]
    assert T.not_prose(df.limit(0)).count() == 0


PROSE = {
    "de": "Der Brief lag auf dem Tisch, und niemand wusste, wer ihn gebracht hatte. Ich habe lange mit meiner Schwester gesprochen, weil sie am Montag nicht kommen kann. Das Fenster war offen, aber es wurde nicht kalt. Wir gehen nach dem Essen noch einmal zum Markt, wenn der Regen aufhört. Er sagte, dass die Arbeit in der neuen Stadt schwer sei, aber die Leute seien sehr freundlich zu ihm.",
    "fr": "La lettre était sur la table et personne ne savait qui l'avait apportée. J'ai parlé longtemps avec ma soeur parce qu'elle ne peut pas venir lundi. La fenêtre était ouverte, mais il ne faisait pas froid. Nous irons encore une fois au marché après le repas si la pluie s'arrête. Il a dit que le travail dans la nouvelle ville était difficile, mais que les gens étaient très gentils avec lui.",
    "pt": "A carta estava em cima da mesa e ninguém sabia quem a tinha trazido. Falei muito tempo com a minha irmã porque ela não pode vir na segunda. A janela estava aberta, mas não fazia frio. Vamos mais uma vez ao mercado depois do almoço se a chuva parar. Ele disse que o trabalho na nova cidade era difícil, mas que as pessoas eram muito simpáticas com ele.",
    "it": "La lettera era sul tavolo e nessuno sapeva chi l'aveva portata. Ho parlato a lungo con mia sorella perché non può venire lunedì. La finestra era aperta, ma non faceva freddo. Andiamo ancora una volta al mercato dopo il pranzo se la pioggia si ferma. Ha detto che il lavoro nella nuova città era difficile, ma che le persone sono molto gentili con lui.",
    "nl": "De brief lag op de tafel en niemand wist wie hem had gebracht. Ik heb lang met mijn zus gesproken omdat zij op maandag niet kan komen. Het raam was open, maar het was niet koud. We gaan na het eten nog een keer naar de markt als de regen ophoudt. Hij zei dat het werk in de nieuwe stad zwaar was, maar dat de mensen daar heel aardig voor hem zijn.",
}
LISTS = {"de": "Brief, Tisch, Schwester, Montag, Fenster, Essen, Markt, Regen, Arbeit, Stadt, Leute", "fr": "lettre, table, soeur, lundi, fenêtre, repas, marché, pluie, travail, ville, gens", "pt": "carta, mesa, irmã, segunda, janela, almoço, mercado, chuva, trabalho, cidade, pessoas"}


def test_other_languages_are_prose_and_their_lists_are_not(spark, docs):
    """A few documents of a language among many of another are measured by it, their lists flagged."""
    rows = [(1000 + k, t, None) for k, t in enumerate(PROSE.values())] + [(2000 + k, "\n".join(f"- {w}" for w in t.split(", ") * 3), None) for k, t in enumerate(LISTS.values())]
    every = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang_found string"))
    flagged = {r["doc_id"] for r in T.not_prose(every).collect() if r["doc_id"] >= 1000}
    assert flagged == {2000, 2001, 2002}
    assert [T.Measure()(t)[2] for t in PROSE.values()] == list(PROSE)


def test_every_statistic_is_sketched_and_scored(docs):
    scored = T.with_tails(docs)
    assert {f"z_{s}" for s in ("n_words", "mean_word_length", "symbol_ratio", "line_end_punct", "common_share")} <= set(scored.columns)
    ref = {r["lang_found"]: r for r in T.references(T.sketches(T.document_statistics(docs))).collect()}
    assert ref["en"]["c_n_words"] > 0 and ref["all"]["c_mean_word_length"] > 3
