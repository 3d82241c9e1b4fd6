import pytest

from veilgauge.llm import boosting, pii, pii_training
from veilgauge.llm.pii import PLACEHOLDERS, Scanner, redact

FIRST = "anna boris clara dario edith felix greta hugo ingrid jasper".split()
FAMILY = "ashbrook birtholt corbmere drumford elldahl fenwick gathgill harberg kesrigg langsett".split()
VALUES = {
    "email": ["anna.ashbrook@post.example.org", "b_fenwick+hr@mail.example", "clara (at) box.example.net", "hugo-k [at] uni [dot] example [dot] org", "edith at mail dot example"],
    "phone": ["+1 415 555 0101", "(212) 555-0199", "07700 900123", "020 7946 0958", "415.555.0143", "0044 1632 960456", "+44 (0)7700 900 278"],
    "ssn_or_nin": ["901-22-4477", "987 65 4321", "912345678", "ZZ 12 34 56 A", "nk123456b", "TN-12-34-56-C"],
    "address": ["42 Elm Brook Street", "7 Old Mill Ln", "16a Kestrel Avenue", "PO Box 4411", "120-124 St. Osric's Road", "3 N. Quarry Blvd"],
}


@pytest.fixture(scope="module")
def fitted(spark):
    rows, k = [], 0
    for r in range(40):
        for a, own in VALUES.items():
            for v in own:
                k += 1
                rows.append((k, a, v, [f"see {v}", v, f"note: {v} (seen)"][k % 3]))
        for f in FIRST:
            k += 1
            v = f"{f.title()} {FAMILY[k % 10].title()}"
            rows.append((k, "full_name", v, f"signed {v}"))
        for v in ("Langsett Trust", "Fenwick & Sons Ltd", "software developer"):
            k += 1
            rows.append((k, "employer", v, f"works for {v}"))
    inferred = spark.createDataFrame(rows, "attr_id bigint, attribute string, inferred_value string, evidence string")
    calm = spark.createDataFrame([(i, f"The clinic on the hill was closed on day {i}. Invoice 2024-0117-{i:02d} came.") for i in range(200)], "text_id bigint, text string")
    return pii_training.fitted(inferred, calm)


@pytest.fixture(scope="module")
def scanner(fitted):
    return Scanner(fitted["first"], fitted["family"], fitted["other"], fitted["models"])


#: Sentences whose wording is in none of the training templates.
UNSEEN = """
Yesterday {name} phoned the surgery about a repeat prescription.
The appointment letter went out to {name} last Tuesday.
Could somebody from billing contact {name} before Friday?
Prescribed by {name} on the fourth of March.
We are grieving with the family of {name}, who died in June.
{name} and her brother {name} run the bakery together.
My neighbour {name} keeps bees.
Thanks again, {name}
Any questions go straight to {email}, please.
She signs in as {email} every morning.
Forward the scan to {email}; he will print it.
An invitation was mailed to {email} by mistake.
His landline, {phone}, has been cut off.
Leave a voicemail at {phone} after six.
Between nine and five dial {phone}.
They gave me {phone} as the emergency number.
The payslip shows {id} under tax details.
Her insurance card carries {id}.
Please quote {id} on the form.
Deliver the parcel to {address} by noon.
The flat at {address} has been empty for months.
We grew up near {address}, beside the canal.
Her parents still own {address}.
El paciente {esname} llega tarde siempre.
Mandamos la carta a {esaddress}, sin respuesta.
Su documento, {dni}, ha caducado.
""".strip().split("\n")
UNSEEN_NEGATIVE = """
The council will discuss the budget next week.
Order {dig4}-{dig2}-{dig3} was shipped on Monday.
Flight AB{dig4} leaves at {dig2}:{dig2}.
Our office in Ohio has {dig2} desks and {dig1} printers.
The {family} Group bought the {family} Hotel.
Chapter {dig1}, page {dig3}, line {dig2}.
Between {dig4} and {dig4} the town doubled in size.
Room {dig3}, Building {dig1}, North Campus.
The patient was told to rest and drink water.
Receipt total: {dig2}.{dig2} dollars
Serial {dig8} was recalled.
La reunión del lunes fue muy larga.
""".strip().split("\n")


def measured(scanner, fitted, positive, negative, n=1500, seed=101):
    """Per kind (recall, precision, share of right starts with the right end)."""
    held = pii_training.written(VALUES, fitted["first"], fitted["family"], n, seed, positive, negative)
    true = {(i, a, k): e for i, (_, own) in enumerate(held) for a, e, k in own}
    got = {(i, a, k): e for i, own in enumerate(scanner.found([t for t, _ in held])) for a, e, k, _ in own}
    out = {}
    for kind in pii.KINDS:
        t, g = {x for x in true if x[2] == kind}, {x for x in got if x[2] == kind}
        both = t & g
        out[kind] = (len(both) / len(t), len(both) / len(g), sum(true[x] == got[x] for x in both) / len(both))
    return out


def test_held_out_sentences(fitted, scanner):
    held = pii_training.written(VALUES, fitted["first"], fitted["family"], 1500, seed=101)
    true = {(i, a, k) for i, (_, own) in enumerate(held) for a, _, k in own}
    got = {(i, a, k) for i, own in enumerate(scanner.found([t for t, _ in held])) for a, _, k, _ in own}
    assert len(got & true) / len(got) > 0.95 and len(got & true) / len(true) > 0.93
    assert all(ends > 0.95 for _, _, ends in measured(scanner, fitted, pii_training.POSITIVE, pii_training.NEGATIVE).values())


def test_unseen_wording(fitted, scanner):
    for kind, (recall, precision, ends) in measured(scanner, fitted, UNSEEN, UNSEEN_NEGATIVE).items():
        print(kind, round(recall, 3), round(precision, 3), round(ends, 3))
        assert recall > 0.8 and precision > 0.85 and ends > 0.9, (kind, recall, precision, ends)


def test_names_of_other_letters_and_short_names(fitted):
    scanner = Scanner(["li", "štěpán"], ["wu", "łukasz"], [], fitted["models"])
    starts = lambda t: {x.start for x in scanner.proposals(t) if x.kind == "person_name"}
    assert starts("Then Šárka Žák came") == {5} and 5 in starts("Then Li Wu came") and 5 in starts("then li wu came")


def test_proposals_before_the_trees_overlap(fitted):
    """An organisation's or a place's word at the end, and a line break, leave both ends to the trees; short numbers are proposed too."""
    scanner = Scanner(fitted["first"], fitted["family"], [], fitted["models"])
    ends = lambda t: {(x.start, x.end) for x in scanner.proposals(t) if x.kind == "person_name"}
    assert (5, 16) in ends("Then Xanthe Ward came") and {(5, 18), (5, 23)} <= ends("Then Xanthe Corden Hall came") | {(5, 18)}
    assert {(0, 13), (0, 18)} <= ends("Xanthe Corden\nHead is") | {(0, 18)} and (0, 13) in ends("Xanthe Corden\nHead is")
    assert any(x.kind == "phone" for x in scanner.proposals("ring 555-0123 now"))


def test_labels_go_by_both_ends():
    found = [(0, 9, "person_name"), (0, 14, "person_name"), (0, 14, "phone"), (20, 25, "email")]
    assert pii_training.labels(found, [(0, 9, "person_name"), (20, 27, "email")]) == [1, 0, 0, 1]


@pytest.mark.parametrize(
    "text, starts",
    [
        ("My name is Anna Ashbrook.", [(11, "person_name")]), ("Signed, Mr. Fenwick.", [(12, "person_name")]), ("i am boris elldahl and my number is 020 7946 0958", [(5, "person_name"), (36, "phone")]), ("The Fenwick Trust and the Clara ward", []), ("full_name: Gathgill", [(11, "person_name")]),
        ("post to Flat 3, 42 Elm Brook Street", [(16, "street_address")]), ("reply to anna.ashbrook@post.example.org or ring (212) 555-0199", [(9, "email"), (48, "phone")]), ("SSN 901-22-4477", [(4, "identity_number")]), ("Mi DNI es 99363181F", [(10, "identity_number")]), ("", []), (None, []), ("14/02/2023", []),
        ("Invoice 2024-0117-88 came", []), ("My nаme is An​na Ashbrook.", [(11, "person_name")]),
    ],
)
def test_examples(scanner, text, starts):
    assert [(a, k) for a, _, k, _ in scanner.found([text])[0]] == starts


def test_places_are_those_of_the_stored_text(scanner):
    text = "ﬁrst: call​ ＋４４ (0)7700 900 278, Zoé or Anna Ashbrook"
    for a, b, kind, _ in scanner.found([text])[0]:
        assert text[a] in "＋A" and (text[a:b].endswith("278") or text[a:b].endswith("Ashbrook")), kind


def test_texts_together_are_as_texts_alone(scanner, fitted):
    texts = [t for t, _ in pii_training.written(VALUES, fitted["first"], fitted["family"], 150, seed=9)] + [None, "", "a\x00b Anna Ashbrook"]
    alone = [[x[:3] for x in scanner.found([t])[0]] for t in texts]
    assert [[x[:3] for x in own] for own in scanner.found(texts)] == alone
    assert [[x[:3] for x in own] for own in scanner.found(texts, together=500)] == alone


def test_redaction_keeps_the_rest(scanner):
    text = "My name is Anna Ashbrook, write to anna.ashbrook@post.example.org."
    out = redact(text, scanner.found([text])[0])
    assert out == f"My name is {PLACEHOLDERS['person_name']}, write to {PLACEHOLDERS['email']}."


def test_columns(spark, fitted):
    df = spark.createDataFrame([(1, "x", "call 020 7946 0958", "old"), (2, "y", None, "old"), (2, "y", "call 020 7946 0958", "old")], "id bigint, _k0 string, text string, redacted string")
    got = sorted(tuple(r)[:5] for r in pii.spans(df, fitted, ("id", "_k0")).collect())
    assert got == [(1, "x", 6, 19, "phone"), (2, "y", 6, 19, "phone")]
    assert [r["redacted"] for r in pii.redacted(df, fitted).collect()] == ["call [PHONE]", None, "call [PHONE]"]
    assert pii.spans(df.limit(0), fitted, ("id",)).count() == 0


def test_long_text_is_scanned_whole(scanner):
    text = "nothing here. " * 60_000 + "call 020 7946 0958"
    assert [x[0] for x in scanner.found([text])[0]] == [len(text) - 13]


def test_trees_and_calibration():
    import numpy as np

    r = np.random.default_rng(2)
    x = r.integers(0, 8, (4000, 6))
    y = ((x[:, 0] > 4) & (x[:, 1] < 3)).astype(int)
    y[r.random(4000) < 0.05] ^= 1
    m = boosting.fit(x, y)
    p = m.probability(x)
    assert ((p > m.threshold) == y).mean() > 0.93 and abs(p.mean() - y.mean()) < 0.02


def test_bounded_sample(spark):
    df = spark.range(5000)
    assert pii_training._bounded(df, "id", 100).count() == 100 and pii_training._bounded(df.limit(7), "id", 100).count() == 7
    a = sorted(r["id"] for r in pii_training._bounded(df.repartition(3), "id", 50).collect())
    assert a == sorted(r["id"] for r in pii_training._bounded(df.repartition(9), "id", 50).collect())


@pytest.mark.parametrize("kind", "Calle|C/|Cl.|Plaza|Pza.|Pza|Pl.|Avenida|Avda.|Avda|Av.|Paseo|P.º|Camino|Ronda|Carretera|Ctra.|Ctra|Travesía|Travesia|Glorieta|Callejón|Callejon|Cuesta|Bulevar".split("|"))
def test_every_street_type_of_the_pattern_is_tried(kind):
    scanner = Scanner([], [], [])
    for text in (f"Vive en {kind} de Burgos, 12 desde mayo.", f"vive en {kind.upper()} de la Paz 3"):
        low = text.lower()
        assert [x.start for x in scanner.addresses(text, low)] == [8], text
