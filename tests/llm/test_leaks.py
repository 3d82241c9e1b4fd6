import random

from veilgauge.llm import leaks
from veilgauge.llm.leaks import Index, Search, leaked

R = random.Random(3)
WORDS = ["".join(R.choice("bcdfglmnprst") + R.choice("aeiou") for _ in range(R.randint(2, 4))) for _ in range(900)]


def text(n):
    return [R.choice(WORDS) for _ in range(n)]


def search(items, run=12):
    return Search([Index(items, run)])


ITEMS = {i: text(60) for i in range(1, 21)}


def planted():
    """(documents, true pairs): exact, changed, short and no passages."""
    docs, true = {}, set()
    for d in range(200):
        own = text(R.choice((20, 150, 900)))
        kind, item = d % 5, R.choice(list(ITEMS))
        k = R.randrange(0, 30)
        if kind == 0:
            own[10:10] = ITEMS[item][k : k + 12]
        elif kind == 1:
            passage = ITEMS[item][k : k + 24]
            passage[7], passage[15] = "other", passage[15] + "x"
            own[5:5] = passage
        elif kind == 2:
            own[10:10] = ITEMS[item][k : k + 7]
        elif kind == 3:
            own[3:3] = [w.upper() for w in ITEMS[item]]
        if kind in (0, 1, 3):
            true.add((item, d))
        docs[d] = " ".join(own)
    return docs, true


def test_planted_passages(spark):
    docs, true = planted()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()] + [(900, None, "x"), (901, "", "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()] + [(99, None), (98, "too short")], "item_id bigint, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leaked(df, items).collect()}
    assert got == true


def test_every_exact_run_of_twelve_words_is_found():
    """Against brute force over the words."""
    docs, _ = planted()
    index = search([(i, " ".join(w)) for i, w in ITEMS.items()])
    runs = {tuple(w[k : k + 12]): i for i, w in ITEMS.items() for k in range(len(w) - 11)}
    for t in docs.values():
        words = t.lower().split()
        exact = {runs[tuple(words[k : k + 12])] for k in range(len(words) - 11) if tuple(words[k : k + 12]) in runs}
        assert exact <= {i for i, *_ in index.leaks([t])[0]}


def test_forms_do_not_matter():
    item = " ".join(ITEMS[1])
    index = search([(1, item)])
    for t in (item.upper(), "> " + item.replace(" ", "\n> "), item.replace("a", "а"), item[:5] + "​" + item[5:], "¡" + item.replace(" ", ",  ") + "!", item + " " + item):
        assert [i for i, *_ in index.leaks([t])[0]] == [1]


def test_texts_together_are_as_texts_alone():
    docs, _ = planted()
    index = search([(i, " ".join(w)) for i, w in ITEMS.items()])
    texts = list(docs.values())[:60]
    assert index.leaks(texts) == [index.leaks([t])[0] for t in texts]


def test_blocks_of_items(spark, monkeypatch):
    docs, true = planted()
    monkeypatch.setattr(leaks, "BLOCK", 7)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()], "item_id bigint, text string")
    assert {(r["item_id"], r["doc_id"]) for r in leaked(df, items).collect()} == true


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leaked(df, items).count() == 0 and leaked(df.limit(0), items).count() == 0


def test_an_altered_passage_repeated_often_keeps_its_chains():
    """Every repetition gives a chain, however many runs lie between its parts in the order of the item."""
    item = ITEMS[1][:14]
    passage = item[:7] + ["other"] + item[8:]
    index = search([(1, " ".join(item))])
    for n in (199, 400, 1000):
        parts = [x for k in range(n) for x in ((0, 7, 14 * k, 14 * k + 7), (8, 14, 14 * k + 8, 14 * k + 14))]
        assert len([c for c in index.parts[0].chains(parts) if c[:2] == (13, 14)]) == n
        assert index.leaks([" ".join(passage * n)]) == [[(1, 14, 13)]]


SHARED = text(40)
#: Items 1 and 2 share twelve words, 1 and 3 nine.
SHARING = {1: SHARED[:30], 2: text(8) + SHARED[5:17] + text(8), 3: text(6) + SHARED[14:23] + text(9)}


def test_items_that_share_twelve_words_are_both_reported():
    """Whichever of them the document holds more of; a shorter phrase that two items share counts for the one it stands in only."""
    index = search([(i, " ".join(w)) for i, w in SHARING.items()])
    found = lambda words: [i for i, *_ in index.leaks([" ".join(words)])[0]]
    around = text(20)
    assert found(around + SHARED[5:17] + around) == [1, 2]
    assert found(around + SHARED[:30] + around) == [1, 2]
    assert found(around + SHARING[2] + around) == [1, 2]
    assert found(around + SHARING[3] + around) == [3]
    assert found(around + SHARED[12:26] + around) == [1]


def test_items_that_share_words_over_blocks(spark, monkeypatch):
    """Several blocks give what one block gives."""
    docs = [SHARED[5:17], SHARED[:30], SHARING[2], SHARING[3], SHARED[12:26], SHARED[:30] + text(5) + SHARING[3]]
    df = spark.createDataFrame([(d, " ".join(text(20) + w + text(20))) for d, w in enumerate(docs)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in SHARING.items()], "item_id bigint, text string")
    one = sorted(map(tuple, leaked(df, items).collect()))
    monkeypatch.setattr(leaks, "BLOCK", 1)
    assert sorted(map(tuple, leaked(df, items).collect())) == one
    assert {(i, d) for i, d, *_ in one} == {(1, 0), (2, 0), (1, 1), (2, 1), (1, 2), (2, 2), (3, 3), (1, 4), (1, 5), (2, 5), (3, 5)}


def altered(r, words, n):
    """`words` with n of the inner words replaced, left out or put in, as a brute force would do it."""
    out = list(words)
    for k in sorted(r.sample(range(1, len(words) - 1), n), reverse=True):
        kind = r.randrange(3) if len(words) > 12 else r.choice((0, 2))  # of twelve words none can be spared
        out[k : k + 1] = ["changed"] if kind == 0 else [] if kind == 1 else [words[k], "added"]
    return out


def test_lightly_altered_passages_are_found():
    """Passages of 12 to 20 words with up to two alterations: at least 0.9 of each kind, nearly all of all."""
    r = random.Random(5)
    index = search([(i, " ".join(w)) for i, w in ITEMS.items()])
    every = []
    for n in (12, 14, 16, 20):
        for changes in (0, 1, 2):
            texts, true = [], []
            for _ in range(150):
                item = r.choice(list(ITEMS))
                k = r.randrange(0, 60 - n)
                texts.append(" ".join(text(30) + altered(r, ITEMS[item][k : k + n], changes) + text(30)))
                true.append(item)
            hits = [t in [i for i, *_ in found] for t, found in zip(true, index.leaks(texts))]
            assert sum(hits) >= 0.9 * len(hits), (n, changes, sum(hits))
            every += hits
    assert sum(every) >= 0.97 * len(every)


def test_an_index_from_a_file_is_the_same(tmp_path):
    docs, _ = planted()
    own = Index([(i, " ".join(w)) for i, w in ITEMS.items()], 12)
    own.save(f"file://{tmp_path}/x.index")
    texts = list(docs.values())
    assert Search([Index.load(f"{tmp_path}/x.index")]).leaks(texts) == Search([own]).leaks(texts)


def test_items_inside_items():
    """An item that stands in another is reported with it, altered alike or not."""
    inner = ITEMS[1][20:36]
    index = search([(1, " ".join(ITEMS[1])), (2, " ".join(inner))])
    changed = ITEMS[1][:25] + ["other"] + ITEMS[1][26:]
    assert [[i for i, *_ in x] for x in index.leaks([" ".join(ITEMS[1]), " ".join(changed), " ".join(inner)])] == [[1, 2], [1, 2], [1, 2]]
