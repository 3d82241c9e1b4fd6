import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgauge.llm import packing as P


def check(h, capacity, **kw):
    out = P.plan(np.array(h), capacity, **kw)
    fill, used = np.zeros(out.containers, int), np.zeros(capacity + 1, int)
    for length, lo, hi, copies, first in out.ranges:
        n = (hi - lo) // copies
        assert lo == used[length] and n * copies == hi - lo
        used[length] = hi
        fill[first : first + n] += length * copies
    assert (used[1:] == np.array(h)[1:]).all() and (fill <= capacity).all() and (fill > 0).all()
    return out.containers


def optimum(items, capacity):
    best = len(items)
    for k in range(1, len(items) + 1):
        for way in itertools.product(range(k), repeat=len(items)):
            load = [0] * k
            for i, c in zip(items, way):
                load[c] += i
            if max(load) <= capacity:
                return k
    return best


@pytest.mark.parametrize("items", [[5, 5, 5, 5], [7, 3, 6, 4, 2, 8], [10, 10, 1], [6, 5, 4, 3, 2], [9, 9, 2, 1, 1, 8]])
def test_small_sets_are_packed_as_well_as_can_be(items):
    assert check(np.bincount(items, minlength=11), 10, grid=10, depth=4) == optimum(items, 10)


@pytest.mark.parametrize("seed", range(4))
def test_fill(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.lognormal(5.5, 1, 20_000).astype(int) + 1, 1, 2048)
    n = check(np.bincount(lengths, minlength=2049), 2048)
    assert n <= 1.005 * -(-int(lengths.sum()) // 2048) + 1


def test_least_squares_against_conditions():
    r = np.random.default_rng(1)
    a, b = r.random((12, 40)), r.random(12)
    x = P.non_negative_least_squares(a, b)
    w = a.T @ (b - a @ x)
    assert (x >= 0).all() and (w <= 1e-7).all() and np.abs(w[x > 0]).max() < 1e-7


def test_combinations():
    assert sorted(P.combinations(4, 3)) == [(2, 1, 1), (2, 2), (3, 1), (4,)]


def test_texts(spark):
    texts = ["word " * n for n in (5, 100, 700, 1500, 2048, 3000, 5000)] * 3 + ["", None, "你好" * 50]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n bigint")
    counts = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(df).collect()}
    rows = P.packed(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(counts)
    for i, own in by.items():
        own.sort(key=lambda r: r["piece_no"])
        assert sum(r["n_tokens"] for r in own) == counts[i] and (len(own) == 1 or counts[i] > 2048)
        assert [r["token_start"] for r in own] == [2048 * k for k in range(len(own))]
    load = {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 2048 and len(load) <= -(-sum(load.values()) // 2048) + 3 and sorted(load) == list(range(len(load)))
    assert P.fill_report(P.packed(df)).first()["tokens"] == sum(counts.values())


def test_ranks_in_buckets_give_the_same_fill(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * (1 + i % 7)) for i in range(500)], "doc_id bigint, text string")
    one = P.fill_report(P.packed(df, capacity=20)).first()
    monkeypatch.setattr(P, "PER_BUCKET", 50)
    two = P.packed(df, capacity=20)
    assert P.fill_report(two, 20).first()["containers"] == one["containers"]
    assert two.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.max("t")).first()[0] <= 20


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
