"""Texts packed into containers of a fixed number of tokens by non-negative least squares on the length histogram.

1. Tokens are counted with a public tokenizer (its file is a parameter). Only a
   text longer than a container is split, into full containers and a rest.
2. The histogram of lengths, with no more rows than a container has tokens,
   goes to the driver. Shallow combinations of coarse lengths that fill the
   window are enumerated, and non-negative least squares solves how often each
   is to be used so that the histogram is met; rounded down, they are realised
   with exact lengths, and the residual is packed greedily (best fit, longest
   first) into their slack and into new containers. All of that works on
   counts, so its cost depends on the capacity and not on the number of texts,
   and the plan has some thousand rows.
3. Every item gets a rank among the items of its length (counted per hashed
   bucket first, so that a length that a third of all items share is no single
   task), and its rank names its container by arithmetic.

Null and empty texts have no tokens and take no space; they are put into the
first container. Equal texts are items of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPACITY = 2048
#: Coarse lengths a window is divided into, and the most parts of a combination.
GRID, DEPTH = 64, 5
#: Items of one length that are ranked in one task, on average.
PER_BUCKET = 50_000


def tokenizer(path: str):
    """A tiktoken encoding of a rank file; special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) for each row of `df`."""
    path = path or default_tokenizer()
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"_i": batch["_i"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["_t"]]})

    out = df.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text_col}`").alias("_t")).mapInPandas(run, f"_i {kind}, n_tokens bigint")
    return out.withColumnRenamed("_i", id_col)


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |ax - b| (active sets after Lawson and Hanson)."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[inside] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * scale:
            break
        inside[j] = True
        while True:
            at = np.flatnonzero(inside)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300))
            x[at] += step * (z - x[at])
            drop = at[(x[at] <= 1e-12 * scale) & bad]
            inside[drop if len(drop) else at[bad][:1]] = False
            x[~inside] = 0
    return x


def combinations(total: int, depth: int, most: int | None = None) -> list[tuple[int, ...]]:
    """Ways to write `total` as at most `depth` parts, largest first."""
    most = total if most is None else most
    if total == 0:
        return [()]
    if depth == 0 or most * depth < total:
        return []
    return [(p, *rest) for p in range(min(most, total), 0, -1) for rest in combinations(total - p, depth - 1, p)]


class Plan:
    """Which ranks of each length go to which containers.

    ranges: (length, first rank, end of ranks, copies in a container, first
    container). Containers with the same space left are kept as intervals of
    their numbers, so there is no object per container.
    """

    def __init__(self, histogram: np.ndarray, capacity: int) -> None:
        self.capacity = capacity
        self.left = np.array(histogram, np.int64).copy()
        self.left[0] = 0
        self.rank = np.zeros(capacity + 1, np.int64)
        self.ranges: list[tuple[int, int, int, int, int]] = []
        self.containers = 0
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.has = np.zeros(capacity + 1, bool)

    def place(self, length: int, first: int, n: int, copies: int = 1) -> None:
        k = int(self.rank[length])
        self.ranges.append((length, k, k + n * copies, copies, first))
        self.rank[length] += n * copies
        self.left[length] -= n * copies

    def leave(self, space: int, first: int, n: int) -> None:
        if space > 0:
            self.open.setdefault(space, []).append((first, n))
            self.has[space] = True

    def pattern(self, used: dict[int, int], n: int) -> None:
        """n new containers with `used`."""
        for v, m in used.items():
            self.place(v, self.containers, n, m)
        self.leave(self.capacity - sum(v * m for v, m in used.items()), self.containers, n)
        self.containers += n

    def best_fit(self, length: int) -> None:
        """All items left of this length into the containers with the least space that holds them, then into new ones."""
        while (todo := int(self.left[length])) > 0:
            at = np.flatnonzero(self.has[length:])
            if len(at):
                space = length + int(at[0])
                first, n = self.open[space].pop()
                if not self.open[space]:
                    self.has[space] = False
                if n > todo:
                    self.leave(space, first + todo, n - todo)
                    n = todo
                self.place(length, first, n)
                self.leave(space - length, first, n)
            else:
                m = self.capacity // length
                if n := todo // m:
                    self.pattern({length: m}, n)
                else:
                    self.pattern({length: todo}, 1)


def plan(histogram: np.ndarray, capacity: int = CAPACITY, grid: int = GRID, depth: int = DEPTH) -> Plan:
    """Places histogram[l] items of l tokens each, for l from 1 to `capacity`."""
    out = Plan(histogram, capacity)
    grid = min(grid, capacity)
    width = -(-capacity // grid)
    coarse = -(-np.arange(capacity + 1) // width)
    ways = combinations(int(coarse[capacity]), depth)
    want = np.bincount(coarse, weights=out.left, minlength=coarse[capacity] + 1)[1:]
    if want.sum() > 0:
        a = np.zeros((coarse[capacity], len(ways)))
        for k, way in enumerate(ways):
            for p in way:
                a[p - 1, k] += 1
        times = np.floor(non_negative_least_squares(a, want)).astype(np.int64)
        for k in np.argsort(-times, kind="stable")[: int((times > 0).sum())]:
            todo = int(times[k])
            while todo > 0:
                used: dict[int, int] = {}
                for i, p in enumerate(ways[k]):
                    lo, hi = (p - 1) * width + 1, min(p * width, capacity)
                    if i == len(ways[k]) - 1:  # the last part takes up what the coarse lengths of the others leave
                        hi = capacity - sum(v * m for v, m in used.items())
                    free = [int(x) for x in np.flatnonzero(out.left[lo : hi + 1])[::-1] + lo if out.left[x] > used.get(int(x), 0)]
                    if i == len(ways[k]) - 2:  # of the last two the pair that fills the container exactly, if there is one
                        space = capacity - sum(v * m for v, m in used.items())
                        free = [x for x in free if x < space and out.left[space - x] > used.get(space - x, 0) + (2 * x == space)] or free
                    v = free[0] if free else 0
                    if not v:
                        todo = 0
                        break
                    used[v] = used.get(v, 0) + 1
                else:
                    n = min(todo, *(int(out.left[v]) // m for v, m in used.items()))
                    out.pattern(used, n)
                    todo -= n
    for length in range(capacity, 0, -1):
        out.best_fit(length)
    return out


def packed(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece_no, token_start, n_tokens, container_id): every text, or piece of a text longer than a container."""
    from veilgauge.session import cut

    spark = df.sparkSession
    counts = token_counts(df, path, id_col, text_col)
    full = F.floor((F.greatest(F.col("n_tokens"), F.lit(1)) - 1) / capacity).cast("bigint")
    pieces = counts.select(F.col(id_col).alias("_i"), "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), full)).alias("p"))
    pieces = cut(pieces.select("_i", F.col("p").alias("piece_no"), (F.col("p") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("p") * capacity).alias("n")))
    found = pieces.groupBy("n").agg(F.count(F.lit(1)).alias("items")).collect()  # at most capacity + 1 rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in found:
        histogram[r["n"]] = r["items"]
    ranges = plan(histogram, capacity).ranges
    ranges.append((0, 0, int(histogram[0]), max(1, int(histogram[0])), 0))
    by_length = spark.createDataFrame(ranges, "n bigint, lo bigint, hi bigint, copies bigint, first bigint").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "copies", "first"))).alias("slots"))
    buckets = max(1, int(histogram.sum()) // PER_BUCKET)
    items = pieces.withColumn("b", F.pmod(F.xxhash64("_i", "piece_no"), F.lit(buckets)))
    sizes = items.groupBy("n", "b").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.withColumn("o", F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    rank = F.row_number().over(Window.partitionBy("n", "b").orderBy("_i", "piece_no")) - 1
    placed = items.withColumn("r", rank).join(before, ["n", "b"]).withColumn("r", F.col("r") + F.col("o"))
    # one row per length, at most capacity + 1
    slot = F.get(F.filter("slots", lambda s: s["hi"] > F.col("r")), F.lit(0))
    placed = placed.join(F.broadcast(by_length), "n").withColumn("s", slot)
    return placed.select(
        F.col("_i").alias(id_col),
        (F.col("piece_no") + 1).alias("piece_no"),
        "token_start",
        F.col("n").alias("n_tokens"),
        (F.col("s.first") + F.floor((F.col("r") - F.col("s.lo")) / F.col("s.copies"))).cast("bigint").alias("container_id"),
    )


def fill_report(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the fullest container and the share of space used."""
    each = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("k").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), (F.sum("t") / (F.count(F.lit(1)) * F.lit(capacity))).alias("used"))
