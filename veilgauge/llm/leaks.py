"""Passages of held-out items inside documents: size-partitioned MinHash containment search, verified exactly.

Documents and items are words; shingles are `SHINGLE` words. A document keeps
only the shingles that any item has (a bit table, then the sorted list of
them): no other can be shared. Items are cut into windows of `run` words,
documents into overlapping pieces; any window of an item that stands in a
document lies wholly in one piece. Pieces are partitioned by the number of
shingles they kept, and each partition gets the number of MinHash bands (of
one row) with which a window of which a single shingle is left is missed with
a probability of `MISSED` at most; more shingles are missed less. Candidates
(document, item) are verified on the words: shingles of the item that the
document holds exactly are the seeds of runs, runs are chained over light
alterations, and a chain must span `run` words of the item. All candidates are
verified; a chain is dropped only where another item's matches strictly more
of the same words (`settled`).

Twelve words with two altered may hold no five words in sequence, but always
four, so shingles have four words here.

The corpus is read and cut into words once, whatever the number of items: the
index is written in parts of `BLOCK` items to the shared folder, sent to the
executors as files and memory-mapped there, and every batch of documents is
held against all parts. Nothing of the documents is shuffled, and neither the
driver nor a task holds more than one part's worth of items in memory of its
own.

Null and empty texts and items of fewer words than `run` give no rows;
repeated documents are each reported.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.words import Words, mixed, shingles
from veilgauge.session import shared_dir, spread

SHINGLE = 4
#: Items in a part of the index.
BLOCK = 20_000
MISSED = 0.03
#: Shingle places of a half piece; a piece is two halves.
HALF = 12
#: Kept shingles of a piece up to which it belongs to a partition.
SIZES = (3, 8, 2 * HALF)
#: Characters of documents handled together.
TOGETHER = 1_000_000
#: Words that may be altered, added or left out between two runs, and the least share of a chain's words that match.
GAP, LEAST_MATCH = 2, 0.7
#: The least share where single words between alterations count as matches too, which any two texts share here and there.
LEAST_ALONE = 5 / 6
#: Words by which the places of item and document may drift apart, and document words looked at, around a seed.
DRIFT, NEAR = 8, 16


def bands(size: int, window: int) -> int:
    """Bands for pieces of `size` kept shingles at most, looking for windows of `window` shingles of which one is left."""
    j = 1 / (size + window - 1)
    return math.ceil(math.log(MISSED) / math.log(1 - j))


#: Matched words, item words spanned, first and last document word, and the matched document words as from, to, from, to, ...
Chain = tuple[int, int, int, int, list[int]]
#: Document words of a place in which chains are looked up.
PLACE = 32


def settled(found: list[tuple[int, Chain]]) -> list[tuple[int, int, int]]:
    """(item, item words spanned, matched words) of a document's chains of all items, the best of each item.

    A chain does not count if a chain of another item that counts matches
    strictly more of the very words it lies over: then it is a phrase the two
    items share, in a passage of the other. So twelve words of an item that
    stand unaltered always count, for every item that has them.
    """
    kept: dict[int, list[tuple[int, list[int]]]] = {}
    out: dict[int, tuple[int, int]] = {}
    for item, (m, span, j0, j1, words) in sorted(found, key=lambda x: (-x[1][0], x[0], x[1][2], x[1][1])):
        places = range(j0 // PLACE, (j1 - 1) // PLACE + 1)
        if any(
            sum(max(0, min(z, j1) - max(a, j0)) for a, z in zip(w[::2], w[1::2])) >= m + (other != item)  # of the same item: nothing new
            for p in places
            for other, w in kept.get(p, ())
        ):
            continue
        for p in places:
            kept.setdefault(p, []).append((item, words))
        out.setdefault(item, (span, m))
    return [(i, a, b) for i, (a, b) in sorted(out.items())]


def _pairs(w: np.ndarray) -> np.ndarray:
    return w[:-1] * np.uint64(31) + w[1:]


def _among(own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of `h` are in the sorted `own`."""
    return own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h if len(own) else np.zeros(len(h), bool)


class Index:
    """MinHash bands of the windows of some items, and the items' words; plain arrays, in memory or mapped from a file."""

    ARRAYS = ("ids", "first", "words", "known", "bits", "pair", "pair_at", "pair_bits", "value", "owner", "band")

    def __init__(self, items: list[tuple[int, str]], run: int) -> None:
        cut, window = Words(), run - SHINGLE + 1
        n_bands = bands(SIZES[-1], window)
        factor = self.factors(n_bands)
        ids, words, sets, values, owners = [], [], [], [[] for _ in range(n_bands)], [[] for _ in range(n_bands)]
        for i, text in items:
            w = cut(text) if text else np.zeros(0, np.uint64)
            if len(w) < run:
                continue
            s = shingles(w, SHINGLE)
            for b, f in enumerate(factor):
                v = np.unique(np.lib.stride_tricks.sliding_window_view(s * f, window).min(axis=1))
                values[b].append(v)
                owners[b].append(np.full(len(v), len(ids), np.int32))
            ids.append(i)
            words.append(w)
            sets.append(np.unique(s))
        none = np.zeros(0, np.uint64)
        self.ids = np.array(ids, np.int64)
        self.first = np.cumsum([0, *[len(w) for w in words]])
        self.words = np.concatenate([none, *words])
        self.known = np.unique(np.concatenate([none, *sets]))
        self.bits = self._bits(self.known)
        pair = np.concatenate([none, *[self._own(_pairs(w), np.full(len(w) - 1, k, np.uint64)) for k, w in enumerate(words)]])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(w) - 1) for w in words]])
        order = np.argsort(pair, kind="stable")
        self.pair, self.pair_at = pair[order], place[order]
        self.pair_bits = self._bits(self.pair)
        value, owner, self.band = [none], [np.zeros(0, np.int32)], np.zeros(n_bands + 1, np.int64)
        for b in range(n_bands):
            v, o = np.concatenate([none, *values[b]]), np.concatenate([np.zeros(0, np.int32), *owners[b]])
            order = np.argsort(v, kind="stable")
            value.append(v[order])
            owner.append(o[order])
            self.band[b + 1] = self.band[b] + len(v)
        self.value, self.owner = np.concatenate(value), np.concatenate(owner)
        self._ready(run)

    def _ready(self, run: int) -> None:
        self.run, self.window = run, run - SHINGLE + 1
        self.bands = [bands(s, self.window) for s in SIZES]
        self.factor = self.factors(self.bands[-1])

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        """A bit table in which a hash that is none of `h` is seldom set."""
        bits = np.zeros(1 << max(16, int(32 * len(h)).bit_length()), bool)
        bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return bits

    @staticmethod
    def _own(pairs: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Hashes of word pairs of items, so that those of all items fit one table."""
        return mixed(pairs + item * np.uint64(0x9E3779B97F4A7C15))

    @staticmethod
    def factors(n: int) -> np.ndarray:
        return mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    # ---- as a file -------------------------------------------------------------------------------------------
    def save(self, uri: str) -> None:
        """The arrays one after the other, each at a multiple of 64 bytes, with a head that names them."""
        from pyarrow import fs

        head, at = {"run": self.run}, 4096
        for n in self.ARRAYS:
            a = np.ascontiguousarray(getattr(self, n))
            head[n] = (str(a.dtype), len(a), at)
            at += -(-a.nbytes // 64) * 64
        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(path) as out:
            out.write(json.dumps(head).encode().ljust(4096))
            for n in self.ARRAYS:
                raw = np.ascontiguousarray(getattr(self, n)).tobytes()
                out.write(raw + bytes(-len(raw) % 64))

    @classmethod
    def load(cls, path: str) -> Index:
        own = cls.__new__(cls)
        with open(path, "rb") as f:
            head = json.loads(f.read(4096))
        for n in cls.ARRAYS:
            kind, size, at = head[n]
            setattr(own, n, np.memmap(path, kind, "r", at, (size,)) if size else np.zeros(0, kind))
        own._ready(head["run"])
        return own

    # ---- candidates ------------------------------------------------------------------------------------------
    def kept(self, s: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        if not len(self.ids) or not len(s):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(s & np.uint64(len(self.bits) - 1)).astype(np.int64)])
        return at[_among(self.known, s[at])]

    def candidates(self, at: np.ndarray, s: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items, documents, first shingle places) of the pieces that may hold a window, in order.

        `at`: places of kept shingles; `s`: their hashes; `doc`: their
        documents; `begin`: where each document begins.
        """
        none = np.zeros(0, np.int64)
        if not len(at):
            return none, none, none
        half = (at - begin[doc]) // HALF
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(half) != 0) | (np.diff(doc) != 0)]))
        d, h = doc[starts], half[starts]
        # a piece is a half and the one after it, if that has kept shingles too
        joined = np.append((d[1:] == d[:-1]) & (h[1:] == h[:-1] + 1), False)
        after = np.minimum(np.arange(len(starts)) + 1, len(starts) - 1)
        size = np.diff(np.append(starts, len(at)))
        size = size + np.where(joined, size[after], 0)
        part = np.searchsorted(SIZES, size)
        found = [none]
        for b, f in enumerate(self.factor):
            low = np.minimum.reduceat(s * f, starts)
            low = np.where(joined, np.minimum(low, low[after]), low)
            own = np.flatnonzero(b < np.asarray(self.bands)[part])
            v = self.value[self.band[b] : self.band[b + 1]]
            lo, hi = np.searchsorted(v, low[own], "left"), np.searchsorted(v, low[own], "right")
            n = hi - lo
            if n.any():
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                found.append(self.owner[self.band[b] + k].astype(np.int64) * len(starts) + np.repeat(own, n))
        item, piece = np.divmod(np.unique(np.concatenate(found)), len(starts))
        return item, d[piece], begin[d[piece]] + h[piece] * HALF

    # ---- verification ----------------------------------------------------------------------------------------
    def runs(self, item: np.ndarray, a: np.ndarray, z: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (candidate, item from, item to, document from, document to) of the runs of words that the candidates' items share with `words[a:z]`.

        In order of candidate and diagonal; given in bulks of whole candidates.
        """
        pairs = _pairs(words)
        n = np.maximum(z - a - 1, 0)
        bulk = np.cumsum(n) // TOGETHER
        edges = np.flatnonzero(np.diff(bulk)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(item)]):
            m = n[lo:hi]
            k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m - a[lo:hi], m)
            own = self._own(pairs[k], np.repeat(item[lo:hi].astype(np.uint64), m))
            at = np.flatnonzero(self.pair_bits[(own & np.uint64(len(self.pair_bits) - 1)).astype(np.int64)])
            first, last = np.searchsorted(self.pair, own[at], "left"), np.searchsorted(self.pair, own[at], "right")
            c = last - first
            i = self.pair_at[np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first, c)]
            j = np.repeat(k[at], c)
            cand = np.repeat(np.repeat(np.arange(lo, hi), m)[at], c)
            order = np.lexsort((j, j - i, cand))
            i, j, cand = i[order], j[order], cand[order]
            if not len(i):
                continue
            new = np.append(True, (cand[1:] != cand[:-1]) | (j[1:] - i[1:] != j[:-1] - i[:-1]) | (j[1:] != j[:-1] + 1))
            head, tail = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(new)) - 1
            yield np.stack([cand[head], i[head], i[tail] + 2, j[head], j[tail] + 2])

    def promising(self, found: np.ndarray) -> np.ndarray:
        """Candidates of which a run holds a whole shingle and, with the runs around it, words enough for a chain.

        Two alterations change two words and may leave two more alone, which are no run.
        """
        cand, i0, i1, j0, j1 = found
        seeds = np.flatnonzero(i1 - i0 >= SHINGLE)
        lo, hi = np.searchsorted(cand, cand[seeds], "left"), np.searchsorted(cand, cand[seeds], "right")
        n = hi - lo
        s = np.repeat(seeds, n)
        r = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        near = (np.abs((j0 - i0)[r] - (j0 - i0)[s]) <= DRIFT) & (j1[r] > j0[s] - NEAR) & (j0[r] < j1[s] + NEAR)
        words = np.bincount(np.repeat(np.arange(len(seeds)), n), np.where(near, (i1 - i0)[r], 0), len(seeds)) if len(seeds) else np.zeros(0)
        return np.unique(cand[seeds[words >= self.run - 4]])

    def alone(self, found: np.ndarray, item: np.ndarray, a: np.ndarray, z: np.ndarray, words: np.ndarray) -> np.ndarray:
        """`found` with the single words of an item that stand near an end of a run, beyond an alteration."""
        cand, i0, i1, j0, j1 = found
        rows = []
        for x in range(GAP + 1):
            for y in range(GAP + 1):
                if x or y:
                    rows += [np.stack([cand, i1 + x, j1 + y]), np.stack([cand, i0 - 1 - x, j0 - 1 - y])]
        c, i, j = np.concatenate(rows, axis=1)
        first, last = self.first[item[c]], self.first[item[c] + 1]
        equal = lambda k: (i + k >= 0) & (first + i + k < last) & (j + k >= a[c]) & (j + k < z[c]) & (self.words[np.clip(first + i + k, 0, len(self.words) - 1)] == words[np.clip(j + k, 0, len(words) - 1)])
        own = equal(0) & ~equal(1) & ~equal(-1)
        single = np.unique(np.stack([c[own], i[own], j[own]]), axis=1)
        every = np.concatenate([found, np.stack([single[0], single[1], single[1] + 1, single[2], single[2] + 1])], axis=1)
        return every[:, np.argsort(every[0], kind="stable")]

    def chains(self, parts: list[tuple[int, int, int, int]], alone: bool = False) -> list[Chain]:
        """Chained runs (item from, to; document from, to) that hold and contain a whole shingle; of a long chain also its beginnings.

        With `alone` single words are parts too, and a chain must match `LEAST_ALONE` of its words on both sides.
        """
        parts = sorted(parts)
        best: list[tuple[int, int, int, int]] = []
        back: list[tuple[int, int]] = []  # the part before in the chain, or -1, and the first document word that is new
        ends: dict[int, dict[int, int]] = {}  # the part that ends at an item word and a document word; no two parts share both
        out = []
        for n, (i0, i1, j0, j1) in enumerate(parts):
            top, link = (i1 - i0, i0, j0, i1 - i0 >= SHINGLE), (-1, j0)
            for pi1 in range(i0 - GAP, min(i0 + GAP, i1 - 1) + 1):  # parts that end there start before this one, so they are done
                at = ends.get(pi1)
                for pj1 in range(j0 - GAP, min(j0 + GAP, j1 - 1) + 1) if at else ():
                    p = at.get(pj1)
                    cut = max(0, pi1 - i0, pj1 - j0)
                    if p is None or i1 - i0 - cut < 1:
                        continue
                    m = best[p][0] + (i1 - i0 - cut)
                    if m > top[0]:
                        top, link = (m, best[p][1], best[p][2], best[p][3] or i1 - i0 >= SHINGLE), (p, j0 + cut)
            ends.setdefault(i1, {})[j1] = n
            best.append(top)
            back.append(link)
            need = LEAST_ALONE * max(i1 - top[1], j1 - top[2]) if alone else LEAST_MATCH * (i1 - top[1])
            if top[3] and min(i1 - top[1], j1 - top[2]) >= self.run and top[0] >= need:
                words, p = [], n
                while p >= 0:
                    words += [parts[p][3], back[p][1]]
                    p = back[p][0]
                out.append((top[0], i1 - top[1], top[2], j1, words[::-1]))
        return out

    def verified(self, item: np.ndarray, doc: np.ndarray, at: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, Chain]]:
        """(document, item id, chain) of the candidates that hold; pieces of one item near each other are gone through together."""
        if not len(item):
            return []
        wide = 2 * self.run
        a, z = np.maximum(begin[doc], at - wide), np.minimum(end[doc], at + 2 * HALF + SHINGLE + wide)
        new = np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (a[1:] > z[:-1]))
        item, doc, a, z = item[new], doc[new], a[new], z[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
        out = []
        for found in self.runs(item, a, z, words):
            good = self.promising(found)
            found = self.alone(found[:, np.isin(found[0], good)], item, a, z, words)
            lo, hi = np.searchsorted(found[0], good, "left"), np.searchsorted(found[0], good, "right")
            for k, x, y in zip(good.tolist(), lo, hi):
                d = int(doc[k])
                j = int(begin[d])
                parts = list(zip(found[1, x:y].tolist(), found[2, x:y].tolist(), (found[3, x:y] - j).tolist(), (found[4, x:y] - j).tolist()))
                whole = self.chains([p for p in parts if p[1] - p[0] > 1])
                out += [(d, int(self.ids[item[k]]), chain) for chain in (*whole, *self.chains(parts, True))]
        return out


class Search:
    """Holds texts against all parts of an index, cutting them into words once."""

    def __init__(self, parts: list[Index]) -> None:
        self.cut, self.parts = Words(), parts

    def leaks(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its leaks: (item, item words spanned, matched words)."""
        out: list[list[tuple[int, int, int]]] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t) + 1
            if size >= TOGETHER:
                out += self._group(group)
                group, size = [], 0
        return out + (self._group(group) if group else [])

    def _group(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        codes = [self.cut.codes(t) for t in texts]
        gap = np.array([10], np.uint32)  # a line break parts the texts
        h, start, _ = self.cut.spans(np.concatenate([x for c in codes for x in (c, gap)]))
        last = np.cumsum([len(c) + 1 for c in codes])
        doc = np.searchsorted(last, start, "right")
        end = np.searchsorted(doc, np.arange(len(texts)), "right")
        begin = np.concatenate([[0], end[:-1]])
        s = shingles(h, SHINGLE)
        inside = doc[: len(s)] == doc[SHINGLE - 1 : SHINGLE - 1 + len(s)]
        found: list[list[tuple[int, Chain]]] = [[] for _ in texts]
        for part in self.parts:
            at = part.kept(s)
            at = at[inside[at]]
            for d, item, chain in part.verified(*part.candidates(at, s[at], doc[at], begin), h, begin, end):
                found[d].append((item, chain))
        return [settled(f) if f else [] for f in found]


def written_index(items: DataFrame, run: int, item_id: str, text: str) -> list[str]:
    """Names of the index's parts, each written to the shared folder and sent to the executors; items go through the driver part by part."""
    context = items.sparkSession.sparkContext
    rows = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    names: list[str] = []
    held: list[tuple[int, str]] = []

    def part() -> None:
        name = f"leaks-{uuid.uuid4().hex}.index"
        uri = f"{shared_dir(items.sparkSession)}/{name}"
        uri = uri if "://" in uri else f"file://{uri}"
        Index(held, run).save(uri)
        context.addFile(uri)
        names.append(name)
        held.clear()

    for r in rows.toLocalIterator():
        held.append((r["i"], r["t"]))
        if len(held) >= BLOCK:
            part()
    if held:
        part()
    return names


def leaked(documents: DataFrame, items: DataFrame, run: int = 12, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, doc_id, span, matched): documents that hold at least `run` words of an item in sequence, at most lightly altered."""
    kinds = f"item_id bigint, doc_id {dict(documents.dtypes)[doc_id]}, span bigint, matched bigint"
    base = documents.select(F.col(f"`{doc_id}`").alias("_i"), F.col(f"`{text}`").alias("_t")).where("_t IS NOT NULL AND _t <> ''")
    names = written_index(items, run, item_id, text)

    def run_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search([Index.load(SparkFiles.get(n)) for n in names])
        for batch in batches:
            found = [(item, i, span, m) for i, leaks in zip(batch["_i"], search.leaks(list(batch["_t"]))) for item, span, m in leaks]
            yield pd.DataFrame(found, columns=["item_id", "doc_id", "span", "matched"])

    return spread(base).mapInPandas(run_pass, kinds).withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})
