"""String similarity and BLEU as Column expressions, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgauge.functions import vocabulary as V
from veilgauge.functions.missing import strip
from veilgauge.functions.text import let, lookup


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def jaro(left: Column, right: Column) -> Column:
    """Jaro similarity: 1 for equal strings, 0 if one is empty, null for a null.

    Each character of the left takes the first free equal one within reach on
    the right; characters taken out of order count as half transpositions.
    """

    def measured(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        n, m = F.size(a), F.size(b)
        reach = F.floor(F.greatest(n, m) / 2).cast("int") - 1
        places = F.sequence(F.lit(0), m - 1)

        def take(state: Column, i: Column) -> Column:
            fits = F.filter(places, lambda j: (j >= i - reach) & (j <= i + reach) & ~F.array_contains(state["used"], j) & (F.get(b, j) == F.get(a, i)))
            j = F.get(fits, F.lit(0))
            return F.when(j.isNull(), state).otherwise(F.struct(F.concat(state["used"], F.array(j)).alias("used"), F.concat(state["seen"], F.array(F.get(a, i))).alias("seen")))

        start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("seen"))
        done = F.aggregate(F.sequence(F.lit(0), n - 1), start, take)

        def value(s: Column) -> Column:
            k = F.size(s["used"])
            there = F.transform(F.array_sort(s["used"]), lambda j: F.get(b, j))
            moved = F.aggregate(F.zip_with(s["seen"], there, lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, x: t + x)
            half = F.floor(moved / 2)
            return F.when(k == 0, 0.0).otherwise((k / n + k / m + (k - half) / k) / 3.0)

        return F.when((n == 0) | (m == 0), 0.0).otherwise(let(done, value))

    return F.when(left == right, 1.0).when(left.isNotNull() & right.isNotNull(), let(F.struct(_chars(left).alias("a"), _chars(right).alias("b")), measured))


def jaro_winkler(left: Column, right: Column, scale: float = 0.1) -> Column:
    """Jaro with a boost for up to four equal first characters, whatever the similarity."""
    same = lambda k: (F.length(left) >= k) & (F.length(right) >= k) & (F.substring(left, 1, k) == F.substring(right, 1, k))
    prefix = F.when(same(4), 4).when(same(3), 3).when(same(2), 2).when(same(1), 1).otherwise(0)
    return let(jaro(left, right), lambda j: j + prefix * scale * (1.0 - j))


def comparable(attribute: Column, value: Column) -> Column:
    """A value as it is compared: digits only for numbers, else lower case with single spaces."""
    text = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(attribute.isin(*V.NUMERIC_EXACT), F.regexp_replace(text, r"\D+", "")).otherwise(F.regexp_replace(text, r"(?U)\s+", " "))


def is_correct_guess(attribute: Column, truth: Column, guess: Column) -> Column:
    """Numbers must be equal, other values similar enough for their attribute; empty values never are."""
    a, b = comparable(attribute, truth), comparable(attribute, guess)
    least = F.coalesce(lookup({k: str(v) for k, v in V.MATCH_THRESHOLD.items()}, attribute).cast("double"), F.lit(0.9))
    return F.when((a == "") | (b == ""), False).when(attribute.isin(*V.NUMERIC_EXACT), a == b).otherwise(jaro_winkler(a, b) >= least)


def _grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), "\x1f"))).otherwise(F.array().cast("array<string>"))


def bleu(reference: Column, candidate: Column, order: int = 4) -> Column:
    """Sentence BLEU over words with add-one smoothing and brevity penalty; 0 if either has no words.

    Clipped counts are those of a set intersection: the n-grams of a text are
    sorted and numbered among their equals, so a gram that stands three times
    on one side and twice on the other is shared twice.
    """
    words = lambda c: F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")

    def numbered(grams: Column) -> Column:
        """Every gram with its number among its equals."""

        def runs(a: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i - 1) != F.get(a, i)))
            length = lambda starts, s, k: F.coalesce(F.get(starts, k + 1), F.size(a)) - s
            run = lambda starts, s, k: F.transform(F.sequence(F.lit(1), length(starts, s, k)), lambda j: F.concat(F.get(a, s), F.lit("\x1e"), j.cast("string")))
            return let(starts, lambda own: F.flatten(F.transform(own, lambda s, k: run(own, s, k))))

        return let(F.array_sort(grams), lambda a: F.when(F.size(a) > 0, runs(a)).otherwise(a))

    def logs(p: Column) -> Column:
        out = F.lit(0.0)
        for n in range(1, order + 1):
            overlap = F.size(F.array_intersect(numbered(_grams(p["c"], n)), numbered(_grams(p["r"], n))))
            total = F.greatest(F.lit(1), F.size(p["c"]) - n + 1)
            out = out + F.log((overlap + 1) / (total + 1))
        penalty = F.when(F.size(p["c"]) > F.size(p["r"]), 0.0).otherwise(1 - F.size(p["r"]) / F.size(p["c"]))
        return F.when((F.size(p["r"]) == 0) | (F.size(p["c"]) == 0), 0.0).otherwise(F.exp(penalty + out / order))

    return let(F.struct(words(reference).alias("r"), words(candidate).alias("c")), logs)
