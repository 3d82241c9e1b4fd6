"""Per-document text quality statistics, sketched per language, with tails flagged as not running prose.

Statistics come from one vectorised pass over the code points of each text (an
Arrow UDF on numpy arrays; no loop over words). Their distributions are kept
as mergeable KLL quantile sketches per language, so any number of partitions
or loads can be merged. Each statistic becomes a robust z-score (distance to
the language's median in units of its interquartile range over 1.349, with a
stated least unit), and documents far out on the bad side of a statistic are
flagged. Medians and units of a language are drawn towards those of all
languages as if these had PRIOR_DOCUMENTS documents, so a language with few
documents is measured mostly by the others, and nothing changes suddenly with
their number.

Null and empty texts have zero counts and null ratios and are flagged as they
hold no prose. Repeated texts are measured alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.session import spread

# Common words by language.
COMMON_WORDS = {
    "en": "the of and to a in is was for that it with as on be at by i he she they we you my your his her their this not are have has had but or from after before about there which an were so if what do does did how when why who than then no been will can may all any me him them out up would could should our us who into over more most only because since until while though although let just also very some one once again please".split(),
    "es": "de la que el en y a los del se las por un con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está mi porque qué tu te cómo cada donde dónde hace llevo nos cuál ni esa ese eso hay usted puede unos unas uno fueron he tan así aunque mucho mucha nadie".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir ihr wenn kann dann unter gegen schon was doch diese dieser mich mir uns hatte keine weil wo sehr immer wieder ihre ihren seine seinen".split(),
    "fr": "le la les de des du un une et en à est que qui dans pour par sur au aux ce cette ces il elle on nous vous ils elles je tu ne pas plus se sa son ses leur leurs avec sans mais ou où donc comme si tout tous très bien été être avoir a ont sont était avait fait lui y même aussi après avant chez entre encore quand depuis peu moi mon ma mes votre notre dont cela".split(),
    "pt": "o a os as de do da dos das em no na nos nas um uma uns umas e que é para por com não se ao aos à às mais mas como foi ele ela eles elas eu você nós lhe me seu sua seus suas ou quando muito já também só pelo pela até isso isto ser são está era tem tinha há sem mesmo depois ainda entre sobre porque onde ter minha meu este esta esse essa foram nem".split(),
    "it": "il lo la i gli le di del della dei delle dello a al alla ai alle da dal dalla in nel nella un uno una e è che non per con su sul sulla si se ma come più anche ci mi ti ha ho hanno sono era erano questo questa quello quella suo sua suoi loro io lui lei noi voi essere stato fatto o quando dove chi cui perché molto già ancora dopo prima tutto tutti".split(),
    "nl": "de het een en van in is dat op te voor met zijn die niet aan er om ook als dan maar bij nog uit naar door over ze hij zij wij je ik we hebben heeft had was werd worden wordt kan kon geen meer wel zo tot tegen na al of deze dit daar hier toen haar hun mijn ons zou moet veel waar omdat wat wie onder".split(),
}
COMMON_HAN = "的一是不了在人有我他这们来到时大地为子中你说生国年着就那和要她出也得里后自以会家可下而过天去能对小多然于心学么之都好看起发当没成只如事把还用第样道想作种开手十用主行方又如前所本见经头面公同三已老从动两长知民间什最分将二问间吗呢吧请您给被让向关但因或"

#: Languages whose common words are told apart from those of texts in any other language of the list: a text counts as one of the
#: others only with so many times their common words.
MAIN, CLEARLY = ("en", "es"), 1.2
#: Every statistic is sketched and scored: least unit of the z-score (so that a statistic that hardly varies in prose doesn't
#: flag trifles), and the units from which on a document is flagged below and above (None: that side is no fault of prose).
TAILS = {
    "common_share": (0.045, 6.0, 4.0),
    "prose_share": (0.08, 5.0, None),
    "symbol_ratio": (0.004, None, 6.0),
    "digit_ratio": (0.02, None, 10.0),
    "word_variety": (0.30, 5.0, None),
    "mark_ratio": (0.05, None, 5.0),
    "n_words": (1.0, None, None),
    "mean_word_length": (0.1, None, None),
    "line_end_punct": (0.05, None, None),
}
#: A language's centres and units count as many documents as it has, those of all languages as this many.
PRIOR_DOCUMENTS = 30
STATS = tuple(TAILS)

_LETTER, _DIGIT, _SPACE, _BREAK, _END, _PUNCT, _HAN, _SYMBOL, _MARK, _BAR = range(10)
_B = np.uint64(1_000_003)


def _table() -> np.ndarray:
    import unicodedata

    kinds = np.full(0x20000, _SYMBOL, np.uint8)
    for o in range(0x20000):
        ch, cat = chr(o), unicodedata.category(chr(o))
        if cat[0] == "L":
            kinds[o] = _LETTER
        elif cat[0] == "M" or cat == "Cf":
            kinds[o] = _MARK
        elif cat == "Nd":
            kinds[o] = _DIGIT
        elif ch in "\n\r  \x0b\x0c":
            kinds[o] = _BREAK
        elif cat == "Zs" or ch == "\t":
            kinds[o] = _SPACE
        elif ch in ".?!。？！…":
            kinds[o] = _END
        elif ch in ",;:'\"()-¿¡’‘“”，；：、（）—–‐‑/&%@+[]":
            kinds[o] = _PUNCT
    kinds[0x3400:0xA000] = _HAN
    for ch in "|\t•·*<>":
        kinds[ord(ch)] = _BAR
    for ch in "¬©³ÃÂ¤§€±¡":  # letters and signs that wrongly decoded bytes leave
        if ch not in "¡":
            kinds[ord(ch)] = _SYMBOL
    return kinds


def _lower_table() -> np.ndarray:
    from veilgauge.llm.lookalikes import CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES

    low = np.arange(0x20000, dtype=np.uint64)
    for o in range(0x3000):
        s = chr(o).lower()
        if len(s) == 1:
            low[o] = ord(s)
    for o in range(0xFF01, 0xFF5F):
        low[o] = ord(chr(o - 0xFEE0).lower())
    for k, v in (CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES).items():
        low[ord(k)] = ord(v.lower())
    return low


def _word_hash(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        h = 0
        for k, ch in enumerate(w):
            h = (h + ord(ch) * pow(int(_B), k, 1 << 64)) % (1 << 64)
        out.append(h)
    return np.sort(np.array(out, np.uint64))


class Measure:
    """Statistics of single texts; the tables are made once for each Python worker."""

    def __init__(self) -> None:
        self.kinds, self.low = _table(), _lower_table()
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, _B, np.uint64)]))
        # the words of all languages in one table, each with the languages that have it as bits
        self.langs = list(COMMON_WORDS)
        bits: dict[int, int] = {}
        for k, words in enumerate(COMMON_WORDS.values()):
            for h in _word_hash(words).tolist():
                bits[h] = bits.get(h, 0) | 1 << k
        self.words = np.array(sorted(bits), np.uint64)
        self.bits = np.array([bits[h] for h in sorted(bits)], np.uint8)
        self.having = (np.arange(1 << len(self.langs))[:, None] >> np.arange(len(self.langs))) & 1
        self.main = sum(1 << self.langs.index(k) for k in MAIN)
        self.han = np.zeros(0x20000, bool)
        self.han[[ord(c) for c in COMMON_HAN]] = True
        self.marks = np.array([ord(c) for c in ",;:|\t"], np.uint32)

    def _languages(self, h: np.ndarray) -> np.ndarray:
        """For each word the languages of which it is a common word, as bits."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.bits[at], 0)

    def _language(self, own: np.ndarray, length: np.ndarray) -> str:
        """The language most of whose common words stand in the text; `und` if too few of any do."""
        hits = dict(zip(self.langs, (np.bincount(own[length > 1], minlength=len(self.having)) @ self.having).tolist()))
        lang = max(MAIN, key=lambda k: hits[k])
        other = max(hits, key=lambda k: hits[k])
        if other not in MAIN and hits[other] > CLEARLY * hits[lang]:
            lang = other
        return lang if len(own) and hits[lang] >= 0.1 * len(own) else "und"

    def __call__(self, text: str | None) -> tuple:
        if not text:
            return (0, 0, "und", None, None, None, 0, None, None, None, None, None)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.minimum(codes, 0x1FFFF)
        kind = self.kinds[codes]
        n = len(codes)
        seen = max(1, int(np.count_nonzero((kind != _SPACE) & (kind != _BREAK))))
        symbol = np.count_nonzero((kind == _SYMBOL) | (kind == _BAR)) / seen
        digit = np.count_nonzero(kind == _DIGIT) / seen
        han = kind == _HAN
        in_word = (kind == _LETTER) | (kind == _MARK)
        edge = np.diff(np.concatenate([[False], in_word, [False]]).astype(np.int8))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        length = stop - start
        # word hashes: sums of code times power of the place in the word
        at = np.flatnonzero(in_word)
        if len(at):
            place = at - np.repeat(start, length)
            h = np.add.reduceat(self.low[codes[at]] * self.power[np.minimum(place, 63)], np.concatenate([[0], np.cumsum(length)[:-1]]))
        else:
            h = np.zeros(0, np.uint64)
        where_han = np.flatnonzero(han)
        bits = self._languages(h)
        lang = "zh" if len(where_han) > 0.2 * seen else self._language(bits, length)
        either = bits & (self.main if lang in (*MAIN, "und", "zh") else 1 << self.langs.index(lang)) != 0
        # units: words, and single Han characters
        unit_at = np.concatenate([start, where_han])
        common = np.concatenate([either, self.han[codes[where_han]]])
        own = np.concatenate([h, codes[where_han].astype(np.uint64)])
        order = np.argsort(unit_at, kind="stable")
        unit_at, common, own = unit_at[order], common[order], own[order]
        units = len(unit_at)
        # segments end at sentence ends before white space, at bars, and at line breaks before list marks or short lines
        nxt = np.concatenate([kind[1:], [_BREAK]])
        before = np.concatenate([[_BREAK], kind[:-1]])
        loose = (kind == _PUNCT) & (before == _SPACE) & (nxt == _SPACE)  # a slash or dash between spaces
        ends = ((kind == _END) & ((nxt == _SPACE) | (nxt == _BREAK) | (codes > 0x2FFF))) | (kind == _BAR) | loose
        breaks = np.flatnonzero(kind == _BREAK)
        line_start = np.concatenate([[0], breaks + 1])
        line_stop = np.concatenate([breaks, [n]])
        solid = np.flatnonzero((kind != _SPACE) & (kind != _BREAK))
        first = np.searchsorted(solid, line_start)
        full = (first < len(solid)) & (solid[np.minimum(first, len(solid) - 1)] < line_stop) if len(solid) else np.zeros(len(line_start), bool)
        n_lines = int(full.sum())
        end_punct = None
        if n_lines:
            last = solid[np.searchsorted(solid, line_stop[full]) - 1]
            end_punct = float(np.mean(kind[last] == _END))
            head = kind[solid[first[full]]]
            words_in = np.searchsorted(unit_at, line_stop[full]) - np.searchsorted(unit_at, line_start[full])
            marked = (head != _LETTER) & (head != _HAN)
            short = words_in < 5
            cut_at = line_start[full][marked | short]
            ends = ends.copy()
            ends[np.maximum(cut_at - 1, 0)] = True
            ends[np.minimum(line_stop[full][short], n - 1)] = True
        common_share = prose_share = variety = mean_len = marks = None
        if units:
            common_share = float(common.mean())
            mean_len = float(length.mean()) if len(length) else 1.0
            segment = np.cumsum(ends)[unit_at]
            segment = segment - segment[0]
            size = np.bincount(segment)
            good = np.bincount(segment, weights=common)
            prose = (size >= 5) & (good >= 0.18 * size)
            prose_share = float(size[prose].sum() / units)
            variety = float(np.log(len(np.unique(own)) / np.sqrt(units)))
            marks = float((np.isin(codes, self.marks).sum() + loose.sum()) / units)
        return (n, units, lang, mean_len, symbol, digit, n_lines, end_punct, common_share, prose_share, variety, marks)


_SCHEMA = "n_chars bigint, n_words bigint, lang_found string, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines bigint, line_end_punct double, common_share double, prose_share double, word_variety double, mark_ratio double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics) for each row of `df`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = Measure()
        for batch in batches:
            rows = [measure(t) for t in batch["_t"]]
            yield pd.concat([batch[["_i"]], pd.DataFrame(rows, columns=_NAMES, index=batch.index)], axis=1)

    kind = dict(df.dtypes)[id_col]
    out = spread(df.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text_col}`").alias("_t"))).mapInPandas(run, f"_i {kind}, {_SCHEMA}")
    return out.withColumnRenamed("_i", id_col)


def sketches(stats: DataFrame, k: int = 400) -> DataFrame:
    """(lang_found, statistic, sketch): mergeable KLL sketches of each statistic per language, and of all languages under `all`.

    Each task keeps one sketch per language and statistic, so a language that
    holds most rows costs no more than any other.
    """
    long = stats.select("lang_found", F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("x")) for s in STATS])).alias("e")).select("lang_found", "e.*").where("x IS NOT NULL")
    own = long.where("lang_found <> 'und'").groupBy("lang_found", "statistic").agg(F.expr(f"kll_sketch_agg_double(x, {k})").alias("sketch"))
    pooled = own.groupBy("statistic").agg(F.expr(f"kll_merge_agg_double(sketch, {k})").alias("sketch")).select(F.lit("all").alias("lang_found"), "statistic", "sketch")
    return own.unionByName(pooled)


def references(sketch: DataFrame) -> DataFrame:
    """(lang_found, n, and per statistic its centre c_ and unit u_): one row per language."""
    quantile = lambda q: F.expr(f"kll_sketch_get_quantile_double(sketch, {q}D)")
    each = sketch.select("lang_found", "statistic", F.expr("kll_sketch_get_n_double(sketch)").alias("n"), quantile(0.5).alias("c"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("u"))
    take = lambda s, x: F.max(F.when(F.col("statistic") == s, F.col(x)))
    return each.groupBy("lang_found").agg(
        F.max("n").alias("n"), *[take(s, "c").alias(f"c_{s}") for s in STATS], *[F.greatest(take(s, "u"), F.lit(TAILS[s][0])).alias(f"u_{s}") for s in STATS]
    )


def scored(stats: DataFrame) -> DataFrame:
    """`stats` with z_ columns and `reasons`, the statistics in whose tail a document lies; `no words` where it has none.

    `stats` is read twice; have it cut before (`with_tails` does).
    """
    ref = references(sketches(stats))
    total = ref.where("lang_found = 'all'").drop("lang_found", "n")
    own = ref.where("lang_found <> 'all'")
    renamed = total.select(*[F.col(c).alias(f"all_{c}") for c in total.columns])
    # a row per language and one for all: never more rows than languages known here
    joined = stats.join(F.broadcast(own), "lang_found", "left").join(F.broadcast(renamed), F.lit(True), "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    towards = lambda c: (n * F.coalesce(c, F.lit(0.0)) + PRIOR_DOCUMENTS * F.col(f"all_{c}")) / (n + PRIOR_DOCUMENTS)
    z = {s: (F.col(s) - towards(f"c_{s}")) / towards(f"u_{s}") for s in STATS}
    tails = []
    for s, (_, below, above) in TAILS.items():
        if below is not None:
            tails.append(F.when(F.col(f"z_{s}") <= -below, f"{s} low"))
        if above is not None:
            tails.append(F.when(F.col(f"z_{s}") >= above, f"{s} high"))
    out = joined.select(*[stats[c] for c in stats.columns], *[v.alias(f"z_{s}") for s, v in z.items()])
    return out.withColumn("reasons", F.array_compact(F.array(F.when(F.col("n_words") == 0, "no words"), *tails)))


def with_tails(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, z-scores and reasons for each row of `df`; texts are read once."""
    from veilgauge.session import cut

    return scored(cut(document_statistics(df, id_col, text_col)))


def not_prose(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of documents that are no running prose."""
    return with_tails(df, id_col, text_col).where(F.size("reasons") > 0).select(id_col)
