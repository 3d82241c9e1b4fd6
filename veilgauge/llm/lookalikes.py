"""One consistent form for texts that look the same but are stored with different characters.

1. Invisible characters are dropped, compatibility forms folded (NFKC: full
   width, ligatures, kinds of space, combining accents) and hyphen variants
   unified. Letters, digits, case and accents stay as they are.
2. Script-aware repair: tokens that mix scripts, or that stand wholly in
   look-alike letters of a script foreign to their text, give candidates in
   their dominant script, then in the dominant script of the text. A candidate
   is taken only if the corpus vocabulary has it as a token written in one
   script anywhere.

The vocabulary is distributed and joined with the candidates by hash; nothing
of it reaches the driver or is broadcast.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.session import cut

# Letters of other scripts with the Latin letter they look like.
CYRILLIC_LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ѵ": "v", "ӏ": "l",
}
GREEK_LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y",
}
_HYPHENS = dict.fromkeys("‐‑‒−", "-")

_TO = {"latin": CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES}
_TO["cyrillic"] = {v: k for k, v in CYRILLIC_LOOKALIKES.items()} | {g: c for g, v in GREEK_LOOKALIKES.items() for c, w in CYRILLIC_LOOKALIKES.items() if v == w}
_TO["greek"] = {v: k for k, v in GREEK_LOOKALIKES.items()} | {c: g for c, v in CYRILLIC_LOOKALIKES.items() for g, w in GREEK_LOOKALIKES.items() if v == w}
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯ])*")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")


def folded(text: str) -> str:
    """Step 1 for one text."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).translate(str.maketrans(_HYPHENS))


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin" if ch.isalpha() else ""
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "greek" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else ("other" if ch.isalpha() else "")


def _counts(text: str) -> dict[str, int]:
    n: dict[str, int] = {}
    for ch in text:
        if s := _script(ch):
            n[s] = n.get(s, 0) + 1
    return n


def candidates(text: str) -> list[tuple[str, str, int]]:
    """(token, repaired, rank) for the tokens of a folded text that may need repair."""
    if text.isascii():
        return []
    found, whole = {}, None
    for m in _TOKEN.finditer(text):
        token = m.group()
        if token.isascii() or token in found:
            continue
        n = _counts(token)
        if not set(n) - {"latin"} or "other" in n:
            continue
        if whole is None:
            whole = max((w := _counts(text)), key=lambda s: (w[s], s == "latin"))
        own = max(n, key=lambda s: (n[s], s == whole))
        if len(n) == 1 and own == whole:
            continue
        ways = []
        for target in dict.fromkeys((own, whole)):
            if target not in _TO:
                continue
            out = unicodedata.normalize("NFC", "".join(ch if _script(ch) in ("", target) else _TO[target].get(ch, "\0") for ch in token))
            if "\0" not in out and out != token:
                ways.append(out)
        found[token] = ways
    return [(t, w, k) for t, ways in found.items() for k, w in enumerate(ways)]


def _prepare(texts: pd.Series) -> pd.DataFrame:
    forms = [None if t is None else folded(t) for t in texts]
    return pd.DataFrame({"form": forms, "ways": [[] if f is None else [{"token": t, "repaired": w, "rank": k} for t, w, k in candidates(f)] for f in forms]})


def _replace(forms: pd.Series, pairs: pd.Series) -> pd.Series:
    out = []
    for form, own in zip(forms, pairs):
        if form is not None and own is not None and len(own):
            to = {p["token"]: p["repaired"] for p in own}
            form = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: to.get(m.group(), m.group()), form))
        out.append(form)
    return pd.Series(out)


def consistent_form(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, text, form): every text with its consistent form; ids must be unique.

    Null texts have a null form, empty texts an empty one. Other columns are
    not carried along, so their names cannot clash.
    """
    prepare = F.pandas_udf(_prepare, "struct<form:string,ways:array<struct<token:string,repaired:string,rank:int>>>")
    replace = F.pandas_udf(_replace, "string")
    base = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    # written once: every text goes through Python in one pass
    ready = cut(base.select("_id", "_text", F.explode(F.array(prepare("_text"))).alias("_p")).select("_id", "_text", "_p.form", "_p.ways"))
    ways = ready.where(F.size("ways") > 0).select("_id", F.explode("ways").alias("w")).select("_id", "w.token", "w.repaired", "w.rank")
    wanted = ways.select("repaired").distinct()
    tokens = ready.select(F.explode(F.split(F.lower("form"), r"[^\p{L}\p{M}\p{N}]+")).alias("word"))
    one_script = F.col("word").rlike(r"^(?:[\p{IsLatin}\p{N}\p{M}]+|[\p{IsCyrillic}\p{N}\p{M}]+|[\p{IsGreek}\p{N}\p{M}]+)$")
    vocabulary = tokens.where("word <> ''").distinct().where(one_script)
    known = wanted.join(vocabulary, F.lower(wanted["repaired"]) == vocabulary["word"], "left_semi")
    best = ways.join(known, "repaired").groupBy("_id", "token").agg(F.min_by("repaired", "rank").alias("repaired"))
    per_row = cut(best.groupBy("_id").agg(F.collect_list(F.struct("token", "repaired")).alias("pairs")))  # no more than a text has tokens
    changed = ready.join(per_row, "_id").select("_id", "_text", replace("form", "pairs").alias("form"))
    same = ready.join(per_row, "_id", "left_anti").select("_id", "_text", "form")
    return same.unionByName(changed).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "form")


def _hashes(c: str, name: str) -> list[Column]:
    """Two independent 64-bit hashes: equal for different strings with a chance of about 2^-128, and far shorter to shuffle than texts."""
    return [F.xxhash64(F.lit(k), F.col(c)).alias(f"{name}{k}") for k in (1, 2)]


def alike_pairs(forms: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Pairs of rows with one form but different strings, smaller id first.

    Only rows of a form with at least two strings are gone on with. Different
    strings of a form are paired first and only then expanded to their rows,
    so copies of one string are never compared with each other. Forms and
    strings are compared by 128-bit hashes. Equal strings make no pair; null
    and empty texts make none.
    """
    rows = cut(forms.where("form <> ''").select(F.col(id_col).alias("_i"), *_hashes(text_col, "t"), *_hashes("form", "f")))
    text = F.struct("t1", "t2")
    several = rows.groupBy("f1", "f2").agg(F.min(text).alias("a"), F.max(text).alias("z")).where("a <> z").select("f1", "f2")
    rows = cut(rows.join(several, ["f1", "f2"], "left_semi"))
    strings = rows.select("f1", "f2", "t1", "t2").distinct()
    other = strings.withColumnsRenamed({"t1": "u1", "t2": "u2"})
    different = strings.join(other, ["f1", "f2"]).where(F.struct("t1", "t2") < F.struct("u1", "u2")).select("t1", "t2", "u1", "u2")
    left = rows.select("_i", "t1", "t2").join(different, ["t1", "t2"]).select("_i", "u1", "u2")
    both = left.join(rows.select(F.col("_i").alias("_j"), F.col("t1").alias("u1"), F.col("t2").alias("u2")), ["u1", "u2"])
    return both.select(F.least("_i", "_j").alias(f"{id_col}_a"), F.greatest("_i", "_j").alias(f"{id_col}_b"))


def classes(forms: DataFrame, id_col: str) -> DataFrame:
    """(id, class_id, n_rows, n_spellings): rows of one form share a class, named by its smallest id."""
    sizes = forms.where("form <> ''").groupBy("form").agg(F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("text").alias("n_spellings"))
    return forms.select(id_col, "form").join(sizes, "form").select(id_col, "class_id", "n_rows", "n_spellings")
