"""Freely typed values mapped to a reference list by a partition-based (pigeonhole) edit-distance join. SQL only.

1. Values are counted first, so each different value is handled once however
   often it stands in the tables. Characters are folded (width, look-alike
   letters, accents, invisible characters, case, separators), and each value
   gets up to four wordings: as typed, with an inverted comma form turned
   round, and both without rank, working time, workplace, training or former
   status around a title.
2. A wording equal to a reference wording (entry, its alternative labels, and
   those of an optional table of usual wordings) maps at once.
3. For the rest, each reference wording of k allowed edits is cut into k+1
   segments. A value within k edits holds one of them unchanged at a place
   shifted by k at most, so segments and the values' substrings are joined by
   equality on (attribute, place, substring); `levenshtein` verifies.
4. Values without a match are found by an anti-join and reported as entry 0.

Ties go to the fewer edits, then to an entry before an alternative label, then to the
plainer wording, then to the smaller entry number. Nulls, blanks and markers for a missing value are no values.
The expressions are written so that Spark and DuckDB read them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.missing import MISSING_MARKERS
from veilgauge.llm.lookalikes import CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES

#: Attributes with a reference list.
ATTRIBUTES = ("occupation", "nationality", "education_level")

_INVISIBLE = "­͏؜​‌‍‎‏⁠﻿"
_WIDE = "".join(chr(0xFF01 + k) for k in range(94))
_NARROW = "".join(chr(0x21 + k) for k in range(94))
_ACCENTED = {"áàâäãåā": "a", "éèêëē": "e", "íìîïī": "i", "óòôöõøō": "o", "úùûüū": "u", "ñ": "n", "ç": "c", "ý": "y", "š": "s", "ž": "z", "ł": "l"}
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t\r\n"

_RANK = "senior|junior|snr|sr|jnr|jr|lead|leading|principal|chief|head|deputy|acting|interim|trainee|student|apprentice|graduate|newly qualified|qualified|ex|former|formerly|previously|retired|semi retired|currently|now|a|an|the|part time|full time|freelance|self employed|locum|agency|temporary|temp|works as|working as|employed as|i am"
_AFTER = "part time|full time|retired|trainee|in training|temporary|freelance|on leave|ret|apprentice|i|ii|iii"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace(c: str, pattern: str, by: str, dialect: str) -> str:
    # Spark reads backslashes in SQL strings as escapes
    p, b = (pattern.replace("\\", "\\\\"), by.replace("\\", "\\\\")) if dialect == "spark" else (pattern, by.replace("$", "\\"))
    return f"regexp_replace({c}, {_quote(p)}, {_quote(b)}{', ' + _quote('g') if dialect == 'duckdb' else ''})"


def folded(c: str, dialect: str) -> str:
    """`c` in lower case with one form for characters that look alike."""
    source, target = _WIDE, _NARROW
    for k, v in (CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES).items():
        source, target = source + k, target + v
    for s in _SPACES:
        source, target = source + s, target + " "
    accents = "".join(_ACCENTED)
    plain = "".join(v * len(k) for k, v in _ACCENTED.items())
    hidden = _replace(c, f"[{_INVISIBLE}̀-ͯ]", "", dialect)
    esc = (lambda s: s.replace("\\", "\\\\").replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n")) if dialect == "spark" else (lambda s: s)
    return f"translate(lower(translate({hidden}, {_quote(esc(source))}, {_quote(esc(target))})), {_quote(accents)}, {_quote(plain)})"


def cleaned(c: str, dialect: str) -> str:
    """A folded `c` as words with single spaces."""
    dots = _replace(c, "[.'’]", "", dialect)
    return f"trim({_replace(dots, '[^a-z0-9]+', ' ', dialect)})"


def turned(c: str, dialect: str) -> str:
    """`operative, warehouse` as `warehouse operative`."""
    return _replace(c, r"^\s*([^,]+),\s*([^,]+?)[\s.]*$", "$2 $1", dialect)


def bare(c: str, dialect: str) -> str:
    """A folded `c` without what stands around a title."""
    cut = _replace(c, r"\([^)]*\)|\s+/.*$|\s+-\s.*$|[\s,]+(at|with|for) (a|an|the|my|our)? ?[^,]*$", " ", dialect)
    words = cleaned(cut, dialect)
    front = _replace(words, rf"^((?:{_RANK}) )+", "", dialect)
    return f"trim({_replace(front, rf'( (?:{_AFTER}))+$', '', dialect)})"


def wordings(c: str, dialect: str) -> list[str]:
    """The wordings tried for a value, plainest first; `c` is already folded."""
    return [cleaned(c, dialect), cleaned(turned(c, dialect), dialect), bare(c, dialect), bare(turned(c, dialect), dialect)]


def missing(c: str) -> str:
    """True where the folded, trimmed `c` is blank or a marker for a missing value."""
    marks = ", ".join(_quote(m) for m in MISSING_MARKERS)
    return f"(trim({c}) = '' OR trim({c}) IN ({marks}))"


def edits(length: str) -> str:
    """Allowed edits k for a reference wording of this length."""
    return f"(CASE WHEN {length} < 4 THEN 0 WHEN {length} < 12 THEN 2 ELSE 4 END)"


def accepted(length: str, distance: str, same_letters: str, alt: str) -> str:
    """Whether a distance is near enough: about one slip of the hand, two from 12 letters on.

    A swap of two letters counts as two edits, so more edits are allowed where
    both strings have the same letters.
    """
    return (
        f"(CASE WHEN {length} < 4 OR ({alt} AND {length} < 6) THEN {distance} = 0 WHEN {length} < 10 THEN {distance} <= 1 OR ({distance} = 2 AND {same_letters}) "
        f"WHEN {length} < 12 THEN {distance} <= 2 ELSE {distance} <= 3 OR {same_letters} END)"
    )


def reference(entries: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(attribute, ref_id, wording, alt): every wording of the reference list and of `more` (attribute, wording, canonical_value), cleaned; wordings that two entries share go to the smaller number."""
    own = entries.select("attribute", "ref_id", F.col("canonical_value").alias("w"), F.lit(False).alias("alt"))
    labels = entries.select("attribute", "ref_id", F.explode("alt_labels").alias("w"), F.lit(True).alias("alt"))
    every = own.unionByName(labels)
    if more is not None:
        every = every.unionByName(more.withColumnRenamed("wording", "w").join(entries.select("attribute", "canonical_value", "ref_id"), ["attribute", "canonical_value"]).select("attribute", "ref_id", "w", F.lit(True).alias("alt")))
    every = every.where("w IS NOT NULL").select("attribute", "ref_id", F.expr(cleaned(folded("w", "spark"), "spark")).alias("wording"), "alt")
    return every.where("wording <> ''").groupBy("attribute", "wording").agg(F.min_by(F.struct("ref_id", "alt"), F.struct("alt", "ref_id")).alias("x")).select("attribute", "wording", "x.ref_id", "x.alt")


def mapped(values: DataFrame, entries: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(attribute, value, ref_id) for each different (attribute, value) of `values`; ref_id 0 where no entry fits.

    Values that are missing have no row. `values` may repeat; it is made
    distinct before anything else, with partial aggregation.
    """
    from veilgauge.session import cut

    typed = values.where("value IS NOT NULL").select("attribute", "value").distinct().withColumn("f", F.expr(folded("value", "spark")))
    typed = cut(typed.where(f"NOT {missing('f')}"))
    ref = cut(reference(entries, more))
    forms = F.array(*[F.expr(w) for w in wordings("f", "spark")])
    tried = cut(typed.select("attribute", "value", F.posexplode(forms).alias("rank", "form")).where("form <> ''").groupBy("attribute", "value", "form").agg(F.min("rank").alias("rank")))
    exact = tried.join(ref.withColumnRenamed("wording", "form"), ["attribute", "form"]).select("attribute", "value", "ref_id", F.lit(0).alias("distance"), "rank")
    done = exact.select("attribute", "value").distinct()
    left = tried.join(done, ["attribute", "value"], "left_anti").select("attribute", "form").distinct()
    # reference side: k+1 segments at all shifted places
    cutup = ref.withColumn("n", F.length("wording")).withColumn("k", F.expr(edits("n"))).where("k > 0")
    cutup = cutup.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).selectExpr("*", "CAST(floor(i * n / (k + 1)) AS INT) AS s", "CAST(floor((i + 1) * n / (k + 1)) AS INT) AS e")
    lengths = sorted(r["seg"] for r in cutup.selectExpr("e - s AS seg").where("seg > 0").distinct().collect())  # no more than the longest wording has characters
    cutup = cutup.withColumn("d", F.explode(F.sequence(-F.col("k"), F.col("k")))).selectExpr("attribute", "wording", "ref_id", "alt", "n", "k", "s + d AS place", "e - s AS seg", "substring(wording, s + 1, e - s) AS piece").where("place >= 0 AND seg > 0")
    sizes = F.array(*[F.lit(x) for x in lengths] or [F.lit(0)])
    pieces = left.withColumn("m", F.length("form")).withColumn("seg", F.explode(sizes)).where("seg > 0 AND seg <= m").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("seg"))))
    pieces = pieces.selectExpr("attribute", "form", "m", "seg", "place", "substring(form, place + 1, seg) AS piece")
    used = cutup.select("attribute", "seg", "place", "piece").distinct()
    pieces = pieces.join(used, ["attribute", "seg", "place", "piece"], "left_semi")
    near = pieces.join(cutup, ["attribute", "seg", "place", "piece"]).where("abs(m - n) <= k").select("attribute", "form", "wording", "ref_id", "alt", "n", "k").distinct()
    near = near.withColumn("distance", F.expr("levenshtein(form, wording, k)")).where("distance >= 0")
    letters = "array_sort(split(replace(form, ' ', ''), '')) = array_sort(split(replace(wording, ' ', ''), ''))"
    near = near.where(accepted("n", "distance", f"({letters})", "alt")).select("attribute", "form", "ref_id", "distance", "alt")
    fuzzy = tried.join(near, ["attribute", "form"]).select("attribute", "value", "ref_id", "distance", "alt", "rank")
    best = exact.withColumn("alt", F.lit(False)).unionByName(fuzzy).groupBy("attribute", "value").agg(F.min_by("ref_id", F.struct("distance", "alt", "rank", "ref_id")).alias("ref_id"))
    none = typed.select("attribute", "value").join(best, ["attribute", "value"], "left_anti").select("attribute", "value", F.lit(0).cast("bigint").alias("ref_id"))
    return best.unionByName(none)


def mapped_rows(rows: DataFrame, entries: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """`rows` (src_table, row_id, item_no, attribute, value) with ref_id; missing values have no row.

    The mapping has one row for each different value; a value that a third of
    all rows share is spread by AQE's skew join or, the mapping being small,
    joined by broadcast when Spark finds it below its measured size threshold.
    """
    found = mapped(rows.select("attribute", "value"), entries, more)
    return rows.join(found, ["attribute", "value"]).select("src_table", "row_id", "item_no", "attribute", "value", "ref_id")


def typed_values(inferred: DataFrame, results: DataFrame, cells: DataFrame, entries: DataFrame) -> DataFrame:
    """(src_table, row_id, item_no, attribute, value): every typed value of the three attributes.

    `inferred`: attr_id, attribute, inferred_value. `results`: result_id and
    elements such as `attribute=value`. `cells`: cell_id and occupation, only
    those that are not literally an entry.
    """
    one = F.lit(1).cast("int")
    a = inferred.where(F.col("attribute").isin(*ATTRIBUTES)).select(F.lit("inferred_attributes").alias("src_table"), F.col("attr_id").alias("row_id"), one.alias("item_no"), "attribute", F.col("inferred_value").alias("value"))
    items = results.select("result_id", F.posexplode("unmatched_quasi_identifiers").alias("k", "x")).where("instr(x, '=') > 0")
    b = items.selectExpr("'score_results' AS src_table", "result_id AS row_id", "CAST(k + 1 AS INT) AS item_no", "trim(substring_index(x, '=', 1)) AS attribute", "substring(x, instr(x, '=') + 1) AS value").where(F.col("attribute").isin(*ATTRIBUTES))
    literal = entries.where("attribute = 'occupation'").select(F.col("canonical_value").alias("occupation")).distinct()
    c = cells.where("occupation IS NOT NULL").join(literal, "occupation", "left_anti").select(F.lit("cross_tab").alias("src_table"), F.col("cell_id").alias("row_id"), one.alias("item_no"), F.lit("occupation").alias("attribute"), F.col("occupation").alias("value"))
    return a.unionByName(b).unionByName(c)


def duckdb_sql(synonyms: dict[str, dict[str, str]]) -> str:
    """The mapping of all typed values as DuckDB SQL, by comparing every value with every reference wording."""
    more = ", ".join(f"({_quote(a)}, {_quote(w)}, {_quote(v)})" for a, own in synonyms.items() for w, v in own.items())
    names = ", ".join(_quote(a) for a in ATTRIBUTES)
    forms = ", ".join(wordings("f", "duckdb"))
    wording = cleaned(folded("w", "duckdb"), "duckdb")
    letters = "list_sort(string_split(replace(form, ' ', ''), '')) = list_sort(string_split(replace(wording, ' ', ''), ''))"
    return f"""
WITH typed AS (
 SELECT 'inferred_attributes' AS src_table, attr_id AS row_id, 1 AS item_no, attribute, inferred_value AS value FROM inferred_attributes WHERE attribute IN ({names})
 UNION ALL SELECT 'score_results', result_id, k, trim(split_part(x, '=', 1)), substr(x, instr(x, '=') + 1) FROM (SELECT result_id, unnest(unmatched_quasi_identifiers) AS x, generate_subscripts(unmatched_quasi_identifiers, 1) AS k FROM score_results) WHERE instr(x, '=') > 0 AND trim(split_part(x, '=', 1)) IN ({names})
 UNION ALL SELECT 'cross_tab', cell_id, 1, 'occupation', occupation FROM cross_tab WHERE occupation NOT IN (SELECT canonical_value FROM canonical_values WHERE attribute = 'occupation')),
each AS (SELECT * FROM (SELECT attribute, value, {folded("value", "duckdb")} AS f FROM (SELECT DISTINCT attribute, value FROM typed WHERE value IS NOT NULL)) WHERE NOT {missing("f")}),
ref AS (SELECT attribute, wording, arg_min(ref_id, (alt, ref_id)) AS ref_id, min(alt) AS alt FROM (
 SELECT attribute, ref_id, alt, {wording} AS wording FROM (
  SELECT attribute, ref_id, canonical_value AS w, false AS alt FROM canonical_values
  UNION ALL SELECT attribute, ref_id, unnest(alt_labels), true FROM canonical_values
  UNION ALL SELECT attribute, ref_id, w, true FROM (VALUES {more}) AS s(attribute, w, canonical_value) JOIN canonical_values USING (attribute, canonical_value))) WHERE wording <> '' GROUP BY ALL),
tried AS (SELECT attribute, value, form, min(rank) AS rank FROM (SELECT attribute, value, unnest([{forms}]) AS form, unnest([0, 1, 2, 3]) AS rank FROM each) WHERE form <> '' GROUP BY ALL),
exact AS (SELECT tried.attribute, value, ref_id, 0 AS distance, false AS alt, rank FROM tried JOIN ref ON ref.attribute = tried.attribute AND wording = form),
near AS (SELECT attribute, value, ref_id, distance, alt, rank FROM (
 SELECT t.attribute, value, form, rank, ref_id, wording, alt, length(wording) AS n, levenshtein(form, wording) AS distance FROM tried t JOIN ref ON ref.attribute = t.attribute AND abs(length(form) - length(wording)) <= 4
 WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.attribute = t.attribute AND e.value = t.value))
 WHERE distance <= {edits("n")} AND {accepted("n", "distance", f"({letters})", "alt")}),
best AS (SELECT attribute, value, arg_min(ref_id, (distance, alt, rank, ref_id)) AS ref_id FROM (SELECT * FROM exact UNION ALL SELECT * FROM near) GROUP BY ALL)
SELECT src_table, row_id, CAST(item_no AS INT) AS item_no, coalesce(ref_id, 0) AS ref_id FROM typed JOIN each USING (attribute, value) LEFT JOIN best USING (attribute, value)"""
