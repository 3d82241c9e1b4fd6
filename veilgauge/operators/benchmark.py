"""A benchmark of anonymisers: entries drawn from a population, transcripts, attacks, risk and utility."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.functions import vocabulary as V
from veilgauge.functions.similarity import bleu, is_correct_guess
from veilgauge.operators.anonymise import Anonymiser, default_set, guess
from veilgauge.registry import Registry

INDIRECT, DIRECT = V.BENCH_INDIRECT, V.BENCH_DIRECT


@dataclass(frozen=True)
class Profile:
    """How many entries with how many attributes, how rare their records, and the risk that counts as success."""

    name: str = "paper"
    n_records: int = 100
    n_indirect: int = 5
    n_direct: int = 1
    theta0: float = 0.9
    theta: float = 0.2
    seed: int = 7
    language: str = "en"


PROFILES = {"paper": Profile(), "production": Profile("production", 200, 5, 1, 0.8, 0.2, 42)}


def get_profile(name: str, **changes: object) -> Profile:
    key = name.strip().lower()
    if key not in PROFILES:
        raise ValueError(f"no such profile: {name}")
    return replace(PROFILES[key], **changes)


def _draw(seed: int, *parts: object) -> Column:
    """A number of at least 0 and below 1 that depends on the seed and the parts only, not on partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 40)) / float(1 << 40)


def targets(spark: SparkSession, profile: Profile) -> DataFrame:
    """(entry, scenario, difficulty, indirect, direct): what each entry is about. Direct attributes are left out of implicit entries."""
    s = profile.seed
    pick = lambda values, k: F.slice(F.transform(F.array_sort(F.transform(F.array(*[F.lit(v) for v in values]), lambda v: F.struct(F.xxhash64(F.lit(s), F.col("entry"), v).alias("h"), v.alias("v")))), lambda x: x["v"]), 1, k)
    one = lambda values, salt: F.get(F.array(*[F.lit(v) for v in values]), F.floor(_draw(s, F.col("entry"), salt) * len(values)).cast("int"))
    base = spark.range(profile.n_records).withColumnRenamed("id", "entry").withColumn("scenario", one(list(V.SCENARIOS), "scenario")).withColumn("difficulty", one(V.DIFFICULTIES, "difficulty"))
    return base.withColumn("indirect", pick(INDIRECT, profile.n_indirect)).withColumn("direct", F.when(F.col("difficulty") == "implicit", F.array().cast("array<string>")).otherwise(pick(DIRECT, profile.n_direct)))


#: Parts into which the classes of a set of attributes fall, so that a draw looks at one part only.
PARTS = 1024
#: Entries up to which their choices are sent to all tasks; more are joined by shuffle.
SHIPPED_ENTRIES = 100_000


def _mask(has) -> Column:
    return sum((F.when(has(a), 1 << i).otherwise(0) for i, a in enumerate(INDIRECT)), F.lit(0))


def _masked_key(values: dict[str, Column]) -> Column:
    """The values of the columns in `_m`, as one text."""
    shown = [F.when(F.col("_m").bitwiseAND(F.lit(1 << i)) != 0, F.concat(F.lit("="), F.coalesce(F.trim(values[a]), F.lit("")))).otherwise(F.lit("")) for i, a in enumerate(INDIRECT)]
    return F.concat_ws("\x1f", *shown)


def _classes(people: DataFrame, masks: list[int], row_id: str) -> DataFrame:
    """(row, _m, _h1, _h2): every person once for each set of attributes, with two hashes of the values in it."""
    each = people.select(F.col(f"`{row_id}`").alias("row"), *INDIRECT, F.explode(F.array(*[F.lit(m) for m in masks] or [F.lit(0)])).alias("_m"))
    key = _masked_key({a: F.col(a) for a in INDIRECT})
    return each.select("row", "_m", *[F.xxhash64(F.lit(k), F.col("_m"), key).alias(f"_h{k}") for k in (1, 2)])


def chosen_records(people: DataFrame, wanted: DataFrame, profile: Profile, row_id: str = "row_id") -> DataFrame:
    """A record for each entry: one that is rare enough in the entry's attributes, else one drawn by rarity.

    Drawn are classes, not people: of people who are rare enough each counts
    alike, so their classes weigh as many as they have; where nobody is, a
    record's chance is one over its class, so all classes weigh the same. The
    classes of a set of attributes fall into PARTS by hash; an entry draws a
    part by the parts' weights, a class in it, and a record in that. Nothing
    is compared with all people, and any number of entries may be drawn.
    """
    from veilgauge.session import cut

    asked = wanted.select("entry", _mask(lambda a: F.array_contains("indirect", a)).alias("_m"))
    masks = [r[0] for r in asked.select("_m").distinct().collect()]  # sets of nine attributes, 511 at most
    each = _classes(people, masks, row_id)
    order = F.xxhash64(F.lit(profile.seed), F.col("row"))
    classes = each.groupBy("_m", "_h1", "_h2").agg(F.count(F.lit(1)).alias("n"), F.max_by("row", order).alias("row"))
    fit = 1.0 / F.col("n") >= profile.theta0
    classes = cut(classes.withColumn("part", F.pmod("_h1", F.lit(PARTS)).cast("int")).withColumn("fit", F.when(fit, F.col("n")).otherwise(0)))
    parts = classes.groupBy("_m", "part").agg(F.sum("fit").alias("fit"), F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("_m").agg(F.array_sort(F.collect_list(F.struct("part", "fit", "n"))).alias("parts"))  # PARTS at most
    sums = sums.withColumn("any_fit", F.exists("parts", lambda p: p["fit"] > 0))
    weights = F.transform("parts", lambda p: F.when(F.col("any_fit"), p["fit"]).otherwise(p["n"]))
    sums = sums.select("_m", "any_fit", F.transform("parts", lambda p: p["part"]).alias("ids"), weights.alias("w"))
    running = F.aggregate("w", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    sums = sums.withColumn("upto", running)
    u = _draw(profile.seed, F.col("entry"), "part") * F.element_at("upto", -1)
    at = F.size(F.filter("upto", lambda c: c <= u)) - 1
    drawn = asked.join(sums, "_m").select("entry", "_m", "any_fit", F.get("ids", at).alias("part"))
    small = F.broadcast if profile.n_records <= SHIPPED_ENTRIES else lambda df: df
    own = classes.join(small(drawn), ["_m", "part"]).withColumn("w", F.when(F.col("any_fit"), F.col("fit")).otherwise(1)).where("w > 0")
    lot = F.log(F.greatest(_draw(profile.seed, F.col("entry"), F.col("_h1")), F.lit(1e-12))) / F.col("w")
    best = cut(own.groupBy("entry").agg(F.max_by(F.struct("_m", "_h1", "_h2", "n", "row"), F.struct(lot, F.col("_h1"))).alias("c")).select("entry", "c.*"))
    alone = best.where("n = 1").select("entry", F.col("row").alias(row_id))
    shared = small(best.where("n > 1").select("entry", "_m", "_h1", "_h2"))
    rows = each.join(shared, ["_m", "_h1", "_h2"]).groupBy("entry").agg(F.max_by("row", F.struct(F.xxhash64(F.lit(profile.seed), "entry", "row"), "row")).alias(row_id))
    return alone.unionByName(rows)


def direct_identifiers(entry: Column, gender: Column, occupation: Column, state: Column) -> dict[str, Column]:
    """Invented direct identifiers, by arithmetic on the entry's number."""
    first = F.when(F.lower(gender) == "male", "Alex").otherwise("Taylor")
    last = F.initcap(F.get(F.split(F.trim(occupation), r"\s+"), F.lit(0)))
    pad = lambda n, k: F.lpad(n.cast("bigint").cast("string"), k, "0")
    return {
        "name": F.concat_ws(" ", first, last),
        "ssn": F.concat_ws("-", pad(200 + entry % 700, 3), pad(10 + entry % 90, 2), pad(1000 + (entry * 17) % 9000, 4)),
        "credit_card": F.substring(F.concat(F.lit("4"), pad(entry + 12345678901234, 15)), 1, 16),
        "phone_number": F.concat(F.lit("("), F.when(F.lower(state) == "california", "415").otherwise("212"), F.lit(") "), (200 + entry % 700).cast("string"), F.lit("-"), pad(1000 + entry % 9000, 4)),
        "address": F.concat((100 + entry).cast("string"), F.lit(" Market Street, "), state),
        "email": F.concat(F.lower(first), F.lit("."), F.lower(last), (1980 + entry % 30).cast("string"), F.lit("@example.com")),
    }


def _hard(attribute: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D+", "")
    low = F.lower(value)
    return (
        F.when(attribute.isin("ssn", "credit_card", "phone_number"), F.trim(F.regexp_replace(digits, r"(\d{3})", "$1 ")))
        .when(attribute == "state_of_residence", F.when(low.contains("california"), "cali").otherwise(low))
        .when(attribute == "address", F.replace(F.replace(value, F.lit("Street"), F.lit("st")), F.lit("Avenue"), F.lit("ave")))
        .otherwise(value)
    )


def _hint(attribute: Column, value: Column) -> Column:
    low = F.lower(value)
    return (
        F.when((attribute == "state_of_residence") & low.contains("california"), "I usually take BART to commute.")
        .when((attribute == "marital_status") & low.contains("divorced"), "Things changed after we split up.")
        .when((attribute == "occupation") & low.contains("engineer"), "I spend my days debugging systems and designs.")
        .when(attribute == "date_of_birth", "I celebrated another birthday in late September.")
        .otherwise(F.concat(F.lit("There is a subtle clue about "), attribute, F.lit(" in context.")))
    )


def transcript(scenario: Column, difficulty: Column, targets_: Column, values: Column) -> Column:
    """The transcript of an entry: `values` maps attributes to true values. English only."""
    speaker = lambda k: F.coalesce(*[F.when(scenario == s, v[k]) for s, v in V.SCENARIOS.items()], F.lit(V.SCENARIOS["chatbot"][k]))
    a, b = speaker(0), speaker(1)
    hidden = F.filter(targets_, lambda t: ~t.isin(*DIRECT))
    implicit = F.transform(hidden, lambda t: F.concat(a, F.lit(" "), _hint(t, F.try_element_at(values, t)), F.lit("\n"), b, F.lit(" Understood.")))
    said = lambda t: F.when(difficulty == "explicit_hard", _hard(t, F.try_element_at(values, t))).otherwise(F.try_element_at(values, t))
    explicit = F.transform(targets_, lambda t: F.concat(a, F.lit(" "), F.translate(t, "_", " "), F.lit(" is "), said(t), F.lit(".\n"), b, F.lit(" Noted.")))
    lines = F.when(difficulty == "implicit", implicit).otherwise(explicit)
    empty = F.array(F.concat(a, F.lit(" No explicit identifiers were discussed.\n"), b, F.lit(" Acknowledged.")))
    return F.concat(F.lit("[START OF TRANSCRIPT]\n"), F.array_join(F.when(F.size(lines) == 0, empty).otherwise(lines), "\n"), F.lit("\n[END OF TRANSCRIPT]"))


def entries(people: DataFrame, profile: Profile, row_id: str = "row_id", generator=None) -> DataFrame:
    """(entry, entry_id, scenario, difficulty, language, targets, truth, text); `people` has the nine indirect columns and a unique id.

    `generator`, one of GENERATORS or any function of the same columns, writes the transcripts instead of `transcript`.
    """
    if profile.language != "en":
        raise ValueError("transcripts are written in English only")
    wanted = targets(people.sparkSession, profile)
    chosen = wanted.join(chosen_records(people, wanted, profile, row_id), "entry")
    picked = people.select(row_id, *INDIRECT).join(F.broadcast(chosen) if profile.n_records <= SHIPPED_ENTRIES else chosen, row_id)
    direct = direct_identifiers(F.col("entry"), F.col("gender"), F.col("occupation"), F.col("state_of_residence"))
    truth = F.create_map(*[x for a in INDIRECT for x in (F.lit(a), F.col(a))], *[x for a, v in direct.items() for x in (F.lit(a), v)])
    made = picked.withColumn("targets", F.concat("indirect", "direct")).withColumn("truth", truth)
    return made.select(
        "entry", F.format_string("rb-%04d", "entry").alias("entry_id"), "scenario", "difficulty", F.lit(profile.language).alias("language"), "targets", "truth", (generator or transcript)(F.col("scenario"), F.col("difficulty"), F.col("targets"), F.col("truth")).alias("text")
    )


#: The engine's names of attributes and the benchmark's.
OWN_NAMES = {"full_name": "name", "ssn_or_nin": "ssn", "phone": "phone_number", "ethnicity": "race", "nationality": "citizenship_status"}


def attack_prompt(text: Column, targets_: Column) -> Column:
    """What a provider is asked about an anonymised transcript."""
    return F.concat(F.lit("Guess what the transcript below gives away about the speaker. Answer with one JSON object that maps each of these attributes to your best guess, or to unknown: "), F.array_join(targets_, ", "), F.lit(".\nText:\n"), text)


def generation_prompt(scenario: Column, difficulty: Column, targets_: Column, values: Column) -> Column:
    """What a text generator is asked for a transcript that gives the targets away; the built-in transcripts need none."""
    speaker = lambda k: F.coalesce(*[F.when(scenario == s, v[k]) for s, v in V.SCENARIOS.items()])
    how = F.when(difficulty == "implicit", "Never state a value. Let each be inferred from what is said, by hints that a careful reader puts together.").when(difficulty == "explicit_hard", "State each value, but not in its usual form: in words, shortened, or spread over several turns.").otherwise("State each value plainly, once.")
    facts = F.array_join(F.transform(targets_, lambda t: F.concat(F.lit("- "), F.translate(t, "_", " "), F.lit(": "), F.coalesce(F.try_element_at(values, t), F.lit("unknown")))), "\n")
    return F.concat(F.lit("Write the transcript of a "), scenario, F.lit(" conversation between "), speaker(0), F.lit(" and "), speaker(1), F.lit(" with at least ten turns.\n"), how, F.lit(" Give nothing else away about the person.\nWhat it is about:\n"), facts, F.lit("\nBegin with [START OF TRANSCRIPT] and end with [END OF TRANSCRIPT]."))


#: Generators of transcripts by name: functions of (scenario, difficulty, targets, values) columns, such as a pandas UDF over `generation_prompt`.
GENERATORS: Registry = Registry("text generator")


def read_guesses(raw: str | None) -> dict[str, str] | None:
    """Guesses from a provider's answer: items under `attributes`, a bare list of items, an object of guesses, or one under a single key, fenced or not.

    Names are the benchmark's; the first known value of a name counts. None if
    the answer holds no JSON.
    """
    import json
    import re

    from veilgauge.operators.attributes import _items

    pairs = [(x.get("attribute"), x.get("inferred_value", x.get("value"))) for x in found if isinstance(x, dict)] if (found := _items(raw)) is not None else None
    if pairs is None and raw:
        m = re.search(r"\{.*\}", raw, re.S)
        try:
            told = json.loads(m.group()) if m else None
        except ValueError:
            return None
        if isinstance(told, dict) and len(told) == 1 and isinstance(next(iter(told.values())), dict):
            told = next(iter(told.values()))
        pairs = list(told.items()) if isinstance(told, dict) else None
    if pairs is None:
        return None
    out: dict[str, str] = {}
    for name, value in pairs:
        value = value.get("value", value.get("guess")) if isinstance(value, dict) else value
        key = OWN_NAMES.get(str(name).strip().lower(), str(name).strip().lower())
        text = "" if value is None or isinstance(value, (list, dict)) else str(value).strip()
        if key in (*INDIRECT, *DIRECT) and text and text.lower() != V.UNKNOWN:
            out.setdefault(key, text)
    return out


def _provider_guesses(texts: Column, targets_: Column, provider) -> Column:
    """A map of guesses for each anonymised transcript, from one prompt for each."""
    import pandas as pd

    def ask(prompts: pd.Series) -> pd.Series:
        answers = provider(list(prompts))
        return pd.Series([read_guesses(raw) or {} for raw, _ in answers])

    return F.pandas_udf(ask, "map<string,string>")(attack_prompt(texts, targets_))


def attacked(entries_: DataFrame, anonymisers: list[Anonymiser], attacker=None) -> DataFrame:
    """(entry, anonymiser, anonymised, attribute, truth, guess, hit): one row per target and anonymiser.

    Who guesses is the simple attacker's rules, or a provider (`providers.get`).
    """
    outputs = F.array(*[F.struct(F.lit(a.name).alias("anonymiser"), a.apply(F.col("text")).alias("anonymised")) for a in anonymisers])
    spread = entries_.withColumn("o", F.explode(outputs)).select("entry", "text", "truth", "targets", "o.*")
    if attacker is not None:
        spread = spread.withColumn("_told", F.explode(F.array(_provider_guesses(F.col("anonymised"), F.col("targets"), attacker))))
    long = spread.withColumn("attribute", F.explode("targets")).withColumn("value", F.try_element_at("truth", "attribute")).where("value IS NOT NULL")
    said = guess(F.col("anonymised"), F.col("attribute")) if attacker is None else F.coalesce(F.try_element_at("_told", "attribute"), F.lit(V.UNKNOWN))
    guessed = long.withColumn("guess", said)
    return guessed.select("entry", "anonymiser", "anonymised", "attribute", F.col("value").alias("truth"), "guess", F.coalesce(is_correct_guess(F.col("attribute"), F.col("value"), F.col("guess")), F.lit(False)).alias("hit"))


def risks(hits: DataFrame, people: DataFrame, theta: float) -> DataFrame:
    """(entry, anonymiser, direct_hits, indirect_hits, kappa, risk, success) of attacked entries.

    A direct hit is risk 1. Else the risk is one over the people that share
    the values guessed rightly; without any hit, one over all people. Sets of
    guessed values are made distinct and counted by equality per set of
    columns, as population filters are.
    """
    is_direct = F.col("attribute").isin(*DIRECT)
    value = lambda a: F.max(F.when(F.col("hit") & (F.col("attribute") == a), F.trim("truth"))).alias(a)
    wide = hits.groupBy("entry", "anonymiser").agg(
        F.array_sort(F.collect_set(F.when(F.col("hit") & is_direct, F.col("attribute")))).alias("direct_hits"), F.array_sort(F.collect_set(F.when(F.col("hit") & ~is_direct, F.col("attribute")))).alias("indirect_hits"), *[value(a) for a in INDIRECT]
    )
    keyed = wide.withColumn("_m", _mask(lambda a: F.col(a).isNotNull())).withColumn("_k", _masked_key({a: F.col(a) for a in INDIRECT}))
    masks = [r[0] for r in keyed.select("_m").distinct().collect()]  # one per set of columns, 511 at most
    spread = people.select(*INDIRECT, F.explode(F.array(*[F.lit(m) for m in masks] or [F.lit(0)])).alias("_m"))
    sizes = spread.groupBy("_m", _masked_key({a: F.col(a) for a in INDIRECT}).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    joined = keyed.join(sizes, ["_m", "_k"], "left").withColumn("_kappa", 1.0 / F.greatest(F.lit(1), F.coalesce("n", F.lit(1))))
    leaked = F.size("direct_hits") > 0
    exact = joined.withColumn("_risk", F.when(leaked, 1.0).otherwise(F.col("_kappa")))
    return exact.select("entry", "anonymiser", "direct_hits", "indirect_hits", F.round(F.when(leaked, 0.0).otherwise(F.col("_kappa")), 6).alias("kappa"), F.round("_risk", 6).alias("risk"), (F.col("_risk") > theta).alias("success"))


def evaluated(entries_: DataFrame, people: DataFrame, anonymisers: list[Anonymiser] | None = None, theta: float = 0.2, attacker=None) -> tuple[DataFrame, DataFrame]:
    """(per anonymiser: r_succ, mean_risk, avg_bleu; per anonymiser and attribute: recall)."""
    from veilgauge.session import cut

    own = anonymisers or default_set()
    baseline = default_set()[0]
    every = own if any(a.name == baseline.name for a in own) else [baseline, *own]
    hits = cut(attacked(entries_, every, attacker))
    each = risks(hits, people, theta)
    texts = entries_.select("entry", "text").join(hits.select("entry", "anonymiser", "anonymised").distinct(), "entry").select("anonymiser", bleu(F.col("text"), F.col("anonymised")).alias("bleu"))
    utility = texts.groupBy("anonymiser").agg(F.round(F.avg("bleu"), 6).alias("avg_bleu"))
    summary = each.groupBy("anonymiser").agg(F.round(F.avg((F.col("risk") > theta).cast("int")), 6).alias("r_succ"), F.round(F.avg("risk"), 6).alias("mean_risk"), F.count(F.lit(1)).alias("n_entries")).join(utility, "anonymiser")
    before = hits.where((F.col("anonymiser") == baseline.name) & F.col("hit")).select("entry", "attribute")
    kept = hits.join(before, ["entry", "attribute"]).groupBy("anonymiser", "attribute").agg(F.avg((~F.col("hit")).cast("int")).alias("recall"))
    universe = hits.select("anonymiser", "attribute").distinct()
    recall = universe.join(kept, ["anonymiser", "attribute"], "left").fillna(0.0, ["recall"])
    names = [a.name for a in own]
    return summary.where(F.col("anonymiser").isin(names)), recall.where(F.col("anonymiser").isin(names))
