"""Fits the trees of `pii` on a bounded sample of labelled rows.

Three sources, all bounded by TRAIN_ROWS:

- rows of the attribute table with their evidence: the value of a direct
  attribute is a positive span where the evidence holds it, the value of any
  other attribute (an employer, a date) a negative one;
- texts scored as carrying no risk: every proposal in them is a negative;
- sentences written here, filled with the labelled values, with invented names
  that no lexicon has (so that context and format count too) and with things
  that only look like personal information.

Rows are taken in the order of a hash of their id, so the sample is the same
however the table is stored.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.llm import boosting
from veilgauge.llm.pii import _COMMON, PARTICLES, TITLES, Scanner

#: Rows taken from each of the two tables, and sentences written.
TRAIN_ROWS = 8000
WRITTEN = 7000
KIND_OF = {"full_name": "person_name", "email": "email", "phone": "phone", "ssn_or_nin": "identity_number", "address": "street_address"}

# Sentences with slots; {name} {email} {phone} {id} {address} are what is to be found.
POSITIVE = """
My name is {name} and I would like an appointment.
This is {name} calling, please call {phone} back.
Dear {name}, thank you for your letter.
{name} said the door was open.
Signed, {name}.
Patient {name} of {address} came in today; ring {phone}.
Patient: {name}
Please ask for {name} at the desk or call {phone}.
The form was filled in by {name} ({email}).
{name}, {address}, next of kin.
The file lists {name}, {address}, as a contact.
According to {name}'s file the address is {address}.
{name}, {phone}
{name}, engineer
{name}, bus driver, 40
full_name: {name}
full_name -> {name}
full_name={name}
full_name: {last}
full_name={last}
name -> {last}
phone: {phone}
email={email}
address -> {address}
ssn_or_nin: {id}
lives at Unit 12, {address}
Apt 9B, {address}
Flat 3, {address}, next of kin.
{name} - {email}
{name} {phone}
{name}, {email}
We met {name} and {name} at noon.
{name} and {name} share {address}; neither answers {phone}.
Claimant {name}, born in spring, employer {org}.
The witness, {name}, gave {id} as proof.
Number on file for {name}: {id}, which is wrong.
Identity checked ({id}) on Monday.
File note: {id} belongs to {name}, {address}.
SSN {id}
NI no. {id}
National insurance or social security number is {id}, I think.
ID on file: {id} ({name})
SSN on record: {id}; contact: {email}.
{name} (NI/SSN {id}) is a married cook at {org}.
We sent it to {address} and rang {phone} twice.
I live at {address}, behind the mill.
Cc: {email}; the original went to {address}.
Reply to {email} or ring {phone}.
from: {name} <{email}>
Write to {email} if anything changes.
You can reach me on {phone} in the evening.
tel. {phone}
mobile is {phone}
my number is {phone}
hi, {name} here, my mobile is {phone} ok?
tel {phone}, mail {email}.
My details are {name}, {phone}, {email}.
moved from {address} last year
lives at {address}
post to {address}
{name} (38) answers {email} and earns a wage at {org}, Ohio.
Her landlord at {address} can be reached on {phone}.
Letters for {name} still go to {address}.
{name} was told about the results and left {email}.
Referral for {name}: welder, tel {phone}.
Resume received from {email}: teacher, 40.
Me llamo {esname} y quería una cita.
La paciente {esname} vive en {esaddress}.
El señor {esname} no vino ayer.
Mi DNI es {dni} y vivo en {esaddress}.
Puede llamarme al {esphone} por la tarde.
Escriba a {email} o llame al {esphone}.
Mi correo es {email}, por si acaso.
Firmado: {esname}
""".strip().split("\n")
NEGATIVE = """
He was seen in the {first} ward after lunch.
You mentioned the {first} suite; is it close?
Meet me at the St. {first} wing or the {first} Hospital.
St. {first}'s infirmary and {family} & Sons Ltd share a yard.
Nobody at {org} knew about the audit.
She has worked for {org} for three weeks.
He retired from {org} soon after.
We expect six replies, although {org} promised more.
works for {org}
name: {org}
attribute: employer, value: {org}
Set the name = blue and the label: red.
The {family} Trust and the {family} co-operative agreed.
The {invented} score and the {invented} scale were recorded.
{invented}'s disease and early {invented}'s syndrome are rare.
job: {Title}
used to be {Title}
works as {Title}
{Title} at the harbour office
{invented} welder, 19, E. Entry 4 of the day.
Early {invented}'s disease.
May and June were busy at {first} station.
April and August are quiet in Victoria.
doctor, Oregon, BS, Iowa, {invented}, teacher, Nevada, Ohio
tinnitus, Maine, LS, Ohio, the water board, Oregon, Oregon
Known in a {invented} village for two witnesses, the keeper then lost a bell by lantern light.
One clerk carries a scar from a fall, and readers learn that the house was empty.
Most visitors from Nevada and New Mexico come by train.
The Third Floor and The Ferry Terminal are closed.
Home | Services | The Community Hall | Login | Terms
Share Tweet Pin Share Tweet Pin
St. {invented}'s infirmary and the St. {first} Ward share a car park.
Invoice {dig4}-{dig4}-{dig2} came to 1,250.00 in total.
Under ISBN 978-0-{dig2}-{dig6}-{dig1} the office must keep it.
According to LOT {dig4}-{dig4}, the sample was late.
item {dig3}-{dig2}-{dig2} was missing
Version {dig1}.{dig1}.{dig1}-{dig3} is out of date.
build {dig2}.{dig1}.{dig1}.{dig3} sheet
born {dig4}-{dig2}-{dig2}
On {dig2}/{dig2}/{dig4} the rota was filed.
we left it before {dig2}/{dig2}/{dig4} i slept badly
ideally before {dig4}-{dig2}-{dig2} a second one
paramedic Ohio {dig2} {dig4} {dig1}.{dig1}%
chef LS {dig2} {dig3} {dig1}.{dig1}%
Q{dig3} teacher SW {dig2} {dig4}
Our reference is {dig8}.
Quote {dig9} whenever you write to us.
{dig2} road works began last week.
Step {dig1} Way ahead for the team.
Honestly, {invented} Street was closed all day.
Follow @{invented} or @{first} for news.
Notes of {dig2}, {dig4}
The Office must keep the Risk Register.
Map square SJ {dig3} {dig3} is blank.
He was seen in ward {dig2}, close observation.
There were {dig2} people in the park.
He put {dig1} boxes on the drive.
It took {dig2} minutes all the way.
She lost {dig1} kilos and can walk.
We saw {dig2} houses on the hill that day, near the court.
See you at the office at noon.
Look at example dot points at the end.
Use the short code 111 out of hours.
Let us move on to the pilot study, since time is short.
[NAME] told us that the case was closed.
The [REDACTED] case was closed on Tuesday.
Doctor: Please keep taking the tablet.
Bus Driver, Civil Engineer, Head Nurse.
KNOWN IN THE HILL DISTRICT FOR A SILVER BROOCH, THEN A SCAR
TAKE THE {first} STREET EXIT AND THE NORTH GATE
Readers learn that the Glass Cutter lost a Medal.
Agenda and Minutes. Contacts and Roles. To Do.
treated for {invented}'s disease
El equipo habló de la Nueva Aplicación en Plaza Mayor.
Trabajo en {org} y vivo cerca del puerto.
Después de la operación pasé 12 días sin dormir en el Hospital San {first}.
Tengo 12 hermanos y 3 plazas en la calle.
""".strip().split("\n")

_ORG = ["Trust", "College", "Analytics", "Freight", "& Sons Ltd", "University", "Group", "Bank", "Council", "Partners", "Clinic", "Services", "Laboratory", "Co-operative", "Board", "Logistics"]
_HEADS = "bar cor del fen gar hal jor kel lom mer nor pel quar ros sal tor ul ver wil zan alb bre cly dro ex".split()
_TAILS = "a ett in ona ric wen ova isk ander ley mont ez uski ardo ine oy imo abel".split()
_ES_FIRST = "María José Lucía Carlos Inés Álvaro Pilar Andrés Sofía Javier Elena Raúl Iñigo Nuria".split()
_ES_HEAD = "Monte Fuente Peña Río Alba Casa Val Torre Roca Campo".split()
_ES_TAIL = "lirio rubia negra clara sola mayor verde nueva bravo luz".split()
_ES_STREET = ["Calle de las", "Calle", "Plaza", "Avenida de la", "C/", "Paseo del", "Camino de", "Avda."]


def _invented(r: random.Random) -> str:
    return (r.choice(_HEADS) + r.choice(_TAILS)).capitalize()


class _Slots:
    def __init__(self, values: dict[str, list[str]], first: list[str], family: list[str], seed: int) -> None:
        self.r, self.values = random.Random(seed), values
        self.first, self.family = first or ["Alba"], family or ["Corden"]

    def name(self) -> str:
        r = self.r
        own = r.random() < 0.5
        f = r.choice(self.first).title() if own else _invented(r)
        l = r.choice(self.family).title() if own else _invented(r) + r.choice(["", "", "son", "berg", "ton"])
        k = r.random()
        if k < 0.12:
            return f"{r.choice(['Mr', 'Mrs', 'Ms', 'Miss', 'Dr', 'Dr.', 'Prof.', 'Mr.', 'Nurse'])} {l}"
        if k < 0.17:
            return f"{r.choice(['Mr', 'Mrs', 'Dr', 'Ms'])} {f[0]}. {l}"
        if k < 0.24:
            return f"{f[0]}. {l}"
        if k < 0.31:
            return f"{f} {r.choice('ABDEHJKLMT')}. {l}"
        if k < 0.38:
            return f"{f} {r.choice(PARTICLES.split('|'))} {l}"
        if k < 0.45:
            return f"{f} {l}-{r.choice(self.family).title() if own else _invented(r)}"
        if k < 0.52:
            return f"{l}, {f}"
        if k < 0.60:
            return f"{f} {l}".upper()
        if own and k < 0.70:
            return f"{f} {l}".lower()
        return f"{f} {l}"

    def esname(self) -> str:
        r = self.r
        l = r.choice(_ES_HEAD) + r.choice(_ES_TAIL)
        return r.choice([f"{r.choice(_ES_FIRST)} {l}", f"{r.choice(_ES_FIRST)} {l} {_invented(r)}", f"Don {l}", f"Doña {l}", f"{r.choice(_ES_FIRST)} de {l}"])

    def get(self, slot: str) -> str:
        r = self.r
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        if slot.startswith("dig"):
            return d(int(slot[3:]))
        if slot in ("email", "phone", "id", "address"):
            key = {"id": "ssn_or_nin"}.get(slot, slot)
            return r.choice(self.values[key]) if self.values.get(key) else {"email": "ab.cd@mail.example", "phone": "020 7946 0999", "id": "999-11-2222", "address": "12 Fern Road"}[slot]
        if slot == "name":
            return self.name()
        if slot == "last":
            return r.choice([r.choice(self.family).title(), _invented(r)])
        if slot == "esname":
            return self.esname()
        if slot == "esaddress":
            return f"{r.choice(_ES_STREET)} {r.choice(['Acequias', 'Río Seco', 'Molino Viejo', 'San Telmo', 'Mar', 'Olmos'])}{r.choice([',', ''])} {r.randint(1, 199)}"
        if slot == "dni":
            n, z = f"9{d(7)}", r.choice("ABCDEFGHJKLMNPQRSTVWXYZ")
            return r.choice([n + z, n + "-" + z, f"{n[:2]}.{n[2:5]}.{n[5:]}-{z}", n + " " + z, f"{r.choice('XYZ')}{d(7)}{z}"])
        if slot == "esphone":
            return r.choice(["{}", "+34 {}", "(+34) {}", "0034 {}"]).format(r.choice([f"555 {d(2)} {d(2)} {d(2)}", f"555{d(6)}", f"555-{d(6)}", f"655 {d(3)} {d(3)}"]))
        if slot == "org":
            return r.choice(["", "the "]) + f"{r.choice([_invented(r), r.choice(self.family).title()])} {r.choice(_ORG)}"
        if slot == "Title":
            return r.choice([f"{r.choice(['Head', 'Civil', 'Land', 'Night', 'Chief', 'Field', 'Crane', 'Web'])} {_invented(r)[:4]}{r.choice(['er', 'or', 'ist', 'ian', 'man'])}", f"{_invented(r)} {r.choice(['Officer', 'Engineer', 'Designer', 'Worker', 'Driver', 'Operator', 'Manager', 'Assistant'])}"])
        if slot == "first":
            return r.choice([r.choice(self.first).title(), _invented(r)])
        if slot == "family":
            return r.choice(self.family).title()
        return _invented(r)


_SLOT = re.compile(r"\{(\w+)\}")
_TRUE = {"name": "person_name", "last": "person_name", "esname": "person_name", "email": "email", "phone": "phone", "esphone": "phone", "id": "identity_number", "dni": "identity_number", "address": "street_address", "esaddress": "street_address"}
_TITLE = re.compile(rf"^(?:(?:{'|'.join(TITLES)})\.?\s+)+", re.I)


def labels(found: list[tuple[int, int, str]], true: list[tuple[int, int, str]]) -> list[int]:
    """1 for the proposals that are a true span: of those with its start and kind the ones whose end is its own, or nearest to it where none is."""
    nearest: dict[tuple[int, str], int] = {}
    for a, b, kind in found:
        for t, e, k in true:
            if a == t and kind == k:
                nearest[a, kind] = min(nearest.get((a, kind), 1 << 30), abs(b - e))
    ends = {(t, k): e for t, e, k in true}
    return [int((a, kind) in nearest and abs(b - ends[a, kind]) == nearest[a, kind]) for a, b, kind in found]


def written(values: dict[str, list[str]], first: list[str], family: list[str], n: int = WRITTEN, seed: int = 7, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, true (start, end, kind)) of n sentences."""
    slots = _Slots(values, first, family, seed)
    r = random.Random(seed + 1)
    out = []
    for k in range(n):
        lines = [r.choice(positive if r.random() < 0.55 else negative) for _ in range(r.choice((1, 1, 2)))]
        text, true = "", []
        for line in lines:
            at = 0
            for m in _SLOT.finditer(line):
                text += line[at : m.start()]
                at = m.end()
                value = slots.get(m[1])
                if kind := _TRUE.get(m[1]):
                    t = _TITLE.match(value) if kind == "person_name" else None
                    true.append((len(text) + (t.end() if t else 0), len(text) + len(value), kind))
                text += value
            text += line[at:] + r.choice([" ", "\n"])
        case = r.random()
        text = text.lower() if case < 0.12 else text.upper() if case < 0.22 and len(text.upper()) == len(text) else text
        out.append((text.rstrip(), true))
    return out


def _bounded(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most `n` rows, those with the smallest hash of their id.

    Rows are thinned by their hash first, so that no more than about the rows
    wanted are sent to the driver, from however many partitions.
    """
    total = df.count()
    if total > n:
        df = df.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, (n + 4 * n**0.5) / total)))
    return df.orderBy(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)), id_col).limit(n)


def fitted(inferred: DataFrame, harmless: DataFrame, text_col: str = "text", id_col: str = "text_id") -> dict:
    """{first, family, other, models}: what a Scanner needs, fitted on the driver.

    `inferred` has attr_id, attribute, inferred_value and evidence; every text
    of `harmless` holds no personal information.
    """
    taken = _bounded(inferred.where("inferred_value IS NOT NULL"), "attr_id", 2 * TRAIN_ROWS).select("attribute", "inferred_value", "evidence").collect()
    calm = _bounded(harmless.where(f"`{text_col}` IS NOT NULL"), id_col, TRAIN_ROWS).select(text_col).collect()
    # the lexicon is made from all rows of the table; it grows with the different names, not with the rows
    plain = F.lower(F.regexp_replace("inferred_value", r"[^\p{L}\p{M} ,.'\-]", ""))
    named = inferred.where("attribute = 'full_name' AND inferred_value IS NOT NULL").select(plain.alias("v")).where(F.col("v").rlike(r"^[\p{IsLatin}\p{M} ,.'\-]+$"))
    inverted = F.col("v").contains(",")
    words = F.split(F.trim(F.regexp_replace("v", rf"[,.]|(?<![\p{{L}}])({PARTICLES})(?![\p{{L}}])", " ")), r"\s+")
    parts = named.select(words.alias("w"), inverted.alias("i")).where(F.size("w") >= 2)
    head = F.when(F.col("i"), F.element_at("w", -1)).otherwise(F.get("w", F.lit(0)))
    tail = F.when(F.col("i"), F.get("w", F.lit(0))).otherwise(F.element_at("w", -1))
    # every name once; words that are also common words of a language would be proposed everywhere
    every = lambda c: sorted(x for x in (r["x"] for r in parts.select(c.alias("x")).where(F.length("x") > 1).distinct().toLocalIterator()) if x not in _COMMON)
    first = every(head)
    family = sorted({p for x in every(tail) for p in x.split("-") if len(p) > 1} - _COMMON)
    # words of the other attributes' values, but for those of names
    rest = inferred.where(~F.col("attribute").isin(*KIND_OF, "date_of_birth")).select(F.explode(F.split(F.lower("inferred_value"), r"[^\p{L}]+")).alias("x"))
    known = set(first) | set(family)
    other = [r["x"] for r in rest.where(F.length("x") > 2).groupBy("x").count().where("count > 1").select("x").toLocalIterator() if r["x"] not in known]
    scanner = Scanner(first, family, other)
    values: dict[str, list[str]] = {}
    rows: dict[str, list[tuple[tuple[int, ...], int]]] = {}

    def add(text: str, true: list[tuple[int, int, str]], only: tuple[int, int] | None = None) -> None:
        s, at = scanner.plainly(text)
        found = []
        for x in scanner.proposals(s):
            a, b = (x.start, x.end) if at is None else (int(at[x.start]), int(at[x.end - 1]) + 1)
            if only is None or (a < only[1] and b > only[0]):
                found.append((a, b, x))
        for (_, _, x), y in zip(found, labels([(a, b, x.kind) for a, b, x in found], true)):
            rows.setdefault(scanner.group(x.kind), []).append((x.features, y))

    for r in taken:
        v = r["inferred_value"]
        kind = KIND_OF.get(r["attribute"])
        if kind and v.isascii():
            values.setdefault(r["attribute"], []).append(v)
    for r in taken:
        v, e, kind = r["inferred_value"], r["evidence"], KIND_OF.get(r["attribute"])
        if e is None:
            continue
        # who else stands in an evidence is not labelled: only what touches the value counts
        if (k := e.find(v)) >= 0 and v.strip():
            t = _TITLE.match(v) if kind == "person_name" else None
            add(e, [(k + (t.end() if t else 0), k + len(v), kind)] if kind else [], (k, k + len(v)))
    for r in calm:
        add(r[text_col], [])
    for text, true in written(values, first, family):
        add(text, true)
    models = {}
    for g, own in rows.items():
        random.Random(3).shuffle(own)
        x, y = np.array([f for f, _ in own], np.int64), np.array([k for _, k in own], np.int64)
        if y.min() < y.max():
            models[g] = boosting.fit(x, y)
    return {"first": first, "family": family, "other": other, "models": models}
