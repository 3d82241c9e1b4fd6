"""Personal information in free text: proposed spans, boosted trees over format and context, typed placeholders.

1. Texts are made plain for matching (width, look-alikes, invisible
   characters), with a map back to the places in the stored text.
2. High-recall generators propose overlapping spans of five kinds. They are
   anchored on rare things (an at sign, runs of digits, capitalised runs, words
   of the name lexicon), so most of a text costs no more than one pass.
3. Every proposal gets format and context features; gradient-boosted trees per
   kind, fitted on a bounded sample of labelled rows (`pii_training`), give
   calibrated probabilities. Of overlapping proposals above their kind's
   threshold the most probable stays.

Null and empty texts have no spans; equal texts have equal spans; texts of any
length are scanned whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from veilgauge.functions.vocabulary import STATES
from veilgauge.llm.boosting import Trees
from veilgauge.llm.textstats import COMMON_WORDS
from veilgauge.llm.words import Words

KINDS = ("person_name", "email", "phone", "identity_number", "street_address")
PLACEHOLDERS = {"person_name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "street_address": "[ADDRESS]"}

# Words around names, numbers and addresses.
TITLES = "mr mrs ms miss mx dr prof professor nurse sister sir dame lord lady rev don doña dona sr sra srta señor señora".split()
PARTICLES = "de la|de las|de los|del|de|van der|van den|van de|van|von|al|el|da|di|du|le|la|bin|ibn"
NAME_BEFORE = set("name named called signed llamo llama am is ask i'm im for by with patient client claimant witness nombre paciente caller contact referral from owner mail dear belongs".split())
ARTICLES = set("the a an at near in el la los las un una this that our".split())
PLACE_AFTER = set("ward suite wing station clinic hospital infirmary score scale disease syndrome trust college university school analytics freight ltd limited plc inc llc gmbh group bank board council co company sons partners services centre center court house hall annex terminal library road street road co-operative cooperative laboratory office mercy church area state county".split())
NAME_AFTER = set("said says gave lives lived vive y and was who answers owns still gets share here reports called calls wrote signed is has told left".split())
PHONE_NEAR = set("tel telephone phone mobile cell call rang ring reach reached number llamar llamarme llame llamo llámeme teléfono telefono móvil movil fax dial text on at al answers contact".split())
ID_NEAR = set("ssn nino nin ni dni nie id identity social security insurance national file record proof passport identidad seguridad number checked number".split())
DECOY_NEAR = set("isbn invoice lot item version build ref batch grid form clause step room extension order code entry page ward week rota section policy ticket model case".split())
STREET = "street|st|road|rd|avenue|ave|av|lane|ln|drive|dr|boulevard|blvd|way|close|court|ct|place|pl|terrace|ter|mews|crescent|cres|square|sq|row|gardens|gdns|grove|hill|walk|parade|quay|rise|view|circle|cir|parkway|pkwy|highway|hwy|alley|path|green|park|trail"
VIA = r"calle|c/|cl\.|plaza|pza\.?|pl\.|avenida|avda\.?|av\.|paseo|p\.º|camino|ronda|carretera|ctra\.?|travesía|travesia|glorieta|callejón|callejon|cuesta|bulevar"

#: Words with which no name begins, even capitalised at the start of a sentence.
NO_NAME = set("honestly under dear according since please however after before although because between during still nobody everyone everybody somebody someone nothing something note record entry doctor person chatbot target other agenda checklist contacts identity file invoice referral resume résumé meet write use version seen only divorced widowed married single several visitors people staff most each every home services share login hello hi thanks thank regards yes sure well maybe perhaps today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december firmado paciente señora señor estimado estimada hola gracias".split())

#: Capital letters of the Latin script, as the inside of a character class.
_U = "A-ZÀ-ÖØ-Þ" + "".join(chr(o) for o in (*range(0x100, 0x250), *range(0x1E00, 0x1F00)) if chr(o).isupper())
_W = rf"(?:[{_U}](?:['’][{_U}])?(?:[^\W\d_{_U}]+(?:[{_U}][^\W\d_{_U}]+)?|[{_U}]+))"
_CAP = rf"{_W}(?:['’-](?:{_W}|s\b|S\b))*(?![^\W_])"
_T = rf"(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Srta|Rev|MR|MRS|MS|DR|PROF)\.|[{_U}]\.(?!\w)|{_CAP})"
_SEQ = re.compile(rf"(?<![\w'’@.+/=-])(?:{_T})(?:,?[ \n]+(?:(?:{PARTICLES})[ \n]+)?(?:{_T}))+")
_TOKENS = re.compile(rf"{_T}|(?:{PARTICLES})(?=[ \n])|,", re.I)
_TITLE_ONLY = re.compile(rf"^(?:{'|'.join(TITLES)})\.?$", re.I)
_BACK = re.compile(rf"(?:(?P<title>(?<!\w)(?:{'|'.join(TITLES)})\.?)[ \n]+)?(?:(?P<first>(?<!\w)[^\W\d_]+)[ \n]+)?(?:(?P<init>(?<!\w)[^\W\d_]\.)[ \n]*)?(?P<part>(?<!\w)(?:{PARTICLES})[ \n]+)?$", re.I)
_FORWARD = re.compile(rf"[^\W\d_]+(?:-[^\W\d_]+)*(?:[ \n]+[^\W\d_]\.)?(?:[ \n]+(?:{PARTICLES}))?[ \n]+[^\W\d_]+(?:['-][^\W\d_]+)*", re.I)
_INVERTED = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*,[ \n]+[^\W\d_]+", re.I)

_LABEL = re.compile(r"(?<![^\W_])(?:name|surname)\s*(?:=|:|->|→)\s*", re.I)
_AFTER_LABEL = re.compile(rf"(?:(?:{'|'.join(TITLES)})\.?[ \n]+)*(?P<name>[^\W\d_](?:[^\W\d_]*\.?)(?:['’-][^\W\d_]+)*(?:,?[ \n]+(?:(?:{PARTICLES})[ \n]+)?[^\W\d_](?:[^\W\d_]*\.?)(?:['’-][^\W\d_]+)*){{0,3}})", re.I)

_AT_BRACKET = re.compile(r"[(\[{] ?at ?[)\]}]")
_DOT_HINTS = (" dot", "dot]", "dot)", "dot}", ".com", ".org", ".net", ".edu", ".example", ".test", ".info")
_AT_WORD = re.compile(r"(?<=\s)at(?=\s[\w-]+\s?(?:[(\[{] ?dot ?[)\]}]|dot\s|\.[a-z]))")
_LOCAL = re.compile(r"[^\W_](?:[\w.+-]*\w)?\s?$")
_DOMAIN = re.compile(r"\s?[^\W_][\w-]*(?:(?:\.|\s?[(\[{] ?dot ?[)\]}]\s?|\sdot\s)[^\W_][\w-]*)+", re.I)

_S = r"[ .\-/\n]?"
_DIGITS = re.compile(r"\d[\d ().\-/\n]{4,}\d")
_RUN = re.compile(r"(?<![\w.])(?:[A-Za-z]{2}[ \-\n]?(?=\d\d[ \-\n]?\d\d[ \-\n]?\d\d[ \-\n]?[A-Za-z](?!\w))|[XYZxyz]-?(?=\d{7}))?(?:\(\+?\d{1,5}\)|\+?\d+)(?:(?:[ \n]?\(\d{1,4}\)[ \n]?|[ .\-/\n])?\d+)*(?:[ \-\n]?[A-Za-z](?!\w))?")
SHAPES = {
    "nanp": re.compile(rf"(?:\+?1[ .\-/\n]?)?(?:\([2-9]\d\d\)[ \n]?|[2-9]\d\d[ .\-/\n]?)[2-9]\d\d{_S}\d{{4}}$"),
    "uk": re.compile(rf"(?:\(0\d{{2,4}}\)[ \n]?|0\d{{2,4}}{_S})\d{{3,4}}(?:{_S}\d{{3,4}})?$|0\d{{10}}$"),
    "plus": re.compile(rf"(?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|00\d\d){_S}(?:\(0\)[ \n]?)?\d(?:{_S}\d){{7,11}}$"),
    "es": re.compile(r"[5-9]\d\d[ .\-\n]\d\d[ .\-\n]\d\d[ .\-\n]\d\d$|[5-9]\d\d[ .\-\n]\d{3}[ .\-\n]\d{3}$|[5-9]\d{8}$|[5-9]\d\d[ \-\n]\d{6}$"),
    "ssn": re.compile(r"\d{3}([ .\-\n]?)\d{2}\1\d{4}$|\d{3}[ .\-\n]\d{2}[ .\-\n]\d{4}$"),
    "nino": re.compile(r"[A-Za-z]{2}([ \-\n]?)\d\d[ \-\n]?\d\d[ \-\n]?\d\d[ \-\n]?[A-Za-z]$"),
    "dni": re.compile(r"\d\d\.?\d{3}\.?\d{3}[ \-]?[A-Za-z]$|[XYZxyz]-?\d{7}-?[A-Za-z]$"),
}
PHONE_SHAPES, ID_SHAPES = ("nanp", "uk", "plus", "es"), ("ssn", "nino", "dni")

_DIR = r"(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?[ \n]+)?"
_STREET = re.compile(rf"(?<![\w.,/-])(?P<no>\d{{1,5}}[a-z]?(?:\s?[-–]\s?\d{{1,5}}[a-z]?)?),?[ \n]+(?P<name>{_DIR}(?:[^\W\d_][\w'’.-]*[ \n]+){{1,4}}?)(?P<kind>{STREET})(?![\w'’-])", re.I)
_BOX = re.compile(r"(?<!\w)(?:P\.?\s?O\.?|Post\s+Office)\s+Box\s+\d+", re.I)
_VIA = re.compile(rf"(?<![\w])(?:{VIA})[ \n]*(?:(?:de|del|la|las|los|el|d')[ \n]+){{0,3}}(?:[^\W\d_][\w'’.-]*[ \n]+){{0,5}}?[^\W\d_][\w'’.-]*,?[ \n]+(?:n\.?º?[ \n]*|núm\.?[ \n]*)?\d{{1,4}}", re.I)
_VIA_KINDS = [re.sub(r"\\\.\?$", "", v).replace("\\", "") for v in VIA.split("|")]
#: What stands at the start of every street type of VIA; a type that begins with another is found by that.
_VIA_HINTS = tuple(v for v in _VIA_KINDS if not any(v != w and v.startswith(w) for w in _VIA_KINDS))

END = "\x00"
_WORD = re.compile(r"[^\W\d_]+")
_HYPHENED = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_STREET_END = re.compile(rf"(?:{STREET})\.?$", re.I)
_CAPS_BEFORE, _CAPS_AFTER = re.compile(r"(?<!\w)[A-Z]{2,}[ \n,.:;]+$"), re.compile(r"[ \n,.:;]+[A-Z]{2,}(?!\w)")
_STATES = {w for s in STATES for w in s.lower().split()}
_PART_WORDS = set(PARTICLES.replace("|", " ").split())
_COMMON = set(COMMON_WORDS["en"]) | set(COMMON_WORDS["es"])
_NEVER = _COMMON | NO_NAME | NAME_BEFORE | PHONE_NEAR | ID_NEAR | DECOY_NEAR
_STOP = _NEVER | set("flat unit apt apartment suite po box room floor".split())
_PARTS = frozenset(PARTICLES.split("|"))
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    features: tuple[int, ...] = field(repr=False, default=())


class Lexicon:
    """Given names and family names of labelled rows, as sorted hashes, and words of their other values."""

    def __init__(self, first: list[str], family: list[str], other: list[str], words: Words) -> None:
        self.other = frozenset(other)
        self.first_names, self.family_names = frozenset(first), frozenset(family)
        h = lambda names: np.unique(np.concatenate([words(n)[:1] for n in names] or [np.zeros(0, np.uint64)]))
        self.first, self.family = h(first), h(family)
        self.endings = frozenset(n[-4:] for n in family if len(n) > 6)

    @staticmethod
    def hits(own: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(own) or not len(h):
            return np.zeros(len(h), bool)
        return own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h


# small patterns of the features, compiled once
_R1 = re.compile(r"\.|dot")
_R2 = re.compile(r"[._+\d-]")
_R3 = re.compile(r"[a-z]{2,}$")
_R4 = re.compile(r"\. |\n| (?=[A-Za-z]$)")
_R5 = re.compile(r"[ \-]?[A-Za-z]$")
_R6 = re.compile(r"[ \-\n]?[A-Za-z]$")
_R7 = re.compile(r"^\d{1,2} (?=\+|0|\()")
_R8 = re.compile(r" \d{1,3}$")
_R9 = re.compile(r"\d+")
_R10 = re.compile(r"[ \n]?\.?\d")
_R11 = re.compile(r"\D")
_R12 = re.compile(r"[a-z]$")
_R13 = re.compile(r"[ \n][a-z]+[ \n][a-z]+")
_R14 = re.compile(r"-[^\W\d_]+")
_R15 = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_R16 = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*,")
_R17 = re.compile(r"(?<!\w)[^\W\d_]\.")
_R18 = re.compile(r"\d[a-z]?[ \n]+(?:[NSEW]{1,2}\.? )?$")
_R19 = re.compile(r"@|\d{3}")
_R20 = re.compile(r"(?:er|or|ist|ian|ant|man|eer|ive)s?$")
_R21 = re.compile(r"name\s*(?:=|:|->|→)\s*$", re.I)


class Scanner:
    """Proposes spans with features, and decides on them with fitted trees."""

    def __init__(self, first: list[str], family: list[str], other: list[str], models: dict[str, Trees] | None = None) -> None:
        from veilgauge.llm.lookalikes import CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES

        self.words = Words()
        self.lexicon = Lexicon(first, family, other, self.words)
        self.models = models or {}
        plain = np.arange(0x20000, dtype=np.uint32)
        for o in range(0xFF01, 0xFF5F):
            plain[o] = o - 0xFEE0
        for k, v in (CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES).items():
            plain[ord(k)] = ord(v)
        for o in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 9):
            plain[o] = 0x20
        for ch in "‐‑‒−":
            plain[ord(ch)] = 0x2D
        self.plain = plain
        self.particles = np.unique(np.concatenate([self.words(p) for p in PARTICLES.split("|")]))
        self.joined, self.mail = np.zeros(0x20000, bool), np.zeros(0x20000, bool)
        self.joined[[ord(c) for c in "-@._'"]] = True
        self.mail[[ord(c) for c in "@_"]] = True
        self.capital = np.zeros(0x20000, bool)
        self.capital[[o for o in (*range(0x250), *range(0x1E00, 0x1F00)) if chr(o).isupper()]] = True

    def plainly(self, text: str) -> tuple[str, np.ndarray | None]:
        """(text for matching, place of each of its characters in `text`; None if they are the same)."""
        if text.isascii() and "\t" not in text:
            return text, None
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x1FFFF)
        at = np.flatnonzero(~self.words.drop[codes])
        out = self.plain[codes[at]]
        if ((out >= 0xFB00) & (out <= 0xFB04)).any():
            k = np.flatnonzero((out >= 0xFB00) & (out <= 0xFB04))
            parts = [_LIGATURES[chr(o)] for o in out[k]]
            more = np.repeat(k + 1, [len(p) - 1 for p in parts])
            out[k] = [ord(p[0]) for p in parts]
            out, at = np.insert(out, more, [ord(c) for p in parts for c in p[1:]]), np.insert(at, more, at[more - 1])
        return out.astype("<u4").tobytes().decode("utf-32-le", "replace"), at

    # ---- proposals -------------------------------------------------------------------------------------------
    # Many texts are scanned as one string, parted by END, which no pattern crosses; windows stop at it.
    @staticmethod
    def _before(s: str, start: int, width: int) -> str:
        w = s[max(0, start - width) : start]
        return w[w.rfind(END) + 1 :]

    @staticmethod
    def _after(s: str, end: int, width: int) -> str:
        w = s[end : end + width]
        k = w.find(END)
        return w if k < 0 else w[:k]

    def _near(self, s: str, start: int, width: int = 28) -> list[str]:
        return _WORD.findall(self._before(s, start, width).lower())

    def emails(self, s: str, low: str) -> list[Span]:
        signs = [m for m in re.finditer("@", s) if s[m.start() - 1 : m.start()].strip().isalnum() or s[max(0, m.start() - 2) : m.start() - 1].isalnum()]
        if "at)" in low or "at]" in low or "at}" in low:
            signs += _AT_BRACKET.finditer(low)
        written = {m.start(): m for at in self._places(low, _DOT_HINTS) for m in _AT_WORD.finditer(low, max(0, at - 45), at + 6)}
        signs += written.values()
        out = []
        for m in signs:
            left = _LOCAL.search(s, max(0, m.start() - 70), m.start())
            right = _DOMAIN.match(s, m.end())
            if not left:
                continue
            local = left.group().strip()
            domain = right.group() if right else ""
            near = self._near(s, left.start())
            dots = len(_R1.findall(domain, re.I))
            f = (
                int(m.group() == "@"), int(m.group().lower() == "at"), int(bool(right)), min(dots, 5), min(len(local), 31), int(bool(_R2.search(local))), min(len(domain), 31),
                int(local.lower() in _COMMON), int(any(w in ("email", "mail", "write", "reply", "correo", "escriba", "contact", "cc", "from", "to") for w in near[-3:])),
                int(bool(_R3.search(domain, re.I))), int(" dot " in domain.lower() or "dot" in domain.lower().split()), int(self._before(s, left.start(), 1) in ("<", "(", " ", "", "\n", ":", ",", "=")),
            )
            out.append(Span(left.start(), right.end() if right else m.end(), "email", f))
        return out

    def numbers(self, s: str) -> list[Span]:
        out = []
        for m in (m for c in _DIGITS.finditer(s) if c.end() - c.start() >= 6 and len(_R11.sub("", c.group())) >= 6 for m in _RUN.finditer(s, max(0, c.start() - 6), c.end() + 3)):
            run = m.group()
            ways = {(0, len(run))}
            for cut in _R4.finditer(run):  # a sentence may have ended, a line may be a new one
                ways.add((0, cut.start()))
                ways.add((cut.end(), len(run)))
            if _R5.search(run):
                ways.add((0, len(_R6.sub("", run))))
            for head in _R7.finditer(run):
                ways.add((head.end(), len(run)))
            for cut in _R8.finditer(run):
                ways.add((0, cut.start()))
            start = m.start()
            near = self._near(s, start)
            told = (int(any(w in PHONE_NEAR for w in near[-3:])), int(any(w in ID_NEAR for w in near[-4:])), int(any(w in DECOY_NEAR for w in near[-1:])))
            seen = False
            for a, b in sorted(ways, key=lambda w: w[0] - w[1]):
                part = run[a:b]
                digits = len(_R11.sub("", part))
                if digits < 6:
                    continue
                shape = [int(bool(p.match(part))) for p in SHAPES.values()]
                if not any(shape) and seen:
                    continue  # of a run without a shape only the longest part
                seen = True
                groups = _R9.findall(part)
                after = self._after(s, start + b, 1)
                before = self._before(s, start + a, 1)
                base = (
                    *shape, min(digits, 16), min(len(groups), 8), int("+" in part), int("(" in part), int("/" in part), int("." in part), int("-" in part), int(" " in part), int(part[0] == "0"), int(groups[0][0] == "9"), int(groups[0][0] == "1"),
                    int(part[-1].isalpha()), int(part[0].isalpha()), *told, int(after in ("%", "/", "-", "_") or after.isdigit()),
                    int(before in ("-", "/", "_", "#")), int("\n" in part), int(bool(_R10.match(self._after(s, start + b, 3)))),
                )
                if any(shape[k] for k, n in enumerate(SHAPES) if n in PHONE_SHAPES) or not any(shape):
                    out.append(Span(start + a, start + b, "phone", (1, *base)))
                if any(shape[k] for k, n in enumerate(SHAPES) if n in ID_SHAPES) or not any(shape):
                    out.append(Span(start + a, start + b, "identity_number", (0, *base)))
        return out

    def addresses(self, s: str, low: str) -> list[Span]:
        out = []
        for m in _STREET.finditer(s):
            name, kind, no = m.group("name"), m.group("kind"), m.group("no")
            words = name.split()
            near = self._near(s, m.start("no"))
            out.append(Span(m.start("no"), m.end(), "street_address", self._address(s, words, kind, no, near, m.start("no"), m.end(), 0)))
        for at in self._places(low, ("box",)):
            m = _BOX.search(s, max(0, at - 14), at + 14)
            if m:
                out.append(Span(m.start(), m.end(), "street_address", self._address(s, [], "", "", self._near(s, m.start()), m.start(), m.end(), 1)))
        for at in self._places(low, _VIA_HINTS):
            m = _VIA.match(s, at)
            if m:
                words = m.group().split()
                out.append(Span(m.start(), m.end(), "street_address", self._address(s, words, words[0], _R9.findall(m.group())[-1], self._near(s, m.start()), m.start(), m.end(), 2)))
        return out

    @staticmethod
    def _places(low: str, hints: tuple[str, ...]) -> list[int]:
        found = []
        for h in hints:
            at = low.find(h)
            while at >= 0:
                found.append(at)
                at = low.find(h, at + 1)
        return sorted(found)

    def _address(self, s: str, words: list[str], kind: str, no: str, near: list[str], start: int, end: int, form: int) -> tuple[int, ...]:
        low = [w.lower().strip(".,") for w in words]
        cap = sum(w[:1].isupper() for w in words)
        return (
            form, min(len(words), 8), min(cap, 8), int(cap == len(words) and cap > 0), int(kind[:1].isupper()), int(kind.isupper() and len(kind) > 2), min(len(_R11.sub("", no)), 6), int(bool(_R12.search(no))), int("-" in no),
            sum(w in _COMMON for w in low), int(bool(low) and low[0] in _COMMON), int(any(w in DECOY_NEAR for w in near[-1:])), int(any(w in ("at", "to", "of", "in", "live", "lives", "vivo", "vive", "en", "from", "address", "share", "post", "still", "is", "unit", "flat", "apt", "went") for w in near[-2:])),
            int(self._before(s, start, 2) == ", "), int(bool(_R13.match(self._after(s, end, 20)))), int(self._after(s, end, 1) in (",", ".", ";", "\n", ")", "")), int(any(w.endswith("s") and w in _COMMON for w in low)), int("\n" in s[start:end]),
        )

    def _run(self, s: str, run: list[tuple[int, int, str]], propose) -> None:
        """Proposals from a run of capitalised tokens that may all belong to names.

        A run is proposed whole and, as a name may end before it does, also up
        to a word for an organisation or a place and up to a line break.
        """
        while run and run[-1][2] == ",":
            run = run[:-1]
        if not run:
            return
        ends = [len(run)]
        if run[-1][2].lower() in PLACE_AFTER:
            ends.append(len(run) - 1)
        ends += [k for k in range(1, len(run)) if "\n" in s[run[k - 1][1] : run[k][0]]]
        titled, fresh = False, True
        for k, (a, _, word) in enumerate(run):
            if _TITLE_ONLY.match(word):
                titled, fresh = True, True
                continue
            if word == "," or (word.lower() in _PARTS and not titled):
                continue
            low = word.lower()
            if fresh or low in self.lexicon.first_names or low.split("-")[0] in self.lexicon.family_names:
                for n in ends:
                    if run[n - 1][2] != "," and n - k >= (1 if titled else 2):
                        propose(a, run[n - 1][1], titled)
            fresh = titled = False

    def names(self, s: str, low: str, codes: np.ndarray, h: np.ndarray, first_at: np.ndarray, last_at: np.ndarray) -> list[Span]:
        lex = self.lexicon
        given, family = lex.hits(lex.first, h), lex.hits(lex.family, h)
        spots: dict[tuple[int, int], bool] = {}

        def propose(start: int, end: int, titled: bool) -> None:
            if end - start >= 2:
                spots[start, end] = titled or spots.get((start, end), False)

        upper = self.capital[codes[first_at]] if len(first_at) else np.zeros(0, bool)
        pair = np.zeros(len(upper), bool)
        if len(upper) > 1:
            then = codes[np.minimum(last_at, len(codes) - 1)]
            going = upper & ((then == 32) | (then == 10) | (then == 44) | (then == 46))
            near = np.append(first_at[1:] - last_at[:-1] <= 4, False)
            part = lex.hits(self.particles, h)
            pair[:-1] = going[:-1] & near[:-1] & upper[1:]
            if len(upper) > 2:  # a particle, or two, between
                pair[:-2] |= going[:-2] & near[:-2] & part[1:-1] & upper[2:]
            if len(upper) > 3:
                pair[:-3] |= going[:-3] & near[:-3] & part[1:-2] & part[2:-1] & upper[3:]
        at_first, at_last = first_at.tolist(), last_at.tolist()
        after = 0
        for k in np.flatnonzero(pair).tolist():
            at = at_first[k]
            if at < after or (m := _SEQ.match(s, at)) is None:
                continue
            after = m.end()
            run: list[tuple[int, int, str]] = []
            for t in (*_TOKENS.finditer(s, at, after), None):
                word = t.group() if t else ""
                plain = word.lower()
                if t and (plain in lex.first_names or plain not in _STOP or _TITLE_ONLY.match(word) or (run and plain in PLACE_AFTER)):
                    run.append((t.start(), t.end(), word))
                    continue
                if run:
                    self._run(s, run, propose)
                    run = []
        # a name in an address of the mail, a handle or behind a hyphen is none
        joined = self.joined[codes[np.maximum(first_at - 1, 0)]] & (first_at > 0) if len(first_at) else np.zeros(0, bool)
        for k in np.flatnonzero(given & ~joined).tolist():
            if (m := _FORWARD.match(s, at_first[k])) is not None:
                propose(at_first[k], m.end(), False)
        mail = self.mail[codes[np.minimum(last_at, len(codes) - 1)]] & (last_at < len(codes)) if len(first_at) else joined
        for k in np.flatnonzero(family & ~joined & ~mail).tolist():
            a, b = at_first[k], at_last[k]
            while s[b : b + 1] == "-" and (t := _R14.match(s, b, b + 30)) is not None:
                b = t.end()
            prev = s[at_first[k - 1] : at_last[k - 1]].lower() if k and a - at_last[k - 1] <= 3 else ""
            back = _BACK.search(s, max(0, a - 45), a) if prev and (len(prev) == 1 or given[k - 1] or prev in _PART_WORDS or prev in TITLES) else None
            head = back.group("first").lower() if back and back.group("first") else ""
            if back and head in lex.first_names:
                propose(back.start("first"), b, bool(back.group("title")))
            elif back and back.group("title") and len(head) == 1:
                propose(back.start("first"), b, True)
            elif back and (back.group("init") or (back.group("title") and not head) or head in TITLES):
                at = back.start("init") if back.group("init") else back.start("part") if back.group("part") else a
                propose(at, b, bool(back.group("title")) or head in TITLES)
            elif s[b : b + 1] == "," and (t := _INVERTED.match(s, a)) is not None:
                propose(a, t.end(), False)
        if "name" in low:
            for m in _LABEL.finditer(low):
                v = _AFTER_LABEL.match(s, m.end())
                if v:
                    propose(v.start("name"), v.end("name"), True)
        return [Span(a, e, "person_name", self._name(s, a, e, t)) for (a, e), t in spots.items()]

    def _name(self, s: str, start: int, end: int, titled: bool) -> tuple[int, ...]:
        lex = self.lexicon
        text = s[start:end]
        words = _R15.findall(text)
        low = [w.lower() for w in words]
        parts = _PART_WORDS
        real = [w for w in low if w not in parts and len(w) > 1]
        before = self._near(s, start)
        behind = self._after(s, end, 30)
        follows = _HYPHENED.search(behind)
        inverted = bool(_R16.match(text))
        last = (real[0] if inverted else real[-1]) if real else ""
        head = (real[-1] if inverted else real[0]) if real else ""
        prev = before[-1] if before else ""
        nxt = follows.group().lower() if follows else ""
        front = self._before(s, start, 14)
        near_end = front[-1:]
        if prev.rstrip(".") in TITLES:
            titled = True
        return (
            int(head in lex.first_names), int(last in lex.family_names), int(any(w in lex.first_names for w in real)), sum(w in lex.family_names for w in real[:6]), min(len(real), 8), int(bool(_R17.search(text))), int(any(w in parts for w in low)),
            int("-" in text), int(inverted), int(titled), int(text.isupper()), int(text.islower()), int(all(w[:1].isupper() for w in words)), int(prev in NAME_BEFORE), int(prev in ARTICLES), int(prev in ("for", "with", "by", "at", "from", "of")), int(nxt in PLACE_AFTER), int(any(w in PLACE_AFTER for w in real)),
            int(nxt in NAME_AFTER), int(head in _COMMON), sum(w in _COMMON for w in real[:8]), min(len(last), 15), int(last[-4:] in lex.endings), int(bool(real) and bool(_STREET_END.match(real[-1]))), int(bool(_R18.search(front[-8:]))),
            int(near_end in ("(", "<", '"')), int(front[-2:] in (": ", ", ", "- ")), int(near_end in ("", "\n")), int(behind[:1] in (",", ".", ";", ")", "\n", "", "<")), int(behind[:2] in ("'s", "’s")), int(behind[:1] == "&" or behind[:2] == " &" or near_end == "&" or front[-2:] == "& "),
            int(bool(_R19.search(behind))), int("\n" in text), min(len(text) // 4, 12), int(head in _NEVER), int(bool(_CAPS_BEFORE.search(front)) + 2 * bool(_CAPS_AFTER.match(behind))), int(any(w in _STATES for w in real)), sum(w in lex.other for w in real[:6]), int(bool(real) and real[-1] in lex.other), int(prev in ("as", "be", "job", "a", "an", "un", "una", "de")),
            int(bool(_R20.search(real[-1] if real else ""))), int(front.rstrip()[-1:] in ("=", ":", ">", "→") and bool(_R21.search(front))),
        )

    def proposals(self, s: str) -> list[Span]:
        codes = np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), 0x1FFFF)
        h, a, b = self.words.spans(codes)
        low = s.lower()
        if len(low) != len(s):  # a few letters change their length
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
        return [*self.emails(s, low), *self.numbers(s), *self.addresses(s, low), *self.names(s, low, codes, h, a, b)]

    # ---- decisions -------------------------------------------------------------------------------------------
    def group(self, kind: str) -> str:
        return "number" if kind in ("phone", "identity_number") else kind

    def found(self, texts: list[str | None], together: int = 400_000) -> list[list[tuple[int, int, str, float]]]:
        """For each text its spans: (start, end, kind, probability), places of the stored text, from 0.

        Texts are scanned together up to about so many characters, so that
        short texts cost no more than their length.
        """
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if t:
                group.append(i)
                size += len(t) + 1
                if size >= together:
                    self._scan(texts, group, out)
                    group, size = [], 0
        if group:
            self._scan(texts, group, out)
        return out

    def _scan(self, texts: list[str | None], group: list[int], out: list[list[tuple[int, int, str, float]]]) -> None:
        parts = [texts[i].replace(END, " ") for i in group]
        first = np.cumsum([0, *[len(p) + 1 for p in parts]])
        s, at = self.plainly(END.join(parts))
        spans = self.proposals(s)
        kept: list[tuple[int, int, str, float]] = []
        for g, model in self.models.items():
            own = [x for x in spans if self.group(x.kind) == g]
            if own:
                q = model.probability(np.clip(np.array([x.features for x in own], np.int64), 0, 31))
                kept += [(x.start, x.end, x.kind, float(v)) for x, v in zip(own, q) if v >= model.threshold]
        kept.sort()
        # of overlapping spans the most probable, then the longest, then the first
        chosen: list[tuple[int, int, str, float]] = []
        cluster: list[tuple[int, int, str, float]] = []
        reach = -1
        for x in [*kept, (len(s) + 1, len(s) + 1, "", 0.0)]:
            if x[0] >= reach:
                won: list[tuple[int, int, str, float]] = []
                for y in sorted(cluster, key=lambda y: (-round(y[3], 2), y[0] - y[1], y[0])):
                    if all(y[1] <= w[0] or y[0] >= w[1] for w in won):
                        won.append(y)
                chosen += sorted(won)
                cluster = []
            cluster.append(x)
            reach = max(reach, x[1])
        if not chosen:
            return
        a, b = np.array([x[0] for x in chosen]), np.array([x[1] for x in chosen])
        if at is not None:
            a, b = at[a], at[b - 1] + 1
        own = np.searchsorted(first, a, "right") - 1
        for k, i, j, x in zip(own.tolist(), (a - first[own]).tolist(), (b - first[own]).tolist(), chosen):
            out[group[k]].append((i, j, x[2], x[3]))


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """`text` with each span replaced by its kind's placeholder."""
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def saved(spark, fitted: dict) -> str:
    """`fitted` written to the shared folder and sent to the executors as a file; its name. A file of its own can be loaded again with `loaded`."""
    import pickle
    import uuid

    from pyarrow import fs

    from veilgauge.session import shared_dir

    name = f"pii-{uuid.uuid4().hex}.model"
    uri = f"{shared_dir(spark)}/{name}"
    uri = uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path) as out:
        out.write(pickle.dumps(fitted))
    spark.sparkContext.addFile(uri)
    return name


def loaded(name: str) -> dict:
    """What `saved` wrote, by its name in a task or by its path."""
    import os
    import pickle

    from pyspark import SparkFiles

    with open(name if os.path.isabs(name) else SparkFiles.get(name), "rb") as f:
        return pickle.load(f)  # noqa: S301  written by this application


_SCANNERS: dict[str, Scanner] = {}


def _scanner(name: str) -> Scanner:
    """The scanner of a saved model, made once in each Python worker."""
    if name not in _SCANNERS:
        f = loaded(name)
        _SCANNERS.clear()
        _SCANNERS[name] = Scanner(f["first"], f["family"], f["other"], f["models"])
    return _SCANNERS[name]


def spans(df, fitted: dict | str, id_cols: tuple[str, ...], text_col: str = "text"):
    """(ids, start_at, end_at, pii_kind, probability): one row per span of each row of `df`; places are 1-based code points, end_at excluded.

    `fitted` comes from `pii_training.fitted`, or is the name that `saved`
    gave it; the model is sent to the executors as a file and loaded once in
    each Python worker, whatever the size of the lexicon.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import functions as F

    from veilgauge.session import spread

    name = fitted if isinstance(fitted, str) else saved(df.sparkSession, fitted)
    kinds = dict(df.dtypes)
    base = spread(df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(id_cols)], F.col(f"`{text_col}`").alias("_t")).where("_t IS NOT NULL AND _t <> ''"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(name)
        for batch in batches:
            found = scanner.found(list(batch["_t"]))
            rows = np.repeat(np.arange(len(batch)), [len(x) for x in found])
            flat = [x for own in found for x in own]
            out = {f"_k{i}": batch[f"_k{i}"].to_numpy()[rows] for i in range(len(id_cols))}
            out |= {"start_at": [x[0] + 1 for x in flat], "end_at": [x[1] + 1 for x in flat], "pii_kind": [x[2] for x in flat], "probability": [x[3] for x in flat]}
            yield pd.DataFrame(out)

    schema = ", ".join([*[f"_k{i} {kinds[c]}" for i, c in enumerate(id_cols)], "start_at int", "end_at int", "pii_kind string", "probability double"])
    return base.mapInPandas(run, schema).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(id_cols)})


def redacted(df, fitted: dict | str, text_col: str = "text", out_col: str = "redacted"):
    """`df` with the column `out_col`: the text with typed placeholders; null stays null, an existing column of that name is replaced."""
    import pandas as pd
    from pyspark.sql import functions as F

    name = fitted if isinstance(fitted, str) else saved(df.sparkSession, fitted)

    def run(batches):
        scanner = _scanner(name)
        for texts in batches:
            own = [None if t is None else t for t in texts]
            yield pd.Series([None if t is None else redact(t, x) for t, x in zip(own, scanner.found(own))])

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out_col, F.pandas_udf(run, "string")(F.col(f"`{text_col}`")))
