"""Fixed values of the engine: attributes, word lists, lookup tables, patterns, tips and limits.

Results depend on exactly these values, so they are written out plainly and
kept together here.
"""

from __future__ import annotations

# Known attributes by category.
DIRECT = ("full_name", "email", "phone", "ssn_or_nin", "address", "date_of_birth")
QUASI = ("age_range", "gender", "ethnicity", "occupation", "employer", "education_level", "postcode_district", "marital_status", "nationality")
CONTEXTUAL = ("medical_conditions", "legal_involvement", "financial_status", "religion", "sexual_orientation")
CATEGORY = {**dict.fromkeys(DIRECT, "direct"), **dict.fromkeys(QUASI, "quasi"), **dict.fromkeys(CONTEXTUAL, "contextual")}

# Columns of the population table that a filter may name, in order.
POPULATION_COLUMNS = ("age_range", "gender", "ethnicity", "occupation", "postcode_district", "marital_status", "nationality")

# Markers and limits.
UNKNOWN = "unknown"
NO_POPULATION = 1_000_000
CONFIDENCE_THRESHOLD = 0.5
RATING_BELOW = (("LOW", 0.1), ("MEDIUM", 0.3), ("HIGH", 0.9))
TOP_RATING = "CRITICAL"
SMALL_GROUP = 5

# Confidences of the detectors.
CONFIDENCE = {
    "email": 0.99, "phone": 0.95, "ssn_or_nin": 1.0, "address": 0.9, "date_of_birth": 0.9, "age_range": 0.82, "gender": 0.85, "occupation": 0.88, "employer": 0.78, "marital_status": 0.76,
    "postcode_uk": 0.86, "postcode_us": 0.8, "medical_conditions": 0.9, "ethnicity": 0.85, "religion": 0.85, "sexual_orientation": 0.85, "name_cue": 0.9, "name_first": 0.8,
}

# Patterns (Java syntax).
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_NANP = r"\b(?:\+?\d{1,2}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"
PHONE_UK = r"(?<!\d)(?:(?:\+44|0044)[\s.-]?\(?0?\)?[\s.-]?\d{2,5}|\(?0\d{2,4}\)?)[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?!\d)"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
NIN = r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b"
CARD = r"\b(?:\d[ -]*?){13,16}\b"
AGE = r"(?i)\bage[ds]?\s+(\d{2})\b|\b(\d{2})\s*[-\s]?(?:years?\s*old|year-old|y/?o)\b"
POSTCODE_UK = r"\b([A-PR-UWYZ][A-HK-Y]?)(?:\d[A-HJKMNPR-Y]?|\d\d)\s?\d[ABD-HJLNP-UW-Z]{2}\b"
ZIP_LABEL = r"(?i)\b(?:zip(?:[ \t]*code)?|postal[ \t]+code)\b[ \t]*(?::|#|is|was)?[ \t]*(\d{5})(?:-\d{4})?(?!\d)"
PO_BOX = r"(?i)\b(?:P\.?[ \t]?O\.?|Post[ \t]+Office)[ \t]*Box[ \t]+\d+\b"
EMPLOYER = r"(?i)\b(?:works at|employed by|employee at)\s+([A-Z][\w&\- ]+)\b"
ZODIAC = r"\b(?:sign|tropic)(?:\s+(?:of|is|was))?\s*:?\s+cancer\b"
CAPITALISED_RUN = r"\b[A-Z][\w'`’-]+(?:[ \-][A-Z][\w'`’-]+)*\b"
CAPITALISED_PAIR = r"\b([A-Z][\w'`’-]+(?:[ \-][A-Z][\w'`’-]+)+)\b"
STREET_FULL = "Street|Avenue|Road|Lane|Drive|Boulevard|Way|Court|Place|Terrace|Close|Crescent|Parkway|Highway|Square|Circle|Gardens|Grove|Mews|Parade|Plaza|Trail"
STREET_SHORT = "St|Ave|Rd|Ln|Blvd|Ct|Pl|Cres|Pkwy|Hwy|Sq|Cir"
COMPASS = "NE|NW|SE|SW|N|S|E|W"
ADDRESS = (
    r"(?<![\w,.])\d{1,5}[A-Za-z]?(?:-\d{1,5})?,?[ \t]+(?:(?:[A-Z][^\W\d_]*(?:['’\-][^\W\d_]+)*|\d{1,3}(?:st|nd|rd|th))\.?[ \t]+){1,4}?"
    rf"(?:(?:{STREET_FULL})\b|(?:{STREET_SHORT})\b\.?|Dr\b(?!\.?[ \t]+[A-Z][a-z])\.?)(?:[ \t]+(?:{COMPASS})\b)?"
)
BIRTH_CUE = r"(?:(?i:\b(?:born|d\.?\s?o\.?\s?b|date\s+of\s+birth|birth\s*date|birthday)(?![a-z]))\.?|(?<![\w.])b\.(?=\s))"
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DATE = (
    rf"(?i:\b(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-](?:\d{{4}}|\d{{2}})|\d{{4}}[/.-]\d{{1,2}}[/.-]\d{{1,2}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{MONTH})\.?,?\s+\d{{4}}"
    rf"|(?:{MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})(?!\d))"
)

# Occupations, conditions and their order.
ROLES = ("nurse", "teacher", "engineer", "marine biologist", "doctor", "lawyer", "accountant", "journalist")
CONDITIONS = ("diabetes", "cancer", "depression", "asthma")

# States of the USA, and codes that need no comma or need one before a ZIP code.
STATES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "District of Columbia", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas",
    "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York",
    "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Puerto Rico", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia",
    "Washington", "West Virginia", "Wisconsin", "Wyoming",
)
STATE_CODES = "AK AR AZ CA DC FL GA IA IL KS KY LA MN MO MT NC ND NE NH NJ NM NV NY PR RI SC SD TN TX UT VA VT WA WI WV WY".split()
STATE_CODES_WITH_COMMA = "AL CO CT DE HI ID IN MA MD ME MI MS OH OK OR PA".split()

# Words around full names. Cues and labels, words that end a run of name words, words that make it an
# organisation, place or condition, places before a name, particles inside it, and words for people and their owners.
HONORIFIC = "Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Sir|Dame"
NAME_LABEL = r"(?:sur|fore)?name\s*(?::|=|-\s|\bis\b|\bwas\b)"
NAME_STOP_WORDS = (
    "january february march april may june july august september sept october november december feb mar apr jun jul aug sep oct nov dec monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "morning afternoon evening night today tomorrow yesterday christmas easter a an and or but nor not the this that these those there here then than of in on at to for from with by about as into onto over under after before "
    "is was are were be been has had have will would shall should can could may might must do does did said says told asked who whom whose which what when where why how he she they we you it i me him her them us his hers their theirs our your its my mine "
    "mr mrs ms miss mx dr prof sir dame redacted anonymised anonymized anonymous anon withheld removed hidden masked deleted omitted confidential private unknown none null blank tbc tbd na "
    "patient patients client clients person people name surname forename safety care records record notes portal transport information experience advice liaison access support advocate advocacy relations account feedback "
    "satisfaction outcomes education leaflet participation choice voice journey pathway reference number id identifier details demographics summary history consent status list registry register zero discharge admission assessment "
    "review guide charter rights forum panel success manager onboarding agreement contract data file files side area zone code new "
    "england scotland wales ireland britain uk usa america europe africa asia canada australia mexico india china pakistan italy france spain germany"
).split()
NAME_ENTITY_WORDS = (
    "street st road rd avenue ave ln drive boulevard blvd way ct place pl terrace close crescent parkway highway hwy square sq circle mews grove station line airport bridge river lake bay valley hills heights island islands beach "
    "forest mountain mountains falls springs creek harbor harbour palace tower house building estate village town city county state province district borough region wing unit suite garden gardens "
    "hospital clinic surgery practice centre center chapel cathedral mosque temple synagogue museum gallery library theatre theater stadium arena hotel inn restaurant cafe café bar pub shop store stores market mall pharmacy "
    "school college university institute academy labs lab laboratory laboratories inc ltd llc llp plc corp corporation company co group holdings partners partnership associates solutions systems technologies tech bank "
    "council board committee commission agency authority department ministry office service services society association union club fc team foundation trust charity fund appeal league show cup bowl award awards prize "
    "medal memorial project programme program scheme act day disease syndrome palsy lymphoma sarcoma scale test score method effect theorem principle aid science democrat democrats democratic"
).split()
NAME_PLACE_PREFIXES = "st saint san santa fort ft port mount mt lake cape glen notre".split()
NAME_PARTICLES = "van von der den de del della di da dos das du la le bin ibn al el ter ten".split()
NAME_OWNERS = "my his her their your our whose full legal maiden first last given preferred birth".split()
MORE_PERSON_WORDS = "someone somebody guy baby friend brother sister doctor nurse teacher".split()
LOCATION_WORDS = "to on onto in into from at the".split()

# Terms of sensitive groups and the group each stands for.
PERSON_NOUNS = "woman women man men person people patient patients girl boy lady ladies gentleman gentlemen female male individual adult child children teen teenager student mother father mum mom dad wife husband partner son daughter family couple neighbour neighbor colleague employee worker resident client customer applicant youth veteran convert priest nun monk".split()
ETHNICITY = {
    "african american": "black", "afro caribbean": "black", "black british": "black", "black african": "black", "black caribbean": "black", "black": "black", "white british": "white", "white irish": "white",
    "caucasian": "white", "white": "white", "south asian": "asian", "east asian": "asian", "british asian": "asian", "asian american": "asian", "asian": "asian", "hispanic": "hispanic", "latino": "hispanic",
    "latina": "hispanic", "latinx": "hispanic", "mixed race": "mixed", "biracial": "mixed", "multiracial": "mixed",
}
ORIGINS = {
    "african": "black", "caribbean": "black", "indian": "asian", "pakistani": "asian", "bangladeshi": "asian", "chinese": "asian", "japanese": "asian", "korean": "asian", "vietnamese": "asian", "filipino": "asian",
    "mexican": "hispanic", "cuban": "hispanic", "puerto rican": "hispanic", "latin american": "hispanic", "european": "white", "mixed": "mixed",
}
RELIGION = {
    "muslim": "muslim", "jewish": "jewish", "jew": "jewish", "hindu": "hindu", "sikh": "sikh", "buddhist": "buddhist", "christian": "christian", "roman catholic": "christian", "catholic": "christian",
    "protestant": "christian", "anglican": "christian", "baptist": "christian", "methodist": "christian", "evangelical": "christian",
}
RELIGION_MODIFIERS = "practi[cs]ing|devout|observant|strict|lapsed|non-practi[cs]ing|orthodox|committed|born-again|conservative|reform|secular|sunni|shia"
# What stands around those terms. A subject, its verb, the end of the clause, a self-description, a label, and nouns of descent.
SUBJECT = rf"(?:\b(?:i|we|she|he|they|who|{'|'.join(PERSON_NOUNS)})|(?-i:\b(?!(?:It|This|That|There|Which|What)\b)[A-Z][a-z]+))"
COPULA = r"(?:\s+(?:is|was|am|are|were)|['’](?:s|m|re))\s+"
CLAUSE_END = r"(?=[ \t]*(?:[,.;:!?)\]\n]|$)|\s+(?:and|but|who|since|from|by|so|although|though|as|like|with|in|at|for)\b)"
IDENTIFIES_AS = r"\b(?:(?:self-)?identif(?:y|ies|ied|ying)|describes?\s+(?:her|him|them)sel(?:f|ves))\s+as\s+(?:an?\s+)?"
TERM_LABEL = r"\s*(?::|=|-|\bis\b|\bwas\b)\s*"
DESCENT = "descent|origin|heritage|background|ancestry|ethnicity|extraction"
ORIENTATION = {"gay": "gay", "lesbian": "lesbian", "bisexual": "bisexual", "pansexual": "pansexual", "asexual": "asexual", "homosexual": "gay", "heterosexual": "heterosexual", "queer": "queer", "straight": "heterosexual"}

# Whole values that mean "no value", and beginnings that do.
PLACEHOLDERS = ("", "none", "null", "nil", "undefined", "n/a", "n.a", "na", "unknown", "undisclosed", "unspecified", "unable to determine", "no mention", "no information", "no data", "redacted", "anonymised", "anonymized", "withheld", "masked")
NOT_GIVEN = r"^(?:not|none|no|cannot be|could not be) (?:mentioned|present|stated|specified|provided|available|applicable|given|found|disclosed|known|determined|inferred|inferable|identified|indicated)\b"
SURROUNDING = " \t\r\n\"'`.,;:!?()"

# Wordings of ages.
DECADE_WORDS = {"teen": 1, "teens": 1, "teenage": 1, "teenager": 1, "twenties": 2, "thirties": 3, "forties": 4, "fifties": 5, "sixties": 6, "seventies": 7, "eighties": 8, "nineties": 9}
AGE_FILLER = "a about age aged ages and approx approximately around between circa early her his in late likely mid old or probably roughly the their to y/o year years yo yr yrs ~".split()

# Synonyms of quasi-identifier values.
GENDER_WORDS = {"f": "female", "female": "female", "woman": "female", "women": "female", "girl": "female", "lady": "female", "m": "male", "male": "male", "man": "male", "men": "male", "boy": "male", "gentleman": "male"}
NATIONALITY_WORDS = {
    "us": "american", "usa": "american", "united states": "american", "united states of america": "american", "america": "american", "american": "american", "uk": "british", "gb": "british", "great britain": "british",
    "britain": "british", "united kingdom": "british", "british": "british", "england": "british", "english": "british", "scotland": "british", "scottish": "british", "wales": "british", "welsh": "british",
    "northern ireland": "british", "northern irish": "british", "ireland": "irish", "canada": "canadian", "mexico": "mexican", "india": "indian", "pakistan": "pakistani", "bangladesh": "bangladeshi", "china": "chinese",
    "philippines": "filipino", "germany": "german", "france": "french", "italy": "italian", "spain": "spanish", "poland": "polish", "nigeria": "nigerian", "australia": "australian",
}
MARITAL_WORDS = {"never married": "single", "not married": "single", "unmarried": "single", "wed": "married", "civil partnership": "married", "in a civil partnership": "married", "divorcee": "divorced", "widow": "widowed", "widower": "widowed", "legally separated": "separated"}
ETHNICITY_WORDS = {
    "latino": "hispanic", "latina": "hispanic", "latinx": "hispanic", "latine": "hispanic", "hispanic or latino": "hispanic", "african american": "black", "black american": "black", "black british": "black",
    "asian american": "asian", "asian british": "asian", "caucasian": "white", "white british": "white", "mixed race": "mixed", "multiracial": "mixed", "biracial": "mixed",
}
OCCUPATION_WORDS = {"registered_nurse": "nurse", "rn": "nurse", "physician": "doctor", "medical_doctor": "doctor", "general_practitioner": "doctor", "gp": "doctor", "attorney": "lawyer", "solicitor": "lawyer", "barrister": "lawyer", "schoolteacher": "teacher", "school_teacher": "teacher"}

# Recommendations.
DIRECT_TIPS = {
    "full_name": "Remove full names and replace with role-based placeholders.",
    "email": "Redact email addresses or replace with synthetic aliases.",
    "phone": "Remove phone numbers, including partially masked variants.",
    "ssn_or_nin": "Fully remove SSN/NIN values; partial masking is insufficient.",
    "address": "Generalize exact address to city or region level.",
    "date_of_birth": "Remove dates of birth; keep at most the year if needed.",
}
QUASI_TIPS = {
    "age_range": "Broaden age into wider buckets (e.g., 20-year range).",
    "occupation": "Generalize niche roles (e.g., marine biologist -> scientist).",
    "employer": "Replace employer names with sector-level categories.",
    "postcode_district": "Reduce geography precision to state/county level.",
    "education_level": "Remove graduation year and institution-level clues.",
    "marital_status": "Drop marital status when not needed for analysis.",
}
CONTEXTUAL_TIPS = {
    "medical_conditions": "Generalize specific diagnoses into broad condition groups.",
    "legal_involvement": "Abstract legal details to high-level categories.",
    "financial_status": "Avoid exact income/debt values; use broad bands.",
    "religion": "Remove religion references unless strictly required.",
    "sexual_orientation": "Avoid sexual orientation markers in shared text.",
}
SECOND_PASS_TIP = "Consider a second anonymization pass and re-score before releasing this text."
DISPARITY_FLAG = "Potential minority-group re-identification amplification: small population match with sensitive group marker."

# The benchmark's attributes, scenarios and thresholds.
BENCH_DIRECT = ("name", "ssn", "credit_card", "phone_number", "address", "email")
BENCH_INDIRECT = ("state_of_residence", "gender", "date_of_birth", "race", "marital_status", "education_level", "employment_status", "occupation", "citizenship_status")
SCENARIOS = {"medical": ("Patient:", "Doctor:"), "chatbot": ("Person:", "Chatbot:"), "meeting": ("Target:", "Other:")}
DIFFICULTIES = ("explicit_easy", "explicit_hard", "implicit")
NUMERIC_EXACT = ("ssn", "credit_card", "phone_number", "age", "date_of_birth")
MATCH_THRESHOLD = {"state_of_residence": 0.93, "gender": 0.98, "race": 0.9, "marital_status": 0.92, "education_level": 0.95, "employment_status": 0.92, "occupation": 0.9, "citizenship_status": 0.94, "name": 0.95, "address": 0.9, "email": 0.98}
ATTACK_STATES = ("california", "florida", "illinois", "new york", "texas", "washington")
ATTACK_ROLES = ("mechanical engineers", "engineer", "teacher", "nurse", "doctor", "lawyer")

# The illustrative population (age range, gender, ethnicity, occupation, postcode district, marital status, nationality, count).
SAMPLE_POPULATION = {
    "US": (
        ("30-39", "female", "white", "nurse", "unknown", "married", "american", 8600),
        ("30-39", "female", "white", "marine_biologist", "unknown", "married", "american", 35),
        ("30-39", "female", "white", "marine_biologist", "unknown", "single", "american", 14),
        ("40-49", "male", "white", "engineer", "unknown", "married", "american", 12100),
        ("20-29", "female", "hispanic", "teacher", "unknown", "single", "american", 10300),
        ("30-39", "male", "black", "journalist", "unknown", "single", "american", 1900),
        ("50-59", "female", "asian", "doctor", "unknown", "married", "american", 1100),
        ("30-39", "female", "white", "lawyer", "unknown", "married", "american", 5300),
        ("30-39", "female", "white", "nurse", "unknown", "single", "american", 7200),
    ),
    "GB": (
        ("30-39", "female", "white", "nurse", "SW", "married", "british", 4400),
        ("30-39", "female", "white", "marine_biologist", "SW", "married", "british", 3),
        ("30-39", "female", "white", "marine_biologist", "SW", "single", "british", 2),
        ("40-49", "male", "white", "engineer", "NW", "married", "british", 6100),
        ("20-29", "female", "asian", "teacher", "E", "single", "british", 4100),
        ("30-39", "male", "black", "journalist", "SE", "single", "british", 520),
        ("50-59", "female", "asian", "doctor", "W", "married", "british", 420),
        ("30-39", "female", "white", "lawyer", "SW", "married", "british", 1200),
        ("30-39", "female", "white", "nurse", "SW", "single", "british", 2800),
    ),
}
