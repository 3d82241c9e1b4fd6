"""An optional table of usual wordings of entries, written for occupations, nationalities and education levels.

The mapping itself knows no wordings but those of the reference list; this
table is given to it by the queries, and any other can be given instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Usual wordings of entries beside the labels the reference list has itself.
SYNONYMS = {
    "occupation": {
        "trucker": "truck_driver", "lorry driver": "truck_driver", "long haul driver": "truck_driver", "abogado": "lawyer", "abogada": "lawyer", "barrister": "lawyer", "counsel": "lawyer",
        "enfermera": "nurse", "enfermero": "nurse", "registered nurse": "nurse", "maestro": "teacher", "educator": "teacher", "school teacher": "teacher", "medico": "doctor", "medica": "doctor", "medic": "paramedic",
        "general practitioner": "doctor", "family doctor": "doctor", "mailwoman": "postal_carrier", "letter carrier": "postal_carrier", "postman": "postal_carrier", "mail carrier": "postal_carrier",
        "flatfoot": "police_officer", "policeman": "police_officer", "policewoman": "police_officer", "coder": "software_developer", "software engineer": "software_developer", "developer": "software_developer", "dev": "software_developer",
        "ingeniero civil": "civil_engineer", "fireman": "firefighter", "fire fighter": "firefighter", "barber": "hairdresser", "hair stylist": "hairdresser", "stylist": "hairdresser", "barman": "bartender", "barmaid": "bartender", "barkeep": "bartender", "mixologist": "bartender",
        "cook": "chef", "chemist shop keeper": "pharmacist", "druggist": "pharmacist", "sparky": "electrician", "chippy": "carpenter", "joiner": "carpenter", "brickie": "bricklayer", "newsman": "journalist", "correspondent": "journalist",
        "vet surgeon": "veterinarian", "veterinary surgeon": "veterinarian", "estate broker": "estate_agent", "real estate agent": "estate_agent", "letting agent": "estate_agent", "steward": "flight_attendant", "stewardess": "flight_attendant", "air steward": "flight_attendant",
        "lecturer": "university_lecturer", "lab technician": "laboratory_technician", "lab tech": "laboratory_technician", "shrink": "psychologist", "salesperson": "retail_salesperson", "shop worker": "retail_salesperson", "checkout operator": "cashier",
        "pilot": "airline_pilot", "farmhand": "farm_worker", "farm hand": "farm_worker", "mason": "bricklayer", "guard": "security_guard", "caretaker": "cleaner", "secretary": "executive_assistant", "pa": "executive_assistant",
    },
    "nationality": {
        "usa": "american", "united states": "american", "us citizen": "american", "from the us": "american", "from the usa": "american", "from america": "american", "uk": "british", "from britain": "british", "from the uk": "british", "english": "british", "from ireland": "irish",
        "from canada": "canadian", "mexicana": "mexican", "mexicano": "mexican", "from spain": "spanish", "espanol": "spanish", "from portugal": "portuguese", "portugues": "portuguese", "deutsche": "german", "from austria": "austrian", "from poland": "polish", "polski": "polish",
        "from romania": "romanian", "from nigeria": "nigerian", "from kenya": "kenyan", "from pakistan": "pakistani", "from bangladesh": "bangladeshi", "filipina": "filipino", "from vietnam": "vietnamese", "from china": "chinese", "from japan": "japanese", "from brazil": "brazilian",
        "brasileiro": "brazilian", "from colombia": "colombian", "colombiano": "colombian", "from ukraine": "ukrainian", "noncitizen": "non_citizen", "estadounidense": "american", "foreigner": "non_citizen", "alien": "non_citizen",
    },
    "education_level": {
        "undergrad degree": "bachelors_degree", "undergraduate degree": "bachelors_degree", "bachelor": "bachelors_degree", "bachelors": "bachelors_degree", "bsc": "bachelors_degree", "master": "masters_degree", "masters": "masters_degree", "postgraduate degree": "masters_degree", "mba": "masters_degree", "ma": "masters_degree",
        "doctoral degree": "doctorate", "dphil": "doctorate", "high school": "high_school_diploma", "secondary school": "high_school_diploma", "associates": "associate_degree", "associates degree": "associate_degree", "no formal education": "no_schooling", "never attended school": "no_schooling",
        "college no degree": "some_college", "college dropout": "some_college", "trade qualification": "professional_qualification", "professional certificate": "professional_qualification",
    },
}


def table(spark: SparkSession) -> DataFrame:
    """(attribute, wording, canonical_value)."""
    return spark.createDataFrame([(a, w, v) for a, own in SYNONYMS.items() for w, v in own.items()], "attribute string, wording string, canonical_value string")
