"""Fixed values of the normalisation rules: spellings and what they stand for."""

# Legal forms.
LEGAL_CANON = {
    "inc": "inc", "incorporated": "inc", "lnc": "inc", "incorp": "inc",
    "llc": "llc", "llp": "llp", "lp": "lp", "plc": "plc", "gmbh": "gmbh",
    "ltd": "ltd", "limited": "ltd", "lted": "ltd",
    "pvt": "pvt", "private": "pvt", "privaet": "pvt", "prvt": "pvt",
    "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sci": "sci",
    "sa": "sa", "snc": "snc", "scop": "scop",
}

# Words that name keys leave out.
NAME_STOP = ("and", "the", "of", "de", "la", "le", "les", "du", "des", "et")

# Long and short forms of words in names.
NAME_CANON = {
    "international": "intl", "intl": "intl", "natl": "natl", "national": "natl",
    "manufacturing": "mfg", "manufacturers": "mfg", "manufacturer": "mfg", "mfg": "mfg",
    "services": "svc", "service": "svc", "svcs": "svc", "svc": "svc",
    "associates": "assoc", "associate": "assoc", "assoc": "assoc", "assocs": "assoc",
    "brothers": "bros", "bros": "bros", "management": "mgmt", "mgmt": "mgmt",
    "technologies": "tech", "technology": "tech", "tech": "tech", "technical": "tech",
    "industries": "ind", "industrial": "ind", "industry": "ind",
    "enterprises": "ent", "enterprise": "ent", "entreprise": "ent", "entreprises": "ent",
    "solutions": "soln", "solution": "soln", "systems": "sys", "system": "sys",
    "engineering": "engg", "engineers": "engg", "engineer": "engg",
    "construction": "constr", "constructions": "constr",
    "development": "dev", "developers": "dev", "developer": "dev",
    "trading": "trdg", "traders": "trdg", "trader": "trdg",
    "distributors": "distr", "distributor": "distr", "distribution": "distr",
    "marketing": "mktg", "agency": "agcy", "agencies": "agcy",
    "holdings": "hldg", "holding": "hldg", "laboratories": "lab", "laboratory": "lab",
    "pharmaceuticals": "pharma", "pharmaceutical": "pharma",
    "products": "prod", "product": "prod", "supplies": "sply", "supply": "sply",
    "equipments": "equip", "equipment": "equip", "machinery": "mach",
    "transport": "trans", "transportation": "trans", "logistics": "logi",
    "consultancy": "cons", "consultants": "cons", "consulting": "cons", "consultant": "cons",
    "societe": "ste2", "restaurant": "rest", "hospital": "hosp",
}

# Long and short forms of words in addresses.
ADDR_CANON = {
    "street": "st", "road": "rd", "avenue": "ave", "av": "ave", "boulevard": "blvd",
    "bd": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "circle": "cir",
    "highway": "hwy", "parkway": "pkwy", "place": "pl", "terrace": "ter",
    "r": "rue", "square": "sq", "suite": "ste",
    "chemin": "ch", "route": "rte", "allee": "all", "allees": "all",
    "impasse": "imp", "quai": "qai", "cours": "crs", "faubourg": "fbg",
    "residence": "res", "batiment": "bat", "zone": "zi", "industrielle": "zi",
}

# Words that addresses drop.
ADDR_DROP = (
    "unit", "ste", "apt", "flr", "floor", "room", "no", "number", "nr", "near",
    "opp", "opposite", "behind", "h", "hn", "hno", "door", "plot", "null", "nan",
    "none", "and",
    "de", "du", "des", "la", "le", "les", "et", "aux",
)

# Suffixes of ordinal numbers, dropped right after digits.
ORDINAL_SUFFIX = ("nd", "rd", "th")

# Letter groups folded to one sound, applied in this order.
DIGRAPHS = (
    ("sh", "s"), ("ch", "c"), ("th", "t"), ("ph", "f"), ("bh", "b"), ("dh", "d"),
    ("gh", "g"), ("kh", "k"), ("jh", "j"), ("zh", "z"), ("ck", "k"), ("qu", "k"),
    ("ee", "i"), ("oo", "u"), ("aa", "a"), ("ii", "i"),
)

# Patterns.
ACRONYM = r"\b([a-z])\.([a-z])\.([a-z])\.?"
TLD = r"\.(com|net|org|in|fr|io|co\.in|co\.uk)\b"
STORE_NUMBER = r"#\s*\d+"
LEET_FROM, LEET_TO = "013457", "oleass"
ALIAS_MARKER = r"(?i)\b(?:f/?k/?a|formerly|d/?b/?a|doing business as|trading as|t/a|a/?k/?a|also known as)\b"

# Latin letters that have no decomposition.
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"))
