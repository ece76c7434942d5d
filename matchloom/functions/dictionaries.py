"""Word lists and script blocks that results depend on."""

# Fixed values (required for equal results): token expansions of the engineered features.
EXPAND = {
    "pvt": "private", "pvtltd": "private limited", "ltd": "limited", "llc": "limited liability company", "inc": "incorporated", "corp": "corporation",
    "co": "company", "corporation": "corporation", "rd": "road", "st": "street", "dr": "drive", "ave": "avenue", "av": "avenue", "blvd": "boulevard",
    "ln": "lane", "hwy": "highway", "ste": "suite", "apt": "apartment", "bldg": "building", "fl": "floor", "no": "number", "nr": "near",
    "opp": "opposite", "mt": "mount", "ctr": "center", "pl": "place", "ct": "court", "sq": "square",
}
# Token expansions of the key file.
EXPAND_KEYS = {
    "inc": "incorporated", "corp": "corporation", "co": "company", "ltd": "limited", "pvt": "private", "rd": "road", "st": "street", "ave": "avenue",
    "blvd": "boulevard", "ln": "lane", "dr": "drive", "hwy": "highway", "apt": "apartment", "fl": "floor", "ste": "suite",
}
# Token expansions of the profile, whose keys, long forms included, are also the words it counts.
EXPAND_PROFILE = EXPAND_KEYS | {"llc": "limited liability company"} | {v: v for v in EXPAND_KEYS.values()}
# Token contractions of the staged pipeline.
CONTRACT = {
    "limited": "ltd", "private": "pvt", "road": "rd", "street": "st", "incorporated": "inc", "drive": "dr", "avenue": "ave", "floor": "fl",
    "company": "co", "corporation": "corp", "boulevard": "blvd", "apartment": "apt", "highway": "hwy", "lane": "ln",
}
# Tokens dropped from a name's core.
CORPORATE = ["private", "limited", "company", "corporation", "incorporated", "llc", "liability"]
# Trailing phrases and words of a legal form.
LEGAL_SUFFIXES = [
    "limited liability company", "private limited", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "pvt", "private", "llc",
]
# Tokens that stand for nothing.
NULL_LIKE = ["", "null", "none", "nan", "n/a"]
# Unicode blocks of the scripts told apart.
SCRIPTS = {
    "DEVANAGARI": (0x0900, 0x097F), "BENGALI": (0x0980, 0x09FF), "GURMUKHI": (0x0A00, 0x0A7F), "GUJARATI": (0x0A80, 0x0AFF), "ORIYA": (0x0B00, 0x0B7F),
    "TAMIL": (0x0B80, 0x0BFF), "TELUGU": (0x0C00, 0x0C7F), "KANNADA": (0x0C80, 0x0CFF), "MALAYALAM": (0x0D00, 0x0D7F), "ARABIC": (0x0600, 0x06FF),
    "CYRILLIC": (0x0400, 0x04FF),
}
INDIC = [s for s in SCRIPTS if s not in ("ARABIC", "CYRILLIC")]
#: Postal codes by country as they stand in normalised addresses; open for more countries.
POSTAL = {"INDIA": r"\b[1-9][0-9]{5}\b", "US": r"\b\d{5}(?:-\d{4})?\b", "FRANCE": r"\b\d{5}\b"}
COUNTRY_ALIASES = {"IN": "INDIA", "USA": "US", "UNITED STATES": "US", "FR": "FRANCE"}
