"""Fixed vocabularies of the name and address rules."""

# Abbreviations in organisation names.
NAME_WORDS = {
    "corp": "corporation", "co": "company", "inc": "incorporated", "incorp": "incorporated", "ltd": "limited",
    "pvt": "private", "pte": "private", "intl": "international", "natl": "national", "mfg": "manufacturing",
    "svcs": "services", "svc": "services", "service": "services", "tech": "technologies", "technology": "technologies",
    "ent": "enterprises", "bros": "brothers", "assoc": "associates", "assocs": "associates", "mgmt": "management",
    "grp": "group", "hldgs": "holdings", "inds": "industries", "sol": "solutions", "solns": "solutions",
    "sys": "systems", "cie": "compagnie", "ste": "societe", "n": "and", "et": "and", "llc": "llc", "l": "l",
    "st": "saint", "mt": "mount", "ft": "fort",
}

# Words of a name that carry no identity.
LEGAL_WORDS = [
    "ag", "and", "center", "centre", "co", "com", "compagnie", "company", "corporation", "de", "des", "du", "esq",
    "eurl", "fr", "france", "gmbh", "groupe", "in", "incorporated", "india", "la", "le", "les", "limited", "llc",
    "llp", "lp", "nee", "net", "of", "opc", "org", "pc", "plc", "pllc", "private", "public", "sa", "sarl", "sas",
    "sasu", "sci", "snc", "societe", "the", "us", "www",
]

# Abbreviations in addresses.
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "str": "street", "saint": "street", "sainte": "sainte", "ave": "avenue", "av": "avenue",
    "blvd": "boulevard", "bd": "boulevard", "ln": "lane", "dr": "drive", "ct": "court", "pl": "place", "sq": "square",
    "sqr": "square", "hwy": "highway", "pkwy": "parkway", "ste": "suite", "apt": "apartment", "fl": "floor",
    "flr": "floor", "bldg": "building", "blk": "block", "sec": "sector", "nr": "near", "opp": "opposite",
    "mkt": "market", "ngr": "nagar", "extn": "extension", "ext": "extension", "cir": "circle", "ter": "terrace",
    "terr": "terrace", "trl": "trail", "rte": "route", "hno": "house", "h": "house", "no": "number", "stn": "station",
    "twp": "township", "mtn": "mountain", "pt": "point", "cv": "cove", "crk": "creek", "hts": "heights",
    "xing": "crossing", "pk": "park", "fwy": "freeway", "expy": "expressway", "tpke": "turnpike", "cres": "crescent",
    "plz": "plaza", "lk": "lake", "vlg": "village", "jn": "junction", "chem": "chemin", "ch": "chemin",
    "imp": "impasse", "fbg": "faubourg", "fg": "faubourg", "r": "rue", "all": "allee", "qu": "quai", "crs": "cours",
    "sent": "sentier", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw",
    "southeast": "se", "southwest": "sw", "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th",
    "fifth": "5th",
}

# Address words that carry no identity.
ADDRESS_STOP = [
    "and", "apartment", "at", "avenue", "behind", "beside", "box", "c/o", "city", "co", "de", "des", "drive", "du",
    "floor", "house", "in", "la", "lane", "le", "les", "n/a", "na", "near", "next", "none", "null", "number", "of",
    "off", "opposite", "pmb", "po", "road", "street", "suite", "the", "to", "unit",
]

# Further address words that are no key of a place.
PLACE_STOP = sorted({
    *ADDRESS_STOP, "allee", "block", "boulevard", "building", "chemin", "colony", "court", "cross", "e", "flat", "layout",
    "main", "n", "nagar", "ne", "nw", "phase", "place", "plot", "route", "rue", "s", "se", "sector", "shop", "sw", "w",
})

# Words that may stand between a house number and its street.
HOUSE_SKIP = [
    "a", "apartment", "b", "box", "c", "d", "e", "flat", "floor", "house", "n", "ne", "number", "nw", "plot", "pmb",
    "po", "s", "se", "suite", "sw", "unit", "w",
]

# Postal codes of US states.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh",
    "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd",
    "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "puerto rico": "pr", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}

# Digits and signs that stand for letters, and consonant classes.
LEET = ("013456789@$!", "oleasgtbgasi")
CONSONANTS = ("ckqgjzsxvfpbdtnmlr", "kkkkjssksfpptdnmlr")

# Marks of missing values, splits of alternative names, web addresses.
MISSING = r"<null>|\bnull\b|\bn/a\b|\bnone\b|\bnan\b"
ALIAS = r"\s+(?:dba|d/b/a|aka|t/a|trading as)\s+|\|"
WEB = r"^(www\.)?[a-z0-9\-]+\.(com|net|org|in|co\.in|fr|us|biz|info)$"

# Latin letters for letters of other scripts, accents taken off (marks that have none give nothing).
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ґ": "g", "ђ": "dj", "ј": "j",
    "љ": "lj", "њ": "nj", "ћ": "tsh", "џ": "dzh",
}
ARABIC = {
    "ء": "", "ا": "a", "ب": "b", "ة": "a", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r",
    "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "g", "ف": "f", "ق": "q", "ك": "k",
    "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ى": "a", "ي": "y", "پ": "p", "چ": "ch", "ژ": "zh", "ک": "k", "گ": "g", "ی": "y",
}
HEBREW = {
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "kh", "ט": "t", "י": "y", "ך": "k", "כ": "k",
    "ל": "l", "ם": "m", "מ": "m", "ן": "n", "נ": "n", "ס": "s", "ע": "", "ף": "p", "פ": "p", "ץ": "ts", "צ": "ts", "ק": "q",
    "ר": "r", "ש": "sh", "ת": "t",
}
LETTERS = GREEK | CYRILLIC | ARABIC | HEBREW
