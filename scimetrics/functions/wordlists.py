"""Fixed word lists."""

# Words that are left out of the noun tables.
GENRE_WORDS = [
    "result", "data", "finding", "paper", "study", "aim", "objective", "goal", "discussion",
    "purpose", "methodology", "author", "research", "introduction", "analysis", "addition",
    "outcome", "report", "method", "approach", "article", "literature", "review", "design",
    "researcher", "data", "datum", "aspect", "point", "other", "authors", "affect",
]

NOISE_WORDS = [
    "google", "scholar", "https", "http", "scopus", "doi.org", "full", "text", "pubmed", "pdf",
    "share", "full", "version", "publication", "date", "special", "issue", "vol.", "press", "pp",
    "e.g.", "i.e.", "et", "al", "ed", "journal", "book", "chapter", "P.", "Pp.", "p.",
    "no.@card@", "&#x0", "lb/acre", "university", "a.d.", "pp.", "$.", "f.", "h.", "l.", "n°",
]

MEASURES = [
    "kg", "mm", "mg", "gr", "m", "usd", "ng", "g", "kg.", "mm.", "mg.", "gr.", "m.", "ng.", "g.",
]

ROMAN_NUMERALS = [
    "i", "ii", "iii", "iv", "v", "vi", "vi", "viii", "ix", "x",
]

MONTHS = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]

STOPWORDS = GENRE_WORDS + NOISE_WORDS + MEASURES + ROMAN_NUMERALS + MONTHS

# Frequent function words per language, in order of preference on a tie.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "on", "for", "was", "with", "as", "by"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "en", "que", "qui", "dans", "du", "elle"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "ein", "eine", "ist", "mit", "nicht"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "una", "por", "con", "las", "del"],
    "pt": ["o", "os", "de", "que", "e", "em", "um", "uma", "por", "com", "do", "da", "dos", "das", "não", "para"],
    "nl": ["de", "het", "een", "en", "van", "in", "is", "dat", "op", "te", "met", "voor", "zijn", "niet"],
    "it": ["il", "lo", "la", "gli", "le", "di", "che", "e", "un", "una", "per", "con", "del", "della", "non", "è"],
}

# Endings that mark an unknown English word as a noun.
NOUN_SUFFIXES = [
    "tion", "sion", "ment", "ness", "ity", "ship", "hood", "dom", "ism", "ist", "ance", "ence",
    "ancy", "ency", "ure", "age", "logy", "graphy", "metry", "nomy", "er", "or", "ant", "ent",
    "ics",
]
