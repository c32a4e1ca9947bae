"""Fixed values of the citation grammar: word lists, tables and patterns.

They state which strings count as citations, so results depend on each of them.
Patterns are written for Java's regular expressions.
"""

YEAR = r"(?:1[0-9]{3}|20[0-9]{2})"

# --- works ---
TITLE_WORD = r"(?:[A-Z][A-Za-z'’\-\.]*,?|\([^()]{1,70}\),?)"
CONNECTIVE = r"(?:of|and|for|to|in|on|at|or|with|under|upon|by|from|against|into|over)"
CONNECTOR = rf"(?:{CONNECTIVE}\s+the|{CONNECTIVE}|etc\.?)"
KIND_NOUN = r"(?:Acts?|Measure|Regulations|Rules|Order|Scheme|Code)"
#: groups: title, year, chapter, devolved type, its number, SI number, SSI number
WORK = (
    rf"(?U)\b({TITLE_WORD}(?:\s+(?:{TITLE_WORD}|{CONNECTOR})){{0,14}}?\s+{KIND_NOUN})\s+({YEAR})"
    rf"(?:\s*\(\s*(?:c\.?\s*(\d+)|(asp|anaw|asc|nia)\s*(\d+)|S\.?\s*I\.?\s*{YEAR}\s*/\s*(\d+)|S\.?\s*S\.?\s*I\.?\s*{YEAR}\s*/\s*(\d+))\s*\))?"
)
#: groups: code, year, number
INSTRUMENT = rf"(?U)\b(S\.?\s?I\.?|S\.?\s?S\.?\s?I\.?|S\.?\s?R\.?)\s*({YEAR})\s*/\s*(\d+)\b"
INSTRUMENT_TYPES = {"SI": "uksi", "SSI": "ssi", "SR": "nisr"}
SHORT_FORM = r"(?U)^\s*\(\s*[\"'“‘]?\s*(?:the\s+)?([A-Za-z0-9][A-Za-z0-9\s'’\.\-]{0,48}?)\s*[\"'”’]?\s*\)"
ARTICLES = ("the", "this", "that", "a", "an")
SHORT_FORM_NOUNS = ("act", "regulation", "rule", "order", "measure", "code", "scheme")

# --- back-references ---
YEAR_ANAPHOR = rf"(?iuU)\b(?:the|that|this|said)\s+({YEAR})\s+(Act|Regulations|Order|Rules|Measure)\b"
BARE_ANAPHOR = r"(?iuU)\b(?:the|that|this)\s+(?:said\s+)?(Act|Regulations|Order|Rules|Measure)\b"
ACRONYM_ANAPHOR = rf"(?U)\b(?:[Tt]h(?:e|at|is)\s+)?([A-Z][A-Z0-9]{{1,9}}(?:\s+{YEAR})?)\b"

# --- provisions ---
KINDS = {
    "section": "section", "sections": "section", "sec": "section", "secs": "section", "s": "section", "ss": "section",
    "subsection": "section", "subsections": "section", "sub-section": "section",
    "schedule": "schedule", "schedules": "schedule", "sched": "schedule", "scheds": "schedule", "sch": "schedule", "schs": "schedule",
    "part": "part", "parts": "part", "pt": "part", "pts": "part",
    "chapter": "chapter", "chapters": "chapter", "ch": "chapter", "chs": "chapter",
    "regulation": "regulation", "regulations": "regulation", "reg": "regulation", "regs": "regulation",
    "article": "article", "articles": "article", "art": "article", "arts": "article",
    "rule": "rule", "rules": "rule",
    "paragraph": "paragraph", "paragraphs": "paragraph", "para": "paragraph", "paras": "paragraph",
    "sub-paragraph": "paragraph", "subparagraph": "paragraph",
}
KIND_WORDS = "|".join(sorted(KINDS, key=len, reverse=True))
NUMBER = r"\d+[A-Z]{0,3}"
ITEM = rf"{NUMBER}(?:\s*\(\s*[0-9A-Za-z]{{1,4}}\s*\))*"
#: groups: kind, items
PROVISION = rf"(?iuU)\b({KIND_WORDS})\s*\.?\s*({ITEM}(?:\s*(?:,\s*|\s+and\s+|\s+to\s+|\s*[-–—]\s*)\s*{ITEM})*)"
#: groups: connector, item
PROVISION_ITEM = rf"(?iuU)(,\s*|\s+and\s+|\s+to\s+|\s*[-–—]\s*)?({ITEM})"
RANGE_WORDS = ("to", "-", "–", "—")
RANKS = {"schedule": 0, "part": 1, "chapter": 2, "section": 3, "regulation": 3, "article": 3, "rule": 3, "paragraph": 4}
CONTAINERS = ("schedule", "part", "chapter")
FORWARD_GAP = r"(?iuU)^\s*(?:of|in|to|under)\s+(?:the\s+)?$"
BACKWARD_GAP = r"(?iuU)^\s*(?:,|—|-)?\s*(?:at\s+)?$"
NESTING_GAP = r"(?iuU)^\s*(?:of|to|in)\s+(?:the\s+)?$"

# --- cases ---
COURT_WORDS = (
    r"EWCA\s+Civ|EWCA\s+Crim|UKSC|UKPC|UKHL|EWHC|EWFC|EWCOP|EWCC|EWCR|UKUT|UKFTT|UKEATS?|EAT|UKIPTrib|"
    r"CSIH|CSOH|HCJAC|NICA|NIQB|NIKB|NICh|NIFam"
)
#: groups: year, court, number, division
NEUTRAL = rf"(?U)\[({YEAR})\]\s+({COURT_WORDS})\s+(\d+(?:_\d+_\d+)?)\b(?:\s*\(\s*([A-Za-z][A-Za-z0-9]{{0,11}})\s*\))?"
SERIES = (
    "AC", "QB", "KB", "Ch", "Fam", "P", "WLR", "All ER", "All ER (Comm)", "All ER (D)", "ICR", "IRLR", "Cr App R", "Cr App R (S)",
    "Lloyd's Rep", "Lloyd’s Rep", "BCLC", "BCC", "EMLR", "FSR", "RPC", "HRLR", "UKHRR", "EHRR", "BHRC", "BMLR", "Med LR",
    "Lloyd's Rep Med", "PIQR", "EG", "EGLR", "P & CR", "HLR", "FLR", "FCR", "STC", "Imm AR", "INLR", "LGR", "ACD", "JPL", "Env LR",
    "CMLR", "SC", "SLT", "NI", "App Cas", "QBD", "Ch D", "PD", "Cl & F", "HL Cas", "TLR", "LT", "LJKB", "LJQB", "Costs LR", "BLR",
    "Con LR", "PNLR", "Pens LR", "TC", "SFTD",
)
SERIES_WORDS = "|".join(
    s.replace("(", r"\(").replace(")", r"\)").replace(" ", r"\s+") for s in sorted(SERIES, key=len, reverse=True)
)
#: groups: bracket, year, volume, series, page
REPORT = rf"(?U)([\[(])({YEAR})[\])]\s+(?:(\d{{1,3}})\s+)?({SERIES_WORDS})\s+(\d{{1,5}})\b"
CITE_GAP = r"(?U)^\s*[,;]?\s*$"
#: group: the pinpoint
CASE_PINPOINT = (
    r"(?iuU)^\s*,?\s*at\s+(\[\d+\](?:\s*[-–]\s*\[\d+\])?|paras?\.?\s*\d+(?:\s*[-–]\s*\d+)?|"
    r"pp?\.?\s*\d+(?:\s*[-–]\s*\d+)?|\d+[A-H]?(?:\s*[-–]\s*\d+[A-H]?)?)"
)
PARTY_WORD = r"(?:[A-Z][\w'’.\-]*,?|\([^()\n]{1,80}\),?|&)"
PARTY_LINK = (
    r"(?:of\s+the|for\s+the|and\s+(?:others|another|ors|anor)|plc|ltd|llp|of|for|and|de|du|da|van|von|der|le|la|upon|"
    r"ex\s+p(?:arte)?\.?)"
)
PARTY = rf"{PARTY_WORD}(?:[ \t]*\n?[ \t]*(?:{PARTY_WORD}|{PARTY_LINK})){{0,14}}"
#: a case name at the end of the text before a citation; group: the name
NAME_BEFORE = rf"(?U)(?<![\w(])({PARTY}\s+v\.?\s+{PARTY}|(?:In\s+)?[Rr]e\s+{PARTY})[ \t,]*\n?[ \t]*$"
NAME_LEADERS = (
    "In", "See", "Applying", "Applied", "Following", "Followed", "Per", "Cf", "But", "And", "As", "Also", "Under", "After", "Unlike",
    "Like", "Contrast", "Compare", "Then", "Thus", "So", "Since", "Because", "Although", "While", "Whereas", "Citing", "Approving",
    "Distinguishing", "Overruling", "Affirming", "Reversing", "Considering", "The", "This", "That", "On", "At", "For", "By", "From",
    "With", "Of", "It", "Here", "There", "However", "Moreover", "Further", "Furthermore", "Similarly", "Accordingly", "Indeed",
    "Notably", "Note", "Where", "When", "If",
)
NAME_TRAILERS = ("of", "for", "and", "de", "du", "da", "van", "von", "der", "le", "la", "upon", "ex", "p", "p.", "parte", "the")
SENTENCE_END = r"(?U)(?<!\bp)(?<!\bLtd)(?<!\bCo)(?<!\bNo)(?<!\b[A-Z])[.!?;:](?=\s)|\n[ \t]*\n"
V_PIVOT, RE_PIVOT = r"(?U)\s+v\.?\s+", r"(?U)\b[Rr]e\s+"
#: how far a name reaches back, and to each side of a pivot; words to each side
NAME_REACH, PIVOT_REACH, PIVOT_WORDS = 250, 200, 15

# --- courts: code, path of the primary service, page of the secondary one, divisions, division needed ---
COURTS = (
    ("UKSC", "uksc", "uk/cases/UKSC/{year}/{number}.html", (), False),
    ("UKPC", "ukpc", "uk/cases/UKPC/{year}/{number}.html", (), False),
    ("UKHL", None, "uk/cases/UKHL/{year}/{number}.html", (), False),
    ("EWCA Civ", "ewca/civ", "ew/cases/EWCA/Civ/{year}/{number}.html", (), False),
    ("EWCA Crim", "ewca/crim", "ew/cases/EWCA/Crim/{year}/{number}.html", (), False),
    ("EWHC", "ewhc", None, ("Admin", "Ch", "QB", "KB", "Fam", "Comm", "TCC", "Pat", "IPEC", "Admlty", "SCCO", "Mercantile"), True),
    ("EWFC", "ewfc", None, ("B",), False),
    ("EWCOP", "ewcop", None, ("T1", "T2", "T3"), False),
    ("EWCC", "ewcc", None, (), False),
    ("EWCR", "ewcr", None, (), False),
    ("UKUT", "ukut", None, ("IAC", "LC", "AAC", "TCC"), True),
    ("UKFTT", "ukftt", None, ("TC", "GRC"), True),
    ("EAT", "eat", None, (), False),
    ("UKEAT", None, "uk/cases/UKEAT/{year}/{number}.html", (), False),
    ("UKEATS", None, None, (), False),
    ("UKIPTrib", "ukiptrib", None, (), False),
    ("CSIH", None, "scot/cases/ScotCS/{year}/{year}_CSIH_{number}.html", (), False),
    ("CSOH", None, "scot/cases/ScotCS/{year}/{year}_CSOH_{number}.html", (), False),
    ("HCJAC", None, "scot/cases/ScotHC/{year}/{year}_HCJAC_{number}.html", (), False),
    ("NICA", None, "nie/cases/NICA/{year}/{number}.html", (), False),
    ("NIQB", None, None, (), False),
    ("NIKB", None, None, (), False),
    ("NICh", None, None, (), False),
    ("NIFam", None, None, (), False),
)
DIVISIONS = {d.lower(): d for court in COURTS for d in court[3]} | {"patents": "Pat"}
NEUTRAL_SINCE = 2001
WORKS_SITE, CASES_SITE, CASES_SITE_2 = "https://www.legislation.gov.uk", "https://caselaw.nationalarchives.gov.uk", "https://www.bailii.org"

# --- normalisation ---
TITLE_NOUNS = ("act", "acts", "measure", "regulations", "regulation", "rules", "rule", "order", "orders", "scheme", "code")
CASE_NOISE = r"\b(?:on the application of|and others|and another|ors|anor|the|ltd|limited|plc|llp|bv|nv|ag|gmbh|inc)\b"

# --- resolution ---
ACT_TYPES = ("ukpga", "ukla", "asp", "nia", "anaw", "asc", "ukcm")
SI_TYPES = ("uksi", "ssi", "nisr", "wsi")
SECONDARY_NOUNS = ("regulations", "rules", "order", "orders", "scheme", "regulation")
ACCEPT, SUGGEST, CROSS_YEAR, NAME_AGREES, SEARCH_CUTOFF, SEARCH_LIMIT = 0.86, 0.60, 0.75, 0.6, 0.55, 5
