"""Patterns and factors that results depend on, as plain text. Logic is elsewhere."""

# Fixed values. Marks of a bibliography, of a publication's notice and of its identity.
REFERENCE_LINE = r"(?:^|\n)\s*(?:\[\d+\]|\d+[.)])\s*(?:[A-Z]\.\s*[A-Z][a-z]|[A-Z][a-z]+,\s*[A-Z]\.)"
YEAR = r"\b(?:19|20)\d{2}\b"
INITIAL = r"\b[A-Z]\.\s"
NOTICE = r"(?i)(?:all rights reserved|www\.|©|copyright|published online|received:|accepted:)"
IDENTITY = r"(?i)\bdoi\s*:|10\.\d{4,9}/"

# Fixed values. Kinds in the order in which they are tried, their factor in a relevance, and what they need: any of
# these lists, of which every pattern must stand so many times.
KINDS = [
    ("bibliography", 0.25, [[(REFERENCE_LINE, 2)], [(YEAR, 3), (INITIAL, 4)]]),
    ("publication_metadata", 0.55, [[(NOTICE, 1)]]),
    ("publication_identity", 0.7, [[(IDENTITY, 1), (YEAR, 1)]]),
]
OTHER_KIND, OTHER_FACTOR = "body_or_title", 1.0

# Fixed values. Normal forms: a word broken over lines, which is joined, and dashes, which part words.
BROKEN_WORD = r"(?<=[A-Za-z])[-‐]\s*\n\s*(?=[a-z])"
DASH_RUN = r"[-‐‑‒–—]+"

# Fixed values. Lines: captions, starts of numbered entries, signs of an entry (two are needed), and words of a sentence.
CAPTION = r"(?i)^\s*(?:Fig(?:ure)?\.?|Scheme|Table)\s*\d+\b|^\s*[图表]\s*\d+"
ENTRY_START = r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)])\s*(?:(?:[A-Z]\.\s*){1,4}[A-Z][a-z]|[A-Z][a-z]+,)"
ENTRY_SIGNS = [(YEAR, 1), (r"(?i)\b(?:doi|vol\.|pp\.)|10\.\d{4,9}/", 1), (r"\b[A-Z]\.\s*[A-Z]", 2), (r"\b(?:J\.|Journal|Chem\.|Phys\.|Catal\.|Rev\.)", 1)]
LINE_NOTICE, LINE_NOTICE_LENGTH = r"(?i)all rights reserved|copyright|©|www\.|published online|received:|accepted:", 220
SENTENCE = r"(?i)\b(?:is|are|was|were|has|have|can|will|measured|shows|requires|increases)\b"
WRAPPED_LINES = 4

# Fixed values. Questions: a quoted publication, what ends the question proper, what speaks of a publication named before, its question word.
QUOTED_PUBLICATION = r"(?i)[“\"].*?[”\"]\s*\([^)]*(?:\b\d{4}\b|doi)[^)]*\)"
INSTRUCTION = r"(?i)(?:Please\s|Use this round|Base the answer|No ingest|Do not ingest)"
FOLLOW_UP = r"(?i)这套|这篇|上述|\b(?:this|that)\s+(?:paper|study|analysis)\b"
QUESTION_WORD = r"(?is)\b(?:what|how|where|which)\b.*"

# Fixed values. Answers: a question for kinds and a text that lists them; a question for a definition.
ASKS_KINDS = r"(?i)几类|哪.*类|哪些类型|\b(?:classes|categories|types|kinds)\b"
LISTS_KINDS = r"\b(?:include|includes|comprise|comprises|consist|types|classes|categories)\b[^.]{0,250}(?:,[^.]{0,80}){3}"
ASKS_DEFINITION = r"(?i)具体.*(?:哪|什么)|\b(?:define|definition|what.*(?:descriptor|difference|parameter))\b"

# Fixed values. Characters beside a span: categories and signs that go on a token, brackets; what else goes on a word or a compact identifier.
GOES_ON_KINDS = ("Cf", "Pc", "Sm", "Pd")
GOES_ON = "+-−⁺⁻₊₋^•·/*"
OPENING, CLOSING = "([{", ")]}"
WORD_JOINERS = "_‌‍"
COMPACT_KINDS = ("Sm", "Pd")
COMPACT = "+-*./·()[]⁺⁻₊₋‐‑‒–—−"

# Fixed values. Names: script signs and what they stand for, dashes, British spellings, and names that end in a charge.
SCRIPT_SIGNS = ("⁺⁻₀₁₂₃₄₅₆₇₈₉₊₋", "+-0123456789+-")
DASHES = "‐‑‒–—−"
SPELLINGS = {"centre": "center", "ionisation": "ionization", "polarisation": "polarization", "electrolyser": "electrolyzer"}
CHARGED = r"^[^ ]+ [0-9⁰¹²³⁴⁵⁶⁷⁸⁹]*[+-]$"

# Fixed value. The heading of a bibliography, on a line of its own.
REFERENCE_HEADING = r"^\s*(?:references|bibliography|literature cited|参考文献)\s*:?\s*$"

# Fixed values. Questions: a line that names a publication, a DOI, a long form before its acronym, and words that ask or are forms of an answer.
SOURCE_LINE = r"(?im)^\s*(?:来源|出处|source|publication)\s*[:：].*$"
DOI = r"10\.\d{4,9}/[A-Za-z0-9.()_;/:-]+"
ACRONYM = r"([A-Za-z][A-Za-z -]{3,80})\s*\(([A-Z]{2,8})\)"
QUESTION_WORDS = "according explain describe discuss give show state stated identify determine values value numerical numeric equation equations formula formulas expression expressions range ranges magnitude correction corrections relationship relationships relation relations premise premises alternative alternatives pathway pathways mechanism mechanisms assumption assumptions steps step respectively based result results article study studies authors author figure figures fig table tables supporting support citation citations quote quotes page pages relevant relevantly text answer question reference references details detailed following follow first second third additionally also whether can could should would must need needs derive derived derivation derivations account accounts accounted consider considered".split()

# Fixed value. What qualifies a label in a question.
QUALIFIER = r"(?iU)(?<!\w)(?:fine|coarse)(?!\w)(?:\s*:\s*|\s+)"
