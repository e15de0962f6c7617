"""Word lists and patterns that must be these for right results."""

LEADING_WORDS = ["the", "a", "an", "this", "that", "these", "those"]
CANON_LEADING_WORDS = ["the", "a", "an", "this", "that"]
BLOCKED_NAMES = [
    "complaint filed case", "summary judgment", "summary judgment motion", "appeal filed case", "appellate opinion case", "discovery order case",
    "hearing held case", "jury verdict case", "regulatory notice case", "witness testimony case", "motion to dismiss", "preliminary injunction",
    "trial testimony", "court hearing", "expert witness", "investor group", "appellate panel", "stack date", "cloud date", "systems date", "circuits date",
    "search date", "platform date", "holdings date", "retail date", "labs date", "devices date", "diagnostics date", "ad exchange date",
    "harbor capital date", "vertex labs date", "titan search date", "horizon systems date",
]
NOISE_SUFFIXES = [" date", " event", " cluster", " case", " relationships", " relationship", " ecosystem", " dispute", " proceeding", " network"]
CANON_NOISE_SUFFIXES = [*NOISE_SUFFIXES, " platform"]
NOISE_KEYWORDS = ["filed case", "opinion case", "order case", "verdict case", "testimony case", "notice case", "hearing case", "corporate fraud trial", "financial reporting fraud"]
NON_NAME_TOKENS = (
    "district court circuit division department bureau office commission coalition council committee tribunal authority agency board expert witness analysis "
    "notice advisory regulatory review market exchange capital group panel motion argument production records emails model report testimony form order verdict "
    "grid stack signal platform logic tech systems software labs diagnostics"
).split()
ROLE_PREFIXES = "dr mr ms mrs prof attorney counsel officer director senior chief".split()
TYPE_RANK = {"Organization": 3, "Location": 2, "Person": 1, "Event": 0}
REDACTION_CODES = ["b3", "b6", "b7c", "b7d", "b7e", "b7f", "b5", "b1", "b2", "bo", "b6e", "b6é", "b7c-", "b6-"]
BOILERPLATE_MARKERS = [
    "deleted page information sheet", "payment request", "foi/pa", "civil action#", "no duplication fee", "for this page", "federal bureau of investigation",
    "draft type", "request type", "payment type", "social security number", "bureau name", "vendor number", "group number", "obligation processing",
]
SKIP_LINES = [
    r"^page\s+\d+", r"^b[367][a-z0-9]?\b", "^federal bureau of investigation$", "^foi/pa$", "^deleted page information sheet$", "^payment request$", "^civil action#",
    "^total deleted page", "^x no duplication fee x$", "^xx deleted page", "^bureau name:", "^social security number:", "^request type:", "^payment type:",
    "^vendor number:", "^group number:",
]
STOPWORDS = "the a an and or to of in on at for from with by that this is was were be been as it he she they them his her their".split()
DEDUP_STOPWORDS = "the of and a an in for llc inc corp co ltd mr mrs ms dr".split()
ATTRIBUTION_CUES = ["according to", "reported by", "stated by", "said", "told investigators", "advised", "claimed"]
EVENT_FAMILIES = {"meeting": ["met", "meeting", "visited"], "travel": ["flew", "traveled", "flight"], "financial": ["paid", "transferred", "wired"], "communication": ["called", "emailed", "wrote"]}
NEGATIONS = ["not", "never", "denied", "false", "incorrect", "no", "refuted", "disputed"]
SOURCE_EXTENSIONS = [".pdf", ".txt", ".md", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp"]
PATTERNS = [
    ("Aircraft", r"\b(N\d{1,5}[A-Z]{0,2}|G-[A-Z]{4}|VP-[A-Z]{3}|VH-[A-Z]{3}|C-[A-Z]{4})\b", False, 0.95),
    ("Phone", r"\b(\+?1[-.\s]?)?\(?([2-9]\d{2})\)?[-.\s]?([2-9]\d{2})[-.\s]?(\d{4})\b", False, 0.92),
    ("Email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", False, 0.97),
    ("Address", r"\b\d{1,5}\s+[A-Z][a-z]+(?:\s+[A-Za-z]+){1,4}\s+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Place|Pl|Way|Circle|Cir)\b", True, 0.82),
    ("Airport", r"\b(K[A-Z]{3}|[A-Z]{4})\b", False, 0.75),
    ("Date", r"\b(?:\d{4}[-/]\d{2}[-/]\d{2}|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}|\d{1,2}/\d{1,2}/\d{2,4})\b", True, 0.88),
    ("Person", r"(?<![.!?]\s)(?<!\n)\b([A-Z][a-z]{1,20}(?:\s+(?:van|de|von|der|la|le|del|bin|al|el|st\.?|jr\.?|sr\.?|ii|iii))?\s+[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20})?)\b", False, 0.55),
]
SOURCE_RELIABILITY_DEFAULT = 0.30
