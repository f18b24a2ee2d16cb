"""Fixed values.

FIXED VALUES: the defaults below must equal the original application's
configuration for matching results to agree.  They are stated plainly, in
their natural order, and are only defaults: every operator takes its keyword
sets, window and limits as parameters.
"""

# --- FIXED VALUES (defaults of the original configuration) -----------------
DEFAULT_SEARCH_KEYWORDS = [
    "UWindsor",
    "University of Windsor",
    "Assumption University",
    "Assumption College",
    "Windsor Law",
    "Essex College",
]

DEFAULT_INSTITUTION_KEYWORDS = [
    "University of Windsor",
    "UWindsor",
    "Windsor Law",
    "Assumption University",
    "Assumption College",
    "Essex College",
]

DEFAULT_STATUS_KEYWORDS = [
    "graduated",
    "graduating",
    "graduate",
    "grad",
    "alumnus",
    "alumna",
    "alumni",
    "attended",
    "studied",
    "degree",
    "B.A.",
    "B.Sc.",
    "LL.B.",
    "J.D.",
    "class of",
]

DEFAULT_MATCH_WINDOW = 160
EXCERPT_PADDING = 45
DEFAULT_PAGE_LIMIT = 125
DEFAULT_MAX_PAGES = 2
DEFAULT_REPEAT_THRESHOLD = 3
MAX_ATTEMPTS = 3
ERROR_MESSAGE_LIMIT = 4000
BASE_DOMAIN = "remembering.ca"
YEAR_BUCKET_FLOOR = 2022

PRIORITY_SUBDOMAINS = [
    "windsorstar",
    "chathamdailynews",
    "theobserver",
    "lfpress",
    "stratfordbeaconherald",
    "stthomastimesjournal",
    "woodstocksentinelreview",
    "brantfordexpositor",
    "thewhig",
    "ottawa",
    "torontosun",
]

MATCH_MODE_SIMPLE = "simple"
MATCH_MODE_PROXIMITY = "proximity"
SIMPLE_STATUS = "simple_keyword"
LISTING_STATE_KEYWORD = "__listing__"
LISTING_LABEL = "Listing scan"

# record outcome statuses
SAVED, SKIPPED, DUPLICATE, ERROR, STOPPED = "saved", "skipped", "duplicate", "error", "stopped"
# skip reasons, in gate order
MISSING_NAME, NO_ALUMNI_KEYWORD, EXISTING_URL, UNKNOWN_CITY = (
    "missing_name", "no_alumni_keyword", "existing_url", "unknown_city")
# crawl state statuses
STATE_RUNNING, STATE_COMPLETED, STATE_BLOCKED, STATE_ERROR = (
    "running", "completed", "pagination_blocked", "error")
# page-reader stop reasons
STOP_REQUESTED = "stop_requested"
STOP_VISITED, STOP_NO_LINKS, STOP_REPEATED, STOP_ERROR = (
    "already_visited", "no_links", "repeated_page", "error")
# run statuses
RUN_RUNNING, RUN_SUCCESS, RUN_STOPPED, RUN_FAILED = "running", "success", "stopped", "failed"
STALE_RUN_MESSAGE = "Marked stopped before starting a new scraper run."

# sentinel strings treated as empty by display formatting
EMPTY_SENTINELS = ["", "N/A", "None", "null"]
# body words that mark a donation sentence
DONATION_TERMS = ["donation", "charity", "memorial fund", "contributions"]
# navigation words dropped from the head of a body
NAV_WORDS = ["Obituary", "Events", "Guestbook", "Share"]
VALID_TAGS = ["new", "updated"]
DEFAULT_TAG = "new"

# CSV export column order
CSV_COLUMNS = [
    "id", "name", "first_name", "last_name", "birth_date", "death_date",
    "publication_date", "city", "province", "funeral_home", "obituary_url",
    "tags", "is_alumni", "latitude", "longitude", "family_information",
    "donation_information",
]
# JSON record projection columns
JSON_COLUMNS = [
    "id", "name", "first_name", "last_name", "obituary_url", "city", "province",
    "birth_date", "death_date", "publication_date", "is_alumni", "tags",
    "latitude", "longitude",
]

# Patterns, formats and selectors that decide parity with the original.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTHS_ABBR = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
# body date patterns, in priority order
BODY_DATE_PATTERNS = [
    r"(?i)\b(?:" + MONTHS + r")\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b",
    r"(?i)\b(?:" + MONTHS_ABBR + r")\.?\s+\d{1,2},?\s+\d{4}\b",
    r"(?i)\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"(?i)\b\d{1,2}-\d{1,2}-\d{2,4}\b",
    r"(?i)\b(?:" + MONTHS + r")\s+\d{1,2}\b",
    r"(?i)\b(?:" + MONTHS_ABBR + r")\s+\d{1,2}\b",
    r"(?i)\b\d{4}\b",
]
YEAR_FOUR_DIGITS = r"\b(\d{4})\b"
YEAR_TWO_TRAILING = r"(?:/|-|,?\s+)(\d{2})$"
MIN_DEATH_YEAR_EXCLUSIVE = 2000
PUBLISHED_PREFIX = r"(?i)^Published(?:\s+online|\s+on)?\s+"
PUBLISHED_IN_PAGE = r"(?i)(Published(?:\s+online|\s+on)?\s+[A-Za-z]+\s+\d{1,2},\s+\d{4})"
CANONICAL_DATE = "MMMM dd, yyyy"
NAME_SUFFIXES = [" Obituary", " obituary"]
TITLE_NAME_CUT = " Obituary"
GLUE_AFTER_LOWER = r"(?<=[a-z0-9,;:])(?=[A-Z])"
GLUE_AFTER_STOP = r"(?<=[.!?])(?=[A-Z])"
NAV_PHRASE = r"\bObituary\s+Events\s+Guestbook\s+Share\b"
HEADER_DATE = r"[A-Za-z]+\s+\d{1,2},\s+\d{4}"
NAV_WORD_AT_START = r"^(Obituary|Events|Guestbook|Share)\b"
TITLE_INDEX_LIMIT = 500
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z\"'])"
DONATION_ITEM_SPLIT = r";|\n"
DONATION_SENTENCE_SPLIT = ". "
DONATION_JOIN = "; "
RECORD_LINK_PREFIX = "/obituary/"
# element selectors read from a notice page, in cascade order
BODY_SELECTORS = [("span", "details-copy"), (None, "details-copy"), ("article", None), ("main", None)]
TESTID_SELECTORS = ["desktop-menu-fullname", "mobile-menu-fullname", "main-fullname"]
PUBLISHED_SELECTORS = [("div", "details-published"), ("span", "details-published"),
                       ("p", "details-published"), ("div", "published"), ("span", "published"),
                       ("time", None)]
# --- end FIXED VALUES ------------------------------------------------------


def parse_keyword_list(raw: str | None, default: list[str]) -> list[str]:
    """Comma list -> trimmed non-blank keywords; empty input -> default."""
    if not raw:
        return list(default)
    return [k.strip() for k in raw.split(",") if k.strip()]


def longest_first(keywords) -> list[str]:
    """Distinct keywords, longest first; equal lengths by keyword ascending
    (our fixed tie rule, the original order there is hash-seed dependent)."""
    return sorted(set(keywords), key=lambda k: (-len(k), k))
