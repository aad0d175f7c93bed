"""Fixed values.

Everything in this module is a value that results depend on: word lists, thresholds, markers and
patterns. Patterns are written for Java regular expressions. ``(?U)`` gives Unicode classes and word
boundaries, ``(?d)`` makes ``\\n`` the only line end.
"""

# --- Folder and file names ------------------------------------------------------------------------
MARKDOWN_DIR = "Markdown"
CONSOLIDATED_DIR = "Consolidated"
LIGHTWEIGHT_DIR = "Lightweight"
REPORT_NAME = "_deflate_report.md"
INDEX_SUFFIX = "_Index.md"
ROOT_FOLDER_LABEL = "General / Root"
ROOT_TARGETS = ["Root", "General / Root", "All Folders"]
GENERIC_FOLDERS = ["Accounts", "documents", "Markdown", "Consolidated", "Lightweight"]
COMPANY_SUFFIXES = [" Limited", " Ltd", " PLC", " plc", " SARL"]
CONSOLIDATED_BANNER = "**Consolidated Archive**"

# --- Boilerplate rules ----------------------------------------------------------------------------
MIN_SECTION_WORDS = 40
MIN_THRESHOLD = 2
DEFAULT_THRESHOLD = 3
DEFAULT_SIMILARITY = 0.85
DEFAULT_PEER_THRESHOLD = 2
EXAMPLE_CHARS = 500
PATTERN_EXAMPLE_CHARS = 400
PATTERN_LIMIT = 200

PROTECTED_HEADING_KEYWORDS = [
    "going concern",
    "business performance",
    "strategic management",
    "strategic report",
    "principal activity",
    "business environment",
    "key performance indicator",
    "kpi",
    "operating review",
    "financial review",
    "chairman's statement",
    "chief executive",
    "directors",
    "board of directors",
    "directors' remuneration",
    "remuneration of directors",
    "staff numbers and costs",
    "related party",
    "ultimate parent",
    "parent company",
    "controlling party",
    "immediate parent",
    "group undertaking",
    "subsidiary undertaking",
    "joint venture undertaking",
    "subsidiaries",
    "group structure",
    "intercompany",
    "intra-group",
    "investments",
    "debtors",
    "creditors",
    "borrowings",
    "subsequent event",
    "post balance sheet",
    "contingent liab",
    "provisions",
    "key audit matter",
    "emphasis of matter",
    "material uncertainty",
    "basis for opinion",
    "opinion on financial statements",
    "dividend",
]

PROTECTED_BODY_KEYWORDS = [
    "going concern",
    "material uncertainty",
    "qualified opinion",
    "emphasis of matter",
    "modified opinion",
    "except for",
    "contingent liab",
    "subsequent event",
    "post balance sheet",
    "exceptional item",
    "prior period adjustment",
    "restatement",
    "key audit matter",
]

FINANCIAL_STATEMENT_KEYWORDS = [
    "statement of comprehensive income",
    "statement of financial position",
    "statement of changes in equity",
    "cash flow statement",
    "statement of cash flows",
    "profit and loss",
    "balance sheet",
    "income statement",
]

# --- Whitespace (Unicode); trimming also takes the four ASCII separators -----------------------------
SPACES = r"(?U)\s+"
WORD = r"(?U)\S+"
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\R|[\x1c-\x1e]"

# --- Page scaffolding -----------------------------------------------------------------------------
RECEIPT_STAMP = (
    r"(?imdU)(?:^|\n)(?:MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY)\s*\n"
    r"[A-Z0-9]+\s*\n\*[A-Za-z0-9*]+\*\s*\n"
    r"\d{2}/\d{2}/\d{4}\s*(?:\n#?\d+\s*)?(?:\n)?COMPANIES\s+HOUSE\s*(?:\n#?\d+)?"
)
PAGE_MARKER_WITH_HEADING = r"(?iU)<!--\s*Page\s+\d+\s*-->\s*\n?(?:##\s+Page\s+\d+\s*\n?)?"
BARE_PAGE_HEADING = r"(?mdU)^##\s+Page\s+\d+\s*$"
RUNNING_HEADER = (
    r"(?mdU)(?:^|\n)([A-Z][A-Za-z\s&',\.\-()]+(?:Limited|Ltd|PLC|SARL|plc|limited))\s*(?:\\?\s*\n|\n)"
    r"(?:Annual\s+[Rr]eport\s+and\s+financial\s+statements|Annual\s+report\s+and\s+accounts)\s*(?:\\?\s*\n|\n)"
    r"(?:Registered\s+number\s+\d+\s*(?:\\?\s*\n|\n))?"
    r"\d+\s+weeks?\s+ended\s+\d{1,2}\s+\w+\s+\d{4}\s*"
)
FOOTER_ONE_LINE = (
    r"(?imdU)^Registered\s+number\s+\d+\s*/\s*\d+\s+weeks?\s+ended\s+[^\n]+?\s*\|\s*\d+\s*$"
)
FOOTER_TWO_LINES = (
    r"(?imdU)^Registered\s+number\s+\d+\s*/\s*\d+\s+weeks?\s+ended\s+[^\n]+$\n\s*\d+\s*$"
)
RULE_RUN = r"(?U)(\n---\s*\n)(?:\s*---\s*\n)+"
BLANK_RUN = r"\n{4,}"

# --- Sections -------------------------------------------------------------------------------------
SECTION_HEADING = r"(?mdU)^(#{1,6})\s+(.+?)$|^(\*{2}[^*\n]{10,}\*{2})\s*$"
PAGE_HEADING_TEXT = r"(?iU)^Page\s+\d+$"
TABLE_ROW = r"(?md)^\|.*\|"
BOARD_CHANGE_WORDS = ["appointed", "resigned", "retired"]
BOARD_CHANGE = (
    r"(?imdU)(?:appointed|resigned|retired)\s*(?:on|with\s+effect\s+from|from)?\s*\d{1,2}\s+\w+\s+\d{4}"
    r"|\(\s*(?:appointed|resigned|retired)\b[^)]*\)"
    r"|^\s*[-*•|]\s*[^\n]*\b(?:appointed|resigned|retired)\b"
)

# --- Masks, in the order they are applied -----------------------------------------------------------
COMPANY_MASK = "{COMPANY}"
CURRENCY = "£"
MASKS_BEFORE_AMOUNT = [
    (
        r"(?iU)\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October"
        r"|November|December)\s+\d{4}",
        "{DATE}",
    ),
]
AMOUNT_TEMPLATE = r"(?iU)%s[\d,]+(?:\.\d+)?(?:\s*(?:000|million|m|bn))?|%snil"
MASKS_AFTER_AMOUNT = [
    (r"(?iU)(?:Registered|Registration|Company)\s+number\s*:?\s*\d+", "{REGNUM}"),
    (r"(?U)\d+\.?\d*\s*%", "{PERCENT}"),
    (r"(?U)\b(19|20)\d{2}\b", "{YEAR}"),
    (r"(?U)\b\d[\d,]*(?:\.\d+)?\b", "{NUM}"),
]

# --- Pages ----------------------------------------------------------------------------------------
PAGE_COMMENT = r"(?iU)<!--\s*Page\s+(\d+)\s*-->"
PAGE_BOUNDARY = r"(?iU)(?:<!--\s*Page\s+(\d+)\s*-->|(?:\n|^)##\s+Page\s+(\d+))"
PAGE_BOUNDARY_LOOSE = r"(?iU)(?:<!--\s*Page\s*(\d+)\s*-->|(?:\n|^)##\s+Page\s*(\d+))"
SEQUENTIAL_MARKER_GAP = 200
FENCE_INFO_UNWRAPPED = ["", "markdown", "md"]

# --- Search ---------------------------------------------------------------------------------------
SNIPPET_RADIUS = 70
QUICK_OPEN_LIMIT = 40

# --- Consolidation --------------------------------------------------------------------------------
UNDATED_YEAR = 9999
YEAR_IN_NAME = r"(?d)(?:^|[^\d])(19\d\d|20\d\d)(?:[^\d]|$)"
SERIAL_IN_NAME = r"(?i)(?<![A-Z0-9])no\.?[ _]+[0-9]+(?![0-9])"
DOCUMENT_HEADER = r"(?mdU)^#\s+[^\n]+\n+(?:>\s+[^\n]+\n+)*(?:---\s*\n+)?"

# --- Comparison -----------------------------------------------------------------------------------
MAX_EDIT_DISTANCE = 800
WHOLESALE_SHARE = 0.95

# --- Conversion ledger ----------------------------------------------------------------------------
MAX_BATCH_BYTES = 1_800_000_000
BYTES_PER_PAGE = 420_000
MAX_PAGES_PER_JOB = MAX_BATCH_BYTES // BYTES_PER_PAGE
RECOVERY_SKEW_SECONDS = 120
MAX_ENQUEUED_TOKENS = 8_000_000
MAX_RECOVERY_ATTEMPTS = 3
JOB_STATES_ACTIVE = ["JOB_STATE_PENDING", "JOB_STATE_RUNNING"]
JOB_STATES_TERMINAL = [
    "JOB_STATE_SUCCEEDED",
    "JOB_STATE_FAILED",
    "JOB_STATE_CANCELLED",
    "JOB_STATE_EXPIRED",
]
GROUP_STATES = ["pending", "submitted", "collected", "complete", "failed"]
GROUP_STATES_FINISHED = ["collected", "complete", "failed"]
PRESET_PROMPT = "preset"
RETRY_PROMPTS = [
    "verbatim-public-record",
    "verbatim-record-keeping",
    "verbatim-top-to-bottom",
    "summary-of-last-resort",
]
MAX_RETRY_PASSES = len(RETRY_PROMPTS)
PROVENANCE_TAG = "folioflow"

# --- Costs ----------------------------------------------------------------------------------------
INPUT_TOKENS_PER_PAGE = 1262
OUTPUT_TOKENS_PER_PAGE = 650
BYTES_PER_TOKEN = 4
DEFAULT_SAVING_RATE = 0.12
DEFAULT_CONTEXT_BUDGET = 2_000_000
STALE_AFTER_DAYS = 30
HEARTBEAT_SECONDS = 30
PROGRESS_LOG_LINES = 150
DEFAULT_MODEL = "gemini-3.1-flash-lite"
# (model, standard in, standard out, batch in, batch out, context cache), USD per million tokens
BASE_RATES = [
    ("gemini-3.1-flash-lite", 0.25, 1.50, 0.125, 0.75, 0.025),
    ("gemini-3.5-flash-lite", 0.30, 2.50, 0.15, 1.25, 0.03),
    ("gemini-3.7-flash", 0.75, 3.75, 0.375, 1.875, 0.075),
    ("gemini-3.6-flash", 0.75, 3.75, 0.375, 1.875, 0.075),
    ("gemini-3.5-flash", 1.50, 9.00, 0.75, 4.50, 0.15),
    ("gemini-3-flash-preview", 0.50, 3.00, 0.25, 1.50, 0.05),
    ("gemini-3.1-pro-preview", 2.00, 12.00, 1.00, 6.00, 0.20),
    ("gemini-2.5-pro", 1.25, 10.00, 0.625, 5.00, 0.125),
    ("gemini-2.5-flash", 0.30, 2.50, 0.15, 1.25, 0.03),
    ("gemini-2.5-flash-lite", 0.10, 0.40, 0.05, 0.20, 0.01),
]
