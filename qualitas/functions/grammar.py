"""Fixed values of the profiling and rule grammar.

Values marked FIXED must stay equal to the behaviour being matched
(date prefixes, the code pattern, name tokens, thresholds, wording of the
healthy dimension, blocked hosts).  Values marked OURS are this engine's
own decisions where the original leaves the result undefined.
"""

# ---------------------------------------------------------------- FIXED values
# Date prefixes, tried in this order.
DATE_PATTERN_ISO = r"^\d{4}-\d{2}-\d{2}"          # YYYY-MM-DD
DATE_PATTERN_SLASH = r"^\d{2}/\d{2}/\d{4}"        # MM/DD/YYYY or DD/MM/YYYY
DATE_PATTERN_MONTH_YEAR = r"^\d{2}/\d{4}"         # MM/YYYY
DATE_PATTERN_YEAR = r"^\d{4}$"                    # YYYY
YEAR_MAX = 2100                                   # a bare year above this is no date

# Pattern statistic: share of present values starting with three capitals and digits.
CODE_PATTERN = r"^[A-Z]{3}\d+"

# Column-name tests (lower-cased names, substring match).
ID_COLUMN_NAME = "id"
ID_COLUMN_SUBSTRINGS = ("_id",)
YEAR_COLUMN_TOKENS = ("year", "date", "time", "at")
KYC_TOKENS = ("kyc", "address")
MONETARY_TOKENS = ("amount", "price")
PERSONAL_TOKENS = ("name", "email", "phone")

TEMPORAL_MIN_COVERAGE = 0.1       # dates must be at least this share of all rows
STALE_DAYS = 365                  # older than this many days before as_of is stale
TOP_K = 3                         # top values per column
SAMPLE_COUNT = 3                  # masked samples per column
MASK = "***"

DIMENSIONS = ("Completeness", "Accuracy", "Consistency", "Validity",
              "Timeliness", "Uniqueness", "Integrity")
HEALTHY_ISSUE = "No issues identified"
HEALTHY_DESCRIPTION = "No specific issues were identified for this dimension."

# Public-URL check.
ALLOWED_URL_SCHEMES = ("http", "https")
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "[::1]",
                 "169.254.169.254", "metadata.google.internal")
# Private IPv4 ranges: first octet 10 or 0; 172.16-31; 192.168; 169.254.

TABLE_NAME_PATTERN = r"^[a-zA-Z_][a-zA-Z0-9_.]*$"
TRANSCRIPT_KEEP = 10              # messages kept by the transcript tail
DEFAULT_DOMAIN = "Unknown"
API_DOMAIN = "API Source"

# ----------------------------------------------------------------- OURS values
CORRUPT_COLUMN = "_corrupt_record"   # where the readers put malformed rows; no column of the dataset
# Decimal number grammar (no hex, no Infinity/NaN, no thousands separators).
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
ISO_DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
CURRENCY_PATTERN = r"^\s*[-+]?[$€£¥₹]\s*[0-9]"
MAJORITY_SHARE = 0.5              # mixed-type and currency rules need a >50 % majority
FRESHNESS_YEARS = 2               # timeliness policy (2-5 years)
DEFAULT_RANGE_RULES = (("cvv", 100.0, None),)   # name token, min, max
# PAN lengths by brand: brand (lower case), min digits, max digits.
PAN_LENGTHS = (("visa", 16, 16), ("amex", 15, 15), ("american express", 15, 15),
               ("diners", 14, 16), ("diners club", 14, 16))
PRIORITY_SHARE_BUCKETS = (0.20, 0.10, 0.05, 0.01)   # share >= bucket[i] -> priority i+1, else 5
