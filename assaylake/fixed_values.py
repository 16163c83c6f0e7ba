"""Texts and constants that results must carry exactly as written here."""

# Prefixes of a value outside the range an assay can measure.
BELOW_PREFIX = "<"
ABOVE_PREFIX = ">"
BELOW_LIMIT_SHARE = 0.5

# Number texts that parse to a double.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"

# Trend marks and the width of the flat band, in percent.
TREND_FLAT = "-"
TREND_UP = "^"
TREND_DOWN = "v"
TREND_NONE = ""
TREND_BAND_PERCENT = 3.0

# Status cell of the snapshot report.
STATUS_BELOW_LIMIT = "BDL"
STATUS_OPTIMAL = "Optimal"
STATUS_NORMAL = "Normal"
STATUS_OUT = "**OUT**"
STATUS_UNKNOWN = "-"

# Range wording of the findings feed.
FINDING_IN = "in range"
FINDING_OUT = "OUT OF RANGE"
FINDING_UNKNOWN = "unknown"
FINDINGS_EMPTY = "No findings data found."

# Status of a row in the environment diff.
DIFF_LEFT_ONLY = "PROD ONLY"
DIFF_RIGHT_ONLY = "ENV ONLY"
DIFF_CHANGED = "CHANGED"
DIFF_SAME = "SAME"

# Order in which condition groups are listed; other states follow.
CONDITION_ORDER = ("active", "monitoring", "confirmed", "resolved")
CONDITION_UNKNOWN = "unknown"

# Placeholder of the n-th redacted string, fence marker, suffixes of text reports.
PLACEHOLDER = "[REDACTED_{}]"
FENCE = "```"
TEXT_SUFFIXES = ("md", "txt")

# The characters that count as white space when text is stripped.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Defaults of an extraction document.
DEFAULT_METHOD = "api"
UNKNOWN_PART = "unknown"
UNCATEGORIZED = "uncategorized"
FINDINGS_ROOT = "docs/findings"
