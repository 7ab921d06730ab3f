"""Fixed values that results depend on. They are data, not logic: change one and the metrics change."""

from __future__ import annotations

# Module names that mark a notebook as using a test framework, and the name pattern that does the same.
TEST_MODULES = ["unittest", "pytest", "nose", "hypothesis", "behave", "mox", "subunit", "twisted.trial"]
TEST_NAME_PATTERN = r"(?i)(?:^|[.\-_])(test|tests|mock|mocks)(?:$|[.\-_])"

# Assistant names searched as whole words, and one phrase searched anywhere, in markdown cells.
AI_NAMES = ["ChatGPT", "Copilot", "Claude", "CodeWhisperer", "Cursor"]
AI_PHRASE = "As an AI language model"

# Patterns searched in code cells.
ABSOLUTE_PATH_PATTERN = r"(^/[^ \n\r]+)|([A-Za-z]:\\[^ \n\r]+)"
CODE_FENCE = "```"

# MIME types (exact) and MIME prefixes behind the six output flags.
MIME_PREFIX_TEXT = ["text/"]
MIME_PREFIX_IMAGE = ["image/png", "image/jpeg", "image/svg"]
MIME_HTML_JS = ["text/html", "application/javascript"]
MIME_FORMATTED = ["text/latex", "text/markdown"]
MIME_PREFIX_EXTENSION = ["application/vnd.", "application/plotly"]

# Endings of dependency files.
REQUIREMENTS_ENDING = "requirements.txt"
SETUP_ENDING = "setup.py"
PIPFILE_ENDING = "pipfile"
NOTEBOOK_ENDING = ".ipynb"

# Words read as true, and defaults for missing text.
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
DEFAULT_BRANCH = "main"
DEFAULT_KERNEL = "python3"
MISSING_SHA = "noSHA"
MISSING_ERROR = "None"
SHA_PREFIX_LENGTH = 8
UNSAFE_NAME_CHARACTER = r"[^A-Za-z0-9_.-]"

# Run logs.
RESULT_PREFIX = "NBEXEC_RESULT:"
LOG_TAIL_CHARACTERS = 2000
ELAPSED_DECIMALS = 3
ERROR_TIMEOUT = "TimeoutExpired"
ERROR_SUBPROCESS = "SubprocessError"
ERROR_UNKNOWN = "UnknownError"
MISSING_MODULE_PATTERN = r"No module named '([^']+)'"
AUTH_CODE = "401"
AUTH_ERROR_NAME = "AuthenticationError"
AUTH_KEY_TEXT = "invalid_api_key"
FILE_ERROR_NAME = "FileNotFoundError"
FILE_ERROR_TEXTS = ["No such file or directory", "not found"]

# Limits of sampling and of the printed top lists.
RANGE_CAP = 900
ROWS_PER_RANGE = 1000
ROWS_PER_PAGE = 100
DEFAULT_ITEM_LIMIT = 1000
TOP_IMPORTS = 10
TOP_ERRORS = 12
TOP_FAILURES = 10
DIVERGENCE_EXAMPLES = 10

# The collection calendar. Windows are Monday-to-Sunday weeks clipped to these bounds; the quotas below
# follow the weeks in order.
CALENDAR_START = "2025-01-01"
CALENDAR_END = "2025-09-30"
CALENDAR_QUOTAS = [
    10, 10, 9, 10, 9,
    10, 9, 10, 10,
    10, 9, 10, 9, 10,
    9, 10, 9, 10,
    9, 10, 9, 10,
    10, 9, 10, 9, 10,
    10, 9, 10, 9,
    10, 9, 10, 9,
    10, 9, 10, 9, 10,
]
