"""Fixed values the semantics depend on.

These must equal the behaviour being reproduced, so they are stated here once,
as plain values, and every operator reads them from this module.
"""

# --- fixed values -----------------------------------------------------------
MAX_CHUNK_CHARS = 4096          # longest synthesis input
PARAGRAPH_SPLIT_CHARS = 1000    # paragraphs longer than this are re-packed
HASH_PREFIX_CHARS = 1000        # content hash covers url + this many chars
LANGUAGE_SAMPLE_CHARS = 1000    # language is detected on this prefix
DEFAULT_LANGUAGE = "en"
WORDS_PER_MINUTE = 150
FEED_STALE_MINUTES = 30
FEED_ENTRIES_REFRESH = 10
FEED_ENTRIES_ON_ADD = 5
FEED_ERROR_THRESHOLD = 3        # status is "error" when error_count > this
VOICES = ("alloy", "echo", "fable", "onyx", "nova", "shimmer")
DEFAULT_VOICE = "onyx"
SYNTHESIS_MODEL = "tts-1"
GUEST_CONVERSION_LIMIT = 3
EXTRACT_ERROR = "Could not extract content from the URL"
NO_TEXT_ERROR = "No text provided for conversion"
DOWNLOAD_DEFAULT_NAME = "blog-audio"
SHARE_MAIL = "mailto:?subject=Listen to this blog post&body=I thought you might enjoy listening to this blog post: "
PARSE_ERROR = "Could not parse feed: "
UNTITLED_POST = "Untitled Post"
RESULT_TITLE = "Blog Post Converted"
UNNAMED_FEED = "Unnamed Feed"
URL_MISSING = "URL is required"
URL_INVALID = "Invalid URL format"
# Labels of a content row's status, then of a feed's; the last one stands for every other status.
BADGES = {"completed": "Ready to Play", "processing": "Processing", "pending": "Pending", "error": "Error"}
FEED_BADGES = {"active": "Active", "error": "Error", "inactive": "Inactive"}
AUDIO_DIR = "static/audio/"
EMAIL_PLACEHOLDER = "[EMAIL REMOVED]"

# Request ceilings: (limit, period) per client key.
RATE_WEB_SUBMIT = (5, "1 minute")
RATE_ADD_FEED = (5, "1 minute")
RATE_API_SUBMIT = (10, "1 hour")
RATE_DEFAULT = (100, "1 day")

# A ceiling of our own that binds on the test tables, where no client comes near the others.
ADMISSION_LIMIT = (5, "1 day")

# Abbreviations spoken in full, applied in this order, case-sensitive.
ABBREVIATIONS = (
    ("Dr.", "Doctor"),
    ("Mr.", "Mister"),
    ("Mrs.", "Misses"),
    ("Ms.", "Miss"),
    ("Prof.", "Professor"),
    ("e.g.", "for example"),
    ("i.e.", "that is"),
    ("etc.", "etcetera"),
    ("vs.", "versus"),
    ("approx.", "approximately"),
)

# Elements removed before the structural main-text pick.
BOILERPLATE_TAGS = ("script", "style", "nav", "footer", "header", "aside")
# Id pattern for the third structural candidate (case-insensitive search).
MAIN_ID_PATTERN = "content|main|article"

# Fixture clock: compared queries never read the wall clock.
FIXTURE_NOW = "2024-02-01 00:00:00"
FIXTURE_EPOCH = "2024-01-01 00:00:00"
