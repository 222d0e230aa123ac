"""Fixed values.

Word lists, patterns, thresholds and messages that decide results. They are
plain data, kept together, and must not be changed without changing results.
"""

# Character classes. Written out because Java, Python and RE2 disagree on what
# the shorthand classes cover; these follow Python's Unicode meaning.
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
SPACE_INLINE = r"[\t\x0b-\r\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Document structure
REFERENCE_HEADINGS = ("references", "bibliography", "works cited", "literature cited")
ABSTRACT_WORDS = ("abstract", "summary", "synopsis")
ABSTRACT_STOPS = ("introduction", "background", "keywords", "1.")
LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
BODY_SHARE = 0.7
CITATION_STYLES = (
    ("numeric", rf"^{DIGIT}+\.?{SPACE}+{WORD}+"),
    ("bracket_numeric", rf"^\[{DIGIT}+\]{SPACE}+{WORD}+"),
    ("apa", rf"^{WORD}+,{SPACE}+{WORD}\.{SPACE}+\({DIGIT}{{4}}\)"),
    ("mla", rf"^{WORD}+,{SPACE}+{WORD}+\.{SPACE}+[\"']"),
    ("chicago", rf"^{WORD}+,{SPACE}+{WORD}+,{SPACE}+and{SPACE}+{WORD}+"),
    ("vancouver", rf"^{DIGIT}+\.{SPACE}+{WORD}+{SPACE}+{WORD}+\."),
)
MIN_ENTRY_CHARS = 15
MAX_ENTRY_CHARS = 2000
VALID_SHARE = 0.8

# Chunks
CHUNK_TOKENS = 800
CHUNK_OVERLAP_CHARS = 100
CHUNK_CHARS = 500
TOKEN_PATTERN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\t-\r\x1c-\x1f\x85\p{{Z}}]"

# Markers
NUMERIC_MARKER = rf"\[{DIGIT}+\]"
AUTHOR_MARKER = rf"\([A-Z][a-z]+(?:{SPACE}+et al\.)?,{SPACE}+{DIGIT}{{4}}\)"
DOI_PATTERN = rf"(?i)\b(10\.[0-9]{{4,}}/[^\t-\r\x1c-\x1f\x85\p{{Z}}]+?)(?:[,\t-\r\x1c-\x1f\x85\p{{Z}})\]}}]|$)"

# Claim context
ABSTRACT_PREVIEW_CHARS = 400
CITATION_PREVIEW_CHARS = 100
CITATIONS_SHOWN = 10
NO_CITATION_KEY = "_no_citation"
RESULT_CLASSES = (
    "qualitative_uncited",
    "quantitative_uncited",
    "qualitative_cited",
    "quantitative_cited",
)

# Fact-check ratings
POSITIVE_RATINGS = ("true", "correct", "accurate", "verified", "confirmed", "mostly true")
NEGATIVE_RATINGS = ("false", "incorrect", "inaccurate", "misleading", "debunked", "unproven")
CLEAR_RATINGS = ("true", "false", "correct", "incorrect")
HEDGED_RATINGS = ("mostly", "partly", "somewhat")
CLEAR_CONFIDENCE, HEDGED_CONFIDENCE, OTHER_CONFIDENCE = 0.9, 0.6, 0.4
DEFAULT_SIMILARITY = 0.8
STRONG_CONFIDENCE = 0.8
DEFAULT_MODEL_CONFIDENCE = 0.5

# Source discovery
CATALOG_QUERY_CHARS = 100
CATALOG_TOP_K = 5
CATALOG_SCORE = 0.7
WEB_CATALOG_SCORE = 0.65
WEB_CATALOG_TOP_K = 3
TABULAR_FORMATS = ("csv", "json", "xlsx", "xls")
REUSE_CONFIDENCE = 0.75
TEXT_QUERY_CHARS = 200
TEXT_TOP_K = 3
TEXT_SCORE = 0.8
PAYWALL_DOMAINS = (
    "jstor.org", "nature.com", "science.org", "springer.com", "wiley.com",
    "tandfonline.com", "sagepub.com", "elsevier.com", "sciencedirect.com",
    "cell.com", "nejm.org", "thelancet.com", "oup.com", "cambridge.org",
    "annualreviews.org",
)
PUBLISHER_HOSTS = (
    "wiley.com", "onlinelibrary.wiley.com", "sciencedirect.com", "elsevier.com",
    "springer.com", "link.springer.com", "nature.com", "tandfonline.com",
    "sagepub.com", "journals.sagepub.com", "jamanetwork.com", "cell.com",
    "science.org", "asm.org", "journals.asm.org", "pnas.org", "oup.com",
    "academic.oup.com",
)
LOGIN_URL_WORDS = ("login", "signin", "sign-in", "subscribe")
PAYWALL_PHRASES = (
    "sign in to read", "subscribe to access", "log in to view", "purchase access",
    "institutional access", "full access required", "create a free account",
    "register to continue",
)
SKIP_DOMAINS = (
    "google.com", "gstatic.com", "googleapis.com", "w3.org", "schema.org",
    "facebook.com", "twitter.com",
)
LINK_BOILERPLATE = ("script", "style", "nav", "footer", "header")
MIN_ANCHOR_CHARS = 5
LINK_BLOCKS = ("p", "div", "li", "td")

# Fetched payloads
MIN_USABLE_CHARS = 200
ARTICLE_BOILERPLATE = (
    "script", "style", "nav", "header", "footer", "aside", "form", "button",
    "noscript", "iframe",
)
JUNK_NAMES = (
    "cookie", "banner", "signin", "sign-in", "login", "related", "sidebar", "advert",
    "promo", "footer", "header", "nav", "skip-link", "menu", "share",
    "citation-tools", "metrics", "altmetric",
)
ARTICLE_CLASSES = ("c-article-body", "article-body", "article__body")
ARTICLE_IDS = ("article-body", "main-content", "content")
NO_URL_DATASET = "No URL found via open-access APIs"
NO_URL_TEXT = "No URL found via open-access APIs or institutional cookies"

# Evidence retrieval
VOCABULARY_SIZE = 1000
MIN_SIMILARITY = 0.15
EVIDENCE_TOP_K = 3
FALLBACK_SCORE = 0.5

# Accounting
INPUT_PRICE_PER_MILLION = 0.10
OUTPUT_PRICE_PER_MILLION = 0.40
RETRYABLE_CODES = ("429", "500", "502", "503", "504")
RETRYABLE_WORDS = ("UNAVAILABLE", "RESOURCE_EXHAUSTED", "DEADLINE_EXCEEDED")
# task, model, strength, cost tier, temperature, daily budget in USD, escalates to, below confidence
TASKS = (
    ("claim_extraction", "gemini-2.5-flash-lite", "small", "low", 0.1, 1.50, None, None),
    ("reference_parsing", "gemini-2.5-flash-lite", "small", "low", 0.1, 0.30, None, None),
    ("plausibility_check", "gemini-2.5-flash-lite", "small", "low", 0.2, 0.75,
     "source_grounded_verification", 0.70),
    ("source_grounded_verification", "gemini-2.5-flash", "medium", "medium", 0.15, 1.50,
     "quant_script_generation", 0.60),
    ("quant_script_generation", "gemini-2.5-pro", "strong", "high", 0.1, 2.00, None, None),
    ("dataset_reuse_decision", "gemini-2.5-flash-lite", "small", "low", 0.2, 0.25, None, None),
    ("generic", "gemini-2.5-flash-lite", "small", "low", 0.2, 0.50, None, None),
)

# Spark's English stop words (fixed values, in its order); a test compares them with Spark's own list.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
    we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
    they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
    mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
    would
    """.split()
)
