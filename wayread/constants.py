"""Fixed values of the data model: limits, roles, prompts, tag lists and patterns.

Everything here is a value that results depend on. Code elsewhere only refers to these names.
"""

# --- lengths, in characters ---------------------------------------------------------------
MIN_SENTENCE_LEN = 12
MAX_SENTENCE_LEN = 480
MIN_PASSAGE_LEN = 40
MAX_PASSAGE_LEN = 960
MIN_HEADLINE_LEN = 3
MAX_HEADLINE_LEN = 300
HEADLINE_QUOTE_LEN = 200
OPENER_QUOTE_LEN = 280
EXCERPT_LEN = 120
MIN_QUERY_LEN = 2

# --- judging ------------------------------------------------------------------------------
DEFAULT_THRESHOLD = 0.45
SECOND_PASS_FLOOR = 0.62
HIGH_TIER = 0.72
FIND_WINDOW = 25
FIND_WINDOW_RANGE = (5, 60)
DIGEST_WINDOW = 12
DIGEST_WINDOW_RANGE = (4, 16)
MIN_PATH = 3
MAX_PATH = 7
SWEEP_HUNDREDTHS = (20, 90, 5)  # first, last, step
DEFAULT_MODEL = "default"
MANIFEST_VERSION = 2

# --- layout -------------------------------------------------------------------------------
BAND_SHARE = 0.08
REPEAT_MAX_LEN = 120
REPEAT_MIN_PAGES = 3
HEADING_MAX_LEN = 200
HEADING_MAX_WORDS = 12
HEADING_SIZE_RATIO = 1.08
ROW_HEIGHT = 4.0

# --- roles: (name, label, weight), in path preference order ---------------------------------
ROLES = [
    ("direct_answer", "Direct answer", 1.0),
    ("background", "Background", 0.9),
    ("reasoning", "Explanation", 0.9),
    ("evidence", "Evidence", 0.9),
    ("qualification", "Important exception", 0.96),
    ("counterpoint", "Counterpoint", 0.96),
    ("irrelevant", "Not needed", 0.9),
]
ROLE_NAMES = [name for name, _, _ in ROLES]
IRRELEVANT = "irrelevant"
CATCH_ROLES = ["qualification", "counterpoint"]
CATCH_LABEL = "The catch"
FALLBACK_LABEL = "Read"
OTHER_WEIGHT = 0.9

# --- HTML ---------------------------------------------------------------------------------
# Blocks ended by the next block tag; they never contain another block.
LEAF_BLOCK_TAGS = ["p", "h1", "h2", "h3", "h4", "h5", "h6"]
# Blocks that nest.
NEST_BLOCK_TAGS = [
    "div", "li", "td", "th", "blockquote", "pre", "article", "section", "dd", "dt", "figcaption",
    "summary", "caption", "label", "main", "aside", "header", "footer", "nav", "ul", "ol", "table",
    "tr", "body", "details", "fieldset", "form",
    # blocks by their default display
    "address", "center", "dialog", "dir", "dl", "figure", "hgroup", "legend", "menu", "search", "tbody", "tfoot", "thead",
]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# Skipped elements whose content is not markup: the tokenizer takes them as one token.
RAW_TEXT_TAGS = ["script", "style", "noscript", "textarea", "title", "iframe"]
# Skipped elements whose content is markup: hidden from the open tag to the matching close tag.
# Options are hidden with the select or datalist they stand in, since their own end tags are often left out.
HIDDEN_TAGS = ["select", "datalist", "svg", "canvas", "code", "kbd", "template", "head", "button"]

# --- whitespace (the Unicode White_Space property), written for Java and RE2 alike ------------
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
WS_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# characters that end a line
LINE_END = r"[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# --- sentences ------------------------------------------------------------------------------
STOPS = ".!?…"
CLOSERS = "\"'”’)\\]"
OPENERS = "A-Z0-9\"'“‘(\\[¿¡•—-"
ABBREVIATIONS = (
    r"e\.g|i\.e|etc|vs|cf|approx|Mr|Mrs|Ms|Dr|Prof|St|No|Fig|Inc|Ltd|Co|Jr|Sr|U\.S|U\.K|a\.m|p\.m|[A-Z]"
)

# --- headlines: a trailing site name after a bar or dash ---------------------------------------
SITE_SUFFIX = WS + r"*[|–—-]" + WS + r"*[^-|–—]{2,60}$"

# --- questions made up from a page ----------------------------------------------------------
AUTO_FROM_HEADLINE = (
    'What is "', '" about? What are its key points, supporting evidence, and important caveats?',
)
AUTO_FROM_OPENER = (
    'What is this page about? It begins: "',
    '" What are its key points, supporting evidence, and important caveats?',
)

# --- questions put to the judge; {id} is the item's id in its window ---------------------------
FIND_QUESTION = {
    "type": "noul",
    "instructions": {
        "question": "Does line {id} of `passage` contain, state, or clearly express what `query` is looking for?",
        "focus": (
            "Match meaning and intent, not exact words. A paraphrase counts; a line that merely shares "
            "vocabulary with the query does not. Other lines are context only: judge {id} by itself."
        ),
    },
    "criteria": {
        "true": "Line {id} directly expresses what the query seeks.",
        "false": "Line {id} is about something else or merely shares wording.",
    },
}
NEEDED_QUESTION = {
    "type": "noul",
    "instructions": {
        "question": (
            "Does passage {id} contain information a reader needs to understand or accurately answer `question`?"
        ),
        "focus": (
            "Judge {id} itself. Include direct answers, necessary background, reasoning, evidence, important "
            "qualifications, and genuine counterpoints. Mere topic overlap is not enough."
        ),
    },
    "criteria": {
        "true": (
            "Omitting {id} could leave the reader with an incomplete, misleading, or poorly supported understanding."
        ),
        "false": "{id} is irrelevant, redundant, or unnecessary for understanding the answer.",
    },
}
ROLE_QUESTION = {
    "type": "choice",
    "instructions": (
        "What is passage {id}'s most useful role in helping a reader understand or answer `question`? "
        "Judge {id} itself."
    ),
    "criteria": {
        "direct_answer": "States or directly implies the answer.",
        "background": "Defines or establishes context required to understand the answer.",
        "reasoning": "Explains why or how the answer works.",
        "evidence": "Provides support, data, a concrete example, or an illustrative case.",
        "qualification": "Adds an important condition, exception, limitation, or caveat.",
        "counterpoint": "Presents a conflicting view, tension, or alternative conclusion.",
        "irrelevant": "Does not materially help the reader understand or answer the question.",
    },
}

# --- cue words of the lexical judge, first rule that fits ---------------------------------------
LEXICAL_CUES = [
    ("qualification", r"(?:^|[^\p{L}\p{N}])(?:unless|except|however|only if|limit)"),
    ("counterpoint", r"(?:^|[^\p{L}\p{N}])(?:but|although|on the other hand)(?:$|[^\p{L}\p{N}])"),
    ("reasoning", r"(?:^|[^\p{L}\p{N}])(?:because|therefore|since)(?:$|[^\p{L}\p{N}])"),
    ("evidence", r"[0-9]|(?:^|[^\p{L}\p{N}])(?:for example|data|study)(?:$|[^\p{L}\p{N}])"),
]
LEXICAL_DIRECT = 0.8
