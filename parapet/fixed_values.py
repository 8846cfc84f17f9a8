"""Patterns, word lists, tables and defaults.

Everything in this module is data that has to keep exactly these values for
results to be right.  No logic lives here; see ``functions/`` for its use.
Patterns are written in the common regex dialect (Unicode-aware ``\\b``,
``\\d`` and ``\\s``); ``functions.patterns`` adapts them to the JVM.
"""

# --- Fixed values: personal-data patterns, in priority order ----------------
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "credit_card": (
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|"
        r"6(?:011|5[0-9]{2})[0-9]{12})\b"
    ),
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "phone": r"\b(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b",
}
PII_PLACEHOLDERS = {
    "email": "[REDACTED_EMAIL]",
    "credit_card": "[REDACTED_CARD]",
    "ssn": "[REDACTED_SSN]",
    "phone": "[REDACTED_PHONE]",
}
TOKEN_PATTERN = r"\[PII_([A-Z_]+)_(\d+)\]"
PARTIAL_TOKEN_PATTERN = r"\[(?:P(?:I(?:I(?:_[A-Z_]*\d*)?)?)?)?"

# --- Fixed values: characters removed or folded before signature scans ------
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e"
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
HOMOGLYPHS_FROM = "аеорсхуіѕјһԁɡАВЕКМНОРСТХαοινκτρυε"
HOMOGLYPHS_TO = "aeopcxyisjhdgABEKMHOPCTXaoivktpue"
LEET_FROM = "013457@$!"
LEET_TO = "oieastasi"
BIDI_PATTERN = "[\u202a-\u202e\u2066-\u2069]"
ZERO_WIDTH_IN_WORD_PATTERN = (
    "[A-Za-z][\u200b\u200c\u200d\u2060\ufeff\u00ad]+[A-Za-z]"
)
BASE64_PATTERN = r"[A-Za-z0-9+/]{24,}={0,2}"

# --- Fixed values: injection signatures (category, weight, pattern) ---------
SIGNATURES = [
    ("instruction override", 1.0,
     r"\b(ignore|disregard|bypass|override|forget|discard)\b[^.!?\n]{0,40}"
     r"\b(previous|prior|above|earlier|initial|original|system|all)\b[^.!?\n]{0,30}"
     r"\b(instructions?|prompts?|directives?|rules?|guidelines?|constraints?|messages?|context)\b"),
    ("instruction override", 1.0,
     r"\bforget (everything|all previous|all prior|your instructions)\b"),
    ("instruction override", 1.0,
     r"\byour new (instructions?|persona|role|task|identity) (is|are)\b"),
    ("instruction override", 1.0,
     r"\b(new|updated|revised) (instructions?|rules?|directives?) *(:|is\b|are\b|follow\b)"),
    ("instruction override", 0.5, r"\bfrom now on,? you (are|will|must)\b"),
    ("instruction override", 0.5, r"\byou must (obey|comply with) (me|my|all)\b"),
    ("persona hijack", 1.0, r"\bDAN\b"),
    ("persona hijack", 1.0, r"\bdo anything now\b"),
    ("persona hijack", 1.0, r"\bjail\s*break(ing|s|ed)?\b"),
    ("persona hijack", 1.0, r"\bdeveloper mode\b"),
    ("persona hijack", 1.0,
     r"\bpretend (you('re| are)|to be) (not |a different |an? )?"
     r"(unrestricted|unfiltered|uncensored|evil|malicious|amoral)"),
    ("persona hijack", 1.0,
     r"\bact as (an? )?(unrestricted|unfiltered|uncensored|amoral|evil)\b"),
    ("persona hijack", 0.5,
     r"\byou are now (a|an|the|no longer|free|unrestricted|unfiltered)\b"),
    ("persona hijack", 0.5,
     r"\bwithout (any )?(restrictions?|filters?|limitations?|censorship|guidelines?)\b"),
    ("persona hijack", 0.5,
     r"\bno (ethical|moral) (guidelines?|constraints?|restrictions?|limits?)\b"),
    ("prompt extraction", 1.0,
     r"\b(print|repeat|output|show|reveal|display|share|paste|leak|tell me)\b[^.!?\n]{0,30}"
     r"\b(system prompt|initial instructions?|base prompt|hidden (prompt|instructions?)"
     r"|your (instructions?|prompt|guidelines))"),
    ("prompt extraction", 1.0,
     r"\bwhat (are|were) your (original |initial |system |hidden )?instructions\b"),
    ("prompt extraction", 0.5,
     r"\brepeat (everything|all( of)? the text|the words) above\b"),
    ("delimiter injection", 1.0, r"</?(system|user|assistant|instructions?)>"),
    ("delimiter injection", 1.0, r"<\|im_(start|end)\|>"),
    ("delimiter injection", 1.0, r"\[/?INST\]"),
    ("delimiter injection", 1.0, r"(?m)^#{1,4} *(system|instructions?) *$"),
    ("delimiter injection", 1.0,
     r"\b(BEGIN|END) (SYSTEM|HIDDEN|SECRET) (PROMPT|MESSAGE|INSTRUCTIONS?)\b"),
]

# --- Fixed values: toxicity word list ---------------------------------------
TOXICITY_PATTERNS = [
    r"\b(kill yourself|kys|go die)\b",
    r"\b(n[i1]gg[ae]r|f[a4]gg[o0]t|ch[i1]nk|sp[i1]c)\b",
]
TOXICITY_LONGEST_MATCH = 13
MODEL_CHECK_INTERVAL = 500

# --- Fixed values: policy defaults ------------------------------------------
DEFAULT_PII_TYPES = ["email", "phone", "ssn", "credit_card"]
DEFAULT_ALERT_EVENTS = ["input_blocked", "output_blocked", "rate_limited"]
DEFAULT_TENANT = "default"
HEADER_TENANT = "__from_header__"

# --- Fixed values: plans (name, price, requests per month, rpm, rph) --------
PLANS = [
    ("free", 0, 200, 10, 200),
    ("starter", 49, 100_000, 60, 1_000),
    ("growth", 199, 1_000_000, 200, 10_000),
]
