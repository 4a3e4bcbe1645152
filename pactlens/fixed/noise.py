r"""Noise patterns for document cleaning and layout filtering (fixed values).

Patterns are written once, in the dialect shared by the engines used here; `\s` stands for
the wide whitespace class and is expanded by `functions.text.pattern`.
"""

# ---- fixed values: noise patterns per category, case-insensitive where marked "i", multi-line "m"
NOISE_PATTERNS = {
    "eStamp": [
        (r"e-?stamp", "i"),
        (r"INDIA NON JUDICIAL", "i"),
        (r"NON JUDICIAL STAMP PAPER", "i"),
        (r"STAMP PAPER", "i"),
        (r"GOVERNMENT OF [A-Z\s]+", "i"),
        (r"STATE OF [A-Z\s]+", "i"),
        (r"KARNATAKA|MAHARASHTRA|DELHI|MUMBAI|BANGALORE", "i"),
    ],
    "government": [
        (r"GOVERNMENT OF", "i"),
        (r"MINISTRY OF", "i"),
        (r"DEPARTMENT OF", "i"),
        (r"REGISTRAR", "i"),
        (r"SUB REGISTRAR", "i"),
        (r"REGISTRATION", "i"),
    ],
    "metadata": [
        (r"AADHAR NO\.?\s*:?\s*\d+", "i"),
        (r"PAN NO\.?\s*:?\s*[A-Z0-9]+", "i"),
        (r"DOCUMENT NO\.?\s*:?\s*[A-Z0-9]+", "i"),
        (r"SERIAL NO\.?\s*:?\s*[A-Z0-9]+", "i"),
        (r"CERTIFICATE NO\.?\s*:?\s*[A-Z0-9]+", "i"),
    ],
    "pageNumbers": [
        (r"PAGE\s+\d+\s+OF\s+\d+", "i"),
        (r"PAGE\s+\d+", "i"),
        (r"^\s*\d+\s*$", "m"),
        (r"\[\s*\d+\s*\]", ""),
    ],
    "boilerplate": [
        (r"WITNESSED BY", "i"),
        (r"IN WITNESS WHEREOF", "i"),
        (r"SIGNED AND DELIVERED", "i"),
        (r"NOTARIZED BY", "i"),
        (r"SWORN BEFORE ME", "i"),
        (r"SUBSCRIBED AND SWORN", "i"),
    ],
    "ocrArtifacts": [
        (r"\|{2,}", ""),
        (r"_{3,}", ""),
        (r"-{5,}", ""),
        (r"\.{4,}", ""),
        (r"\s{3,}", ""),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
    ],
    "watermarks": [
        (r"WATERMARK", "i"),
        (r"CONFIDENTIAL", "i"),
        (r"DRAFT", "i"),
        (r"COPY", "i"),
        (r"DUPLICATE", "i"),
        (r"ORIGINAL", "i"),
        (r"SPECIMEN", "i"),
    ],
}

# ---- fixed values: stamp phrases removed after the eStamp patterns (blanks match any whitespace run)
STAMP_PHRASES = [
    "INDIA NON JUDICIAL",
    "NON JUDICIAL STAMP PAPER",
    "GOVERNMENT OF KARNATAKA",
    "GOVERNMENT OF MAHARASHTRA",
    "GOVERNMENT OF DELHI",
    "STATE GOVERNMENT",
    "STAMP DUTY",
    "REVENUE STAMP",
]

# ---- fixed values: the only patterns removed by conservative filtering
CONSERVATIVE_PATTERNS = [
    (r"e-?stamp", "i"),
    (r"INDIA NON JUDICIAL", "i"),
    (r"GOVERNMENT OF [A-Z\s]+", "i"),
    (r"AADHAR NO\.?\s*:?\s*\d+", "i"),
    (r"PAGE\s+\d+\s+OF\s+\d+", "i"),
    (r"\|{3,}", ""),
    (r"_{4,}", ""),
    (r"-{6,}", ""),
]

# ---- fixed values: words that mark contract content in noise filtering
CONTRACT_KEYWORDS = [
    "agreement", "contract", "lease", "rental", "tenant", "landlord", "lessor", "lessee",
    "party", "parties", "terms", "conditions", "obligations", "rights", "responsibilities",
    "payment", "rent", "deposit", "duration", "termination", "maintenance", "repairs",
    "liability", "damages", "breach", "default", "notice", "consent", "approval", "assignment",
    "subletting", "alterations", "modifications", "insurance", "utilities", "possession",
    "delivery", "surrender", "renewal", "extension",
]

# ---- fixed values: limits of the keep-or-fall-back check
MIN_KEPT_SHARE = 0.3
MIN_CONTRACT_KEYWORDS = 3
MIN_CLEAN_CHARS = 100

# ---- fixed values: words that mark contract content in layout filtering
LAYOUT_INDICATORS = [
    "agreement", "contract", "lease", "rental", "tenant", "landlord", "lessor", "lessee",
    "party", "parties", "whereas", "therefore", "terms", "conditions", "obligations", "rights",
    "payment", "termination", "duration", "maintenance", "alterations", "hereby", "witnesseth",
]

# ---- fixed values: layout regions and their indicators
LAYOUT_REGIONS = {
    "headerRegion": [
        (r"INDIA NON JUDICIAL", "i"), (r"GOVERNMENT OF", "i"), (r"STATE OF", "i"),
        (r"STAMP PAPER", "i"), (r"e-?stamp", "i"), (r"REVENUE", "i"),
    ],
    "footerRegion": [
        (r"PAGE\s+\d+", "i"), (r"^\s*\d+\s*$", ""), (r"NOTARIZED", "i"), (r"WITNESSED", "i"), (r"SIGNATURE", "i"),
    ],
    "stampRegion": [
        (r"SEAL", "i"), (r"STAMP", "i"), (r"NOTARY", "i"), (r"OFFICIAL", "i"), (r"CERTIFICATE", "i"),
    ],
    "metadataRegion": [
        (r"AADHAR NO\.?\s*:?\s*\d+", "i"),
        (r"PAN NO\.?\s*:?\s*[A-Z0-9]+", "i"),
        (r"DOCUMENT NO\.?\s*:?\s*[A-Z0-9]+", "i"),
        (r"REGISTRATION NO\.?\s*:?\s*[A-Z0-9]+", "i"),
        (r"SERIAL NO\.?\s*:?\s*[A-Z0-9]+", "i"),
    ],
}

# ---- fixed values: tests for a tabular header (applied to lower-cased text)
TABULAR_PATTERNS = [(r"\|\s*[^|]+\s*\|", ""), (r":\s*[A-Z0-9]+", ""), (r"[-=_]{5,}", "")]

# ---- fixed values: whole-line noise
LINE_NOISE = {
    "tabularNoise": [
        (r"^\s*[A-Z\s]+\s*:\s*[A-Z0-9\s]+\s*$", "m"),
        (r"^\s*\|\s*[^|]+\s*\|\s*[^|]+\s*\|\s*$", "m"),
        (r"^\s*[-=_]{3,}\s*$", "m"),
    ],
    "graphicalNoise": [
        (r"^\s*[▪▫■□●○◆◇▲△▼▽]+\s*$", "m"),
        (r"^\s*[┌┐└┘├┤┬┴┼│─]+\s*$", "m"),
        (r"^\s*[░▒▓█]+\s*$", "m"),
    ],
    "stampArtifacts": [
        (r"^\s*[A-Z]{1,3}\s*[A-Z]{1,3}\s*[A-Z]{1,3}\s*$", "m"),
        (r"^\s*\d{1,2}\/\d{1,2}\/\d{2,4}\s*$", "m"),
        (r"^\s*Rs\.?\s*\d+\s*$", "m"),
    ],
}
# the same matches without adjacent \s quantifiers, so that matching doesn't backtrack
LINE_NOISE_FAST = {
    r"^\s*[A-Z\s]+\s*:\s*[A-Z0-9\s]+\s*$": r"^[A-Z\s]+:[A-Z0-9\s]+$",
    r"^\s*\|\s*[^|]+\s*\|\s*[^|]+\s*\|\s*$": r"^\s*\|[^|]+\|[^|]+\|\s*$",
}

# ---- fixed values: noise that stops conservative body extraction
BODY_STOP_PATTERNS = [
    (r"india non judicial", "i"), (r"government of", "i"), (r"e-?stamp", "i"),
    (r"aadhar no", "i"), (r"pan no", "i"), (r"page \d+", "i"),
]

# ---- fixed values: layout limits
HEADER_SHARE = 0.25
FOOTER_START_SHARE = 0.95
MIN_HEADER_INDICATORS = 2
MIN_BODY_CHARS = 100
MAX_REMOVED_SHARE = 0.8
MIN_LAYOUT_INDICATORS = 3
SHORT_RESULT_CHARS = 500

# ---- fixed values: literal artefacts replaced by a blank in recognised text
OCR_LITERALS = ["|", "___", "---", "==="]
