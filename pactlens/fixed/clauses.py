"""Clause taxonomy and label sets (fixed values)."""

# ---- fixed values: the 12 clause types in extraction order, with display name, keywords and risk factors
CLAUSE_TYPES = {
    "termination": (
        "Termination",
        ["terminate", "termination", "end", "expire", "dissolution", "cancel"],
        ["immediate termination", "without cause", "no notice period"],
    ),
    "payment": (
        "Payment",
        ["payment", "pay", "invoice", "fee", "cost", "price", "compensation", "rent", "deposit"],
        ["late payment penalties", "advance payment", "non-refundable"],
    ),
    "liability": (
        "Liability",
        ["liability", "liable", "damages", "responsible", "indemnify", "limitation"],
        ["unlimited liability", "broad indemnification", "no liability cap"],
    ),
    "confidentiality": (
        "Confidentiality",
        ["confidential", "non-disclosure", "proprietary", "secret", "nda"],
        ["perpetual confidentiality", "broad definition", "no exceptions"],
    ),
    "intellectual_property": (
        "Intellectual Property",
        ["intellectual property", "copyright", "trademark", "patent", "ip rights"],
        ["broad IP assignment", "work for hire", "no retained rights"],
    ),
    "dispute_resolution": (
        "Dispute Resolution",
        ["dispute", "arbitration", "mediation", "court", "litigation"],
        ["mandatory arbitration", "limited venue", "waiver of jury trial"],
    ),
    "force_majeure": (
        "Force Majeure",
        ["force majeure", "act of god", "unforeseeable", "natural disaster"],
        ["narrow definition", "no relief provisions", "short notice period"],
    ),
    "governing_law": (
        "Governing Law",
        ["governing law", "jurisdiction", "applicable law", "venue"],
        ["unfavorable jurisdiction", "foreign law", "inconvenient venue"],
    ),
    "duration": (
        "Duration",
        ["duration", "term", "period", "commence", "expire", "months", "years", "lease period"],
        ["auto-renewal", "long term commitment", "no early termination"],
    ),
    "internal_maintenance": (
        "Internal Maintenance",
        ["internal maintenance", "repairs", "upkeep", "interior", "tenant responsibility", "lessee maintains"],
        ["broad maintenance obligations", "structural repairs", "no landlord responsibility"],
    ),
    "additions_alterations": (
        "Additions and Alterations",
        ["additions", "alterations", "modifications", "changes", "improvements", "structural changes"],
        ["no alterations allowed", "landlord approval required", "restoration obligations"],
    ),
    "assignment": (
        "Assignment",
        ["assignment", "transfer", "subletting", "sublet", "assign"],
        ["no assignment allowed", "landlord consent required", "personal guarantees"],
    ),
}

# ---- fixed values: extraction limits (characters, rows)
SENTENCE_TAIL = 200
CONTEXT_CHARS = 100
MIN_CLAUSE_CHARS = 30
DEDUPE_PREFIX = 50
DEDUPE_DISTANCE = 50
MAX_CLAUSES = 25

# ---- fixed values: document-level type sets
STANDARD_TYPES = [
    "termination", "liability", "payment", "confidentiality", "dispute_resolution",
    "governing_law", "duration", "internal_maintenance", "additions_alterations",
]
CRITICAL_TYPES = ["termination", "liability", "payment", "duration"]
IMPORTANT_TYPES = ["intellectual_property", "confidentiality", "internal_maintenance"]
RENTAL_TYPES = ["duration", "internal_maintenance", "additions_alterations"]

# ---- fixed values: the 13 labels of the rule classifiers and of model evaluation
LABELS = [
    "termination", "payment", "liability", "confidentiality", "intellectual_property",
    "dispute_resolution", "force_majeure", "governing_law", "duration", "internal_maintenance",
    "additions_alterations", "assignment", "other",
]

# ---- fixed values: ordered substring rules, 8 labels then `other`
FIRST_MATCH_RULES = [
    ("termination", ["terminate", "end", "expire", "cancel"]),
    ("payment", ["pay", "payment", "fee", "cost", "invoice"]),
    ("liability", ["liable", "liability", "damages", "responsible"]),
    ("confidentiality", ["confidential", "non-disclosure", "secret"]),
    ("intellectual_property", ["intellectual", "copyright", "patent", "trademark"]),
    ("dispute_resolution", ["dispute", "arbitration", "mediation", "court"]),
    ("duration", ["duration", "term", "period", "months", "years"]),
    ("governing_law", ["governing", "jurisdiction", "legal"]),
]

# ---- fixed values: ordered substring rules, 12 labels then `other`
EVALUATION_RULES = [
    ("termination", ["terminate", "termination", "end"]),
    ("payment", ["payment", "pay", "invoice", "fee"]),
    ("liability", ["liability", "liable", "damages"]),
    ("confidentiality", ["confidential", "secret", "proprietary"]),
    ("intellectual_property", ["intellectual property", "copyright", "patent"]),
    ("dispute_resolution", ["dispute", "arbitration", "court"]),
    ("force_majeure", ["force majeure", "act of god"]),
    ("governing_law", ["governing law", "jurisdiction"]),
    ("duration", ["duration", "term", "lease period"]),
    ("internal_maintenance", ["maintenance", "repairs", "upkeep"]),
    ("additions_alterations", ["alterations", "modifications", "changes"]),
    ("assignment", ["assignment", "transfer", "assign"]),
]

# ---- fixed values: keywords that raise the confidence of a predicted label
CONFIDENCE_KEYWORDS = {
    "termination": ["terminate", "end", "expire", "cancel"],
    "payment": ["pay", "payment", "fee", "cost", "price", "invoice"],
    "liability": ["liable", "liability", "responsible", "damages"],
    "confidentiality": ["confidential", "non-disclosure", "secret", "proprietary"],
    "intellectual_property": ["intellectual", "property", "copyright", "patent", "trademark"],
    "dispute_resolution": ["dispute", "arbitration", "mediation", "court"],
    "duration": ["duration", "term", "period", "months", "years"],
    "governing_law": ["governing", "law", "jurisdiction", "legal"],
}

# ---- fixed values: dominant-label keywords (first label wins ties, `general` without hits)
DOMINANT_KEYWORDS = {
    "termination": ["terminate", "end", "expir", "cancel"],
    "payment": ["pay", "fee", "cost", "price", "amount"],
    "confidential": ["confidential", "secret", "private", "disclosure"],
    "liability": ["liable", "responsible", "damages", "loss"],
}

# ---- fixed values: legal terms whose share gives the density score
LEGAL_TERMS = [
    "contract", "agreement", "party", "parties", "shall", "hereby",
    "termination", "payment", "liability", "confidential", "breach",
    "clause", "provision", "obligation", "rights", "duties",
]

# ---- fixed values: confidence scales, highest first
CONFIDENCE_THRESHOLDS = [("HIGH", 0.9), ("MEDIUM", 0.7), ("LOW", 0.5)]
CONFIDENCE_SCALE_5 = [("VERY_HIGH", 0.9), ("HIGH", 0.8), ("MEDIUM", 0.7), ("LOW", 0.6)]
DENSITY_SCALE = [("VERY_HIGH", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.4), ("LOW", 0.2)]

# ---- fixed values: annotation file name -> label, first substring hit wins
FILE_NAME_LABELS = [
    ("Anti-assignment", "anti_assignment"),
    ("Audit Rights", "audit_rights"),
    ("Covenant not to Sue", "covenant_not_to_sue"),
    ("Dates", "dates"),
    ("Document Name", "document_name"),
    ("Governing Law", "governing_law"),
    ("Insurance", "insurance"),
    ("IP Ownership Assignment", "ip_ownership_assignment"),
    ("Joint IP Ownership", "joint_ip_ownership"),
    ("Licenses", "licenses"),
    ("Liquidated Damages", "liquidated_damages"),
    ("Minimum Commitment", "minimum_commitment"),
    ("Most Favored Nation", "most_favored_nation"),
    ("No-Solicit of Employees", "no_solicit_employees"),
    ("Non-Compete, Exclusivity, No-Solicit", "non_compete_exclusivity"),
]

# ---- fixed values: the 27 training labels
TRAINING_LABELS = [label for _, label in FILE_NAME_LABELS] + [
    "termination", "payment", "liability", "confidentiality", "intellectual_property",
    "dispute_resolution", "force_majeure", "duration", "internal_maintenance",
    "additions_alterations", "assignment", "other",
]

# ---- fixed values: wide annotation column -> label
WIDE_COLUMN_LABELS = [
    ("Termination", "termination"),
    ("Payment", "payment"),
    ("Liability", "liability"),
    ("Confidentiality", "confidentiality"),
    ("IP Ownership Assignment", "intellectual_property"),
    ("Dispute Resolution", "dispute_resolution"),
    ("Force Majeure", "force_majeure"),
    ("Governing Law", "governing_law"),
    ("Anti-Assignment", "assignment"),
]
