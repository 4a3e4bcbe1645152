"""Personal-data patterns, weights and messages (fixed values)."""

# ---- fixed values: configured patterns (name, pattern, token), case-insensitive, in detection order
CONFIGURED_PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    ("phone", r"(\+?1[-\.\s]?)?\$?([0-9]{3})\$?[-\.\s]?([0-9]{3})[-\.\s]?([0-9]{4})", "[PHONE]"),
    ("ssn", r"\b\d{3}-?\d{2}-?\d{4}\b", "[SSN]"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CREDIT_CARD]"),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP_ADDRESS]"),
]

# ---- fixed values: basic patterns (label, pattern, confidence), case-sensitive, in detection order
BASIC_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.9),
    ("PHONE", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", 0.9),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.9),
    ("CREDIT_CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", 0.9),
    ("PERSON", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", 0.8),
]

# ---- fixed values: sensitivity in tenths, other labels 5
SENSITIVITY = {
    "SSN": 1.0, "CREDIT_CARD": 1.0, "EMAIL": 0.7, "PHONE": 0.7, "PERSON": 0.8,
    "DATE": 0.3, "MONEY": 0.2, "ORGANIZATION": 0.4, "LOCATION": 0.5,
}
DEFAULT_SENSITIVITY = 0.5

# ---- fixed values: points deducted per span, other labels 1
DEDUCTIONS = {
    "SSN": -50, "CREDIT_CARD": -50, "EMAIL": -10, "PHONE": -10, "PERSON": -2, "LOCATION": -2,
    "ORG": -1, "ORGANIZATION": -1, "GPE": -1, "DATE": -1, "MONEY": -1,
}
DEFAULT_DEDUCTION = -1
DEDUCTION_SCALE = [("EXCELLENT", 80), ("GOOD", 60), ("FAIR", 40), ("POOR", 20)]

# ---- fixed values: compliance scale and the labels that need urgent redaction
COMPLIANCE_SCALE = [("HIGH", 0.9), ("MEDIUM", 0.7), ("LOW", 0.5)]
URGENT_LABELS = ["SSN", "CREDIT_CARD"]

# ---- fixed values: messages
MSG_NONE = "No PII detected. Document appears privacy-compliant."
MSG_FOUND = "Found %d PII entities that should be redacted."
MSG_CRITICAL = "CRITICAL: High PII density detected. Consider extensive redaction before sharing."
MSG_WARNING = "WARNING: Moderate PII risk. Review and redact sensitive information."
MSG_CAUTION = "CAUTION: Some PII detected. Consider redaction for external sharing."
MSG_URGENT = "URGENT: Highly sensitive information (SSN/Credit Card) detected. Immediate redaction required."
MSG_REVIEW = "Review detected entities before sharing."
