"""Upload limits, enumerations and report formats (fixed values)."""

# ---- fixed values: accepted MIME types and extraction routes
MIME_ROUTES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/msword": "docx",
    "text/plain": "txt",
    "image/jpeg": "image",
    "image/png": "image",
}
EXTENSION_ROUTES = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "txt", "jpg": "image", "jpeg": "image", "png": "image",
}
BATCH_MIME = "batch/multiple"

# ---- fixed values: size limits in bytes and characters
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_BATCH_BYTES = 200 * 1024 * 1024
MAX_BATCH_NAME = 255
FILE_TEXT_CHARS = 100_000
BATCH_TEXT_CHARS = 500_000
PREVIEW_CHARS = 10_000
MODEL_INPUT_CHARS = 512
MIN_ANALYSIS_CHARS = 50
BATCH_MARKER = "\n\n[Content truncated due to size limit]"

# ---- fixed values: error messages
ERR_MIME = "Only PDF, DOC, DOCX, TXT, JPG, and PNG files are allowed"
ERR_FILE_SIZE = "File size must be less than 50MB"
ERR_BATCH_SIZE = "Total batch size must be less than 200MB"
ERR_BATCH_NAME_LENGTH = "Batch name must be less than 255 characters"
ERR_BATCH_NAME_CHARS = "Batch name contains invalid characters"
ERR_NO_TEXT = "No text provided for analysis"
ERR_SHORT_TEXT = "Document text is too short for meaningful analysis"
ERR_NOT_EXTRACTED = "Document text not yet extracted. Please wait for text extraction to complete."
ERR_PROCESSING = "Document is already being processed"
ERR_UNSUPPORTED = "Unsupported file type"
ERR_EMPTY_FILE = "TXT file appears to be empty"
BATCH_NAME_FORBIDDEN = r'[<>:"/\\|?*]'

# ---- fixed values: separators of a merged batch
SEPARATOR = "--- Content from %s ---\n\n"
SEPARATOR_FAILED = "--- Content from %s (extraction failed) ---\n\n"
PLACEHOLDER_FAILED = "[Text extraction failed: %s]"
PLACEHOLDER_EMPTY = "[No readable text content found in %s]"
BATCH_CONTENT_MARK = "--- Content from"

# ---- fixed values: enumerations of the stored document
STATUSES = ["uploaded", "extracting", "processing", "completed", "error"]
RISK_LEVELS = ["low", "medium", "high"]
CLAUSE_RISK_LEVELS = ["LOW", "MEDIUM", "HIGH"]
PRIORITIES = ["low", "medium", "high", "critical"]
STORED_CLAUSE_TYPES = [
    "termination", "payment", "liability", "confidentiality", "intellectual_property",
    "dispute_resolution", "force_majeure", "governing_law", "amendment", "assignment",
    "severability", "entire_agreement", "duration", "internal_maintenance",
    "additions_alterations", "other",
]

STORED_MISSING_TYPES = [
    "termination", "payment", "liability", "confidentiality", "intellectual_property",
    "dispute_resolution", "force_majeure", "governing_law", "duration", "internal_maintenance",
    "additions_alterations",
]

# ---- fixed values: analysis version and display names
ANALYSIS_VERSION = "4.0-trust-safety"
SIZE_UNITS = ["Bytes", "KB", "MB", "GB"]
TYPE_DISPLAY = {
    "application/pdf": "PDF",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX",
    "application/msword": "DOC",
    "text/plain": "TXT",
    "image/jpeg": "JPG",
    "image/png": "PNG",
}

# ---- fixed values: fairness thresholds, metrics and messages
DISPARITY_THRESHOLD = 0.1
HIGH_DISPARITY = 0.2
MIN_GROUP_SAMPLES = 50
FAIRNESS_METRICS = ["accuracy", "f1_score", "precision", "recall"]
REC_POSITIVE = ("positive", "low", "No significant bias detected",
                "The model shows relatively fair performance across contract types.",
                "Continue monitoring with regular audits.")
REC_CRITICAL = ("critical", "high", "Critical bias issues detected",
                "Found %d high-severity bias issues requiring immediate attention.",
                "Review training data balance, consider data augmentation for underperforming contract types, "
                "and retrain model.")
REC_WARNING = ("warning", "medium", "Moderate bias issues detected",
               "Found %d medium-severity bias issues.",
               "Monitor closely and consider targeted improvements for affected contract types.")
REC_DATA = ("data", "medium", "Insufficient data for %s contracts",
            "Only %d samples available for %s contracts.",
            "Collect more training data for %s contracts to improve model performance.")
LOW_F1 = 0.85
MSG_LOW_F1 = "%s classification shows lower performance (F1: %s). Consider additional training data."
MSG_F1_OK = "All clause types show excellent performance above 85% F1-score."

# ---- fixed value: error of a batch whose files hold no readable text
ERR_NO_TEXT_IN_BATCH = "No text could be extracted from any of the uploaded files"
