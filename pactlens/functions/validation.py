"""Validation of uploads and stored rows, routes and display fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.fixed import documents as D
from pactlens.functions.text import drop_nulls, level_of, lookup, strip


def checked(error: Column) -> Column:
    """struct<is_valid,error> of an error column that is NULL when all is well."""
    return F.struct(error.isNull().alias("is_valid"), error.alias("error"))


def mime_error(mime: Column) -> Column:
    return F.when(~F.coalesce(mime.isin(list(D.MIME_ROUTES)), F.lit(False)), F.lit(D.ERR_MIME))


def validate_mime(mime: Column) -> Column:
    """Allow-list of six MIME types (B1)."""
    return checked(mime_error(mime))


def size_error(size: Column) -> Column:
    return F.when(size > D.MAX_FILE_BYTES, F.lit(D.ERR_FILE_SIZE))


def validate_file_size(size: Column) -> Column:
    """At most 50 MiB (B2)."""
    return checked(size_error(size))


def batch_size_error(total: Column) -> Column:
    return F.when(total > D.MAX_BATCH_BYTES, F.lit(D.ERR_BATCH_SIZE))


def validate_batch_name(name: Column) -> Column:
    """Optional, at most 255 characters, none of the forbidden ones."""
    return checked(
        F.when(F.coalesce(name, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.length(name) > D.MAX_BATCH_NAME, F.lit(D.ERR_BATCH_NAME_LENGTH))
        .when(name.rlike(D.BATCH_NAME_FORBIDDEN), F.lit(D.ERR_BATCH_NAME_CHARS))
    )


def file_error(name: Column, mime: Column, size: Column) -> Column:
    """`name: reason` of the first failed check, type before size; NULL for a valid file."""
    reason = F.coalesce(mime_error(mime), size_error(size))
    return F.when(reason.isNotNull(), F.concat(name, F.lit(": "), reason))


def analysis_gate(text: Column, status: Column | None = None) -> Column:
    """Why a text cannot be analysed, NULL when it can.

    With the status of the stored document its own checks come first: text still missing, or
    analysis already running.
    """
    given = F.coalesce(text, F.lit(""))
    blank = strip(given) == ""
    if status is None:
        gate = F.when(blank, F.lit(D.ERR_NO_TEXT))
    else:
        gate = (
            F.when(given == "", F.lit(D.ERR_NOT_EXTRACTED))
            .when(status == "processing", F.lit(D.ERR_PROCESSING))
            .when(blank, F.lit(D.ERR_NO_TEXT))
        )
    return gate.when(F.length(text) < D.MIN_ANALYSIS_CHARS, F.lit(D.ERR_SHORT_TEXT))


def extraction_route(mime: Column, file_name: Column | None = None) -> Column:
    """pdf, docx, txt, image or unsupported, by MIME type, else by extension (A2)."""
    by_mime = lookup(D.MIME_ROUTES, mime, None)
    if file_name is None:
        return F.coalesce(by_mime, F.lit("unsupported"))
    extension = F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(by_mime, lookup(D.EXTENSION_ROUTES, extension, None), F.lit("unsupported"))


def label_from_filename(file_name: Column, mapping=C.FILE_NAME_LABELS) -> Column:
    """Label of the first name part found in the file name, else `other` (A5)."""
    chain = None
    for part, label in mapping:
        chain = (F.when if chain is None else chain.when)(F.contains(file_name, F.lit(part)), F.lit(label))
    return chain.otherwise(F.lit("other"))


def _not_in(column: Column, allowed, rule: str) -> Column:
    return F.when(column.isNotNull() & ~column.isin(list(allowed)), F.lit(rule))


def _outside(column: Column, low, high, rule: str) -> Column:
    bad = column < low if high is None else (column < low) | (column > high)
    return F.when(bad, F.lit(rule))


def _longer(column: Column, limit: int, rule: str) -> Column:
    return F.when(F.length(column) > limit, F.lit(rule))


def _any_entry(column: Column, bad: Callable[[Column], Column], rule: str) -> Column:
    return F.when(F.exists(column, bad), F.lit(rule))


def document_violations(d: dict[str, Column]) -> Column:
    """array<string> of broken rules of a stored document (B6); rules of absent columns are left out."""
    rules = {
        "batch_name": lambda c: [_longer(c, 255, "batch_name.length")],
        "filename": lambda c: [F.when(c.isNull(), F.lit("filename.required")), _longer(c, 2000, "filename.length")],
        "original_name": lambda c: [
            F.when(c.isNull(), F.lit("original_name.required")), _longer(c, 2000, "original_name.length")],
        "file_size": lambda c: [
            F.when(c.isNull(), F.lit("file_size.required")), _outside(c, 0, D.MAX_BATCH_BYTES, "file_size.range")],
        "mime": lambda c: [
            F.when(c.isNull(), F.lit("mime.required")), _not_in(c, [*D.MIME_ROUTES, D.BATCH_MIME], "mime.enum")],
        "status": lambda c: [_not_in(c, D.STATUSES, "status.enum")],
        "text": lambda c: [_longer(c, 1_000_000, "text.length")],
        "risk_score": lambda c: [_outside(c, 1, 10, "risk_score.range")],
        "risk_level": lambda c: [_not_in(c, D.RISK_LEVELS, "risk_level.enum")],
        "summary": lambda c: [_longer(c, 1000, "summary.length")],
        "missing_clauses": lambda c: [
            _any_entry(c, lambda x: ~x.isin(D.STORED_MISSING_TYPES), "missing_clauses.enum")],
        "recommendations": lambda c: [_any_entry(c, lambda x: F.length(x) > 500, "recommendations.length")],
        "error_message": lambda c: [_longer(c, 500, "error_message.length")],
        "tags": lambda c: [_any_entry(c, lambda x: F.length(x) > 50, "tags.length")],
    }
    return drop_nulls(*[check for name, make in rules.items() if name in d for check in make(d[name])])


def clause_violations(c: dict[str, Column]) -> Column:
    """array<string> of broken rules of a stored clause."""
    rules = {
        "type": lambda x: [
            F.when(x.isNull(), F.lit("type.required")), _not_in(x, D.STORED_CLAUSE_TYPES, "type.enum")],
        "content": lambda x: [F.when(x.isNull(), F.lit("content.required")), _longer(x, 5000, "content.length")],
        "text": lambda x: [F.when(x.isNull(), F.lit("text.required")), _longer(x, 5000, "text.length")],
        "risk_factors": lambda x: [_any_entry(x, lambda f: F.length(f) > 200, "risk_factors.length")],
        "suggestions": lambda x: [_any_entry(x, lambda f: F.length(f) > 500, "suggestions.length")],
        "start": lambda x: [_outside(x, 0, None, "start.range")],
        "end": lambda x: [_outside(x, 0, None, "end.range")],
        "confidence": lambda x: [_outside(x, 0, 1, "confidence.range")],
        "risk_score": lambda x: [_outside(x, 1, 10, "risk_score.range")],
        "risk_level": lambda x: [_not_in(x, D.CLAUSE_RISK_LEVELS, "risk_level.enum")],
        "suggestion": lambda x: [_longer(x, 500, "suggestion.length")],
        "justification": lambda x: [_longer(x, 500, "justification.length")],
        "source_file": lambda x: [_longer(x, 255, "source_file.length")],
        "priority": lambda x: [_not_in(x, D.PRIORITIES, "priority.enum")],
    }
    return drop_nulls(*[check for name, make in rules.items() if name in c for check in make(c[name])])


def type_display_name(clause_type: Column) -> Column:
    """Title case of a type name: first letters raised, the rest kept."""
    return F.array_join(
        F.transform(
            F.split(clause_type, "_", -1),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
        ),
        " ",
    )


def file_size_display(size: Column) -> Column:
    """Size with two decimals at most and its unit."""
    chain = F.when(size == 0, F.lit("0 Bytes"))
    for i, unit in enumerate(D.SIZE_UNITS):
        shown = F.floor(size / float(1024 ** i) * 100 + 0.5) / 100.0
        text = F.concat(F.regexp_replace(shown.cast("string"), r"\.0$", ""), F.lit(f" {unit}"))
        chain = chain.when(size < 1024 ** (i + 1), text)
    return chain.otherwise(text)


def document_display_name(mime: Column, batch_name: Column, original_name: Column) -> Column:
    """Batch name for batches that have one, else the original name."""
    return F.when((mime == D.BATCH_MIME) & (F.coalesce(batch_name, F.lit("")) != ""), batch_name).otherwise(original_name)


def file_type_display(mime: Column, file_count: Column) -> Column:
    return F.when(
        mime == D.BATCH_MIME,
        F.concat(F.lit("Batch ("), F.coalesce(file_count, F.lit(1)).cast("string"), F.lit(" files)")),
    ).otherwise(lookup(D.TYPE_DISPLAY, mime, "Document"))


def first_files(names: Column, shown: int = 3) -> Column:
    """First three file names and how many more."""
    more = F.size(names) - shown
    return F.concat(
        F.array_join(F.slice(names, 1, shown), ", "),
        F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")),
    )


def metric_band(value: Column) -> Column:
    """Band of a metric on the evaluation page."""
    return level_of(value, [("excellent", 0.9), ("good", 0.8), ("fair", 0.7)], "poor")


def audit_band(value: Column) -> Column:
    """Band of an F1 score on the audit page."""
    return level_of(value, [("excellent", 0.95), ("good", 0.9), ("fair", 0.85)], "poor")
