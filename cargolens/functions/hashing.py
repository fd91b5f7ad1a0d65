"""Fingerprints of issues, learned examples and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(text: Column) -> Column:
    """A JSON string literal, or null as the word null.

    Control characters below space are removed first: their escapes differ
    between JSON writers, so they may not take part in a fingerprint.
    """
    body = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for char, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(shown))
    # most texts hold nothing to replace
    body = F.when(text.rlike(r'[\x00-\x1f"\\]'), body).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def issue_fingerprint(code: Column, severity: Column, message: Column, case_number: Column, path: Column) -> Column:
    """SHA-256 of the compact JSON of an issue with its keys in alphabetical order."""
    parts = [
        ("case_number", case_number),
        ("code", code),
        ("field_path", path),
        ("message", message),
        ("severity", severity),
    ]
    pieces = []
    for i, (name, value) in enumerate(parts):
        pieces += [F.lit(("," if i else "{") + f'"{name}":'), json_text(value)]
    return F.sha2(F.concat(*pieces, F.lit("}")).cast("binary"), 256)


def example_fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 over the parts joined by a bar; null counts as empty."""
    return F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256), F.lit(16))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
