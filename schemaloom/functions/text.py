"""Text functions on schema documents."""

from pyspark.sql import Column, functions as F


def canonical_json(raw: Column) -> Column:
    """Re-serialised JSON without blanks, key order kept; null if the text is not JSON."""
    whole = F.get_json_object(raw, "$")
    # '$' drops the quotes of a lone string
    lone_string = F.trim(raw).startswith('"')
    return F.when(whole.isNotNull() & lone_string, F.trim(raw)).otherwise(whole)


def fingerprint(content: Column) -> Column:
    """SHA-256 of the canonical text, in hex."""
    return F.sha2(content, 256)
