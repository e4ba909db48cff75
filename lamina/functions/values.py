"""Normalisers and small scalar functions, all built from JVM expressions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Spaces trimmed, and blank made null; inner white space stays."""
    return F.nullif(F.trim(c), F.lit(""))


def category(c: Column) -> Column:
    return F.lower(text(c))


def instant(c: Column) -> Column:
    """Text to timestamp in the session's zone; null where it is none."""
    return F.try_to_timestamp(c)


def small_int(c: Column) -> Column:
    """To int; null where it doesn't fit, so that one record can't fail a load."""
    return c.try_cast("int")


def length(c: Column) -> Column:
    """Elements of an array; null for null."""
    return F.array_size(c)


def json_text(payload: Column, path: str) -> Column:
    """The value at a dotted path as text; null where it is missing or the JSON is broken."""
    return F.get_json_object(payload, "$." + path)


def decode_source(directory: Column) -> Column:
    """owner__name to owner/name: only the first separator, and only after an owner without underscore."""
    return F.regexp_replace(directory, r"^([^_]+)__", "$1/")


def encode_source(source: str) -> str:
    return source.replace("/", "__")


def decode_source_name(directory: str) -> str:
    """decode_source for one Python string."""
    owner, mark, name = directory.partition("__")
    return f"{owner}/{name}" if mark and owner and "_" not in owner else directory


def iso(c: Column) -> Column:
    """A timestamp as UTC text to the second (the session's zone must be UTC)."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_text(at: datetime | None) -> str | None:
    """A Python datetime as UTC text to the second; naive ones are UTC."""
    if at is None:
        return None
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_iso(value: str | None) -> datetime | None:
    """ISO text to an aware datetime; naive ones are UTC, and anything else is None."""
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00")) if value else None
    except (ValueError, AttributeError):
        return None
    return at if at is None or at.tzinfo else at.replace(tzinfo=timezone.utc)


def nested(record: object, path: str) -> object:
    """The value at a dotted path of nested dicts; None where a step is no dict or missing."""
    for step in path.split("."):
        if not isinstance(record, dict):
            return None
        record = record.get(step)
    return record


def surrogate_key(*parts: Column) -> Column:
    """Deterministic key of a dimension row: a hash of its natural key and validity."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
