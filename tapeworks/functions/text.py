"""Text, hashing and JSON column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "∅"


def or_blank(*choices: Column) -> Column:
    """The first choice that is neither NULL nor blank, trimmed."""
    trimmed = [F.trim(c) for c in choices]
    return F.coalesce(*[F.when(c != "", c) for c in trimmed])


def row_hash(columns: Iterable[Column]) -> Column:
    """128-bit hex digest of a row in which NULL keeps its place."""
    parts = [F.coalesce(c.cast("string"), F.lit(NULL_MARK)) for c in columns]
    return F.md5(F.concat_ws("||", *parts))


def json_or(default: str, text: Column) -> Column:
    """JSON column text, with a default for NULL or empty."""
    return F.coalesce(F.when(text != "", text), F.lit(default))


def json_record(*columns) -> Column:
    """A record as JSON text: NULL fields kept, dates and timestamps in the plain text forms."""
    options = {
        "timestampFormat": "yyyy-MM-dd HH:mm:ss",
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
        "dateFormat": "yyyy-MM-dd",
        "ignoreNullFields": "false",
    }
    return F.to_json(F.struct(*columns), options)


def number(text: Column, kind: str) -> Column:
    """Number text to ``kind``; text that is no number gives NULL."""
    if kind in ("int", "bigint"):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)
