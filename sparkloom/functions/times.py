"""Times that logs write in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A zone at the end of an ISO 8601 time (fixed value).
ZONE = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def parsed(c: str | Column) -> Column:
    """An ISO 8601 text as a time; one without zone is UTC whatever the session's zone is; null for what is no time."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    return F.when(whole.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.when(whole.rlike(ZONE), whole).otherwise(F.concat(whole, F.lit("+00:00"))).try_cast("timestamp"))


def parsed_or_epoch(c: str | Column) -> Column:
    """The same with the beginning of 1970 for what is no time, so that an audit log sorts it first."""
    return F.coalesce(parsed(c), F.timestamp_seconds(F.lit(0)))
