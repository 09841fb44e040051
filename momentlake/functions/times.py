"""Times: recording times, arrival stamps and media seconds as text."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from momentlake.errors import Refused

#: The tags that hold a recording's time, in order.
TIME_TAGS = ("com.apple.quicktime.creationdate", "creation_time", "date_recorded", "date")


def stamp(value: str | datetime | None, name: str = "time") -> str | None:
    """A time as ISO 8601 in UTC with milliseconds; without a zone it is taken as UTC."""
    if value is None:
        return None
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError:
            raise Refused(f"{name} is a date and time or ISO 8601, not {value!r}") from None
    value = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)
    return value.isoformat(timespec="milliseconds")


def iso_millis(ts: Column) -> Column:
    """A timestamp (session zone UTC) as ISO 8601 with milliseconds, as `stamp` gives it."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))


def recording_time(text: Column) -> Column:
    """A recording time as a timestamp; null for a date without a time of day and for anything in or before 1970."""
    t = F.trim(text)
    when = F.try_to_timestamp(t)
    return F.when(t.rlike(r"\d[T ]\d") & (F.year(when) > 1970), when)


def tagged_time(tags: Column) -> Column:
    """The first usable time among a map of tags, by the order of TIME_TAGS; names count without case."""
    low = F.transform_keys(tags, lambda k, _: F.lower(k))
    return F.coalesce(*[recording_time(F.element_at(low, F.lit(t))) for t in TIME_TAGS])
