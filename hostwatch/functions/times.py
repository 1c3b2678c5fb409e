"""Wall-clock and mixed-format time parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col

# Formats tried in order, day first.
TIMESTAMP_FORMATS = (
    "d/M/yyyy h:mm:ss a", "d/M/yyyy H:mm:ss", "d/M/yyyy h:mm a", "d/M/yyyy H:mm",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
)


def parse_timestamp(text: str | Column, formats=TIMESTAMP_FORMATS) -> Column:
    """First format that parses wins; NULL when none does."""
    text = F.trim(as_col(text))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def local_to_epoch(date: str | Column, hhmm: str | Column, offset_hours: int) -> Column:
    """Local date + HH:MM[:SS], shifted by the UTC offset, as epoch seconds."""
    parts = F.split(as_col(hhmm), ":")
    day = F.unix_date(F.to_date(as_col(date))).cast("long") * F.lit(86400)
    second = F.coalesce(F.get(parts, F.lit(2)).cast("long"), F.lit(0).cast("long"))
    return (day + parts[0].cast("long") * 3600 + parts[1].cast("long") * 60 + second
            + F.lit(int(offset_hours) * 3600))
