"""Date parsing. Anything that does not parse becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two date spellings found on article pages.
DAY_FIRST = r"(\d{1,2}/\d{1,2}/\d{4}),\s*(\d{1,2}:\d{2})"
DAY_FIRST_FORMAT = "d/M/yyyy H:m"
YEAR_FIRST = r"(\d{4}-\d{1,2}-\d{1,2})\s*(\d{1,2}:\d{2}:\d{2})"
YEAR_FIRST_FORMAT = "y-M-d H:m:s"


def _parse(text: Column, pattern: str, layout: str) -> Column:
    found = F.concat_ws(
        " ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    )
    return F.try_to_timestamp(found, F.lit(layout)).cast("timestamp_ntz")


def day_first_time(text: Column) -> Column:
    """``7/1/2025, 08:05`` anywhere in the text, as a time without zone."""
    return _parse(text, DAY_FIRST, DAY_FIRST_FORMAT)


def year_first_time(text: Column) -> Column:
    """``2025-1-7 8:05:09`` anywhere in the text, as a time without zone."""
    return _parse(text, YEAR_FIRST, YEAR_FIRST_FORMAT)


def published_at(text: Column) -> Column:
    """Either spelling."""
    return F.coalesce(day_first_time(text), year_first_time(text))


def tolerant_time(text: Column) -> Column:
    """Any spelling Spark's own cast reads; a bad value is NULL."""
    return text.try_cast("timestamp_ntz")
