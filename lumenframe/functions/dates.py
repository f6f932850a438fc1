"""Date expressions; anything that can't be read gives null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXIF = EXIF_TEXT = "yyyy:MM:dd HH:mm:ss"


def exif_date(text: Column, modified: Column) -> Column:
    """The camera's date, or the file's, as EXIF text."""
    taken = F.try_to_timestamp(text, F.lit(EXIF))
    return F.date_format(F.coalesce(taken, F.timestamp_seconds(modified)), EXIF_TEXT)


def iso_date(text: Column) -> Column:
    """ISO 8601 creation time of a video (``Z`` or offset) as EXIF text in UTC."""
    return F.date_format(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")), EXIF_TEXT)


def backfill_year(year: Column, stored: Column, taken: Column) -> Column:
    """A missing year from stored metadata, then from the date's text."""
    return F.coalesce(F.nullif(year, F.lit(0)), stored, F.substring(taken, 1, 4).try_cast("int"))
