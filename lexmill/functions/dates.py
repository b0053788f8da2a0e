"""Dates as ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, formats) in the order in which they are tried; a find that isn't a date falls through to the next.
PATTERNS = [
    (r"(?i)\b(\d{4}-\d{1,2}-\d{1,2})(?!\d)", ["yyyy-M-d"]),
    (r"(?i)\b(\d{4}/\d{1,2}/\d{1,2})\b", ["yyyy/M/d"]),
    (r"(?i)\b(\d{1,2}/\d{1,2}/\d{4})\b", ["M/d/yyyy"]),
    (r"(?i)\b(\d{1,2}-\d{1,2}-\d{4})\b", ["M-d-yyyy"]),
    (r"(?i)\b([A-Za-z]+\.?\s+\d{1,2}(?:st|nd|rd|th)?[,]?\s+\d{4})\b", ["MMM d yyyy", "MMMM d yyyy"]),
    (r"(?i)\b(\d{1,2}\s+[A-Za-z]+\.?[,]?\s+\d{4})\b", ["d MMM yyyy", "d MMMM yyyy"]),
]


def norm_date(c: Column) -> Column:
    """ISO date of a text by its first reading that is a date, '' otherwise."""
    tries = []
    for pattern, formats in PATTERNS:
        v = F.regexp_replace(F.regexp_extract(c, pattern, 1), r"(?i)(\d)(st|nd|rd|th)\b", "$1")
        v = F.regexp_replace(F.regexp_replace(v, r"(?i)\bSept\b", "Sep"), r"[,.]", "")
        v = F.regexp_replace(v, r"\s+", " ")
        tries += [F.try_to_date(v, f) for f in formats]
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), F.lit(""))
