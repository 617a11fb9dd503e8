"""Key normalisation shared by joins on record identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK_ENDS = r"^[\s  -​　]+|[\s  -​　]+$"


def guid_key(col: Column | str) -> Column:
    """GUIDs compare without regard to letter case and surrounding blanks. Null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(col, _BLANK_ENDS, ""))


def is_blank(col: Column | str) -> Column:
    """True for null, empty and white-space-only values."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNull() | (F.regexp_replace(col, _BLANK_ENDS, "") == "")
