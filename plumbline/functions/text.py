"""Text expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(c: Column | str) -> Column:
    """Clean form of an id: blanks and tabs at both ends removed, everything up
    to and including the last ``/`` removed, upper case. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""), r"^.*/", ""))


def words(c: Column | str) -> Column:
    """Maximal runs of letters or digits of the lower-cased text; null gives null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
