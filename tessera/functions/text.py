"""Column helpers on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters taken for white space at the ends of names.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)


def stripped(c: Column | str) -> Column:
    """``c`` without white space at both ends; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def name_or_null(c: Column | str) -> Column:
    """A stripped name; null where nothing is left."""
    return F.nullif(stripped(c), F.lit(""))
