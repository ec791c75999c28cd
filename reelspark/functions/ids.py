"""Identifier rules shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that may stand around an id: space, tab, line ends, no-break and ideographic space.
BLANKS = " \t\n\r\u00a0\u3000"


def clean_id(c: Column | str) -> Column:
    """The id without outer blanks, in lower case; null for a null or blank one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def clean_label(c: Column | str) -> Column:
    """A source or language label: trimmed, lower case, ``-`` read as ``_``; null if blank."""
    return F.translate(clean_id(c), "-", "_")
