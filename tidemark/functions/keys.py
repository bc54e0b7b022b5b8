"""Column expressions for untidy keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def ref_key(c: Column | str) -> Column:
    """A reference as it compares: trimmed, lower case; blank and null are null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c.cast("string"), F.lit(BLANKS))), F.lit(""))


def label_key(c: Column | str) -> Column:
    """A status-like label as it compares: trimmed, upper case; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.btrim(c.cast("string"), F.lit(BLANKS)))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def e4(c: Column | str) -> Column:
    """A decimal as whole ten-thousandths."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("decimal(19,4)") * F.lit(10000)).cast("long")
