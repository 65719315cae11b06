"""Text functions on Unicode white space, the no-break spaces included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode White_Space code points; zero-width characters aren't among them.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """`col` without white space around it; null stays null."""
    return F.btrim(col, F.lit(WHITE))


def is_blank(col: Column) -> Column:
    """True for null, empty and white space only."""
    return col.isNull() | (F.length(strip(col)) == 0)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once for each row; inside a lambda a bare expression would be worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def accessions(cell: str) -> Column:
    """The different accessions of a cell, whatever its delimiters and quotes."""
    return F.array_distinct(F.regexp_extract_all(cell, F.lit(r"[A-Za-z0-9_-]+"), 0))
