"""Column expressions shared by the layers.  All are built-in functions, inside whole-stage code generation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"


#: White space that is stripped.  A trim costs in proportion to the length of this set.
WHITE = " \t\n\x0b\x0c\r\x85\xa0"


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at both ends; null counts as empty.  A trim by a set of characters looks at
    the ends alone, where a pattern would scan the text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c, F.lit("")), F.lit(WHITE))


def lenient_double(c: Column) -> Column:
    """A number, or null if the text is none; NaN and infinities stay what they are.  The pattern keeps out forms that
    only some engines read, such as ``1.0d`` and ``1_000``."""
    text = strip(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def lenient_long(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def lenient_timestamp(c: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss as a zone-less timestamp, null otherwise: one explicit format."""
    text = strip(c)
    return F.when(text.rlike(_ISO), text.try_cast("timestamp_ntz"))


def lenient_date(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def ntz(value: dt.datetime) -> Column:
    """A zone-less timestamp; a datetime literal would pass through the zones of Python and of the session."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def is_true(c: Column) -> Column:
    """TRUE for ``true`` in any case, FALSE for all else and null."""
    return F.lower(strip(c)) == "true"


def finite(c: Column) -> Column:
    """Never null: whether the number is there, no NaN and no infinity."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def flag(c: Column) -> Column:
    """A predicate with null as FALSE."""
    return F.coalesce(c, F.lit(False))


def count_if(c: Column) -> Column:
    """Rows for which the predicate holds; 0 for none."""
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def codes(pairs: list[tuple[str, str]]) -> Column:
    """Comma-joined codes of the flags that hold, in the order given."""
    return F.concat_ws(",", *[F.when(F.col(name), F.lit(code)) for name, code in pairs])
