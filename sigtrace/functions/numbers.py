"""Numbers written as text in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spaces, tabs, line ends and no-break blanks around a value.
_EDGE = r"^[\s ]+|[\s ]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def number_text(c: Column) -> Column:
    """One text per number: ``" 0x1F"``, ``"031"`` and ``"31.0"`` all give ``"31"``.

    Null and blank text give null. Text that is no number keeps its own
    identity as ``"text:..."``, so that different garbage stays different.
    Hexadecimal values of up to 31 significant digits are converted exactly.
    """
    t = F.lower(trimmed(c.cast("string")))
    digits = F.regexp_replace(t, r"^0x0*(?=[0-9a-f])", "")
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    high = F.conv(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 16, F.lit(0))), 16, 10)
    low = F.conv(F.substring(digits, F.greatest(F.length(digits) - 15, F.lit(1)), F.lit(16)), 16, 10)
    wide = (high.cast("decimal(18,0)") * two64 + low.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    dec = t.try_cast("decimal(38,9)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(dec, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(c.cast("string").rlike(r"^(0|[1-9][0-9]*)$"), c.cast("string"))  # most values need no more
        .when(t.isNull() | (t == ""), None)
        .when(t.rlike(r"^\+?[0-9]+$"), F.regexp_replace(t, r"^\+?0*(?=[0-9])", ""))
        .when(t.rlike(r"^0x[0-9a-f]+$") & (F.length(digits) <= 16), F.conv(digits, 16, 10))
        .when(t.rlike(r"^0x[0-9a-f]+$") & (F.length(digits) <= 31), wide)
        .when(t.rlike(r"^0x[0-9a-f]+$"), F.concat(F.lit("0x"), digits))
        .when(dec.isNotNull(), F.when(plain == "-0", "0").otherwise(plain))
        .otherwise(F.concat(F.lit("text:"), t))
    )


def number(c: Column) -> Column:
    """The same as an exact DECIMAL(38,9), null where the text is no number (or beyond 29 digits)."""
    return number_text(c).try_cast("decimal(38,9)")


def exact_time(c: Column) -> Column:
    """Seconds as DECIMAL(38,18), null where ``c`` is null or no number."""
    return trimmed(c.cast("string")).try_cast("decimal(38,18)")
