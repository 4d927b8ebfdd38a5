"""Display formatting of numbers with built-in functions.

``format_number`` rounds half-even on the number's decimal form, as the original's
formatter does; its thousands separators are taken out where none are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_point(x: Column, decimals: int, prefix: str = "", suffix: str = "", grouping: bool = False) -> Column:
    """``f"{prefix}{x:.{decimals}f}{suffix}"`` (``{x:,.Nf}`` with ``grouping``); null and NaN give null."""
    x = x.cast("double")
    body = F.format_number(x, decimals)
    body = body if grouping else F.translate(body, ",", "")
    return F.when(x.isNotNull() & ~F.isnan(x), F.concat(F.lit(prefix), body, F.lit(suffix)))


def thousands(x: Column, sep: str = ",") -> Column:
    """Integer with a thousands separator; null stays null."""
    s = F.format_number(x.cast("double"), 0)
    return s if sep == "," else F.translate(s, ",", sep)
