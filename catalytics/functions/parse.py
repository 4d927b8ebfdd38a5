"""Cleaning scalars: dirty listing / variant text -> typed values.

Every function maps ``Column -> Column`` with built-in expressions only, so
parsing stays inside whole-stage codegen. Three price/sales dialects exist on
purpose (they disagree on some inputs); each is kept under its own name.

Spark specifics handled here:

* ANSI casts raise on bad text -> ``try_cast`` everywhere.
* ``try_cast`` to double accepts ``1.5d``, ``inf``, ``nan`` -> the text must
  first match a plain decimal number pattern.
* ``regexp_extract`` returns ``''`` on no match; ``try_cast('')`` is null.
* Java ``\\s``/``\\d``/``\\W`` are ASCII; ``(?U)`` gives Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# A plain decimal number as a Python float() call accepts it (no inf/nan),
# with surrounding white space; group 1 is the number itself.
_FLOAT_RE = r"(?U)^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"
_INT_RE = r"(?U)^\s*([+-]?[0-9]+)\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pystrip(x) -> Column:
    """Strip leading/trailing Unicode white space (``str.strip()``)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def to_double(x) -> Column:
    """``float(text)`` or null: one anchored match, then a cast ('' -> null)."""
    return F.regexp_extract(_c(x), _FLOAT_RE, 1).try_cast("double")


def to_long(x) -> Column:
    """``int(text)`` or null (white space around the digits is allowed)."""
    return F.regexp_extract(_c(x), _INT_RE, 1).try_cast("bigint")


def _is_sentinel(x, any_case: bool = False) -> Column:
    c = _c(x)
    if any_case:
        return c.isNull() | (F.lower(c) == F.lit(fixed.SENTINEL.lower()))
    return c.isNull() | (c == F.lit(fixed.SENTINEL))


# --- prices ---------------------------------------------------------------

def price_a(x) -> Column:
    """Drop ``MAD``, comma -> dot, strip, float; sentinel -> null."""
    body = F.replace(F.replace(_c(x), F.lit("MAD"), F.lit("")), F.lit(","), F.lit("."))
    return F.when(~_is_sentinel(x), to_double(body))


def price_b(x) -> Column:
    """Keep digits and dots only, float; ``n/a`` in any case -> null."""
    kept = F.regexp_replace(_c(x), r"[^0-9.]", "")
    return F.when(~_is_sentinel(x, any_case=True), to_double(kept))


def price_c(x) -> Column:
    """Same rule as P1 (numeric coercion of the cleaned text)."""
    return price_a(x)


def rating_a(x) -> Column:
    """Comma -> dot, float or null."""
    return F.when(~_is_sentinel(x), to_double(F.replace(_c(x), F.lit(","), F.lit("."))))


def rating_b(x) -> Column:
    """P5: float or null; a decimal comma is not accepted."""
    return F.when(~_is_sentinel(x, any_case=True), to_double(x))


# --- sales ----------------------------------------------------------------

def sales_a(x) -> Column:
    """First ``([\\d\\s,]+)\\s*vendus``; drop blanks and commas; int, else 0."""
    grp = F.regexp_extract(_c(x), r"(?U)([\d\s,]+)\s*vendus", 1)
    digits = F.translate(grp, " ,", "")
    return F.when(_is_sentinel(x), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(to_long(digits), F.lit(0).cast("bigint")))


def sales_b(x) -> Column:
    """Lower, drop blanks/commas, join all digit runs, x1000 if a ``k`` occurs; else 0."""
    s = F.translate(F.lower(_c(x)), " ,", "")
    digits = F.regexp_replace(s, r"[^0-9]", "")
    n = digits.try_cast("bigint")
    scaled = F.try_multiply(n, F.when(F.contains(s, F.lit("k")), F.lit(1000)).otherwise(F.lit(1)).cast("bigint"))
    return F.when(_is_sentinel(x, any_case=True), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(scaled, F.lit(0).cast("bigint")))


def sales_c(x) -> Column:
    """First run of digits/blanks/plus signs, non-digits removed; else null."""
    grp = F.regexp_extract(F.coalesce(_c(x), F.lit("nan")), r"(?U)([\d\s+]+)", 1)
    digits = F.regexp_replace(grp, r"[^0-9]", "")
    return digits.try_cast("bigint")


# --- discount, badges -----------------------------------------------------

def discount(x) -> Column:
    """First ``\\d+\\.?\\d*`` as float; sentinel or no match -> 0.0."""
    grp = F.regexp_extract(_c(x), r"([0-9]+\.?[0-9]*)", 1)
    return F.when(_is_sentinel(x), F.lit(0.0)).otherwise(F.coalesce(grp.try_cast("double"), F.lit(0.0)))


def derived_discount(original, price) -> Column:
    """P10: ``(orig - price) / orig * 100`` when ``orig > price`` and ``orig > 0``, else 0."""
    o, p = _c(original), _c(price)
    return F.coalesce(F.when((o > p) & (o > 0), (o - p) / o * F.lit(100.0)), F.lit(0.0))


def badge_flag(x, markers: list[str] | None = None) -> Column:
    """1 when the lower-case text contains a best-seller marker, else 0."""
    low = F.lower(_c(x))
    hit = F.lit(False)
    for m in (markers or fixed.BADGE_MARKERS):
        hit = hit | F.contains(low, F.lit(m))
    return F.coalesce(hit, F.lit(False)).cast("int")


# --- variant columns ------------------------------------------------------

def numeric(x) -> Column:
    """Numeric coercion (``to_numeric(errors='coerce')``)."""
    return to_double(x)


def timestamp(x) -> Column:
    """Timestamp or null for unparseable text."""
    return F.try_to_timestamp(_c(x))


def tri_bool(x) -> Column:
    """``true``/``false`` in any case; anything else -> null."""
    low = F.lower(_c(x))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def unknown_if_null(x, label: str = fixed.UNKNOWN_LABEL) -> Column:
    """Null category -> label."""
    return F.coalesce(_c(x), F.lit(label))


def availability_label(x) -> Column:
    """True -> available label, false -> unavailable label, null -> unknown."""
    c = _c(x)
    return (F.when(c, F.lit(fixed.AVAILABLE_LABEL))
            .when(~c, F.lit(fixed.UNAVAILABLE_LABEL))
            .otherwise(F.lit(fixed.UNKNOWN_LABEL)))


# --- links ----------------------------------------------------------------

def absolutise(x, base: str = fixed.MARKETPLACE_BASE, missing: str | None = fixed.SENTINEL) -> Column:
    """``//x`` -> ``https:x``; ``/x`` -> base + x; else as is; null -> sentinel."""
    c = _c(x)
    out = (F.when(c.startswith("//"), F.concat(F.lit("https:"), c))
           .when(c.startswith("/"), F.concat(F.lit(base), c))
           .otherwise(c))
    return F.coalesce(out, F.lit(missing)) if missing is not None else out


def store_endpoint(domain) -> Column:
    """``https://<authority>/products.json``; empty authority -> null."""
    auth = F.nullif(F.regexp_extract(_c(domain), r"^([^/?#]+)", 1), F.lit(""))
    return F.concat(F.lit("https://"), auth, F.lit("/products.json"))
