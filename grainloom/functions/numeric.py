"""Numbers and vectors as columns (M01-M09, P25-P27, V01-V03 parts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors between units.
UNIT_FACTORS = {("kJ", "kcal"): 1 / 4.184, ("IU", "ug"): 1 / 40, ("mg", "g"): 1 / 1000, ("ug", "mg"): 1 / 1000, ("g", "g"): 1.0}


def known(c: Column) -> Column:
    """Null instead of NaN."""
    return F.when(F.isnan(c), None).otherwise(c)


def finite_or_zero(c: Column) -> Column:
    """P25."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def covered(c: Column) -> Column:
    """Finite and not negative."""
    return F.coalesce(~F.isnan(c) & (c < float("inf")) & (c >= 0), F.lit(False))


def whole_id(c: Column) -> Column:
    """An integral id as text; null for blanks, booleans and fractions."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"^[0-9]+(\.0+)?$"), F.regexp_replace(s, r"\.0+$", ""))


def required_id(c: Column) -> Column:
    """An integral id as text; blanks, booleans and fractions raise when they are read."""
    return F.coalesce(whole_id(c), F.raise_error(F.concat(F.lit("no whole id: "), F.coalesce(c.cast("string"), F.lit("null")))))


def tolerant_int(c: Column) -> Column:
    """0 where it cannot be read."""
    return F.coalesce(known(c.cast("string").try_cast("double")).cast("long"), F.lit(0).cast("long"))


def convert(c: Column, have: str, want: str) -> Column:
    """M07."""
    return c * UNIT_FACTORS[have, want]


def close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-9) -> Column:
    """M05."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def log_term(p: Column) -> Column:
    """Ln with a floor."""
    return F.ln(F.greatest(p, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    """M03, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Column) -> Column:
    """Divided by its length, at least 1e-12."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
