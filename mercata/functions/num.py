"""Numbers: decimal-safe means, half-even rounding, tolerant parsing."""

from pyspark.sql import Column, functions as F

from .text import col

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def half_even(c, places=2) -> Column:
    """Round half-even on the exact binary value.

    `round` works on the shortest decimal and `bround` scales first; only the
    formatter sees the stored value. The added zero turns -0.0 into 0.0.
    """
    pattern = "0." + "0" * places
    text = F.call_function("format_number", col(c), F.lit(pattern))
    return text.cast("double") + F.lit(0.0)


def exact_mean(c) -> Column:
    """Nearest double to the true mean of the values as written.

    Sum and division are decimal, so neither the order of the rows nor a
    retried task can move a mean across a rounding edge.
    """
    return (F.sum(col(c).cast("decimal(38,18)")) / F.count(col(c))).cast("double")


def number(c) -> Column:
    """Text to a finite double; anything else, booleans included, is null."""
    text = col(c).cast("string")
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def whole_number(c) -> Column:
    """Text to a long, only when the number has no fraction."""
    value = number(c)
    return F.when(value == F.floor(value), value.cast("long"))


def is_multiple(c, step, tolerance=1e-9) -> Column:
    """`c` is a multiple of `step`, up to float noise on the quotient."""
    q = col(c) / F.lit(step)
    r = F.rint(q)
    slack = F.greatest(F.abs(q), F.abs(r)) * F.lit(tolerance)
    return F.abs(q - r) <= F.greatest(slack, F.lit(tolerance))
