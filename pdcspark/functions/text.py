"""Text forms of report numbers (thousands separators, percents, decimals).

A double prints as correct rounding of its binary value has it, ties to even,
with the sign of a negative zero: the text Python and C write.  That takes two
steps.  Away from a tie, Spark's own ``format_string`` is right.  Near one,
``x * 10**d`` is compared with it exactly (the product of two doubles is the sum
of two), and what is printed is the neighbour on the right side.  Every helper
tests for NULL first.  The helpers name their argument many times, so give them
a column rather than an expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
_SPLIT = 134217729.0
#: Scaled values closer than this to a tie are compared with it exactly; far beyond any rounding error.
_NEAR = 1e-3


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _beside_tie(x: Column, scale: float) -> Column:
    """``x`` rounded to a multiple of 1 / scale, ties to even, as the double nearest to it."""
    size = F.abs(x)
    below = F.floor(size * F.lit(scale))
    split = size * F.lit(_SPLIT)
    high = split - (split - size)
    # Both products are exact, so is the first difference, and the sign of the sum.
    over = (high * F.lit(scale) - below - F.lit(0.5)) + (size - high) * F.lit(scale)
    up = F.signum(over) + F.lit(0.5) * (below % F.lit(2)) > 0  # above the tie, or on it and below is odd
    rounded = (below + up.cast("int")) / F.lit(scale)
    return F.when(x < 0, -rounded).otherwise(rounded)


def round_text(x: Column, decimals: int) -> Column:
    """``x`` rounded to ``decimals`` (0 to 6) places, as text ("86.7", "89", "-0.0")."""
    scale = float(10**decimals)
    x = x.cast("double")
    near = F.abs(F.abs(x) * F.lit(scale) % F.lit(1.0) - F.lit(0.5)) < F.lit(_NEAR)
    text = F.format_string(f"%.{decimals}f", F.when(near, _beside_tie(x, scale)).otherwise(x))
    infinite = F.abs(x) == float("inf")
    return F.when(F.isnan(x), F.lit("nan")).when(infinite, F.when(x < 0, F.lit("-inf")).otherwise(F.lit("inf"))).otherwise(text)


def thousands(c) -> Column:
    """Integer with thousands separators: 1234567 -> "1,234,567"."""
    x = _col(c)
    return F.when(x.isNotNull(), F.format_number(x, 0))


def percent_text(c, decimals: int = 1, scale: float = 100.0) -> Column:
    """Ratio as percent text: 0.8667 -> "86.7%".  scale=1 for values already in percent."""
    x = _col(c)
    v = x * F.lit(scale) if scale != 1 else x
    return F.when(x.isNotNull(), F.concat(round_text(v, decimals), F.lit("%")))


def fixed_text(c, decimals: int = 2) -> Column:
    """Fixed decimals: 0.8375 -> "0.84"."""
    x = _col(c)
    return F.when(x.isNotNull(), round_text(x, decimals))


def cell_percent(c, decimals: int = 1, missing: str = "-") -> Column:
    """Pivot cell: percent text, or a dash when there is no value."""
    return F.coalesce(percent_text(c, decimals), F.lit(missing))
