"""Row predicates on the weekly fact table.

OneFillCode is three-valued: 'Yes' is a one-fill gap, NULL is a denominator
gap, and any other value is neither.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pdcspark.schema import COMPLIANCE_CUTOFF, ONE_FILL, ONE_FILL_YES, PDC


def is_one_fill() -> Column:
    return F.col(ONE_FILL) == F.lit(ONE_FILL_YES)


def is_denominator_gap() -> Column:
    return F.col(ONE_FILL).isNull()


def is_eligible() -> Column:
    """Rows that enter PDC statistics: no one-fill code and a PDC value."""
    return F.col(ONE_FILL).isNull() & F.col(PDC).isNotNull()


def is_compliant(threshold: float = COMPLIANCE_CUTOFF) -> Column:
    """PDC at or above the cut-off (inclusive)."""
    return F.col(PDC) >= F.lit(threshold)


def is_non_compliant(threshold: float = COMPLIANCE_CUTOFF) -> Column:
    return F.col(PDC) < F.lit(threshold)
