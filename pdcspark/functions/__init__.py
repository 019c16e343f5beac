"""Column-expression helpers (all built-in Spark functions, no UDFs)."""

from pdcspark.functions.calendar import (  # noqa: F401
    date_text,
    month_label,
    month_start,
    week_label,
    week_number,
    week_start,
)
from pdcspark.functions.numeric import percent_change, share_percent  # noqa: F401
from pdcspark.functions.predicates import (  # noqa: F401
    is_compliant,
    is_denominator_gap,
    is_eligible,
    is_non_compliant,
    is_one_fill,
)
from pdcspark.functions.labels import measure_label  # noqa: F401
from pdcspark.functions.text import (  # noqa: F401
    cell_percent,
    fixed_text,
    percent_text,
    thousands,
)
