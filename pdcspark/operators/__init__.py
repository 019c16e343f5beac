"""DataFrame -> DataFrame operators.  All lazy; compose with ``DataFrame.transform``."""

from pdcspark.operators.cube import (  # noqa: F401
    cube_compliance_rate,
    cube_compliance_split,
    cube_counts,
    cube_distribution,
    cube_histogram,
    cube_pdc_stats,
    cube_pdc_stats_table,
    weekly_cube,
)
from pdcspark.operators.detail import week_detail  # noqa: F401
from pdcspark.operators.filters import (  # noqa: F401
    apply_filters,
    by_codes,
    by_week,
    by_weeks,
    eligible,
    lookback,
    lookback_start,
)
from pdcspark.operators.kpi import (  # noqa: F401
    kpi_cards_of,
    kpi_change,
    kpi_change_all_weeks,
    kpi_changes_of,
    kpis_by_week,
    weekly_kpis,
)
from pdcspark.operators.measures import (  # noqa: F401
    measure_counts,
    measure_distribution,
    measure_distribution_complete,
)
from pdcspark.operators.members import distinct_members, member_bitmaps, member_ids  # noqa: F401
from pdcspark.operators.options import (  # noqa: F401
    code_table,
    distinct_codes,
    distinct_values,
    filter_options,
    options_from_codes,
)
from pdcspark.operators.order import (  # noqa: F401
    ORDERS,
    order_counts,
    order_detail,
    order_measures,
    order_options,
    order_segments,
    order_series,
    order_trend,
    ordered,
    ranked,
)
from pdcspark.operators.pdc import (  # noqa: F401
    compliance_rate,
    compliance_split,
    eligible_detail,
    pdc_histogram,
    pdc_stats,
    pdc_stats_table,
)
from pdcspark.operators.printed import (  # noqa: F401
    compliance_rate_text,
    kpi_cards_text,
    measure_counts_text,
    pdc_stats_text,
    record_count_text,
    segment_text,
    share_text,
    star_labels_text,
)
from pdcspark.operators.segments import (  # noqa: F401
    market_summary,
    payer_summary,
    segment_series,
    segment_summaries,
    segment_summary,
    series_of_summaries,
)
from pdcspark.operators.trend import (  # noqa: F401
    monthly_trend,
    monthly_trend_of,
    pdc_pivot,
    pdc_pivot_text,
    pivot_months,
    pivot_months_of,
    star_comparison,
    threshold_table,
    trend_input,
    trend_measures,
    trend_series,
    trend_with_thresholds,
)
from pdcspark.operators.weeks import (  # noqa: F401
    available_weeks,
    select_week,
    week_labels,
    week_positions,
)
