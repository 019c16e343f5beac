"""Sources and sinks: the weekly fact table, constant dimensions, report sinks."""

from pdcspark.sources.dimensions import measure_labels, star_thresholds  # noqa: F401
from pdcspark.sources.sinks import write_report  # noqa: F401
from pdcspark.sources.star import weekly_from_star_schema, weekly_from_tables  # noqa: F401
from pdcspark.sources.weekly import conform, load_weekly, write_weekly  # noqa: F401
