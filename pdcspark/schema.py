"""Declared schema of the weekly adherence fact table and its fixed dimensions.

The fact table has one row per adherence gap per week.  Types are pinned here
once; every source conforms to them (``sources.weekly.conform``).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the weekly fact table.
DATA_AS_OF = "DataAsOfDate"
WEEK = "WeekOf"
GAP_ID = "UGID"
PATIENT_ID = "UPID"
MEASURE = "MedAdherenceMeasureCode"
MARKET = "MarketCode"
PAYER = "PayerCode"
ONE_FILL = "OneFillCode"
PDC = "PDCNbr"
DRUG = "NDCDesc"

WEEKLY_SCHEMA = T.StructType(
    [
        T.StructField(DATA_AS_OF, T.DateType(), True),
        T.StructField(WEEK, T.DateType(), True),
        T.StructField(GAP_ID, T.StringType(), True),
        T.StructField(PATIENT_ID, T.StringType(), True),
        T.StructField(MEASURE, T.StringType(), True),
        T.StructField(MARKET, T.StringType(), True),
        T.StructField(PAYER, T.StringType(), True),
        T.StructField(ONE_FILL, T.StringType(), True),
        T.StructField(PDC, T.DoubleType(), True),
        T.StructField(DRUG, T.StringType(), True),
    ]
)
WEEKLY_COLUMNS = tuple(f.name for f in WEEKLY_SCHEMA.fields)

# Derived column names used by the reports.
WEEK_NUMBER = "WeekNumber"
YEAR = "Year"
MONTH = "Month"
MONTH_DATE = "MonthDate"
MONTH_LABEL = "MonthLabel"
LABEL = "Measure"

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the dashboard's own constants for results to
# match: measure codes and display labels, CMS star thresholds per measure and
# star level, the 0.8 compliance cut-off, the one-fill marker, default counts,
# KPI card titles and compliance status labels.
# ---------------------------------------------------------------------------
STANDARD_MEASURES = ("MAC", "MAH", "MAD")
MEASURE_LABELS = {
    "MAC": "MAC (Cholesterol)",
    "MAH": "MAH (Hypertension)",
    "MAD": "MAD (Diabetes)",
}
STAR_THRESHOLDS = {
    "MAC": {2: 0.84, 3: 0.89, 4: 0.91, 5: 0.93},
    "MAH": {2: 0.84, 3: 0.88, 4: 0.91, 5: 0.93},
    "MAD": {2: 0.82, 3: 0.86, 4: 0.90, 5: 0.92},
}
DISPLAYED_STAR_LEVELS = (3, 4, 5)
COMPLIANCE_CUTOFF = 0.8
ONE_FILL_YES = "Yes"
DEFAULT_NUM_WEEKS = 12
DEFAULT_LOOKBACK_MONTHS = 6
HISTOGRAM_BINS = 20
KPI_TITLES = (
    "Total Gaps (UGIDs)",
    "Unique Patients (UPIDs)",
    "One-Fill Gaps",
    "Denominator Gaps",
)
COMPLIANT_STATUS = "Compliant (PDC ≥ 80%)"
NON_COMPLIANT_STATUS = "Non-Compliant (PDC < 80%)"
# ---------------------------------------------------------------------------

MEASURE_LABEL_SCHEMA = T.StructType(
    [
        T.StructField("MeasureCode", T.StringType(), False),
        T.StructField(LABEL, T.StringType(), False),
    ]
)
STAR_THRESHOLD_SCHEMA = T.StructType(
    [
        T.StructField(MEASURE, T.StringType(), False),
        T.StructField("Stars", T.IntegerType(), False),
        T.StructField("Threshold", T.DoubleType(), False),
    ]
)
