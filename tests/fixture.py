"""The 14-row hand fixture (FIXTURES.md section 3)."""

import datetime as dt

from pdcspark.schema import WEEKLY_SCHEMA

D = dt.date
ROWS = [
    # WeekOf, UGID, UPID, Measure, Market, Payer, OneFill, PDC
    (D(2025, 7, 7), "G1", "P1", "MAC", "TX", "AET", None, 0.80),
    (D(2025, 7, 7), "G1", "P1", "MAC", "TX", "AET", None, 0.80),
    (D(2025, 7, 7), "G2", "P1", "MAH", "TX", "HUM", None, 0.79),
    (D(2025, 7, 7), "G3", "P2", "MAC", "FL", "AET", "Yes", 0.95),
    (D(2025, 7, 7), "G4", "P3", "MAD", None, "AET", None, None),
    (D(2025, 7, 7), "G5", "P4", "SUPD", "FL", None, "No", 0.50),
    (D(2025, 7, 7), "G6", None, None, "FL", "HUM", None, 0.90),
    (D(2025, 7, 7), None, "P5", "MAC", "FL", "HUM", None, 1.00),
    (D(2025, 6, 23), "G1", "P1", "MAC", "TX", "AET", None, 0.70),
    (D(2025, 6, 23), "G2", "P1", "MAH", "TX", "HUM", "Yes", None),
    (D(2025, 6, 9), "G2", "P1", "MAH", "TX", "HUM", None, 0.90),
    (D(2025, 6, 2), "G7", "P6", "MAC", "TX", "AET", None, 0.85),
    (D(2025, 1, 6), "G8", "P7", "MAC", "TX", "AET", None, 0.99),
    (None, "G9", "P8", "MAC", "TX", "AET", None, 0.88),
]


def hand_fixture(spark):
    full = [(r[0], r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], None) for r in ROWS]
    return spark.createDataFrame(full, WEEKLY_SCHEMA)
