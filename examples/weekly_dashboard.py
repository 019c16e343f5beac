"""Compute and write every table of the dashboard page for one set of filters.

    python examples/weekly_dashboard.py /root/testdata/sf0.01 /tmp/out-XXXX [--as-of 2001-08-15]

Derives (once) the WeekOf-partitioned weekly table from the star schema, then
writes the weekly and trend report tables as parquet under the output folder.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pdcspark.plans.materialize import weekly_table  # noqa: E402
from pdcspark.plans.report import dashboard, write_reports  # noqa: E402
from pdcspark.session import local_session  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("sf_dir")
    ap.add_argument("out")
    ap.add_argument("--as-of", default=None, help="trend anchor date (default: today)")
    ap.add_argument("--position", type=int, default=0, help="week picker position, 0 = newest")
    ap.add_argument("--measures", nargs="*", default=None)
    ap.add_argument("--markets", nargs="*", default=None)
    ap.add_argument("--payers", nargs="*", default=None)
    args = ap.parse_args()

    spark = local_session()
    weekly = weekly_table(spark, args.sf_dir)
    reports = dashboard(weekly, args.position, args.measures, args.markets, args.payers,
                        as_of=args.as_of)
    for name in write_reports(reports, args.out):
        print(f"wrote {args.out}/{name}")
    spark.stop()


if __name__ == "__main__":
    main()
