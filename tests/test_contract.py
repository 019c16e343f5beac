"""The driver contract: bench.py prints one JSON line with the required keys."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF0001


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF0001, BENCH_RUNS="1", BENCH_CPUS="2",
               BENCH_QUERIES="weekly_kpis,monthly_trend")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                         capture_output=True, text=True, timeout=600, check=True)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["failed"] == {}
    assert set(d["queries"]) == {"weekly_kpis", "monthly_trend"}
    assert d["value"] == round(sum(d["queries"].values()), 3)
