"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on DuckDB with the star-schema tables registered as views.
The weekly table is the FIXTURES.md derivation, embedded as a CTE.  Doubles
are rounded to 6 places, integers cast to the Spark result types, and
conditional counts use ``count(*) FILTER (...)`` (DuckDB's ``count_if`` is
NULL, not 0, over all-NULL input).
"""

from __future__ import annotations

from pdcspark.plans.catalog import (
    AS_OF,
    FILTER_MARKETS,
    FILTER_MEASURES,
    FILTER_PAYERS,
    LOOKBACK_MONTHS,
)
from pdcspark.schema import (
    COMPLIANT_STATUS,
    KPI_TITLES,
    MEASURE_LABELS,
    NON_COMPLIANT_STATUS,
    STAR_THRESHOLDS,
)

WEEKLY_SQL = """
SELECT CAST(l.l_shipdate AS DATE) AS DataAsOfDate,
  CAST(date_trunc('week', l.l_shipdate) AS DATE) AS WeekOf,
  concat('G', CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING)) AS UGID,
  concat('P', CAST(o.o_custkey AS STRING)) AS UPID,
  CASE WHEN l.l_linenumber <= 2 THEN 'MAC' WHEN l.l_linenumber <= 4 THEN 'MAH'
       WHEN l.l_linenumber <= 6 THEN 'MAD' WHEN l.l_tax > 0.01 THEN 'SUPD' END AS MedAdherenceMeasureCode,
  CASE WHEN r.r_regionkey = 4 AND l.l_tax = 0.0 THEN NULL ELSE r.r_name END AS MarketCode,
  CASE WHEN l.l_discount = 0.0 THEN NULL ELSE c.c_mktsegment END AS PayerCode,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'Yes'
       WHEN l.l_returnflag = 'R' AND l.l_quantity <= 10 THEN 'No' END AS OneFillCode,
  CASE WHEN l.l_quantity > 3 THEN (50 + l.l_quantity) / 100 END AS PDCNbr,
  p.p_name AS NDCDesc
FROM lineitem l
LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""

M = "MedAdherenceMeasureCode"
ELIG = "OneFillCode IS NULL AND PDCNbr IS NOT NULL"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _r(x: str, alias: str) -> str:
    return f"round({x}, 6) AS {alias}"


def _label(c: str = M) -> str:
    whens = " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in MEASURE_LABELS.items())
    return f"CASE {whens} ELSE {c} END"


def _round_text(x: str, d: int) -> str:
    return f"printf('%.{d}f', CAST({x} AS DOUBLE))"  # C's rounding of the binary value


def _pct_text(x: str, d: int = 1, scale: int = 100) -> str:
    v = f"round(CAST({x} AS DOUBLE), 10) * {scale}" if scale != 1 else f"round(CAST({x} AS DOUBLE), 10)"
    return f"CASE WHEN {x} IS NOT NULL THEN {_round_text(v, d)} || '%' END"


def _fixed_text(x: str, d: int) -> str:
    v = f"round(CAST({x} AS DOUBLE), 10)"
    return f"CASE WHEN {x} IS NOT NULL THEN {_round_text(v, d)} END"


def _thousands(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN format('{{:,}}', {x}) END"


def _week_number(c: str = "WeekOf") -> str:
    return f"CAST(strftime({c}, '%U') AS INTEGER)"


def _pct_change(cur: str, prev: str) -> str:
    return (
        f"CASE WHEN {prev} IS NULL THEN NULL WHEN {prev} = 0 THEN "
        f"CASE WHEN {cur} = 0 THEN 0.0 ELSE 100.0 END "
        f"ELSE CAST({cur} - {prev} AS DOUBLE) / {prev} * 100.0 END"
    )


def _stars_values(alias: str = "s", levels=(3, 4, 5)) -> str:
    rows = [
        f"('{m}', {s}, {t})" for m, by in STAR_THRESHOLDS.items() for s, t in by.items()
        if s in levels
    ]
    return "(VALUES " + ", ".join(rows) + f") AS {alias}({M}, Stars, Threshold)"


BASE = f"""
WITH weekly AS ({WEEKLY_SQL}),
latest AS (SELECT max(WeekOf) AS W FROM weekly),
prev AS (SELECT max(WeekOf) AS P FROM weekly WHERE WeekOf < (SELECT W FROM latest)),
wk AS (SELECT * FROM weekly WHERE WeekOf = (SELECT W FROM latest)),
top_weeks AS (SELECT DISTINCT WeekOf FROM weekly WHERE WeekOf IS NOT NULL
              ORDER BY WeekOf DESC LIMIT 12)
"""

TREND_AGG = f"""
  SELECT CAST(date_trunc('month', WeekOf) AS DATE) AS MonthDate, {M},
    count(DISTINCT UGID) AS TotalGaps,
    count(DISTINCT UPID) AS UniquePatients,
    count(*) FILTER (WHERE OneFillCode = 'Yes') AS OneFillCount,
    avg(CASE WHEN {ELIG} THEN PDCNbr END) AS AvgPDC,
    CAST(count(*) FILTER (WHERE PDCNbr >= 0.8 AND {ELIG}) AS DOUBLE)
      / NULLIF(count(*) FILTER (WHERE {ELIG}), 0) AS ComplianceRate
  FROM weekly
  WHERE WeekOf >= CAST(DATE '{AS_OF}' - INTERVAL {LOOKBACK_MONTHS} MONTH AS DATE) {{filters}}
  GROUP BY 1, 2
"""


def _trend_cte(filtered: bool = False, measures=None) -> str:
    filters = f"AND {M} IN {_in(measures)}" if measures else ""
    if filtered:
        filters = (
            f"AND {M} IN {_in(FILTER_MEASURES)} AND MarketCode IN {_in(FILTER_MARKETS)} "
            f"AND PayerCode IN {_in(FILTER_PAYERS)}"
        )
    return f""",
trend AS (
  SELECT CAST(month(MonthDate) AS INTEGER) AS Month, CAST(year(MonthDate) AS INTEGER) AS Year,
    strftime(MonthDate, '%b %Y') AS MonthLabel, MonthDate, {M},
    TotalGaps, UniquePatients, OneFillCount, AvgPDC, ComplianceRate
  FROM ({TREND_AGG.format(filters=filters)}) g
)
"""


TREND_COLS = (
    f"Month, Year, MonthLabel, MonthDate, {M}, TotalGaps, UniquePatients, OneFillCount, "
    f"{_r('AvgPDC', 'AvgPDC')}, {_r('ComplianceRate', 'ComplianceRate')}"
)

KPI_SELECT = f"""
  count(*) AS TotalGaps, count(DISTINCT UPID) AS UniquePatients,
  count(*) FILTER (WHERE {M} = 'MAC') AS MACCount,
  count(*) FILTER (WHERE {M} = 'MAH') AS MAHCount,
  count(*) FILTER (WHERE {M} = 'MAD') AS MADCount,
  count(*) FILTER (WHERE OneFillCode = 'Yes') AS OneFillCount,
  count(*) FILTER (WHERE OneFillCode IS NULL) AS DenominatorGapCount
"""

CARD_AGG = """
  count(*) AS TotalGaps, count(DISTINCT UPID) AS UniquePatients,
  count(*) FILTER (WHERE OneFillCode = 'Yes') AS OneFillCount,
  count(*) FILTER (WHERE OneFillCode IS NULL) AS DenominatorGapCount
"""
CARD_COLS = ("TotalGaps", "UniquePatients", "OneFillCount", "DenominatorGapCount")


def _cards_union(src: str, keys: str = "") -> str:
    parts = []
    for i, (title, c) in enumerate(zip(KPI_TITLES, CARD_COLS)):
        parts.append(
            f"SELECT {keys}{i} AS Card, '{title}' AS Metric, cur_{c} AS Current, "
            f"prev_{c} AS Previous FROM {src}"
        )
    return " UNION ALL ".join(parts)


KPI_CHANGE_CARDS = f""",
per AS (SELECT WeekOf, {CARD_AGG} FROM weekly
        WHERE WeekOf IN ((SELECT W FROM latest), (SELECT P FROM prev)) GROUP BY WeekOf),
wide AS (SELECT {", ".join(
    f"coalesce(max({c}) FILTER (WHERE WeekOf = (SELECT W FROM latest)), 0) AS cur_{c}, "
    f"coalesce(max({c}) FILTER (WHERE WeekOf = (SELECT P FROM prev)), 0) AS prev_{c}"
    for c in CARD_COLS)} FROM per),
cards AS ({_cards_union("wide")})
"""

def _pdc_stats(rows: str = "wk") -> str:
    return f""",
obs AS (SELECT {M}, count(PDCNbr) AS Count, avg(PDCNbr) AS a, stddev_samp(PDCNbr) AS s,
          avg(CASE WHEN PDCNbr >= 0.8 THEN 1.0 ELSE 0.0 END) AS r
        FROM {rows} WHERE {ELIG} AND {M} IS NOT NULL GROUP BY {M}),
codes AS (SELECT {M} FROM obs UNION SELECT * FROM (VALUES ('MAC'), ('MAH'), ('MAD')) v({M})),
stats AS (SELECT c.{M}, {_label("c." + M)} AS Measure, coalesce(o.Count, 0) AS Count,
            coalesce(o.a, 0.0) AS AvgPDC,
            CASE WHEN o.Count IS NULL THEN 0.0 ELSE o.s END AS StdPDC,
            coalesce(o.r, 0.0) AS ComplianceRate
          FROM codes c LEFT JOIN obs o ON c.{M} = o.{M})
"""


PDC_STATS = _pdc_stats()

SEGMENT_AGG = """
  count(UGID) AS TotalGaps, count(DISTINCT UPID) AS UniquePatients,
  count(*) FILTER (WHERE OneFillCode = 'Yes') AS OneFillCount,
  coalesce(avg(PDCNbr), 0.0) AS AvgPDC
"""

# Pivot columns must be spelled out in SQL.  The fixed AS_OF lookback yields
# Feb-Oct 2001 on every scale of the test data (it ends 2001-11-04); the Spark
# side derives its month list from the data and must agree.
PIVOT_MONTHS = [f"{m} 2001" for m in ("Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct")]


def _pivot_cells(fmt) -> str:
    return ", ".join(
        fmt(f"max(AvgPDC) FILTER (WHERE MonthLabel = '{m}')", m) for m in PIVOT_MONTHS
    )


def _star_level_cols() -> str:
    return ", ".join(
        f"{_pct_text(f'max(Threshold) FILTER (WHERE Stars = {s})', 0)} AS \"{s}-Star\""
        for s in (3, 4, 5)
    )


ORACLES: dict[str, str] = {
    "weekly_detail": BASE + f"""
SELECT DataAsOfDate, WeekOf, {_week_number()} AS WeekNumber, CAST(year(WeekOf) AS INTEGER) AS Year,
  UGID, UPID, {M}, MarketCode, PayerCode, OneFillCode, PDCNbr, NDCDesc FROM wk""",
    "available_weeks": BASE + f"""
SELECT WeekOf, {_week_number()} AS WeekNumber, CAST(year(WeekOf) AS INTEGER) AS Year
FROM top_weeks""",
    "week_labels": BASE + f"""
SELECT WeekOf,
  printf('Week %d, %d (Week of %s)', {_week_number()}, year(WeekOf), strftime(WeekOf, '%b %d, %Y'))
    AS WeekLabel,
  strftime(WeekOf, '%Y-%m-%d') AS WeekText
FROM top_weeks""",
    "previous_week": BASE + """
SELECT CAST(row_number() OVER (ORDER BY WeekOf DESC) - 1 AS INTEGER) AS Position, WeekOf,
  coalesce(lead(WeekOf) OVER (ORDER BY WeekOf DESC), WeekOf) AS PreviousWeekOf
FROM top_weeks""",
    "distinct_measures": BASE + f"SELECT DISTINCT {M} FROM weekly WHERE {M} IS NOT NULL",
    "distinct_markets": BASE + "SELECT DISTINCT MarketCode FROM weekly WHERE MarketCode IS NOT NULL",
    "distinct_payers": BASE + "SELECT DISTINCT PayerCode FROM weekly WHERE PayerCode IS NOT NULL",
    "filter_options": BASE + f"""
SELECT 'measure' AS Kind, {M} AS Value FROM weekly WHERE {M} IS NOT NULL
UNION SELECT 'market', MarketCode FROM weekly WHERE MarketCode IS NOT NULL
UNION SELECT 'payer', PayerCode FROM weekly WHERE PayerCode IS NOT NULL
UNION SELECT 'week', printf('Week %d, %d (Week of %s)', {_week_number()}, year(WeekOf),
  strftime(WeekOf, '%b %d, %Y')) FROM top_weeks""",
    "weekly_kpis": BASE + f"SELECT {KPI_SELECT} FROM wk",
    "weekly_kpis_filtered": BASE + f"""
SELECT {KPI_SELECT} FROM wk
WHERE {M} IN {_in(FILTER_MEASURES)} AND MarketCode IN {_in(FILTER_MARKETS)}
  AND PayerCode IN {_in(FILTER_PAYERS)}""",
    "empty_week": BASE + f"""
SELECT {KPI_SELECT} FROM weekly WHERE WeekOf = (SELECT W FROM latest) + 7""",
    "kpi_change": BASE + KPI_CHANGE_CARDS + f"""
SELECT Card, Metric, Current, Previous, {_r(_pct_change("Current", "Previous"), "PercentChange")}
FROM cards""",
    "kpi_change_all_weeks": BASE + f""",
per AS (SELECT WeekOf, {CARD_AGG} FROM weekly WHERE WeekOf IS NOT NULL GROUP BY WeekOf),
lagged AS (SELECT WeekOf, {", ".join(
    f"{c} AS cur_{c}, lag({c}) OVER (ORDER BY WeekOf) AS prev_{c}" for c in CARD_COLS)} FROM per),
cards AS ({_cards_union("lagged", keys="WeekOf, ")})
SELECT WeekOf, Card, Metric, Current, Previous,
  {_r(_pct_change("Current", "Previous"), "PercentChange")}
FROM cards""",
    "kpi_change_oldest_week": BASE + f""",
oldest AS (SELECT min(WeekOf) AS O FROM top_weeks),
per AS (SELECT {CARD_AGG} FROM weekly WHERE WeekOf = (SELECT O FROM oldest)),
wide AS (SELECT {", ".join(f"{c} AS cur_{c}, {c} AS prev_{c}" for c in CARD_COLS)} FROM per),
cards AS ({_cards_union("wide")})
SELECT Card, Metric, Current, Previous, {_r(_pct_change("Current", "Previous"), "PercentChange")}
FROM cards""",
    "kpis_by_week": BASE + f"""
SELECT WeekOf, {KPI_SELECT} FROM weekly WHERE WeekOf IS NOT NULL GROUP BY WeekOf""",
    "weekly_kpis_default_filters": BASE + f"""
SELECT {KPI_SELECT} FROM wk WHERE {M} IN (SELECT DISTINCT {M} FROM weekly WHERE {M} IS NOT NULL)""",
    "market_summary_filtered": BASE + f"""
SELECT MarketCode, {SEGMENT_AGG.replace("coalesce(avg(PDCNbr), 0.0) AS AvgPDC",
                                        "round(coalesce(avg(PDCNbr), 0.0), 6) AS AvgPDC")}
FROM wk WHERE MarketCode IS NOT NULL AND {M} IN {_in(FILTER_MEASURES)}
  AND MarketCode IN {_in(FILTER_MARKETS)} AND PayerCode IN {_in(FILTER_PAYERS)}
GROUP BY MarketCode""",
    "payer_summary_filtered": BASE + f"""
SELECT PayerCode, {SEGMENT_AGG.replace("coalesce(avg(PDCNbr), 0.0) AS AvgPDC",
                                       "round(coalesce(avg(PDCNbr), 0.0), 6) AS AvgPDC")}
FROM wk WHERE PayerCode IS NOT NULL AND PayerCode IN {_in(FILTER_PAYERS)}
GROUP BY PayerCode""",
    "weekly_kpis_text": BASE + KPI_CHANGE_CARDS + f"""
SELECT Card, Metric, {_thousands("Current")} AS CurrentText,
  {_pct_text(_pct_change("Current", "Previous"), 1, 1)} AS ChangeText
FROM cards""",
    "measure_distribution": BASE + f"""
, counts AS (SELECT {M}, count(*) AS Count FROM wk WHERE {M} IS NOT NULL GROUP BY {M})
SELECT {M}, {_label()} AS Measure, Count,
  {_r("Count * 100.0 / sum(Count) OVER ()", "Percent")}
FROM counts""",
    "measure_distribution_complete": BASE + f"""
, obs AS (SELECT {M}, count(*) AS n FROM wk WHERE {M} IN {_in(FILTER_MEASURES)} GROUP BY {M}),
codes AS (SELECT {M} FROM obs UNION SELECT * FROM (VALUES ('MAC'), ('MAH'), ('MAD')) v({M})),
counts AS (SELECT c.{M}, CAST(coalesce(o.n, 0) AS BIGINT) AS Count
           FROM codes c LEFT JOIN obs o ON c.{M} = o.{M})
SELECT {M}, {_label()} AS Measure, Count,
  {_r("CASE WHEN sum(Count) OVER () = 0 THEN NULL ELSE Count * 100.0 / sum(Count) OVER () END",
      "Percent")}
FROM counts""",
    "pdc_stats": BASE + PDC_STATS + f"""
SELECT {M}, Measure, Count, {_r("AvgPDC", "AvgPDC")}, {_r("StdPDC", "StdPDC")},
  {_r("ComplianceRate", "ComplianceRate")} FROM stats""",
    "pdc_stats_page": BASE + f""",
obs AS (SELECT {M}, count(CASE WHEN {ELIG} THEN PDCNbr END) AS n,
          avg(CASE WHEN {ELIG} THEN PDCNbr END) AS a,
          stddev_samp(CASE WHEN {ELIG} THEN PDCNbr END) AS s,
          avg(CASE WHEN {ELIG} THEN CASE WHEN PDCNbr >= 0.8 THEN 1.0 ELSE 0.0 END END) AS r
        FROM wk WHERE {M} IS NOT NULL GROUP BY {M}),
rows_ AS (SELECT * FROM obs
          UNION ALL SELECT c, 0, NULL, NULL, NULL FROM (VALUES ('MAC'), ('MAH'), ('MAD')) v(c)
          WHERE NOT EXISTS (SELECT 1 FROM obs))
SELECT {M}, {_label()} AS Measure, n AS Count,
  {_r("CASE WHEN n = 0 THEN 0.0 ELSE a END", "AvgPDC")},
  {_r("CASE WHEN n = 0 THEN 0.0 ELSE s END", "StdPDC")},
  {_r("CASE WHEN n = 0 THEN 0.0 ELSE r END", "ComplianceRate")}
FROM rows_""",
    "measure_distribution_empty_week": BASE + f"""
, wk2 AS (SELECT * FROM weekly WHERE WeekOf = (SELECT W FROM latest) + 7),
obs AS (SELECT {M}, count(*) AS Count FROM wk2 WHERE {M} IS NOT NULL GROUP BY {M}),
counts AS (SELECT * FROM obs UNION ALL
           SELECT c, CAST(0 AS BIGINT) FROM (VALUES ('MAC'), ('MAH'), ('MAD')) v(c)
           WHERE NOT EXISTS (SELECT 1 FROM obs))
SELECT {M}, {_label()} AS Measure, Count,
  {_r("CASE WHEN sum(Count) OVER () = 0 THEN NULL ELSE Count * 100.0 / sum(Count) OVER () END",
      "Percent")}
FROM counts""",
    "pdc_stats_text": BASE + PDC_STATS + f"""
SELECT {M}, Measure, {_thousands("Count")} AS CountText, {_fixed_text("AvgPDC", 2)} AS AvgText,
  {_fixed_text("StdPDC", 3)} AS StdText, {_pct_text("ComplianceRate", 1)} AS ComplianceText
FROM stats""",
    "compliance_split": BASE + f"""
, t AS (SELECT count(*) FILTER (WHERE PDCNbr >= 0.8) AS c, count(*) FILTER (WHERE PDCNbr < 0.8) AS n,
          count(*) AS total FROM wk WHERE {ELIG})
SELECT '{COMPLIANT_STATUS}' AS Status, c AS Count,
  {_r("CASE WHEN total = 0 THEN NULL ELSE c * 100.0 / total END", "Percent")} FROM t
UNION ALL
SELECT '{NON_COMPLIANT_STATUS}', n, {_r("CASE WHEN total = 0 THEN NULL ELSE n * 100.0 / total END", "Percent")}
FROM t""",
    "compliance_rate": BASE + f"""
SELECT {_r("CAST(count(*) FILTER (WHERE PDCNbr >= 0.8) AS DOUBLE) / NULLIF(count(*), 0)",
           "ComplianceRate")}
FROM wk WHERE {ELIG}""",
    "pdc_histogram": BASE + f"""
, b AS (SELECT {M}, CAST(least(greatest(floor(PDCNbr * 20), 0), 19) AS INTEGER) AS Bin
        FROM wk WHERE {ELIG} AND {M} IS NOT NULL),
c AS (SELECT {M}, Bin, count(*) AS Count FROM b GROUP BY {M}, Bin)
SELECT {M}, Bin, {_r("Bin / 20.0", "BinStart")}, {_r("(Bin + 1) / 20.0", "BinEnd")}, Count,
  {_r(f"Count * 100.0 / sum(Count) OVER (PARTITION BY {M})", "Percent")}
FROM c""",
    "pdc_histogram_out_of_range": BASE + f"""
, v AS (SELECT {M}, (PDCNbr - CAST(0.6 AS DOUBLE)) * CAST(3.0 AS DOUBLE) AS x FROM wk WHERE {ELIG} AND {M} IS NOT NULL),
b AS (SELECT {M}, CAST(CASE WHEN x < 0 THEN -1 WHEN x > 1 THEN 20 ELSE least(floor(x * 20), 19) END AS INTEGER) AS Bin FROM v),
c AS (SELECT {M}, Bin, count(*) AS Count FROM b GROUP BY {M}, Bin)
SELECT {M}, Bin, CASE WHEN Bin >= 0 THEN round(Bin / 20.0, 6) END AS BinStart,
  CASE WHEN Bin < 20 THEN round((Bin + 1) / 20.0, 6) END AS BinEnd, Count,
  {_r(f"Count * 100.0 / sum(Count) OVER (PARTITION BY {M})", "Percent")}
FROM c""",
    "pdc_stats_nan": BASE.replace("wk AS (SELECT * FROM weekly WHERE", "wk AS (SELECT * REPLACE (CASE WHEN PDCNbr > 0.95 THEN NULL ELSE PDCNbr END AS PDCNbr) FROM weekly WHERE") + PDC_STATS + f"""
SELECT {M}, Measure, Count, {_r("AvgPDC", "AvgPDC")}, {_r("StdPDC", "StdPDC")},
  {_r("ComplianceRate", "ComplianceRate")} FROM stats""",
    "segment_text": BASE + f"""
, s AS (SELECT 'MarketCode' AS Segment, MarketCode AS Code, {SEGMENT_AGG} FROM wk WHERE MarketCode IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'PayerCode', PayerCode, {SEGMENT_AGG} FROM wk WHERE PayerCode IS NOT NULL GROUP BY 2)
SELECT Segment, Code, {_thousands("TotalGaps")} AS TotalGaps, {_thousands("UniquePatients")} AS UniquePatients,
  {_thousands("OneFillCount")} AS OneFillCount, {_fixed_text("AvgPDC", 2)} AS AvgPDC FROM s""",
    "measure_counts_text": BASE + f"""
, c AS (SELECT {M}, count(*) AS n FROM wk WHERE {M} IS NOT NULL GROUP BY {M})
SELECT {_label()} AS Measure, {_thousands("n")} AS Count FROM c""",
    "compliance_rate_text": BASE + f"""
, r AS (SELECT CAST(count(*) FILTER (WHERE PDCNbr >= 0.8) AS DOUBLE) / NULLIF(count(*), 0) AS x FROM wk WHERE {ELIG})
SELECT {_pct_text("x")} AS ComplianceRate FROM r WHERE x IS NOT NULL""",
    "star_labels_text": BASE + _trend_cte() + f""",
cur AS (SELECT {M}, avg(AvgPDC) AS Current FROM trend WHERE {M} IS NOT NULL GROUP BY {M})
SELECT c.{M}, CAST(s.Stars AS INTEGER) AS Stars, {_pct_text("c.Current")} AS ValueText,
  CAST(s.Stars AS VARCHAR) || '\u2605: ' || {_pct_text("CAST(s.Threshold AS DOUBLE)", 0)} AS LevelText,
  {_label("c." + M)} || ' ' || CAST(s.Stars AS VARCHAR) || '\u2605 (' || {_pct_text("CAST(s.Threshold AS DOUBLE)", 0)} || ')' AS LineText
FROM cur c LEFT JOIN {_stars_values()} ON c.{M} = s.{M}""",
    "measure_distribution_ranked": BASE + f"""
, counts AS (SELECT {M}, count(*) AS Count FROM wk WHERE {M} IS NOT NULL GROUP BY {M})
SELECT {M}, {_label()} AS Measure, Count, {_r("Count * 100.0 / sum(Count) OVER ()", "Percent")},
  CAST(row_number() OVER (ORDER BY Count DESC, {M}) AS INTEGER) AS Place
FROM counts""",
    "monthly_trend_ranked": BASE + _trend_cte() + f"""
SELECT {TREND_COLS}, CAST(row_number() OVER (ORDER BY Year, Month, {M} NULLS FIRST) AS INTEGER) AS Place FROM trend""",
    "market_summary_ranked": BASE + f"""
SELECT MarketCode, {SEGMENT_AGG.replace("coalesce(avg(PDCNbr), 0.0) AS AvgPDC",
                                        "round(coalesce(avg(PDCNbr), 0.0), 6) AS AvgPDC")},
  CAST(row_number() OVER (ORDER BY MarketCode) AS INTEGER) AS Place
FROM wk WHERE MarketCode IS NOT NULL GROUP BY MarketCode""",
    "detail_newest_first": BASE + f"""
SELECT DataAsOfDate, WeekOf, {_week_number()} AS WeekNumber, CAST(year(WeekOf) AS INTEGER) AS Year,
  UGID, UPID, {M}, MarketCode, PayerCode, OneFillCode, PDCNbr, NDCDesc,
  CAST(dense_rank() OVER (ORDER BY WeekOf DESC) AS INTEGER) AS Place
FROM weekly WHERE WeekOf IN ((SELECT W FROM latest), (SELECT P FROM prev))""",
    "pdc_eligible_detail": BASE + f"SELECT WeekOf, UGID, UPID, {M}, PDCNbr FROM wk WHERE {ELIG}",
    "market_summary": BASE + f"""
SELECT MarketCode, {SEGMENT_AGG.replace("coalesce(avg(PDCNbr), 0.0) AS AvgPDC",
                                        "round(coalesce(avg(PDCNbr), 0.0), 6) AS AvgPDC")}
FROM wk WHERE MarketCode IS NOT NULL GROUP BY MarketCode""",
    "payer_summary": BASE + f"""
SELECT PayerCode, {SEGMENT_AGG.replace("coalesce(avg(PDCNbr), 0.0) AS AvgPDC",
                                       "round(coalesce(avg(PDCNbr), 0.0), 6) AS AvgPDC")}
FROM wk WHERE PayerCode IS NOT NULL GROUP BY PayerCode""",
    "segment_series": BASE + f"""
, m AS (SELECT MarketCode AS k, {SEGMENT_AGG} FROM wk WHERE MarketCode IS NOT NULL GROUP BY 1),
p AS (SELECT PayerCode AS k, {SEGMENT_AGG} FROM wk WHERE PayerCode IS NOT NULL GROUP BY 1)
SELECT 'market_gaps' AS Series, k AS Key, {_r("CAST(TotalGaps AS DOUBLE)", "Value")} FROM m
UNION ALL SELECT 'market_pdc', k, round(AvgPDC, 6) FROM m
UNION ALL SELECT 'payer_gaps', k, round(CAST(TotalGaps AS DOUBLE), 6) FROM p""",
    "monthly_trend": BASE + _trend_cte() + f"SELECT {TREND_COLS} FROM trend",
    "monthly_trend_filtered": BASE + _trend_cte(True) + f"SELECT {TREND_COLS} FROM trend",
    "trend_series": BASE + _trend_cte() + f"""
SELECT {M}, {_label()} AS Measure, MonthDate, MonthLabel, 'AvgPDC' AS Metric,
  {_r("AvgPDC", "Value")} FROM trend WHERE {M} IS NOT NULL
UNION ALL
SELECT {M}, {_label()}, MonthDate, MonthLabel, 'ComplianceRate', round(ComplianceRate, 6)
FROM trend WHERE {M} IS NOT NULL""",
    "trend_with_thresholds": BASE + _trend_cte() + f"""
SELECT t.MonthDate, t.MonthLabel, t.{M}, {_label("t." + M)} AS Measure,
  {_r("t.AvgPDC", "Value")}, CAST(s.Stars AS INTEGER) AS Stars,
  {_r("CAST(s.Threshold AS DOUBLE)", "Threshold")}
FROM trend t JOIN {_stars_values()} ON t.{M} = s.{M}""",
    "star_comparison": BASE + _trend_cte() + f""",
cur AS (SELECT {M}, avg(AvgPDC) AS Current, arg_min(MonthLabel, MonthDate) AS FirstMonth
        FROM trend WHERE {M} IS NOT NULL GROUP BY {M})
SELECT c.{M}, {_label("c." + M)} AS Measure, {_r("c.Current", "Current")}, c.FirstMonth,
  CAST(s.Stars AS INTEGER) AS Stars, {_r("CAST(s.Threshold AS DOUBLE)", "Threshold")},
  c.Current >= s.Threshold AS Meets
FROM cur c LEFT JOIN {_stars_values()} ON c.{M} = s.{M}""",
    "pdc_pivot": BASE + _trend_cte() + f"""
SELECT {M}, {_pivot_cells(lambda e, m: f'round({e}, 6) AS "{m}"')}
FROM trend WHERE {M} IS NOT NULL AND AvgPDC IS NOT NULL GROUP BY {M}""",
    "pdc_pivot_text": BASE + _trend_cte() + f"""
SELECT {_label()} AS Measure,
  {_pivot_cells(lambda e, m: f'coalesce({_pct_text(e, 1)}, {chr(39)}-{chr(39)}) AS "{m}"')}
FROM trend WHERE {M} IS NOT NULL AND AvgPDC IS NOT NULL GROUP BY {M}""",
    "threshold_table": BASE + _trend_cte() + f"""
SELECT {_label()} AS Measure, {_star_level_cols()}
FROM {_stars_values()}
WHERE EXISTS (SELECT 1 FROM trend)
GROUP BY {M}""",
    "trend_measures": BASE + _trend_cte() + f"""
SELECT DISTINCT {M}, CAST((SELECT count(DISTINCT MonthDate) FROM trend) AS INTEGER) AS NumMonths
FROM trend""",
}

# Queries of stored states give the same rows as those of the fact table.
ORACLES |= {f"{name}_cube": ORACLES[name] for name in (
    "measure_distribution", "pdc_stats", "pdc_histogram", "compliance_split", "compliance_rate")}
ORACLES |= {
    "kpi_change_stored": ORACLES["kpi_change"],
    "monthly_trend_stored": ORACLES["monthly_trend"],
    "pdc_stats_page_cube": ORACLES["pdc_stats_page"],
    "pdc_stats_all_weeks_cube": BASE + _pdc_stats("weekly") + f"""
SELECT {M}, Measure, Count, {_r("AvgPDC", "AvgPDC")}, {_r("StdPDC", "StdPDC")},
  {_r("ComplianceRate", "ComplianceRate")} FROM stats""",
    "monthly_trend_stored_filtered": BASE + _trend_cte(measures=FILTER_MEASURES) + f"SELECT {TREND_COLS} FROM trend",
    "distinct_members_all_weeks": BASE + f"""
SELECT {M}, count(DISTINCT UGID) AS TotalGaps, count(DISTINCT UPID) AS UniquePatients FROM weekly GROUP BY {M}""",
    "week_counts_cube": BASE + f"""
SELECT count(*) AS TotalGaps, {", ".join(f"count(*) FILTER (WHERE {M} = '{m}') AS {m}Count" for m in STAR_THRESHOLDS)},
  count(*) FILTER (WHERE OneFillCode = 'Yes') AS OneFillCount,
  count(*) FILTER (WHERE OneFillCode IS NULL) AS DenominatorGapCount FROM wk""",
    "week_cube": BASE + f"""
SELECT WeekOf, {M}, CASE WHEN OneFillCode = 'Yes' THEN 'one-fill' WHEN OneFillCode IS NULL THEN 'denominator' ELSE 'other' END
    AS OneFillClass, PDCNbr >= 0.8 AS Compliant,
  CAST(CASE WHEN PDCNbr < 0 THEN -1 WHEN PDCNbr > 1 THEN 20 WHEN PDCNbr IS NOT NULL THEN least(floor(PDCNbr * 20), 19) END
    AS INTEGER) AS Bin,
  count(*) AS Rows, count(PDCNbr) AS PdcCount, {_r("coalesce(avg(PDCNbr), 0.0)", "PdcMean")},
  {_r("coalesce(var_pop(PDCNbr) * count(PDCNbr), 0.0)", "PdcM2")}
FROM wk GROUP BY ALL""",
}

_SUMMARIES = f"""
, s AS (SELECT 'MarketCode' AS Segment, MarketCode AS Code, {SEGMENT_AGG} FROM wk WHERE MarketCode IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'PayerCode', PayerCode, {SEGMENT_AGG} FROM wk WHERE PayerCode IS NOT NULL GROUP BY 2)
"""


def _placed(query: str, order: str) -> str:
    """A query's rows with each row's place; the order is spelt here once more, apart from Spark's."""
    return f"SELECT *, CAST(rank() OVER (ORDER BY {order}) AS INTEGER) AS Place FROM ({ORACLES[query]})"


# Printed tables, reports and orders.
ORACLES |= {
    "segment_summaries": BASE + _SUMMARIES + f"""
SELECT Segment, Code, TotalGaps, UniquePatients, OneFillCount, {_r("AvgPDC", "AvgPDC")} FROM s""",
    "segment_series_of_summaries": ORACLES["segment_series"],
    "report_written": ORACLES["market_summary"],
    "trend_series_ranked": _placed("trend_series", f"{M}, Metric, MonthDate"),
    "payer_summary_ranked": _placed("payer_summary", "PayerCode"),
    "pdc_stats_ranked": _placed("pdc_stats", M),
    "filter_options_ranked": _placed("filter_options", "Kind, Value"),
    "pdc_stats_page_text": BASE + f""",
obs AS (SELECT {M}, count(CASE WHEN {ELIG} THEN PDCNbr END) AS n, avg(CASE WHEN {ELIG} THEN PDCNbr END) AS a,
          stddev_samp(CASE WHEN {ELIG} THEN PDCNbr END) AS s,
          avg(CASE WHEN {ELIG} THEN CASE WHEN PDCNbr >= 0.8 THEN 1.0 ELSE 0.0 END END) AS r
        FROM wk WHERE {M} IS NOT NULL GROUP BY {M}),
zeros AS (SELECT {M}, n, CASE WHEN n = 0 THEN 0.0 ELSE a END AS a, CASE WHEN n = 0 THEN 0.0 ELSE s END AS s,
            CASE WHEN n = 0 THEN 0.0 ELSE r END AS r FROM obs)
SELECT {M}, {_label()} AS Measure, {_thousands("n")} AS CountText, {_fixed_text("a", 2)} AS AvgText,
  {_fixed_text("s", 3)} AS StdText, {_pct_text("r", 1)} AS ComplianceText
FROM zeros""",
    "measure_shares_text": BASE + f"""
, c AS (SELECT {M}, count(*) AS n FROM wk WHERE {M} IS NOT NULL GROUP BY {M}),
p AS (SELECT {M}, CAST(n AS DOUBLE) * 100 / sum(n) OVER () AS p FROM c)
SELECT {_label()} AS Measure, {_pct_text("p", 1, 1)} AS Percent FROM p""",
    "compliance_shares_text": BASE + f"""
, t AS (SELECT count(*) FILTER (WHERE PDCNbr >= 0.8) AS c, count(*) FILTER (WHERE PDCNbr < 0.8) AS n,
          count(*) AS total FROM wk WHERE {ELIG}),
u AS (SELECT '{COMPLIANT_STATUS}' AS Status, CAST(c AS DOUBLE) * 100 / total AS p FROM t WHERE total > 0
      UNION ALL SELECT '{NON_COMPLIANT_STATUS}', CAST(n AS DOUBLE) * 100 / total FROM t WHERE total > 0)
SELECT Status, {_pct_text("p", 1, 1)} AS Percent FROM u""",
    "record_count_text": BASE + f"""
, c AS (SELECT count(*) AS n FROM wk) SELECT {_thousands("n")} AS Records FROM c WHERE n > 0""",
}
