"""The weekly cube: one aggregate of the fact rows, from which the measure and PDC tables are read.

A cell is a week, a measure, a one-fill class, compliance and a histogram bin.
It holds its number of rows and the moments of their PDC, both mergeable, so
any set of weeks and measures has its distribution, statistics, histogram, split
and rate from cells alone: a few hundred for each week, whatever the data's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.functions.moments import mean_of, merged, moments, sample_std_of
from pdcspark.functions.predicates import is_compliant, is_denominator_gap, is_one_fill
from pdcspark.operators.measures import distribution_of_weights
from pdcspark.operators.pdc import bin_shares, histogram_bin, observed_or_standard, split_rows, stats_columns
from pdcspark.schema import COMPLIANCE_CUTOFF, HISTOGRAM_BINS, MEASURE, PDC, STANDARD_MEASURES, WEEK

ONE_FILL_CLASS = "OneFillClass"
ONE_FILL, DENOMINATOR, NEITHER = "one-fill", "denominator", "other"

CUBE_SCHEMA = T.StructType([
    T.StructField(WEEK, T.DateType(), True),
    T.StructField(MEASURE, T.StringType(), True),
    T.StructField(ONE_FILL_CLASS, T.StringType(), True),
    T.StructField("Compliant", T.BooleanType(), True),
    T.StructField("Bin", T.IntegerType(), True),
    T.StructField("Rows", T.LongType(), True),
    T.StructField("PdcCount", T.LongType(), True),
    T.StructField("PdcMean", T.DoubleType(), True),
    T.StructField("PdcM2", T.DoubleType(), True),
])


def weekly_cube(df: DataFrame, threshold: float = COMPLIANCE_CUTOFF, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """The cells of the rows.  Rows without a PDC value have NULL compliance and bin.

    NULL weeks and measures are cells of their own.  Partial aggregation leaves
    at most a cell's row for each task, so a hot week or measure costs nothing.
    """
    kind = F.when(is_one_fill(), F.lit(ONE_FILL)).when(is_denominator_gap(), F.lit(DENOMINATOR)).otherwise(F.lit(NEITHER))
    bin_ = F.when(F.col(PDC).isNotNull(), histogram_bin(bins))
    rows = df.select(WEEK, MEASURE, kind.alias(ONE_FILL_CLASS), is_compliant(threshold).alias("Compliant"), bin_.alias("Bin"), PDC)
    cells = rows.groupBy(WEEK, MEASURE, ONE_FILL_CLASS, "Compliant", "Bin").agg(
        F.count(F.lit(1)).alias("Rows"), moments(F.col(PDC)).alias("pdc"))
    return cells.select(
        WEEK, MEASURE, ONE_FILL_CLASS, "Compliant", "Bin", "Rows",
        F.col("pdc.n").alias("PdcCount"), F.col("pdc.mean").alias("PdcMean"), F.col("pdc.m2").alias("PdcM2"),
    )


def pdc_of_cell() -> Column:
    """A cell's moments as a struct."""
    return F.struct(F.col("PdcCount").alias("n"), F.col("PdcMean").alias("mean"), F.col("PdcM2").alias("m2"))


def is_eligible_cell() -> Column:
    """Cells whose rows enter PDC statistics."""
    return (F.col(ONE_FILL_CLASS) == DENOMINATOR) & (F.col("PdcCount") > 0)


def eligible_count() -> Column:
    """An aggregate: eligible rows."""
    return F.coalesce(F.sum(F.when(is_eligible_cell(), F.col("PdcCount"))), F.lit(0))


def compliant_count(compliant: bool = True) -> Column:
    """An aggregate: eligible rows at or above the cut-off (below it)."""
    fits = is_eligible_cell() & (F.col("Compliant") == F.lit(compliant))
    return F.coalesce(F.sum(F.when(fits, F.col("PdcCount"))), F.lit(0))


def class_count(kind: str) -> Column:
    """An aggregate: rows of a one-fill class."""
    return F.coalesce(F.sum(F.when(F.col(ONE_FILL_CLASS) == kind, F.col("Rows"))), F.lit(0))


def cube_counts(cube: DataFrame) -> DataFrame:
    """One row of the additive KPIs (rows, rows of each standard measure, one-fills, denominator gaps); zeros of no cells."""
    of_measure = [F.coalesce(F.sum(F.when(F.col(MEASURE) == c, F.col("Rows"))), F.lit(0)).alias(f"{c}Count") for c in STANDARD_MEASURES]
    return cube.agg(
        F.coalesce(F.sum("Rows"), F.lit(0)).alias("TotalGaps"), *of_measure,
        class_count(ONE_FILL).alias("OneFillCount"), class_count(DENOMINATOR).alias("DenominatorGapCount"),
    )


def cube_distribution(cube: DataFrame, fallback: bool = True, standard=STANDARD_MEASURES) -> DataFrame:
    """``measure_distribution`` of the cells' rows."""
    return distribution_of_weights(cube.select(MEASURE, F.col("Rows").alias("_w")), fallback, standard)


def _by_measure(cube: DataFrame, standard) -> DataFrame:
    """Moments, compliant rows and whether any row was seen, for each measure and the standard ones."""
    cells = cube.where(F.col(MEASURE).isNotNull()).withColumn("_obs", F.lit(1))
    seed = cube.sparkSession.createDataFrame([(c, 0) for c in standard], f"{MEASURE} string, _obs int")
    part = F.when(is_eligible_cell(), pdc_of_cell())  # collect_list passes NULL over
    return cells.unionByName(seed, allowMissingColumns=True).groupBy(MEASURE).agg(
        F.max("_obs").alias("_obs"), merged(part).alias("_pdc"), compliant_count().alias("_compliant"))


def _stats(by_measure: DataFrame) -> DataFrame:
    m = F.col("_pdc")
    rate = F.try_divide(F.col("_compliant").cast("double"), m["n"].cast("double"))
    return stats_columns(by_measure, m["n"], mean_of(m), sample_std_of(m), rate)


def cube_pdc_stats(cube: DataFrame, standard=STANDARD_MEASURES) -> DataFrame:
    """``pdc_stats`` of the cells: the standard measures and those with eligible rows."""
    found = _by_measure(cube, standard)
    return _stats(found.where((F.col("_pdc.n") > 0) | F.col(MEASURE).isin(list(standard))))


def cube_pdc_stats_table(cube: DataFrame, standard=STANDARD_MEASURES) -> DataFrame:
    """``pdc_stats_table`` of the cells: the observed measures, or the standard ones."""
    return _stats(observed_or_standard(_by_measure(cube, standard)))


def cube_compliance_split(cube: DataFrame) -> DataFrame:
    """``compliance_split`` of the cells (at the cube's cut-off)."""
    return split_rows(cube.agg(compliant_count().alias("c"), compliant_count(False).alias("n"), eligible_count().alias("total")))


def cube_compliance_rate(cube: DataFrame) -> DataFrame:
    """``compliance_rate`` of the cells (NULL without eligible rows)."""
    return cube.agg(F.try_divide(compliant_count().cast("double"), eligible_count().cast("double")).alias("ComplianceRate"))


def cube_histogram(cube: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``pdc_histogram`` of the cells; ``bins`` is the cube's."""
    counts = cube.where(is_eligible_cell() & F.col(MEASURE).isNotNull()).groupBy(MEASURE, "Bin").agg(F.sum("PdcCount").alias("Count"))
    return bin_shares(counts, bins)
