"""Exact mergeable distinct counts: bitmaps of numbered ids.

Every gap and patient id gets a number once.  A week's distinct ids of a measure
are bitmaps over the numbers, one for each bucket of 32,768; the distinct ids of
any set of weeks or measures are their union, bit by bit.  So a lookback reads
bitmaps and no ids, and counts exactly, where sums of weekly counts would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.schema import GAP_ID, MEASURE, PATIENT_ID, WEEK

KINDS = {"gap": GAP_ID, "patient": PATIENT_ID}

IDS_SCHEMA = T.StructType([
    T.StructField("Kind", T.StringType(), True),
    T.StructField("Id", T.StringType(), True),
    T.StructField("Number", T.LongType(), True),
])
FOUND_SCHEMA = T.StructType([
    T.StructField(WEEK, T.DateType(), True),
    T.StructField(MEASURE, T.StringType(), True),
    T.StructField("Kind", T.StringType(), True),
    T.StructField("Id", T.StringType(), True),
])
MEMBERS_SCHEMA = T.StructType([
    T.StructField(MEASURE, T.StringType(), True),
    T.StructField("Kind", T.StringType(), True),
    T.StructField("Bucket", T.LongType(), True),
    T.StructField("Bits", T.BinaryType(), True),
    T.StructField(WEEK, T.DateType(), True),
])


def member_ids(df: DataFrame) -> DataFrame:
    """(WeekOf, measure, Kind, Id): the distinct ids of each week and measure; NULL ids aren't any.

    A row becomes one for each kind of id.  The distinct runs partially in each
    task, so an id with a third of all rows is a row for each week and measure.
    """
    pairs = ", ".join(f"'{k}', `{c}`" for k, c in KINDS.items())
    rows = df.select(WEEK, MEASURE, F.expr(f"stack({len(KINDS)}, {pairs}) AS (Kind, Id)"))
    return rows.where(F.col("Id").isNotNull()).distinct()


def unnumbered(members: DataFrame, ids: DataFrame) -> DataFrame:
    """(Kind, Id, FirstWeek) of the members that have no number yet."""
    first = members.groupBy("Id", "Kind").agg(F.min(WEEK).alias("FirstWeek"))
    return first.join(ids, ["Id", "Kind"], "left_anti").select("Kind", "Id", "FirstWeek")


def placed(new: DataFrame) -> DataFrame:
    """(Kind, Id, Place): a place that tells the task and the row within it, in order of kind and first week.

    Ids of one week get neighbouring places, so its bitmaps are few and full.
    Write the result before ``numbered`` reads it: places follow the tasks.
    """
    rows = new.repartitionByRange("Kind", "FirstWeek", "Id").sortWithinPartitions("Kind", "FirstWeek", "Id")
    return rows.select("Kind", "Id", F.monotonically_increasing_id().alias("Place"))


def numbered(stored: DataFrame, after: int) -> DataFrame:
    """(Kind, Id, Number): the stored places as numbers without gaps, from ``after`` + 1 on.

    Only a row count for each task that wrote them reaches the driver.
    """
    task = F.shiftright("Place", 33)
    sizes = sorted(tuple(r) for r in stored.groupBy(task.alias("Task")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], int(after)
    for of, n in sizes:
        starts.append((of, total))
        total += n
    first = stored.sparkSession.createDataFrame(starts, "Task long, Start long")
    rows = stored.withColumn("Task", task).join(F.broadcast(first), "Task")  # a row for each writing task
    within = F.col("Place") - F.shiftleft(F.col("Task"), 33)
    return rows.select("Kind", "Id", (F.col("Start") + within + 1).alias("Number"))


def member_bitmaps(members: DataFrame, ids: DataFrame) -> DataFrame:
    """(measure, Kind, Bucket, Bits, WeekOf): the numbers of each week's and measure's ids as bitmaps.

    The numbers are moved, each once, and a bitmap is made where all of its
    numbers are: at most 32,768.  Bitmaps made before the shuffle would be nearly
    empty, a task's ids being of any number, and as many as tasks times buckets.
    Keys of many values come first: what is sorted by them compares few others.
    """
    n = F.col("Number")
    bucket = ["Bucket", WEEK, MEASURE, "Kind"]
    numbers = members.join(ids, ["Id", "Kind"]).select(
        WEEK, MEASURE, "Kind", F.bitmap_bucket_number(n).alias("Bucket"), F.bitmap_bit_position(n).alias("Position"))
    return (
        numbers.repartition(*bucket)
        .groupBy(*bucket)
        .agg(F.bitmap_construct_agg("Position").alias("Bits"))
        .select(*[f.name for f in MEMBERS_SCHEMA.fields])
    )


def distinct_members(bitmaps: DataFrame, *keys: Column) -> DataFrame:
    """(keys, TotalGaps, UniquePatients): the distinct ids of each group, exactly.

    Bitmaps of one bucket are united in each task before they are moved, so a
    group of any number of weeks and rows sends one for each bucket and task.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    buckets = bitmaps.groupBy(*(k.alias(n) for k, n in zip(keys, names, strict=True)), "Kind", "Bucket")
    united = buckets.agg(F.bitmap_count(F.bitmap_or_agg("Bits")).alias("n"))

    def of_kind(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("Kind") == kind, F.col("n"))), F.lit(0))

    return united.groupBy(*names).agg(of_kind("gap").alias("TotalGaps"), of_kind("patient").alias("UniquePatients"))
