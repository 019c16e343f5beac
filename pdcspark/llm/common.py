"""Shared pieces of the training-data operators: words, columns, lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pdcspark.session import storage_root

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The result no longer depends on lost executors or on earlier stages.  The
    files live as long as the shared folder's owner keeps them.
    """
    spark = df.sparkSession
    path = f"{storage_root(spark)}/pdcspark-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Recent:
    """Values by key, of the keys used last: what a worker has worked out and may need again.

    A generation takes what is needed; when it holds half of ``most``, it becomes
    the old one, and the one before it is forgotten.  What is used again moves
    to the young one, so frequent keys are never forgotten, whatever comes between.
    """

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def missing(self, needed: set) -> set:
        """The needed keys without a value; the others are in ``young`` then, where values are put and read."""
        absent = needed.difference(self.young)
        if len(self.young) + len(absent) > self.half:
            back = {k: self.old[k] for k in absent.intersection(self.old)}
            self.old, self.young = self.young, back
            absent = needed.difference(back)
        for key in absent.intersection(self.old):
            self.young[key] = self.old[key]
        return absent.difference(self.young)


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of ``text``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (Spark ignores case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small: a batch is held in memory at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
