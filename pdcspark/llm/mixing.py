"""Mixing sources to target weights with hash-threshold histograms.

Every row has a fixed hash of 60 bits.  An epoch of a source takes the rows
whose hash is under a threshold; a source that gives more than it holds has a
full first epoch, so the thresholds are nested.  The threshold for a budget of
tokens is found without sorting rows: tokens are summed by source and leading
hash digits, the one bucket in which the running sum passes the budget is cut
into finer buckets, and so on to the last digits.  A histogram has at most
``2 ** BITS`` rows a source, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdcspark.llm.common import cut, n_words, text_or_empty, unused

HASH_BITS, BITS = 60, 12
WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MOST_EPOCHS = 150, 2


def row_hash(id_col: Column, text_col: Column) -> Column:
    """The leading 60 bits of MD5 of the id, or of the text where the id is null."""
    key = F.coalesce(id_col.cast("string"), F.concat(F.lit("text:"), text_or_empty(text_col)))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) one row a source -> the same with ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn.  They
    share ``share_percent`` of all sizes by weight, none beyond ``most_epochs``
    times its size: by rising ratio of that limit to the weight, the first
    source whose limit exceeds what its share of the rest comes to, and all
    after it, get their share; those before it get their limits.  Sums are of
    integers, so the targets are the same on every run.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.cast("long").alias("w"), (F.lit(most_epochs) * F.col("source_size")).alias("limit"))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    # In hundredths, to stay with integers.
    w = w.withColumns({
        "left": F.sum("source_size").over(everything) * share_percent - F.coalesce(F.sum("limit").over(before), F.lit(0)) * 100,
        "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    is_open = F.col("left") * F.col("w") < F.col("limit") * F.col("w_left") * 100
    so_far = rising.rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("first", F.first(F.when(is_open, F.struct("left", "w_left")), ignorenulls=True).over(so_far))
    share = (F.col("first.left") * F.col("w")) / (F.col("first.w_left") * 100)
    return w.select("source", "source_size", F.coalesce(share, F.col("limit").cast("double")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, size, hash) rows and (source, budget) -> (source, threshold, inclusive).

    Rows with ``hash < threshold``, or ``<=`` where ``inclusive``, hold tokens
    near the budget: the value at which the running sum passes it goes to the
    side that is nearer.  Rows of one hash stay together.
    """
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    for depth in range(BITS, HASH_BITS + 1, BITS):
        inside = sized.alias("s").join(state.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.shiftright("s.hash", HASH_BITS - depth + BITS) == F.col("b.prefix")))
        histogram = inside.groupBy(F.col("s.source").alias("source"), F.shiftright("s.hash", HASH_BITS - depth).alias("bucket")).agg(F.sum("s.size").alias("n"), F.first("b.rest").alias("rest"))
        through = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        passing = histogram.withColumn("through", through).where(F.col("through") > F.col("rest"))
        least = F.min(F.struct("bucket", "n", "through", "rest")).alias("b")
        state = passing.groupBy("source").agg(least).select("source", F.col("b.bucket").alias("prefix"), (F.col("b.rest") - (F.col("b.through") - F.col("b.n"))).alias("rest"), F.col("b.n").alias("n"))
        state = cut(state, f"boundary{depth}")
    return state.select("source", F.col("prefix").alias("threshold"), (F.col("n") - F.col("rest") <= F.col("rest")).alias("inclusive"))


def plan(sized: DataFrame) -> DataFrame:
    """(source, size, hash) rows -> one row a source: source_size, target, epochs, threshold, inclusive."""
    aims = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    aims = aims.withColumn("epochs", whole)
    budgets = aims.select("source", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))
    limits = thresholds(sized, budgets)
    both = aims.alias("a").join(limits.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")), "left")
    return cut(both.select("a.*", "t.threshold", "t.inclusive"), "plan")


def copies(row_hash: Column, epochs: Column, threshold: Column, inclusive: Column) -> Column:
    """How often the mix takes a row: the full epochs, and one more under the threshold."""
    under = (row_hash < threshold) | (inclusive & (row_hash == threshold))
    return epochs + F.coalesce(under, F.lit(False)).cast("int")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        row_hash(F.col(id_col), F.col(text_col)).alias("hash"),
    ), "sized")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: (id, size, source_size, target, taken).

    ``size`` is the row's number of words, 0 for a null or blank text.  Null is
    a source of its own, in the last place.  ``taken`` is 0, 1 or 2 times the
    size.  Rows of equal id fall on the same side of a threshold; so do rows
    with null ids and equal texts.  An empty table gives an empty result, and
    one without a word takes nothing.  Other columns are not read.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    joined = sized.alias("s").join(plan(sized).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    times = copies(*map(F.col, ("s.hash", "p.epochs", "p.threshold", "p.inclusive")))
    return joined.select(F.col("s.id").alias(id_col), "s.size", "p.source_size", "p.target", (F.col("s.size") * times).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``; one taken twice comes twice.

    The decisions and edge cases are those of ``mix_sizes``; a row without a
    word follows its hash like the others.
    """
    names = {c: unused(f"mix_{c}", docs.columns) for c in ("hash", "source", "epochs", "threshold", "inclusive", "copy")}
    of_source = plan(_sized(docs, id_col, text_col, source_col)).select(*(F.col(c).alias(names[c]) for c in ("source", "epochs", "threshold", "inclusive")))
    hashed = docs.withColumn(names["hash"], row_hash(F.col(id_col), F.col(text_col)))
    joined = hashed.join(of_source, F.col(source_col).cast("string").eqNullSafe(F.col(names["source"])))
    times = copies(*(F.col(names[c]) for c in ("hash", "epochs", "threshold", "inclusive")))
    repeated = joined.where(times > 0).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), times)))
    return repeated.select(*docs.columns)
