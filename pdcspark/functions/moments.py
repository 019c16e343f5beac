"""Mergeable moments: count, mean and the sum of squared deviations (M2) of a value.

Moments of disjoint rows merge by the parallel variance rule, so means and
standard deviations of any union come from stored parts, without their rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = ("n", 0, "long"), ("mean", 0.0, "double"), ("m2", 0.0, "double")


def moments(value: Column) -> Column:
    """The moments of an aggregate's rows, as a struct (n, mean, m2); nulls don't count."""
    n = F.count(value)
    return F.struct(
        n.alias("n"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(value) * n, F.lit(0.0)).alias("m2"),
    )


def no_moments() -> Column:
    """The moments of no rows."""
    return F.struct(*(F.lit(v).cast(t).alias(name) for name, v, t in _NONE))


def merged(parts: Column) -> Column:
    """An aggregate: the moments of the union of the group's parts.

    A group gathers its parts, which stand for whole groups of rows (say one
    for each week and bin), never rows.  They are merged in order of their
    values, so the result doesn't depend on how they arrive.
    """

    def add(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = F.try_divide(b["n"].cast("double"), n.cast("double"))
        both = F.struct(
            n.alias("n"),
            (a["mean"] + apart * share).alias("mean"),
            (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"),
        )
        return F.when(b["n"] == 0, a).otherwise(both)

    return F.aggregate(F.array_sort(F.collect_list(parts)), no_moments(), add)


def mean_of(m: Column) -> Column:
    """NULL of no rows."""
    return F.when(m["n"] > 0, m["mean"])


def sample_std_of(m: Column) -> Column:
    """NULL of fewer than two rows."""
    return F.when(m["n"] > 1, F.sqrt(m["m2"] / (m["n"] - 1)))
