"""Counts of distinct values and quantiles as sketches: stored a group, merged over groups, read at any time.

The opt-in form of exact distinct counts, medians and bins for data that is read once and asked about often: a sketch has a
few kilobytes whatever it has seen, groups are summed in the map tasks, and a coarser group is a merge of finer ones.
Distinct counts are within 5 % (12 bits: 1.6 % is one standard error), ranks within 2.7 % (k of 200: 1.33 % is one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a distinct count, places of a quantile sketch, and the bounds that hold for each.
HLL_BITS, KLL_PLACES, DISTINCT_ERROR, RANK_ERROR = 12, 200, 0.05, 0.027


def sketched(rows: DataFrame, by: list[str], distinct: str | None = None, value: str | None = None) -> DataFrame:
    """by, n, and the sketches of a column's distinct values (hll) and of a whole number's distribution (kll)."""
    made = [F.count(F.lit(1)).alias("n")]
    if distinct is not None:
        made.append(F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(HLL_BITS)).alias("hll"))
    if value is not None:
        made.append(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(KLL_PLACES)).alias("kll"))
    return rows.groupBy(*by).agg(*made)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches of finer groups as those of coarser ones."""
    merges = {"n": F.sum, "hll": F.hll_union_agg, "kll": F.kll_merge_agg_bigint}
    return sketches.groupBy(*by).agg(*(merge(c).alias(c) for c, merge in merges.items() if c in sketches.columns))


def distinct_count(hll: Column | str = "hll") -> Column:
    return F.hll_sketch_estimate(hll)


def quantile(share: float, kll: Column | str = "kll") -> Column:
    return F.kll_sketch_get_quantile_bigint(kll, F.lit(float(share)))


def rank_of(value: Column, kll: Column | str = "kll") -> Column:
    """The share of values up to a value."""
    return F.kll_sketch_get_rank_bigint(kll, value)


def binned(rows: DataFrame, value: str, sketch: DataFrame, k: int) -> DataFrame:
    """rows with bin 0 to k - 1 by the quantiles of a sketch of one row: no sort and no shuffle of the rows."""
    cuts = sketch.select(F.array(*(quantile(i / k) for i in range(1, k))).alias("_cuts"))
    return rows.join(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
