"""Ordered computations within groups: ranks, smoothing, imputation, densities, folds."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.ordered import bare, lay_out, running_sums


def second_best(rows: DataFrame, keys: Sequence[str], score: str, cutoff: float, tie: Column) -> DataFrame:
    """The best row of each group with `second_score`, the next row's score or `cutoff`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    ranked = rows.withColumn("place__", F.row_number().over(w)).filter("place__ <= 2")
    return ranked.withColumn("second_score", F.coalesce(F.lead(score).over(w), F.lit(cutoff))).filter("place__ = 1").drop("place__")


def rank_within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """Ranks from 1 (W11, W12); the order is to be total."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_with_ties(rows: DataFrame, keys: Sequence[str], score: str, n: int) -> DataFrame:
    """The rows with a score no lower than the n-th of their group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    return rows.withColumn("rank__", F.rank().over(w)).filter(F.col("rank__") <= n).drop("rank__")


def gap_imputed(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "imputed") -> DataFrame:
    """Zeros and nulls replaced by the line between the known neighbours in places; the ends copy the nearest known value."""
    w, back = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.desc(order))
    numbered = rows.withColumn("at__", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull() & (F.col(value) != 0), F.struct(F.col("at__").alias("at"), F.col(value).cast("double").alias("v")))
    sides = numbered.withColumn("a__", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b__", F.last(known, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    ratio = (F.col("at__") - F.col("a__.at")) / (F.col("b__.at") - F.col("a__.at"))
    line = F.col("a__.v") + (F.col("b__.v") - F.col("a__.v")) * ratio
    filled = F.when(F.col("a__.at") == F.col("at__"), F.col("a__.v")).otherwise(F.coalesce(line, F.col("a__.v"), F.col("b__.v")))
    return sides.withColumn(name, filled).drop("at__", "a__", "b__")


def moving_average(rows: DataFrame, keys: Sequence[str], order: str, value: str, each_side: int, name: str = "smoothed") -> DataFrame:
    """The mean over up to `each_side` rows on either side and the row itself."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-each_side, each_side)
    return rows.withColumn(name, F.avg(value).over(w))


def carried_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The latest known value up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, True).over(w))


def _densities(distinct: DataFrame, radius: float, groups: Sequence[str] = ()) -> DataFrame:
    """`distinct` (`groups`, value, n) with `density`: the other rows within `radius` of each value.

    Values are spread over cells of their line; each cell also gets the values within `radius` of it, so every window is local and no task
    sorts all values. A value comes once, however often it occurs.
    """
    cell = F.floor(F.col("value") / (8 * radius))
    span = F.array_distinct(F.array(F.floor((F.col("value") - radius) / (8 * radius)), F.floor((F.col("value") + radius) / (8 * radius)), cell))
    spread = distinct.withColumn("home__", cell).withColumn("cell__", F.explode(span))
    by = ", ".join(f"`{c}`" for c in [*groups, "cell__"])
    near = F.expr(f"sum(n) OVER (PARTITION BY {by} ORDER BY value RANGE BETWEEN {float(radius)!r}D PRECEDING AND {float(radius)!r}D FOLLOWING)")
    return spread.withColumn("density", near - 1).filter("home__ = cell__").drop("home__", "cell__")


def density_neighbours(rows: DataFrame, value: str, radius: float, groups: Sequence[str] = ()) -> DataFrame:
    """Each row with `density`: the other rows within `radius` of its value (W16). Null and NaN values give no rows.

    Equal values are counted before any window, so a value that a third of all rows have is one row there.
    """
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    distinct = known.groupBy(*groups, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    found = _densities(distinct, radius, groups).select(*[F.col(g).alias(f"{g}__g") for g in groups], F.col("value").alias("value__"), "density")
    same = F.col(value) == F.col("value__")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__g"))
    return known.join(found, same).drop("value__", *[f"{g}__g" for g in groups])


def distance_to_denser(pdf: pd.DataFrame, value: str) -> np.ndarray:
    """For values in ascending order, how far the nearest one of higher density is; for the densest, the farther end."""
    v, p = pdf[value].to_numpy(float), pdf["density"].to_numpy()
    out = np.full(len(v), np.inf)
    for step, order in ((1, range(len(v))), (-1, range(len(v) - 1, -1, -1))):
        stack: list[int] = []
        for i in order:
            while stack and p[stack[-1]] <= p[i]:
                stack.pop()
            if stack:
                out[i] = min(out[i], abs(v[i] - v[stack[-1]]))
            stack.append(i)
    top = p == p.max()
    out[top] = np.maximum(v.max() - v[top], v[top] - v.min())
    return out


def density_peaks(rows: DataFrame, key: str, value: str, radius: float) -> DataFrame:
    """(peak, n_members, mean_value) of the clusters of a value by density peaks.

    A peak has a neighbour, nothing denser within `radius`, and no better peak within it; members lie within `radius` of a peak, whose mean and
    count come out, those of one member aside. Values farther apart than `radius` can't affect each other, so the values are cut into runs at
    larger gaps and each run is clustered on its own; equal values of a run come as one row with their number.
    """
    known = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    distinct = _densities(known.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")), radius)
    # A run ends where no value follows within the radius: found by cells, then numbered by the running count of ends.
    laid = lay_out(distinct, [], [F.col("value")])
    ends = _last_of_runs(distinct, radius)
    marked = running_sums(laid.join(ends, "value", "left").withColumn("end__", F.coalesce("end__", F.lit(0))), [], {"run": F.col("end__")}).withColumn("run", F.col("run") - F.col("end__"))

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value", ignore_index=True)
        sigma = distance_to_denser(pdf, "value")
        v, p, n = pdf["value"].to_numpy(), pdf["density"].to_numpy(), pdf["n"].to_numpy()
        chosen: list[float] = []  # ascending, so only the neighbours on either side can be near
        for i in np.lexsort((v, -p)).tolist():
            if p[i] >= 1 and (sigma[i] >= radius or p[i] == p.max()):
                at = bisect.bisect(chosen, v[i])
                if all(abs(v[i] - c) > radius for c in chosen[max(at - 1, 0) : at + 1]):
                    chosen.insert(at, v[i])
        found = []
        for c in chosen:
            # Values within the radius stand in a row; the ends are compared as differences, as everywhere else.
            a, b = np.searchsorted(v, [c - 2 * radius, c + 2 * radius])
            near = a + np.flatnonzero(np.abs(v[a:b] - c) <= radius)
            found.append((c, int(n[near].sum()), float((v[near] * n[near]).sum() / n[near].sum())))
        return pd.DataFrame([f for f in found if f[1] > 1], columns=["peak", "n_members", "mean_value"])

    # A run of one value makes no cluster, and most runs are such.
    worth = marked.groupBy("run").agg(F.sum("n").alias("total__")).filter("total__ > 1").select("run")
    return bare(marked).join(worth, "run").groupBy("run").applyInPandas(peaks, "peak double, n_members bigint, mean_value double")


def _last_of_runs(distinct: DataFrame, radius: float) -> DataFrame:
    """(value, end__) of the values that no other follows within the radius."""
    cell = F.floor(F.col("value") / (8 * radius))
    spread = distinct.select("value", cell.alias("home__"), F.explode(F.array_distinct(F.array(F.floor((F.col("value") - radius) / (8 * radius)), cell))).alias("cell__"))
    following = F.lead("value").over(Window.partitionBy("cell__").orderBy("value"))
    gap = spread.withColumn("gap__", following - F.col("value")).filter("home__ = cell__")
    return gap.filter(F.col("gap__").isNull() | (F.col("gap__") > radius)).select("value", F.lit(1).alias("end__"))


def folds(rows: DataFrame, group: str, decoy: str, score: str, n: int = 4) -> DataFrame:
    """(`group`, fold) dealt in turn among targets and decoys apart, by group size and best score, both descending.

    Turns are over groups, of which there are far fewer than rows, by a running count over their order.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size__"), F.max(score).alias("best__"), F.bool_or(decoy).alias("decoys__"))
    laid = lay_out(sizes, ["decoys__"], [-F.col("size__"), -F.col("best__"), F.col(group)])
    turn = running_sums(laid, ["decoys__"], {"turn__": F.lit(1)})
    return bare(turn).select(group, ((F.col("turn__") - 1) % n).cast("int").alias("fold"))


def longest_run(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The longest stretch of consecutive positions of each group."""
    distinct = rows.select(*keys, position).distinct()
    island = distinct.withColumn("island__", F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position)))
    return island.groupBy(*keys, "island__").agg(F.count(F.lit(1)).alias("n__")).groupBy(*keys).agg(F.max("n__").alias("longest_run"))


def greedy_dedupe(rows: DataFrame, keys: Sequence[str], value: str, tolerance: float, order: Sequence[str]) -> DataFrame:
    """Rows in `order`, without those within the tolerance (ppm) of one kept before in their group (I13). Groups are scans: tens of rows."""
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("v__"), F.struct(*rows.columns).alias("row__")))).alias("all__"))
    apart = lambda kept, x: F.forall(kept, lambda k: F.abs(x["v__"] - k["v__"]) > k["v__"] * tolerance / 1e6)
    kept = F.aggregate("all__", F.slice("all__", 1, 0), lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select(F.explode(kept).alias("kept__")).select("kept__.row__.*")


def chained_windows(rows: DataFrame, value: str, gap: float, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, window_no, lowest, highest, n): the values cut wherever the next is farther than `gap`.

    Online assignment to the nearest window depends on the order of arrival; chaining over the sorted values gives the same windows whenever they are
    apart by more than the gap, and one result for any order.
    """
    distinct = rows.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("value").over(Window.partitionBy(*groups).orderBy("value")) if groups else None
    if before is None:
        ends = _last_of_runs(distinct, gap)
        laid = lay_out(distinct.join(ends, "value", "left").withColumn("end__", F.coalesce("end__", F.lit(0))), [], [F.col("value")])
        numbered = running_sums(laid, [], {"window_no": F.col("end__")}).withColumn("window_no", F.col("window_no") - F.col("end__"))
    else:
        starts = distinct.withColumn("s__", F.when(before.isNull() | (F.col("value") - before > gap), 1).otherwise(0))
        numbered = starts.withColumn("window_no", F.sum("s__").over(Window.partitionBy(*groups).orderBy("value")) - 1)
    return numbered.groupBy(*groups, "window_no").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.sum("n").alias("n"))

