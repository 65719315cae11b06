"""Running sums and minima over a total order of any number of rows.

A window without a partition key puts all rows into one task. Here the rows are range-partitioned by the order and written once; each
partition's total is a row, the totals' running sums are the partitions' offsets, and windows run within the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import materialize

_PART = "ordered_part"


def lay_out(rows: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """`rows` written in order within `groups`, with the number of their partition and `ordered_key`, the order within it."""
    placed = rows.withColumn("ordered_key", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    placed = placed.repartitionByRange(*groups, "ordered_key")
    return materialize(placed.withColumn(_PART, F.spark_partition_id()), "ordered")


def _windows(groups: Sequence[str]) -> tuple:
    within = Window.partitionBy(*groups, _PART).orderBy("ordered_key")
    return within, Window.partitionBy(*groups).orderBy(_PART)


def running_sums(laid: DataFrame, groups: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """`laid` with the sum of each value over the rows up to this one; `sums` maps new names to values."""
    within, parts = _windows(groups)
    totals = laid.groupBy(*groups, _PART).agg(*[F.sum(v).alias(f"{n}__t") for n, v in sums.items()])
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, _PART, *[F.coalesce(F.sum(f"{n}__t").over(before), F.lit(0)).alias(f"{n}__o") for n in sums])
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = laid.withColumns({n: F.sum(v).over(upto) for n, v in sums.items()})
    out = _joined(out, offsets, groups)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"{n}__o") for n in sums}).drop(*[f"{n}__o" for n in sums])


def running_extreme(laid: DataFrame, groups: Sequence[str], name: str, value: Column, least: bool, forward: bool) -> DataFrame:
    """`laid` with the least or greatest value over the rows up to this one, or from this one on (`forward` false)."""
    within, parts = _windows(groups)
    if not forward:  # a frame that grows: one that ends at the last row is worked out anew for every row
        within, parts = Window.partitionBy(*groups, _PART).orderBy(F.desc("ordered_key")), Window.partitionBy(*groups).orderBy(F.desc(_PART))
    pick, both = (F.min, F.least) if least else (F.max, F.greatest)
    ends, others = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    totals = laid.groupBy(*groups, _PART).agg(pick(value).alias("ordered_total"))
    offsets = totals.select(*groups, _PART, pick("ordered_total").over(parts.rowsBetween(*others)).alias("ordered_offset"))
    out = _joined(laid.withColumn(name, pick(value).over(within.rowsBetween(*ends))), offsets, groups)
    return out.withColumn(name, both(name, "ordered_offset")).drop("ordered_offset")


def running(laid: DataFrame, groups: Sequence[str], sums: dict[str, Column], extremes: dict[str, tuple[Column, bool, bool]]) -> DataFrame:
    """`laid` with running sums and with running extremes of values made from them, in one pass over the rows.

    `extremes` maps a name to (value, whether the least, whether forward). Both directions are windows over the same partitions, so the rows are shuffled
    once; what a partition passes on to the next ones is a row of its own.
    """
    within, parts = _windows(groups)
    upto, out = within.rowsBetween(Window.unboundedPreceding, 0), laid
    if sums:
        totals = laid.groupBy(*groups, _PART).agg(*[F.sum(v).alias(f"{n}__t") for n, v in sums.items()])
        offsets = totals.select(*groups, _PART, *[F.coalesce(F.sum(f"{n}__t").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{n}__o") for n in sums])
        out = _joined(laid, offsets, groups).withColumns({n: F.coalesce(F.sum(v).over(upto), F.lit(0)) + F.col(f"{n}__o") for n, v in sums.items()}).drop(*[f"{n}__o" for n in sums])
    back = Window.partitionBy(*groups, _PART).orderBy(F.desc("ordered_key")).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({n: (F.min if least else F.max)(v).over(upto if forward else back) for n, (v, least, forward) in extremes.items()})
    if sums:
        out = materialize(out, "running")
        ends = out.groupBy(*groups, _PART).agg(*[(F.min if least else F.max)(n).alias(f"{n}__t") for n, (_, least, _f) in extremes.items()])
    else:  # the values don't depend on what is before them, so a partition's extreme is known at once
        ends = laid.groupBy(*groups, _PART).agg(*[(F.min if least else F.max)(v).alias(f"{n}__t") for n, (v, least, _f) in extremes.items()])
    others = (Window.unboundedPreceding, -1)
    after = Window.partitionBy(*groups).orderBy(F.desc(_PART))
    passed = ends.select(*groups, _PART, *[(F.min if least else F.max)(f"{n}__t").over((parts if forward else after).rowsBetween(*others)).alias(f"{n}__o") for n, (_, least, forward) in extremes.items()])
    out = _joined(out, passed, groups)
    return out.withColumns({n: (F.least if least else F.greatest)(n, f"{n}__o") for n, (_, least, _f) in extremes.items()}).drop(*[f"{n}__o" for n in extremes])


def _joined(rows: DataFrame, offsets: DataFrame, groups: Sequence[str]) -> DataFrame:
    keys = [*groups, _PART]
    other = offsets.select(*[F.col(k).alias(f"{k}__k") for k in keys], *[c for c in offsets.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__k"))
    return rows.join(other, same).drop(*[f"{k}__k" for k in keys])


def bare(rows: DataFrame) -> DataFrame:
    """Without the columns of the layout."""
    return rows.drop("ordered_key", _PART)
