"""Extracted ion chromatograms and data-independent grouping."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions.masses import overlap_ratio
from massloom.functions.text import bound
from massloom.operators.joins import band_join
from massloom.operators.ordered import bare, lay_out, running_sums
from massloom.operators.search import classic_search
from massloom.session import materialize


def traces(peaks: DataFrame, keys: Sequence[str], scan: str, mz: str, intensity: str, ppm: float = 10.0, missed: int = 1, least: int = 3) -> DataFrame:
    """(`keys`, trace, n_peaks, mean_mz, apex_scan, start, end, points): peaks of near m/z in near scans.

    m/z are chained where the next is within the tolerance; a chain is cut where more than `missed` scans go by without a peak. Every peak counts:
    `points` has one entry a scan, the sum of its peaks in the trace, and the apex is the highest of them, of equal ones the earliest.
    """
    # Peaks of the same scan and m/z always share a trace, so they are summed before the windows.
    known = peaks.filter(F.col(scan).isNotNull() & F.col(mz).isNotNull())
    peaks = known.groupBy(*keys, scan, mz).agg(F.count(F.lit(1)).alias("n__"), F.sum(F.col(intensity).cast("double")).alias("sum__"))
    # Where a chain ends is found in cells of the logarithm of m/z, and chains are numbered over a total order, so a file of any size is many tasks.
    distinct = peaks.select(*keys, F.col(mz).alias("mz__")).distinct().withColumn("log__", F.log("mz__"))
    reach = -math.log1p(-ppm / 1e6)
    cell = F.floor(F.col("log__") / (8 * reach))
    spread = distinct.withColumn("home__", cell).withColumn("cell__", F.explode(F.array_distinct(F.array(F.floor((F.col("log__") - 2 * reach) / (8 * reach)), cell))))
    after = F.lead("mz__").over(Window.partitionBy(*keys, "cell__").orderBy("mz__"))
    ends = spread.withColumn("next__", after).filter("home__ = cell__").withColumn("end__", F.when(F.col("next__") - F.col("mz__") <= F.col("next__") * ppm / 1e6, 0).otherwise(1))
    laid = lay_out(ends.select(*keys, "mz__", "end__"), [], [*[F.col(k) for k in keys], F.col("mz__")])
    numbered = bare(running_sums(laid, [], {"chain__": F.col("end__")})).withColumn("chain__", F.col("chain__") - F.col("end__")).drop("end__")
    same = F.col(mz) == F.col("mz__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__k"))
    chained = peaks.join(numbered.withColumnsRenamed({k: f"{k}__k" for k in keys}), same).drop("mz__", *[f"{k}__k" for k in keys])
    by_scan = Window.partitionBy(*keys, "chain__").orderBy(scan, mz)
    gap = F.when(F.col(scan) - F.lag(scan).over(by_scan) <= missed + 1, 0).otherwise(1)
    cut = chained.withColumn("gap__", gap).withColumn("part__", F.sum("gap__").over(by_scan))
    per_scan = cut.groupBy(*keys, "chain__", "part__", scan).agg(F.sum("n__").alias("n__"), F.sum(F.col(mz) * F.col("n__")).alias("mz__"), F.sum("sum__").alias("sum__"))
    point = F.struct(F.col(scan).alias("scan"), F.col("sum__").alias("intensity"))
    out = per_scan.groupBy(*keys, "chain__", "part__").agg(F.sum("n__").alias("n_peaks"), (F.sum("mz__") / F.sum("n__")).alias("mean_mz"), F.max_by(scan, F.struct("sum__", -F.col(scan))).alias("apex_scan"), F.min(scan).alias("start"), F.max(scan).alias("end"), F.array_sort(F.collect_list(point)).alias("points"))
    trace = F.concat_ws("-", F.col("chain__").cast("string"), F.col("part__").cast("string")).alias("trace")
    return out.filter(F.col("n_peaks") >= least).select(*keys, trace, "n_peaks", "mean_mz", "apex_scan", "start", "end", "points")


def _centred_correlation(u: np.ndarray, v: np.ndarray) -> float:
    u, v = u - u.mean(), v - v.mean()
    d = np.sqrt((u * u).sum() * (v * v).sum())
    return float((u * v).sum() / d) if d > 0 else 0.0


def pearson(a: Sequence, b: Sequence) -> float:
    """The correlation of two traces over their common scans, missing points as 0; NaN under three points, 0 without variance."""
    x, y = {p["scan"]: p["intensity"] for p in a}, {p["scan"]: p["intensity"] for p in b}
    lo, hi = max(min(x), min(y)), min(max(x), max(y))
    if hi - lo + 1 < 3:
        return float("nan")
    return _centred_correlation(*(np.array([t.get(s, 0.0) for s in range(lo, hi + 1)]) for t in (x, y)))


def umpire_correlation(a: Sequence, b: Sequence, points_per_interval: int = 150) -> float:
    """The correlation of two traces as their highest points in equal intervals of time.

    Intervals are two units over `points_per_interval` long and begin at the later of the two starts; there are half as many as the longer trace
    has points, and fewer than six give NaN. A point on the border of two intervals is in neither. An empty interval between others gets the
    mean of its neighbours, from left to right.
    """
    count, width = max(len(a), len(b)) // 2, 2.0 / points_per_interval
    if count < 6:
        return float("nan")
    begin = max(min(p["scan"] for p in a), min(p["scan"] for p in b))
    sides = []
    for t in (a, b):
        at = np.array([(p["scan"] - begin) / width for p in t])
        place = np.floor(at)
        inside = (place >= 0) & (place < count) & ((at > place) | (place == 0))
        top = np.zeros(count)
        np.maximum.at(top, place[inside].astype(int), np.array([p["intensity"] for p in t])[inside])
        for i in range(1, count - 1):
            if top[i] == 0:
                top[i] = (top[i - 1] + top[i + 1]) / 2
        sides.append(top)
    return _centred_correlation(*sides)


def correlation_of(a: str, b: str) -> Column:
    """`pearson` of two columns of points, by built-in functions: the common scans' sums are taken in one pass over aligned arrays."""
    first, last = (lambda c: F.array_min(F.transform(c, lambda p: p["scan"]))), (lambda c: F.array_max(F.transform(c, lambda p: p["scan"])))
    lo, hi = F.greatest(first(a), first(b)), F.least(last(a), last(b))
    inside = lambda c, x: F.filter(c, lambda p: p["scan"].between(x["lo"], x["hi"]))

    def total(points: Column, of) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + of(p))

    def worked(x: Column) -> Column:
        n = (x["hi"] - x["lo"] + 1).cast("double")
        pa, pb = inside(a, x), inside(b, x)
        by_scan = F.map_from_entries(F.transform(pb, lambda p: F.struct(p["scan"], p["intensity"])))
        both = bound(by_scan, lambda m: total(pa, lambda p: p["intensity"] * F.coalesce(F.try_element_at(m, p["scan"]), F.lit(0.0))))
        sa, sb = total(pa, lambda p: p["intensity"]), total(pb, lambda p: p["intensity"])
        qa, qb = total(pa, lambda p: p["intensity"] * p["intensity"]), total(pb, lambda p: p["intensity"] * p["intensity"])
        spread = (qa - sa * sa / n) * (qb - sb * sb / n)
        # Sums of squares leave a rest of rounding where nothing varies.
        flat = (qa - sa * sa / n <= qa * 1e-12) | (qb - sb * sb / n <= qb * 1e-12)
        return F.when(n < 3, float("nan")).when(flat, 0.0).otherwise((both - sa * sb / n) / F.sqrt(spread))

    return bound(F.struct(lo.alias("lo"), hi.alias("hi")), worked)


def precursor_groups(precursors: DataFrame, fragments: DataFrame, keys: Sequence[str], apex_tolerance: float, least_overlap: float, least_correlation: float, least_fragments: int = 1, fragment_rank: int = 100, precursor_rank: int = 10) -> DataFrame:
    """(`keys`, precursor, fragment, overlap, correlation, fragment_rank, precursor_rank) of traces that elute together.

    Traces are joined on their apex, kept if they overlap and correlate enough (NaN never does), counted, ranked from both sides and counted
    again. Both tables have trace, apex_scan, start, end and points.
    """
    a = precursors.select(*keys, F.col("trace").alias("precursor"), F.col("points").alias("pa"), F.col("start").alias("sa"), F.col("end").alias("ea"), (F.col("apex_scan") - apex_tolerance).alias("lo"), (F.col("apex_scan") + apex_tolerance).alias("hi"))
    b = fragments.select(*keys, F.col("trace").alias("fragment"), F.col("points").alias("pb"), F.col("start").alias("sb"), F.col("end").alias("eb"), F.col("apex_scan").cast("double").alias("apex"))
    near = band_join(a, b, "lo", "hi", "apex", max(4 * apex_tolerance, 1.0), keys)
    near = near.withColumn("overlap", overlap_ratio(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb"))).filter(F.col("overlap") >= least_overlap)
    good = near.withColumn("correlation", correlation_of("pa", "pb")).filter(~F.isnan("correlation") & (F.col("correlation") >= least_correlation)).select(*keys, "precursor", "fragment", "overlap", "correlation")
    of_precursor, of_fragment = Window.partitionBy(*keys, "precursor"), Window.partitionBy(*keys, "fragment")
    many = good.withColumn("n__", F.count(F.lit(1)).over(of_precursor)).filter(F.col("n__") > least_fragments)
    ranked = many.withColumn("fragment_rank", F.row_number().over(of_precursor.orderBy(F.desc("correlation"), "fragment"))).withColumn("precursor_rank", F.row_number().over(of_fragment.orderBy(F.desc("correlation"), "precursor")))
    kept = ranked.filter((F.col("fragment_rank") <= fragment_rank) & (F.col("precursor_rank") <= precursor_rank))
    return kept.withColumn("n__", F.count(F.lit(1)).over(of_precursor)).filter(F.col("n__") >= least_fragments).drop("n__")


def pseudo_spectra(groups: DataFrame, fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A fragment spectrum for each precursor: the apex peaks of its fragments by m/z."""
    top = F.aggregate("points", F.lit(0.0), lambda acc, p: F.greatest(acc, p["intensity"]))
    apex = fragments.select(*keys, F.col("trace").alias("fragment"), F.col("mean_mz"), top.alias("intensity"))
    joined = groups.join(apex, [*keys, "fragment"])
    peaks = F.array_sort(F.collect_list(F.struct(F.col("mean_mz").alias("mz"), "intensity")))
    return joined.groupBy(*keys, "precursor").agg(peaks.alias("peaks"))


#: The width of a block of m/z in the logarithm, and of one of scans in apex tolerances; pairs of traces that are correlated at once.
TRACE_BLOCK = 0.05
APEX_BLOCK = 1024
PAIRS_AT_ONCE = 200_000


def block_traces(peaks: DataFrame, keys: Sequence[str], scan: str, mz: str, intensity: str, ppm: float = 10.0, missed: int = 1, least: int = 3) -> DataFrame:
    """The traces of `traces` without their names, chained within blocks of m/z.

    A chain that comes near the border of its block is open: it is written with the sums of its scans, and the open chains of a file are then linked
    and cut like the others. Peaks are shuffled once.
    """
    known = peaks.filter(F.col(scan).isNotNull() & (F.col(mz) > 0) & ~F.isnan(F.col(mz).cast("double")))
    rows = known.select(*keys, F.col(scan).alias("scan__"), F.col(mz).cast("double").alias("mz__"), F.coalesce(F.col(intensity).cast("double"), F.lit(0.0)).alias("sum__"))
    rows = rows.withColumn("block__", F.floor(F.log("mz__") / TRACE_BLOCK))
    kind = peaks.schema[scan].dataType
    of_keys = [T.StructField(k, peaks.schema[k].dataType) for k in keys]
    point = T.StructType([T.StructField("scan", kind), T.StructField("intensity", T.DoubleType())])
    shape = T.StructType([*of_keys, T.StructField("n_peaks", T.LongType()), T.StructField("mean_mz", T.DoubleType()), *[T.StructField(c, kind) for c in ("apex_scan", "start", "end")], T.StructField("points", T.ArrayType(point))])
    open_ = [T.StructField("low__", T.DoubleType()), T.StructField("high__", T.DoubleType()), T.StructField("counts__", T.ArrayType(T.LongType())), T.StructField("sums__", T.ArrayType(T.DoubleType()))]

    def cut(chain: np.ndarray, scans: np.ndarray, n: np.ndarray, mzs: np.ndarray, x: np.ndarray, whole: bool = False) -> tuple[dict, np.ndarray]:
        """The columns of the traces, or, with `whole`, of the chains, of points in order of chain and scan; and where each begins."""
        new = np.r_[True, np.diff(chain) != 0] if whole else np.r_[True, (np.diff(chain) != 0) | (np.diff(scans) > missed + 1)]
        at = np.flatnonzero(new)
        part = np.cumsum(new) - 1
        count = np.add.reduceat(n, at)
        top = np.flatnonzero(x == np.maximum.reduceat(x, at)[part])
        apex = scans[top[np.unique(part[top], return_index=True)[1]]]
        kept = np.ones(len(at), bool) if whole else count >= least
        inside, sizes = kept[part], np.diff(np.r_[at, len(x)])
        points = pa.StructArray.from_arrays([pa.array(scans[inside]), pa.array(x[inside])], ["scan", "intensity"])
        ends = np.r_[0, np.cumsum(sizes[kept])].astype(np.int32)
        out = {"n_peaks": count[kept], "mean_mz": (np.add.reduceat(mzs, at) / count)[kept], "apex_scan": apex[kept], "start": scans[at][kept], "end": scans[at + sizes - 1][kept], "points": pa.ListArray.from_arrays(ends, points)}
        return {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()}, ends

    def summed(chain: np.ndarray, scans: np.ndarray, n: np.ndarray, mzs: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """One row for each chain and scan."""
        order = np.lexsort((scans, chain))
        chain, scans = chain[order], scans[order]
        at = np.flatnonzero(np.r_[True, (np.diff(chain) != 0) | (np.diff(scans) != 0)])
        return [chain[at], scans[at], *[np.add.reduceat(v[order], at) for v in (n, mzs, x)]]

    def named(t: pa.Table, columns: dict) -> pa.Table:
        size = pa.array(np.zeros(len(columns["n_peaks"]), np.int64))
        return pa.table({**{k: t[k].take(size) for k in keys}, **columns})

    def within(t: pa.Table) -> pa.Table:
        mzs = t["mz__"].to_numpy()
        order = np.argsort(mzs, kind="stable")
        mzs, scans, x, block = mzs[order], t["scan__"].to_numpy()[order], t["sum__"].to_numpy()[order], t["block__"][0].as_py()
        new = np.r_[True, ~(np.diff(mzs) <= mzs[1:] * ppm / 1e6)]
        at = np.flatnonzero(new)
        low, high = mzs[at], mzs[np.r_[at[1:], len(mzs)] - 1]
        border = (np.floor(np.log(low * (1 - 2 * ppm / 1e6)) / TRACE_BLOCK) != block) | (np.floor(np.log(high * (1 + 2 * ppm / 1e6)) / TRACE_BLOCK) != block)
        chain, *rest = summed(np.cumsum(new) - 1, scans, np.ones(len(mzs), np.int64), mzs, x)
        side, out = border[chain], []
        if not side.all():
            columns, _ = cut(chain[~side], *[v[~side] for v in rest])
            none = {f.name: pa.nulls(len(columns["n_peaks"]), k) for f, k in zip(open_, (pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)}
            out.append(named(t, {**columns, **none}))
        if side.any():
            scans, n, sums, x = (v[side] for v in rest)
            columns, ends = cut(chain[side], scans, n, sums, x, True)
            out.append(named(t, {**columns, "low__": pa.array(low[border]), "high__": pa.array(high[border]), "counts__": pa.ListArray.from_arrays(ends, pa.array(n)), "sums__": pa.ListArray.from_arrays(ends, pa.array(sums))}))
        return pa.concat_tables(out)

    def across(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["low__"].to_numpy(), kind="stable")))
        low, high = t["low__"].to_numpy(), t["high__"].to_numpy()
        chain = np.cumsum(np.r_[True, ~(low[1:] - high[:-1] <= low[1:] * ppm / 1e6)]) - 1
        points = pc.list_flatten(t["points"])
        values = [points.combine_chunks().field("scan"), pc.list_flatten(t["counts__"]), pc.list_flatten(t["sums__"]), points.combine_chunks().field("intensity")]
        return named(t, cut(*summed(np.repeat(chain, pc.list_value_length(t["points"]).to_numpy()), *[v.to_numpy(zero_copy_only=False) if isinstance(v, pa.Array) else v.to_numpy() for v in values]))[0])

    chained = materialize(rows.groupBy(*keys, "block__").applyInArrow(within, T.StructType([*shape.fields, *open_])), "traces")
    names = [f.name for f in shape.fields]
    linked = chained.filter("low__ IS NOT NULL").groupBy(*keys).applyInArrow(across, shape)
    return chained.filter("low__ IS NULL").select(*names).unionByName(linked)


def _flat_points(points: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, scans, intensities) of a column of points."""
    flat = pc.list_flatten(points).combine_chunks()
    return np.r_[0, np.cumsum(pc.list_value_length(points).to_numpy(), dtype=np.int64)], *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("scan", "intensity"))


def _correlations(p: np.ndarray, f: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: tuple, b: tuple) -> np.ndarray:
    """`pearson` of the pairs of traces `p` of `a` and `f` of `b`, each (offsets, scans, intensities), over the scans `lo` to `hi`."""

    def inside(which: np.ndarray, side: tuple) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(side[0])[which]
        owner = np.repeat(np.arange(len(which)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - side[0][which], sizes)
        ok = (side[1][place] >= lo[owner]) & (side[1][place] <= hi[owner])
        return owner[ok], place[ok]

    scans, codes = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
    held = np.repeat(np.arange(len(b[0]) - 1), np.diff(b[0])) * len(scans) + codes[len(a[1]) :]
    (oa, pa_), (ob, pb), n = inside(p, a), inside(f, b), (hi - lo + 1).astype(float)
    x, y = a[2][pa_], b[2][pb]
    asked = f[oa] * len(scans) + codes[pa_]
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    total = lambda owner, v: np.bincount(owner, v, len(p))
    both, sa, sb, qa, qb = total(oa, x * np.where(held[at] == asked, b[2][at], 0.0)), total(oa, x), total(ob, y), total(oa, x * x), total(ob, y * y)
    with np.errstate(invalid="ignore", divide="ignore"):
        ra, rb = qa - sa * sa / n, qb - sb * sb / n
        # Sums of squares leave a rest of rounding where nothing varies.
        r = np.where((ra <= qa * 1e-12) | (rb <= qb * 1e-12), 0.0, (both - sa * sb / n) / np.sqrt(ra * rb))
    return np.where(n < 3, np.nan, r)


def _places(group: np.ndarray, worth: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Ranks from 1 within groups, by descending worth."""
    order = np.lexsort((tie, -worth, group))
    at = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.repeat(at, np.diff(np.r_[at, len(group)])) + 1
    return out


def block_spectra(precursors: DataFrame, fragments: DataFrame, keys: Sequence[str], apex_tolerance: float, least_overlap: float, least_correlation: float, least_fragments: int = 1, fragment_rank: int = 100, precursor_rank: int = 10) -> DataFrame:
    """(`keys`, precursor_mass, apex_scan, start, peaks, intensities, total): the spectra of `precursor_groups` and `pseudo_spectra`, made within blocks of scans.

    A block also has the traces beside it that ranks and counts of its own precursors depend on, so traces are shuffled once and pairs never.
    Equal correlations are ranked by mean m/z and start.
    """
    width = max(APEX_BLOCK * apex_tolerance, 1.0)

    def placed(t: DataFrame, reach: float) -> DataFrame:
        blocks = F.sequence(F.floor((F.col("apex_scan") - reach) / width), F.floor((F.col("apex_scan") + reach) / width))
        return t.select(*keys, "mean_mz", "apex_scan", "start", "end", "points", F.explode(blocks).alias("block__"))

    kind = precursors.schema["apex_scan"].dataType
    some = T.ArrayType(T.DoubleType())
    shape = T.StructType([*[T.StructField(k, precursors.schema[k].dataType) for k in keys], T.StructField("precursor_mass", T.DoubleType()), T.StructField("apex_scan", kind), T.StructField("start", kind), T.StructField("peaks", some), T.StructField("intensities", some), T.StructField("total", T.DoubleType())])

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = (t.take(pa.array(np.lexsort((t["start"].to_numpy(), t["mean_mz"].to_numpy())))) for t in (left, right))
        a, b = _flat_points(left["points"]), _flat_points(right["points"])
        apex, at = left["apex_scan"].to_numpy(), right["apex_scan"].to_numpy()
        by_apex = np.argsort(at, kind="stable")
        first, last = np.searchsorted(at[by_apex], apex - apex_tolerance), np.searchsorted(at[by_apex], apex + apex_tolerance, side="right")
        p = np.repeat(np.arange(len(apex)), last - first)
        f = by_apex[np.arange(len(p)) - np.repeat(np.cumsum(last - first) - last, last - first)] if len(p) else np.zeros(0, np.int64)
        (sa, ea), (sb, eb) = ((t["start"].to_numpy(), t["end"].to_numpy()) for t in (left, right))
        common, span = np.minimum(ea[p], eb[f]) - np.maximum(sa[p], sb[f]), np.maximum(ea[p], eb[f]) - np.minimum(sa[p], sb[f])
        near = np.where((common <= 0) | (span <= 0), 0.0, common / np.where(span > 0, span, 1)) >= least_overlap
        p, f = p[near], f[near]
        r = [np.zeros(0)]
        for k in range(0, len(p), PAIRS_AT_ONCE):
            i, j = p[k : k + PAIRS_AT_ONCE], f[k : k + PAIRS_AT_ONCE]
            r.append(_correlations(i, j, np.maximum(sa[i], sb[j]), np.minimum(ea[i], eb[j]), a, b))
        r = np.concatenate(r)
        for kept in (lambda: r >= least_correlation, lambda: np.bincount(p, minlength=len(apex))[p] > least_fragments, lambda: (_places(p, r, f) <= fragment_rank) & (_places(f, r, p) <= precursor_rank), lambda: np.bincount(p, minlength=len(apex))[p] >= least_fragments):
            ok = kept() if len(p) else np.zeros(0, bool)
            p, f, r = p[ok], f[ok], r[ok]
        home = np.floor(apex / width) == (left["block__"][0].as_py() if len(apex) else 0)
        p, f = p[home[p]], f[home[p]]
        top = np.maximum(np.maximum.reduceat(b[2], b[0][:-1]), 0.0) if len(at) else np.zeros(0)
        mass = right["mean_mz"].to_numpy()
        order = np.lexsort((top[f], mass[f], p))
        p, f = p[order], f[order]
        starts = np.flatnonzero(np.r_[True, np.diff(p) != 0]) if len(p) else np.zeros(0, np.int64)
        own, ends = pa.array(p[starts]), np.r_[starts, len(p)].astype(np.int32)
        total = np.add.reduceat(top[f], starts) if len(p) else np.zeros(0)
        lists = {n: pa.ListArray.from_arrays(ends, pa.array(v[f])) for n, v in (("peaks", mass), ("intensities", top))}
        return pa.table({**{k: left[k].take(own) for k in keys}, "precursor_mass": left["mean_mz"].take(own), "apex_scan": left["apex_scan"].take(own), "start": left["start"].take(own), **lists, "total": pa.array(total)})

    # Ranks of a block's precursors depend on others up to twice the tolerance away, and those on fragments up to three times.
    a, b = placed(precursors, 2 * apex_tolerance), placed(fragments, 3 * apex_tolerance)
    return a.groupBy(*keys, "block__").cogroup(b.groupBy(*keys, "block__")).applyInArrow(group, shape)


def dia_search(survey: DataFrame, product: DataFrame, keys: Sequence[str], peptides: DataFrame, ppm: float = 10.0, apex_tolerance: float = 2.0, least_overlap: float = 0.3, least_correlation: float = 0.5, least_fragments: int = 2, cutoff: float = 5.0) -> DataFrame:
    """(`keys`, precursor_mass, apex_scan, peptide, score): a search of data-independent spectra (Q8).

    `survey` and `product` are deconvoluted peaks (`keys`, scan, mass, intensity). Both are traced, traces that elute together become the pseudo
    spectrum of their precursor, and those are searched. For fragments made in the source, `product` are the scans of a high voltage (X16).
    """
    a, b = (block_traces(t, keys, "scan", "mass", "intensity", ppm) for t in (survey, product))
    spectra = block_spectra(a, b, keys, apex_tolerance, least_overlap, least_correlation, least_fragments)
    scans = materialize(spectra.withColumn("scan_id", F.to_json(F.struct(*keys, "precursor_mass", "start"))), "scans")
    found = classic_search(scans, peptides, cutoff=cutoff)
    return found.join(scans.select("scan_id", *keys, "precursor_mass", "apex_scan"), "scan_id").select(*keys, "precursor_mass", "apex_scan", "peptide", "score")
