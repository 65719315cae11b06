"""Joins on ranges, nearest values and shared bins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.operators.ordered import bare, lay_out, running
from massloom.session import materialize


def band_join(left: DataFrame, right: DataFrame, lo: str, hi: str, value: str, width: float, keys: Sequence[str] = (), scale: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of `left` and `right` with `lo` <= `value` <= `hi` and equal `keys`.

    Each left row is copied to the bins that its range covers and joined by bin, so the join is hashed and never a nested loop. `width` is
    a bin's width after `scale`; with F.log it is relative, as ppm are. Choose it near the usual range: a range takes (hi - lo) / width + 1 copies.
    Null and NaN bounds or values match nothing. Hot bins are split by adaptive execution.
    """
    scaled = scale or (lambda c: c)
    number = lambda c: F.floor(scaled(F.col(c)) / width)
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    a = left.filter(known(lo) & known(hi) & (F.col(lo) <= F.col(hi))).withColumn("bin__", F.explode(F.sequence(number(lo), number(hi))))
    b = right.filter(known(value)).withColumn("bin__", number(value))
    return a.join(b, [*keys, "bin__"]).filter(F.col(value).between(F.col(lo), F.col(hi))).drop("bin__")


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, payload: Sequence[str] = ()) -> DataFrame:
    """Each left row with `nearest`: the right row (value and `payload`) of equal keys whose value is closest, of two as close the lower one.

    The closest is chosen before any filter, so a closer unfit one hides a fit one behind it; callers filter afterwards. Both sides are laid out in one order
    and the neighbours on either side carried along; ties of the value go to the least payload. Null where the keys have no right row.
    """
    row = F.struct(F.col(value).alias("value"), *payload)
    taken = right.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("at__")).agg(F.min(row).alias("row__"))
    points = taken.select(*keys, "at__", "row__", F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("left__"))
    asked = left.select(*keys, F.col(at).cast(right.schema[value].dataType).alias("at__"), F.lit(None).cast(taken.schema["row__"].dataType).alias("row__"), F.struct(*left.columns).alias("left__"))
    # One total order of both sides, a point before those that ask at its value; a hot key is as many tasks as it needs.
    laid = lay_out(points.unionByName(asked), keys, [F.col("at__"), F.col("left__").isNotNull()])
    both = bare(running(laid, keys, {}, {"below__": (F.col("row__"), False, True), "above__": (F.col("row__"), True, False)}))
    down, up = F.col("at__") - F.col("below__.value"), F.col("above__.value") - F.col("at__")
    nearest = F.when(F.col("below__").isNull() | (down > up), F.col("above__")).otherwise(F.col("below__"))
    return both.filter("left__ IS NOT NULL").select("left__.*", nearest.alias("nearest"))


#: Of one task of `index_count_join`: lists of peptides and of scans at most, pairs of a scans' list and a peptide, and bytes of a table of counts by kind and peptide.
PEPTIDES_AT_ONCE = 1024
SCANS_AT_ONCE = 20_000
PAIRS_AT_ONCE = 1 << 26
DENSE_BYTES = 1 << 26


def index_count_join(fragments: DataFrame, index: DataFrame, scan: str, peptide: str, cutoff: int, residual: Column | None = None) -> DataFrame:
    """(`scan`, `peptide`, n_hits) of the pairs that share at least `cutoff` bins.

    `fragments` has (`scan`, bin, ...), one row for each observed fragment and bin it covers; `index` has (bin, `peptide`, ...). `residual` is a
    condition on the other columns of both, such as a window on the precursor mass; it is checked once for each two kinds of row that share a
    bin. Lists of kinds meet in blocks of scans and peptides and are counted there, so neither hits nor pairs under the cutoff are shuffled.
    Scans with the same kinds are one list and so are peptides: equal lists are sent and counted once, and pairs become rows behind the count.
    """
    seen = fragments.filter("bin IS NOT NULL").select(F.col(scan).alias("scan__"), F.struct(*[c for c in fragments.columns if c != scan]).alias("f__"))
    held = index.filter("bin IS NOT NULL").select(F.col(peptide).alias("peptide__"), F.struct(*[c for c in index.columns if c != peptide]).alias("i__"))
    met = seen.select("f__").distinct().select("f__", "f__.*").join(held.select("i__").distinct().select("i__", "i__.*"), "bin")
    met = (met if residual is None else met.filter(residual)).groupBy("f__").agg(F.collect_list("i__").alias("i__"))
    kinds = materialize(met.withColumn("kind__", F.monotonically_increasing_id()), "kinds")
    of = lambda rows, key, name: rows.groupBy(key).agg(F.array_sort(F.collect_list("kind__")).alias("kinds__")).groupBy("kinds__").agg(F.collect_list(F.struct(key)).alias(name))
    peptides = materialize(of(held.join(kinds.select(F.explode("i__").alias("i__"), "kind__"), "i__"), "peptide__", "peptides__"), "peptide-kinds")
    # A peptide may have a kind several times; so many hits a kind has at most.
    n_lists, n_peptides, most = peptides.agg(F.count(F.lit(1)), F.sum(F.size("peptides__")), F.max(F.size("kinds__") - F.size(F.array_distinct("kinds__")) + 1)).first()
    scans = of(seen.join(kinds.select("f__", "kind__"), "f__"), "scan__", "scans__").filter(F.size("kinds__").cast("bigint") * F.lit(most or 1) >= cutoff)
    scans = materialize(scans, "scan-kinds")
    blocks, n_scans = max(1, -(-n_lists // PEPTIDES_AT_ONCE)), scans.count()
    parts = max(1, -(-n_scans // SCANS_AT_ONCE), -(-n_scans * (n_peptides or 0) // (blocks * PAIRS_AT_ONCE)))
    spread = lambda n: F.pmod(F.xxhash64("kinds__", F.lit("block")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = scans.select("scans__", "kinds__", spread(parts).alias("part__"), every(blocks).alias("block__"))
    right = peptides.select("peptides__", "kinds__", spread(blocks).alias("block__"), every(parts).alias("part__"))

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        at, to, n = _shared_counts(*_flat(a["kinds__"]), *_flat(b["kinds__"]), max(cutoff, 1))
        # A row for each list of scans and number of hits, with all peptides that have so many.
        order = np.lexsort((to, n, at))
        at, to, n = at[order], to[order], n[order]
        first = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(n) != 0)]) if len(at) else at
        sizes = pc.list_value_length(b["peptides__"]).to_numpy()
        ends, begin = np.r_[0, np.cumsum(sizes[to], dtype=np.int64)], np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        places = np.repeat(begin[to] - ends[:-1], sizes[to]) + np.arange(ends[-1])
        names = pc.list_flatten(b["peptides__"]).take(pa.array(places)).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(np.r_[ends[:-1][first], ends[-1]], pa.int32()), names)
        return pa.table({"scans__": a["scans__"].take(pa.array(at[first])), "peptides__": lists, "n_hits": pa.array(n[first])})

    shape = T.StructType([T.StructField("scans__", scans.schema["scans__"].dataType), T.StructField("peptides__", peptides.schema["peptides__"].dataType), T.StructField("n_hits", T.LongType())])
    found = left.groupBy("part__", "block__").cogroup(right.groupBy("part__", "block__")).applyInArrow(count, shape)
    found = found.select(F.explode("scans__").alias("s__"), "peptides__", "n_hits").select("s__", F.explode("peptides__").alias("p__"), "n_hits")
    return found.select(F.col("s__.scan__").alias(scan), F.col("p__.peptide__").alias(peptide), "n_hits")


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists without nulls."""
    sizes = pc.list_value_length(lists).to_numpy()
    return pc.list_flatten(lists).to_numpy().astype(np.int64), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def _shared_counts(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray, cutoff: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left list, right list, count) of the pairs of lists with `cutoff` equal pairs of values or more."""
    none = np.zeros(0, np.int64)
    values, place = np.unique(right, return_inverse=True)
    width, n_left = len(right_at) - 1, len(left_at) - 1
    if not len(values) or not n_left:
        return none, none, none
    # Values that no right list has match nothing; they get a row without hits.
    rows = np.searchsorted(values, left)
    rows[values[np.minimum(rows, len(values) - 1)] != left] = len(values)
    owner = np.repeat(np.arange(width), np.diff(right_at))
    sizes = np.diff(left_at)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if (len(values) + 1) * width <= DENSE_BYTES and len(right) * 64 >= len(values) * width:
        table = np.bincount(place * width + owner, minlength=(len(values) + 1) * width).reshape(-1, width)
        kind = np.uint8 if int(table.max()) * int(sizes.max()) < 256 else np.int64
        table = table.astype(kind)
        step = max(1, (1 << 19) // width)
        for size in np.unique(sizes[sizes > 0]):
            some = np.flatnonzero(sizes == size)
            for k in range(0, len(some), step):
                lists = some[k : k + step]
                n = table[rows[left_at[lists]]]
                for i in range(1, size):
                    n += table[rows[left_at[lists] + i]]
                at, to = np.nonzero(n >= cutoff)
                out.append((lists[at], to, n[at, to].astype(np.int64)))
    else:
        order = np.argsort(place, kind="stable")
        owner, ends = owner[order], np.r_[0, np.cumsum(np.bincount(place, minlength=len(values) + 1))]
        for i in range(n_left):
            near = [owner[ends[r] : ends[r + 1]] for r in rows[left_at[i] : left_at[i + 1]]]
            if near and sum(map(len, near)) >= cutoff:
                n = np.bincount(np.concatenate(near), minlength=width)
                to = np.flatnonzero(n >= cutoff)
                out.append((np.full(len(to), i), to, n[to]))
    return tuple(np.concatenate([none, *x]) for x in zip(*out, strict=True)) if out else (none, none, none)


def fragment_bins(fragments: DataFrame, lo: str, hi: str, per_unit: float) -> DataFrame:
    """Each fragment once for each bin between its bounds, the bins of both bounds included."""
    return fragments.withColumn("bin", F.explode(F.sequence(F.floor(F.col(lo) * per_unit), F.ceil(F.col(hi) * per_unit))))


def with_fallback(rows: DataFrame, library: DataFrame, exact: Sequence[str], fallback: Sequence[str], value: str) -> DataFrame:
    """`rows` with the library's `value` under the exact key, else under the fallback key (J15), the least of a repeated key."""
    first = library.groupBy(*exact).agg(F.min(value).alias("exact__"))
    second = library.groupBy(*fallback).agg(F.min(value).alias("fallback__"))
    out = rows.join(first, list(exact), "left").join(second, list(fallback), "left")
    return out.withColumn(value, F.coalesce("exact__", "fallback__")).withColumn("is_fallback", F.col("exact__").isNull() & F.col("fallback__").isNotNull()).drop("exact__", "fallback__")


def library_merge(library: DataFrame, found: DataFrame, keys: Sequence[str], ions: str, score: str) -> DataFrame:
    """A library brought up to date: an entry stays while it has more ions than the whole part of the new score; new keys come in."""
    a = library.select(*keys, F.col(ions).alias("old_ions"), F.lit(True).alias("in_library"))
    b = found.select(*keys, F.col(score).alias("new_score"), F.lit(True).alias("in_found"))
    both = a.join(b, list(keys), "full_outer")
    kept = F.col("in_found").isNull() | (F.col("in_library") & (F.col("old_ions") > F.floor("new_score")))
    return both.select(*keys, F.when(kept, "library").otherwise("match").alias("taken_from"))


#: The most rows of a list, such as one of modifications, that is taken into a plan as literals.
MOST_LISTED = 10_000


def listed(rows: DataFrame, *columns: str) -> list[tuple]:
    """The distinct rows of a list that doesn't grow with the data, in order; more than MOST_LISTED raise ValueError."""
    found = [tuple(r) for r in rows.select(*columns).distinct().orderBy(*columns).limit(MOST_LISTED + 1).collect()]
    if len(found) > MOST_LISTED:
        raise ValueError(f"more than {MOST_LISTED} rows are no fixed list")
    return found


def pairs_to_sum(singles: DataFrame, targets: DataFrame, mass: str, name: str, target: str, tolerance: float) -> DataFrame:
    """(target row, first, second) with two masses of `singles` that add up to the target within the tolerance, first <= second.

    For fixed lists only, of up to MOST_LISTED masses: each target gets a row for each possible first. The second is looked up by a band join
    on what the first leaves, so the pairs of singles are never all formed. The list is broadcast, so the targets' rows are never shuffled.
    """
    width = max(tolerance * 4, 1e-6)
    firsts = F.array(*[F.struct(F.lit(n).alias("first"), F.lit(m).alias("first_mass")) for n, m in listed(singles, name, mass)])
    left = targets.select(*targets.columns, F.inline(firsts))
    left = left.withColumn("lo__", F.col(target) - F.col("first_mass") - tolerance).withColumn("hi__", F.col(target) - F.col("first_mass") + tolerance)
    seconds = singles.select(F.col(name).alias("second"), F.col(mass).alias("second_mass"))
    out = band_join(left, F.broadcast(seconds), "lo__", "hi__", "second_mass", width)
    return out.filter(F.col("first") <= F.col("second")).select(*targets.columns, "first", "second")


def outward_walk(points: DataFrame, groups: Sequence[str], start: str, ordinal: str, found: str) -> DataFrame:
    """The points that are reached from `start` by steps of one `ordinal` in either direction while `found` holds."""
    w = Window.partitionBy(*groups).orderBy(ordinal)
    ok = points.filter(F.col(found)).withColumn("island__", F.col(ordinal) - F.row_number().over(w))
    sides = Window.partitionBy(*groups, "island__")
    reach = ok.withColumn("near__", F.bool_or(F.col(ordinal).between(F.col(start) - 1, F.col(start) + 1)).over(sides))
    return reach.filter("near__").drop("island__", "near__")


def first_case(cases: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first case that holds, null if none does (J10): mutually exclusive by priority."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(cases):
        out = F.when(condition, name).otherwise(out)
    return out
