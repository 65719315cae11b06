"""Aggregations over ions, sites and groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def morpheus_score(ions: Column, intensity: str, kind: str, total: Column) -> Column:
    """One for each matched ion and its share of the total ion current; diagnostic ions (`D`) don't count (A1)."""
    return F.aggregate(ions, F.lit(0.0), lambda acc, i: acc + F.when(i[kind] == "D", 0.0).otherwise(1.0 + i[intensity] / total))


def xcorr_score(ions: Column, intensity: str, kind: str) -> Column:
    """The sum of intensities, of ions with a loss and a-degree and a-star ions a hundredth (A2)."""
    return F.aggregate(ions, F.lit(0.0), lambda acc, i: acc + i[intensity] * F.when(i[kind].rlike("^a[°*]|-"), 0.01).otherwise(1.0))


def all_charge_score(ions: Column, kind: str, number: str, intensity: str, total: Column) -> Column:
    """One for each type and number, at whatever charges, and the ions' share of the total (A3)."""
    distinct = F.size(F.array_distinct(F.transform(ions, lambda i: F.concat(i[kind], i[number].cast("string")))))
    return distinct + F.aggregate(ions, F.lit(0.0), lambda acc, i: acc + i[intensity]) / total


def group_score(rows: DataFrame, group: str, sequence: str, score: str) -> DataFrame:
    """The sum over a group's sequences of each one's best score."""
    best = rows.groupBy(group, sequence).agg(F.max(score).alias("best__"))
    return best.groupBy(group).agg(F.sum("best__").alias("group_score"), F.count(F.lit(1)).alias("n_sequences"))


def coverage(spans: DataFrame, keys: Sequence[str], start: str, end: str, length: Column) -> DataFrame:
    """The share of residues of each protein that spans cover (A10), by merging overlapping spans instead of listing residues."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    until = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("covered__", F.greatest(F.col(end) - F.greatest(F.col(start) - 1, F.coalesce(until, F.lit(0))), F.lit(0)))
    return new.groupBy(*keys).agg(F.sum("covered__").alias("n_covered"), F.max(length).alias("length")).withColumn("coverage", F.col("n_covered") / F.col("length"))


def masked_sequence(sequence: Column, starts_ends: Column) -> Column:
    """The sequence with covered residues in upper case, the others in lower case (A10)."""
    letters = F.split(sequence, "")
    masked = F.transform(letters, lambda c, i: F.when(F.exists(starts_ends, lambda s: (s["start"] <= i + 1) & (s["end"] >= i + 1)), F.upper(c)).otherwise(F.lower(c)))
    return F.array_join(masked, "")


def occupancy(sites: DataFrame, spans: DataFrame, keys: Sequence[str], site: str, start: str, end: str, weight: str) -> DataFrame:
    """Of each modified site how many matches have the modification, of those that span it."""
    modified = sites.groupBy(*keys, site, "modification").agg(F.sum(weight).alias("n_modified"))
    totals = modified.select(*keys, site).distinct().join(spans, list(keys)).filter(F.col(site).between(F.col(start), F.col(end))).groupBy(*keys, site).agg(F.sum(weight).alias("n_spanning"))
    return modified.join(totals, [*keys, site]).withColumn("occupancy", F.col("n_modified") / F.col("n_spanning"))


def complementary_ions(n_numbers: Column, c_numbers: Column, length: Column) -> Column:
    """How many cleavage sites both an N-terminal and a C-terminal ion show."""
    return F.size(F.array_intersect(n_numbers, F.transform(c_numbers, lambda c: length - c)))


def fragment_coverage(n_numbers: Column, c_places: Column, length: Column) -> Column:
    """The residues that matched fragments pin down, ascending.

    `n_numbers` are the residues at which N-terminal fragments end, `c_places` those at which C-terminal ones begin, from 1. A residue is covered
    between two N-terminal fragments in a row, between two C-terminal ones, or between one of each; the ends need one fragment. Of the
    N-terminal fragments the first only counts for the first residue, as where it ends nothing is known of the residue before.
    """
    n, c = F.array_sort(F.array_distinct(n_numbers)), F.array_sort(F.array_distinct(c_places))
    later = F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(0)))
    none = F.array().cast("array<int>")
    one = lambda condition, x: F.when(condition, F.array(x)).otherwise(none)
    parts = [
        one(F.array_contains(n, length - 1) | F.array_contains(c, length), length), one(F.array_contains(n, 1) | F.array_contains(c, 2), F.lit(1)),
        F.filter(later, lambda x: F.array_contains(n, x - 1) | F.array_contains(c, x)), F.transform(F.filter(later, lambda x: F.array_contains(c, x + 2)), lambda x: x + 1),
        F.filter(c, lambda x: F.array_contains(c, x + 1)),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def mobility(charge: Column, mass: Column) -> Column:
    """The predicted mobility of an ion in capillary electrophoresis."""
    return F.log(1 + 0.35 * charge) / F.pow(mass, F.lit(0.411)) * 100


def weighted_error(rows: DataFrame, keys: Sequence[str], error: str, log_intensity: str) -> DataFrame:
    """The mean error weighted by intensity."""
    weight = F.pow(F.lit(10.0), F.col(log_intensity))
    return rows.groupBy(*keys).agg((F.sum(weight * F.col(error)) / F.sum(weight)).alias("mean_error"))


def most_intense_child(scans: DataFrame, keys: Sequence[str], intensity: str, scan: str) -> DataFrame:
    """(`keys`, `scan`): of each precursor scan its most intense fragment scan, of equal ones the least `scan`."""
    return scans.groupBy(*keys).agg(F.max_by(scan, F.struct(F.col(intensity), -F.col(scan))).alias(scan))


def binned_statistics(rows: DataFrame, keys: Sequence[str], x: Column, y: str, least_stdev: float = 0.5, most_ratio: float = 3.0) -> DataFrame:
    """Mean and sample standard deviation of `y` in each bin of `x`; a deviation that is missing, tiny or over three times the overall one is replaced by it."""
    bins = rows.groupBy(*keys, x.alias("bin")).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("stdev"), F.count(F.lit(1)).alias("n"))
    overall = rows.groupBy(*keys).agg(F.stddev_samp(y).alias("overall"))
    s, g = F.col("stdev"), F.col("overall")
    odd = s.isNull() | F.isnan(s) | (s < least_stdev) | (s > most_ratio * g)
    return bins.join(overall, list(keys)).withColumn("stdev", F.when(odd, g).otherwise(s)).drop("overall")


def new_tolerance(rows: DataFrame, keys: Sequence[str], error: str, factor: float) -> DataFrame:
    """Median, interquartile range and the tolerance of `factor` ranges beyond the median's size, to a tenth."""
    q = F.percentile(error, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*keys).agg(q.alias("q__")).select(*keys, F.col("q__")[1].alias("median"), (F.col("q__")[2] - F.col("q__")[0]).alias("iqr"))
    return out.withColumn("tolerance", F.round(factor * F.col("iqr") + F.abs("median"), 1))


def calibration_accepted(before: dict[str, float], after: dict[str, float]) -> bool:
    """Both counts up; or neither down and both median errors at most 1 ppm or no larger than before."""
    counts = ("psms", "peptides")
    if all(after[c] > before[c] for c in counts):
        return True
    if any(after[c] < before[c] for c in counts):
        return False
    return all(abs(after[m]) <= 1 or abs(after[m]) <= abs(before[m]) for m in ("precursor_ppm", "product_ppm"))


def localization_level(routes: DataFrame, keys: Sequence[str], site: str, mod: str, route: str) -> DataFrame:
    """Each site and modification with the share of routes that have it, and the match's level.

    Level 1: every modification is at one site in all routes; 2: some are; 3: none is.
    """
    total = routes.groupBy(*keys).agg(F.countDistinct(route).alias("n_routes"))
    pairs = routes.groupBy(*keys, site, mod).agg(F.countDistinct(route).alias("n")).join(total, list(keys))
    sure = pairs.withColumn("sure", F.col("n") == F.col("n_routes"))
    level = sure.groupBy(*keys).agg(F.bool_and("sure").alias("all__"), F.bool_or("sure").alias("any__"))
    level = level.select(*keys, F.when(F.col("all__"), 1).when(F.col("any__"), 2).otherwise(3).alias("level"))
    return sure.join(level, list(keys))


def site_probability(routes: DataFrame, keys: Sequence[str], site: str, mod: str, weight: str) -> DataFrame:
    """The weight of the routes through each site and modification over the weight of all routes (A25); a route is one row for each of its sites."""
    total = routes.groupBy(*keys, "route").agg(F.max(weight).alias("w__")).groupBy(*keys).agg(F.sum("w__").alias("total__"))
    part = routes.groupBy(*keys, site, mod).agg(F.sum(weight).alias("part__"))
    return part.join(total, list(keys)).select(*keys, site, mod, (F.col("part__") / F.col("total__")).alias("probability"))


def median_polish(matrix: np.ndarray, rounds: int = 10, tolerance: float = 1e-6) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(overall, row effects, column effects, residuals) by taking medians off rows and columns in turn; NaN cells don't count."""
    rest = np.array(matrix, float)
    rows, cols, overall = np.zeros(rest.shape[0]), np.zeros(rest.shape[1]), 0.0
    for _ in range(rounds):
        r = np.nanmedian(rest, axis=1)
        rest -= r[:, None]
        rows += r
        c = np.nanmedian(rest, axis=0)
        rest -= c[None, :]
        cols += c
        shift = np.nanmedian(rows)
        overall, rows = overall + shift, rows - shift
        shift = np.nanmedian(cols)
        overall, cols = overall + shift, cols - shift
        if np.nanmax(np.abs(r)) < tolerance and np.nanmax(np.abs(c)) < tolerance:
            break
    return overall, rows, cols, rest


def protein_rollup(peptides: DataFrame, protein: str, peptide: str, sample: str, intensity: str) -> DataFrame:
    """A protein's abundance in each sample by median polish of its peptides' log2 intensities (A35); a protein's peptides fit in memory."""

    def polish(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.assign(v=np.log2(pdf[intensity].astype(float))).pivot_table(index=peptide, columns=sample, values="v", aggfunc="max").sort_index(axis=0).sort_index(axis=1)
        overall, _, columns, _ = median_polish(wide.to_numpy())
        return pd.DataFrame({protein: pdf[protein].iloc[0], sample: wide.columns, "abundance": overall + columns})

    kinds = {c: peptides.schema[c].dataType.simpleString() for c in (protein, sample)}
    ok = peptides.filter((F.col(intensity) > 0) & ~F.isnan(intensity)).select(protein, peptide, sample, intensity)
    return ok.groupBy(protein).applyInPandas(polish, f"{protein} {kinds[protein]}, {sample} {kinds[sample]}, abundance double")
