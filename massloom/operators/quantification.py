"""Quantification: apex intensities, labels, reporters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators.joins import band_join


def apex_intensities(matches: DataFrame, peaks: DataFrame, ppm: float = 10.0, minutes: float = 1.0) -> DataFrame:
    """(file, sequence, charge, intensity): the highest survey peak near the match's m/z and time, of all its matches.

    `matches` has file, sequence, charge, mz and rt; `peaks` has file, mz, rt and intensity.
    """
    wanted = matches.select("file", "sequence", "charge", F.col("rt").alias("rt__"), (F.col("mz") * (1 - ppm / 1e6)).alias("lo"), (F.col("mz") * (1 + ppm / 1e6)).alias("hi"))
    found = band_join(wanted, peaks, "lo", "hi", "mz", 4 * ppm / 1e6, ["file"], F.log).filter(F.abs(F.col("rt") - F.col("rt__")) <= minutes)
    return found.groupBy("file", "sequence", "charge").agg(F.max("intensity").alias("intensity"))


def matched_between_runs(known: DataFrame, shifts: DataFrame, peaks: DataFrame, ppm: float = 10.0, minutes: float = 0.5) -> DataFrame:
    """Intensities of sequences in files where they weren't matched, at the time of another file moved by the files' median shift.

    `known` has file, sequence, charge, mz, rt; `shifts` (from_file, to_file, shift) are medians over shared sequences.
    """
    donors = known.join(shifts, known["file"] == shifts["from_file"]).select(F.col("to_file").alias("file"), "sequence", "charge", "mz", (F.col("rt") + F.col("shift")).alias("rt"))
    missing = donors.join(known.select("file", "sequence", "charge"), ["file", "sequence", "charge"], "left_anti")
    return apex_intensities(missing.groupBy("file", "sequence", "charge").agg(F.avg("mz").alias("mz"), F.percentile("rt", 0.5).alias("rt")), peaks, ppm, minutes).withColumn("is_transferred", F.lit(True))


def time_shifts(known: DataFrame) -> DataFrame:
    """(from_file, to_file, shift): the median difference of retention times of the sequences that two files share; files are few."""
    a = known.groupBy("file", "sequence").agg(F.avg("rt").alias("rt"))
    b = a.select(F.col("file").alias("to_file"), "sequence", F.col("rt").alias("to_rt"))
    return a.join(b, "sequence").filter("file <> to_file").groupBy(F.col("file").alias("from_file"), "to_file").agg(F.percentile(F.col("to_rt") - F.col("rt"), 0.5).alias("shift"))


def normalized(rows: DataFrame, sample: str, key: Sequence[str], intensity: str) -> DataFrame:
    """Intensities divided by their sample's median ratio to the geometric mean of each row over the samples."""
    logs = rows.filter(F.col(intensity) > 0).withColumn("log__", F.log(intensity))
    centre = logs.groupBy(*key).agg(F.avg("log__").alias("centre__"), F.count(F.lit(1)).alias("n__")).filter("n__ > 1")
    factor = logs.join(centre, list(key)).groupBy(sample).agg(F.percentile(F.col("log__") - F.col("centre__"), 0.5).alias("factor__"))
    return rows.join(factor, sample, "left").withColumn(intensity, F.col(intensity) / F.exp(F.coalesce("factor__", F.lit(0.0)))).drop("factor__")


def relabelled(sequence: Column, light: str, heavy: str) -> Column:
    """A sequence with each light residue replaced by the letter of its heavy form."""
    return F.translate(sequence, light, heavy)


def label_series(rows: DataFrame, sequence: str, residue: str, heavy: str) -> DataFrame:
    """A row for each number of heavy residues that a sequence can have: the light, mixed and heavy forms of turnover."""
    n = F.length(sequence) - F.length(F.translate(F.col(sequence), residue, ""))
    return rows.withColumn("n_sites", n).withColumn("n_heavy", F.explode(F.sequence(F.lit(0), F.col("n_sites")))).withColumn("heavy_letter", F.lit(heavy))


def turnover(rows: DataFrame, keys: Sequence[str], n_heavy: str, n_sites: str, intensity: str) -> DataFrame:
    """(`keys`, old, new, n_evidence): intensity split by the share of heavy residues; 0 unless two units of evidence back it.

    A form that is all light or all heavy is two units, a mixed one is one.
    """
    pure = (F.col(n_heavy) == 0) | (F.col(n_heavy) == F.col(n_sites))
    share = F.when(F.col(n_sites) > 0, F.col(n_heavy) / F.col(n_sites)).otherwise(0.0)
    seen = F.col(intensity) > 0
    out = rows.groupBy(*keys).agg(F.sum(F.when(seen, F.when(pure, 2).otherwise(1)).otherwise(0)).alias("n_evidence"), F.sum(F.when(seen, F.col(intensity) * (1 - share)).otherwise(0.0)).alias("old__"), F.sum(F.when(seen, F.col(intensity) * share).otherwise(0.0)).alias("new__"))
    enough = F.col("n_evidence") >= 2
    return out.withColumn("old", F.when(enough, F.col("old__")).otherwise(0.0)).withColumn("new", F.when(enough, F.col("new__")).otherwise(0.0)).drop("old__", "new__")


def shared_scan_intensity(rows: DataFrame, keys: Sequence[str], scan: str, label: str, intensity: str, n_labels: int) -> DataFrame:
    """The intensity of each label summed over the scans in which all labels were seen."""
    full = rows.filter(F.col(intensity) > 0).groupBy(*keys, scan).agg(F.countDistinct(label).alias("n__")).filter(F.col("n__") == n_labels)
    return rows.join(full.select(*keys, scan), [*keys, scan]).groupBy(*keys, label).agg(F.sum(intensity).alias(intensity))


def reporter_intensities(mz: Column, intensity: Column, reporters: Sequence[float], tolerance: float = 0.003) -> Column:
    """The highest peak within the tolerance of each reporter, 0 if there is none; a peak counts for the first reporter that it fits."""
    peaks = F.arrays_zip(mz.alias("mz"), intensity.alias("intensity"))
    out, before = [], float("-inf")
    for r in sorted(reporters):
        lo = max(r - tolerance, before)
        mine = F.filter(peaks, _between(lo, r + tolerance))
        out.append(F.coalesce(F.array_max(F.transform(mine, lambda p: p["intensity"])), F.lit(0.0)))
        before = r + tolerance
    return F.array(*out)


def _between(lo: float, hi: float):
    return lambda p: (p["mz"] > lo) & (p["mz"] <= hi)


def fractional_intensity(peaks: Column, lo: Column, hi: Column, own: Column) -> Column:
    """An envelope's share of all intensity in the isolation range."""
    total = F.aggregate(F.filter(peaks, lambda p: p["mz"].between(lo, hi)), F.lit(0.0), lambda acc, p: acc + p["intensity"])
    return F.when(total > 0, own / total)
