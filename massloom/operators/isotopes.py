"""Isotope patterns, deconvolution, assignment of envelopes and averaging of spectra."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions.masses import ISOTOPE_STEP, PROTON

#: Chances of the isotopes of an element by extra neutrons, and the elements of an average residue with its mass.
ISOTOPES = {"C": (0.9893, 0.0107), "H": (0.999885, 0.000115), "N": (0.99636, 0.00364), "O": (0.99757, 0.00038, 0.00205), "S": (0.9499, 0.0075, 0.0425, 0.0, 0.0001)}
AVERAGE_RESIDUE = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
AVERAGE_MASS = 111.05430526
#: Peaks of a pattern below this share of its highest one are left off at its end.
LEAST_SHARE = 0.01


def isotope_pattern(counts: dict[str, int], peaks: int = 12) -> np.ndarray:
    """The chances of 0, 1, 2, ... extra neutrons of a formula (X8): each element's isotopes raised to its count by squaring, then multiplied."""
    out = np.ones(1)
    for element, n in counts.items():
        power, base = np.ones(1), np.array(ISOTOPES[element])
        while n:
            if n & 1:
                power = np.convolve(power, base)[:peaks]
            base = np.convolve(base, base)[:peaks]
            n >>= 1
        out = np.convolve(out, power)[:peaks]
    return out


@lru_cache(maxsize=4096)
def average_pattern(tens: int) -> np.ndarray:
    """The pattern of an average peptide of ten times `tens` dalton, cut where it fades, its highest peak 1."""
    n = max(10.0 * tens, 50.0) / AVERAGE_MASS
    p = isotope_pattern({e: round(k * n) for e, k in AVERAGE_RESIDUE.items()}, 60)
    p = p / p.max()
    return p[: np.flatnonzero(p >= LEAST_SHARE)[-1] + 1]


def deconvolute(mz: np.ndarray, intensity: np.ndarray, charges: Sequence[int], ppm: float = 10.0, least_peaks: int = 2, least_share: float = 0.5) -> list[tuple[float, int, float, int]]:
    """(monoisotopic mass, charge, total intensity, peaks) of the envelopes of a spectrum, most intense first.

    The highest peak left is tried as the highest peak of an average peptide's pattern at each charge. Peaks of the pattern are looked for within the
    tolerance; one that is missing ends the pattern on its side. The charge whose found peaks hold the most intensity of the expected pattern wins, of equal ones the one with
    more peaks, then the lower charge. Found peaks are used up; a peak with no envelope is passed.
    """
    order = np.argsort(mz, kind="stable")
    mz, intensity = mz[order], intensity[order].astype(float)
    left = np.ones(len(mz), bool)
    out = []
    for top in np.argsort(-intensity, kind="stable").tolist():
        if not left[top]:
            continue
        best = None
        for z in charges:
            pattern = average_pattern(round((mz[top] - PROTON) * abs(z) / 10))
            apex = int(pattern.argmax())
            found = {apex: top}
            for step in (-1, 1):
                k = apex + step
                while 0 <= k < len(pattern):
                    at = _nearest(mz, left, mz[top] + (k - apex) * ISOTOPE_STEP / abs(z), ppm)
                    if at < 0 or at in found.values() or intensity[at] > 4 * intensity[top] * max(pattern[k], LEAST_SHARE):
                        break
                    found[k] = at
                    k += step
            share = pattern[list(found)].sum() / pattern.sum()
            if len(found) >= least_peaks and share >= least_share:
                rank = (round(share, 6), len(found), -abs(z))
                if best is None or rank > best[0]:
                    best = (rank, z, found, apex)
        if best is not None:
            _, z, found, apex = best
            places = list(found.values())
            mass = (mz[top] - PROTON * np.sign(z)) * abs(z) - apex * ISOTOPE_STEP
            out.append((float(mass), int(z), float(intensity[places].sum()), len(places)))
            left[places] = False
    return out


def _nearest(mz: np.ndarray, left: np.ndarray, wanted: float, ppm: float) -> int:
    a, b = np.searchsorted(mz, [wanted * (1 - ppm / 1e6), wanted * (1 + ppm / 1e6)])
    near = [i for i in range(a, b) if left[i]]
    return min(near, key=lambda i: (abs(mz[i] - wanted), i)) if near else -1


def deconvoluted(spectra: DataFrame, key: str, charges: Sequence[int] = (1, 2, 3, 4, 5, 6), ppm: float = 10.0) -> DataFrame:
    """(`key`, mass, charge, intensity, n_peaks) of each envelope of spectra (`key`, mz, intensity) (X6). Null and empty spectra give no rows."""

    @F.pandas_udf("array<struct<mass:double,charge:int,intensity:double,n_peaks:int>>")
    def envelopes(mz: pd.Series, intensity: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("mass", "charge", "intensity", "n_peaks"), e, strict=True)) for e in deconvolute(np.asarray(m, float), np.asarray(i, float), charges, ppm)] for m, i in zip(mz, intensity, strict=True)])

    rows = spectra.filter(F.size("mz") > 0)
    return rows.select(F.col(key), F.explode(envelopes("mz", "intensity")).alias("e")).select(key, "e.*")


def envelopes_of():
    """A pandas UDF: (mz, intensity) of an average peptide's pattern of a mass and a charge, its highest peak 1: the inverse of `deconvolute`."""

    @F.pandas_udf("struct<mz:array<double>,intensity:array<double>>")
    def envelope(mass: pd.Series, charge: pd.Series) -> pd.DataFrame:
        rows = []
        for m, z in zip(mass, charge, strict=True):
            p = average_pattern(round(m / 10))
            rows.append((((m + np.arange(len(p)) * ISOTOPE_STEP) / abs(z) + PROTON * np.sign(z)).tolist(), p.tolist()))
        return pd.DataFrame(rows, columns=["mz", "intensity"])

    return envelope


def assign(costs: np.ndarray) -> list[int]:
    """The column of each row with the least total cost, -1 for rows left over (I11): the Hungarian method by shortest augmenting paths."""
    costs = np.asarray(costs, float)
    n, m = costs.shape
    if n > m:
        back = assign(costs.T)
        out = [-1] * n
        for c, r in enumerate(back):
            out[r] = c
        return out
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, here, low = row, -1, 0.0
        while True:
            reach = low + costs[at] - u[at] - v
            better = ~done & (reach < dist)
            dist[better], via[better] = reach[better], here
            here = int(np.where(done, np.inf, dist).argmin())
            low = dist[here]
            done[here] = True
            if match[here] < 0:
                break
            at = match[here]
        # Prices keep the reduced costs of the rows passed at 0.
        u[row] += low
        for c in np.flatnonzero(done):
            if c != here:
                u[match[c]] += low - dist[c]
                v[c] -= low - dist[c]
        while here >= 0:
            prior = via[here]
            match[here] = match[prior] if prior >= 0 else row
            here = prior
    out = [-1] * n
    for c, r in enumerate(match.tolist()):
        if r >= 0:
            out[r] = c
    return out


def assigned(groups: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(`key`, left_no, right_no, distance): precursors of a scan matched one to one to envelopes with the least total distance of mass.

    `left` and `right` are arrays of masses; places count from 0. Those left over on either side give no rows.
    """

    @F.pandas_udf("array<struct<left_no:int,right_no:int,distance:double>>")
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            d = np.abs(np.subtract.outer(np.asarray(x, float), np.asarray(y, float))) if len(x) and len(y) else np.zeros((0, 0))
            out.append([{"left_no": i, "right_no": c, "distance": float(d[i, c])} for i, c in enumerate(assign(d) if d.size else []) if c >= 0])
        return pd.Series(out)

    rows = groups.filter((F.size(left) > 0) & (F.size(right) > 0))
    return rows.select(key, F.explode(matched(left, right)).alias("m")).select(key, "m.*")


def averaged(peaks: DataFrame, keys: Sequence[str], scan: str, mz: str, intensity: str, width: float = 0.01, deviations: float = 1.5, n_scans: int | None = None) -> DataFrame:
    """(`keys`, bin, mz, intensity, n_kept) of the average of each group's scans.

    Peaks of all scans are put into bins of `width`, the highest of a scan in each; those farther than `deviations` sample deviations from
    the bin's mean are outliers and go. With `n_scans`, scans without a peak in a bin count as 0 in its intensity.
    """
    known = peaks.filter(F.col(mz).isNotNull() & F.col(intensity).isNotNull())
    top = known.groupBy(*keys, F.floor(F.col(mz) / width).alias("bin"), scan).agg(F.max_by(mz, intensity).alias("mz__"), F.max(intensity).cast("double").alias("i__"))
    stats = top.groupBy(*keys, "bin").agg(F.avg("i__").alias("mean__"), F.coalesce(F.stddev_samp("i__"), F.lit(0.0)).alias("sd__"))
    kept = top.join(stats, [*keys, "bin"]).filter(F.abs(F.col("i__") - F.col("mean__")) <= deviations * F.col("sd__") + 1e-9 * F.abs(F.col("mean__")))
    total = F.sum("i__")
    weighted = F.sum(F.col("mz__") * F.col("i__")) / total
    mean = total / F.lit(n_scans) if n_scans else F.avg("i__")
    return kept.groupBy(*keys, "bin").agg(F.when(total > 0, weighted).otherwise(F.avg("mz__")).alias("mz"), mean.alias("intensity"), F.count(F.lit(1)).alias("n_kept"))


def pattern_of(formula: Sequence[str] = ("C", "H", "N", "O", "S"), peaks: int = 6):
    """A pandas UDF: the isotope pattern of columns of element counts, in the order of `formula`."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def pattern(*counts: pd.Series) -> pd.Series:
        return pd.Series([isotope_pattern(dict(zip(formula, map(int, row), strict=True)), peaks) for row in zip(*counts, strict=True)])

    return pattern
