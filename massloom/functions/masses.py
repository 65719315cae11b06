"""Masses, tolerances, bins and chances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masses in dalton.
PROTON = 1.007276466879
ISOTOPE_STEP = 1.00335483810
WATER = 18.010564684
AMMONIA = 17.026549101
LOW_RES_BIN = 1.0005079
#: Monoisotopic residue masses of the amino acids.
RESIDUES = {
    "A": 71.03711381, "C": 103.00918451, "D": 115.02694307, "E": 129.04259313, "F": 147.06841395, "G": 57.02146374, "H": 137.05891188, "I": 113.08406402, "K": 128.09496305, "L": 113.08406402,
    "M": 131.04048464, "N": 114.04292747, "P": 97.05276389, "Q": 128.05857754, "R": 156.10111106, "S": 87.03202843, "T": 101.04767851, "U": 150.95363559, "V": 99.06841395, "W": 186.07931300, "Y": 163.06332857,
}


def to_mass(mz: Column, charge: Column) -> Column:
    """The neutral mass of an ion."""
    return mz * F.abs(charge) - charge * PROTON


def to_mz(mass: Column, charge: Column) -> Column:
    return (mass + charge * PROTON) / F.abs(charge)


def tolerance_bounds(mass: Column, value: float, ppm: bool = True) -> tuple[Column, Column]:
    """The least and the greatest mass within the tolerance of `mass`."""
    return (mass * (1 - value / 1e6), mass * (1 + value / 1e6)) if ppm else (mass - value, mass + value)


def within(a: Column, b: Column, value: float, ppm: bool = True) -> Column:
    """Whether `a` is within the tolerance of `b`, the bounds included."""
    lo, hi = tolerance_bounds(b, value, ppm)
    return a.between(lo, hi)


def low_res_bin(mass: Column) -> Column:
    """The number of the low-resolution bin; halves go to the even number."""
    return F.rint(mass / LOW_RES_BIN).cast("bigint")


def mass_bin(mass: Column, per_dalton: int = 1000) -> Column:
    """The number of the bin of the fragment index."""
    return F.rint(mass * per_dalton).cast("bigint")


def mass_error_da(observed: Column, theoretical: Column) -> Column:
    return F.round(observed - theoretical, 5)


def mass_error_ppm(observed: Column, theoretical: Column) -> Column:
    return F.round((observed - theoretical) / theoretical * 1e6, 2)


def capped_z(value: Column, mean: Column, stdev: Column, cap: float = 10.0) -> Column:
    """The absolute z score, `cap` at most and where it isn't a number (X11)."""
    z = F.abs(value - mean) / stdev
    return F.when(stdev.isNull() | (stdev == 0) | F.isnan(z), cap).otherwise(F.least(z, F.lit(cap)))


def decoy_share_z(decoys: Column, n: Column) -> Column:
    """How many standard deviations a bin's share of decoys is below one half."""
    return (0.5 - decoys / n) / F.sqrt(0.25 / n)


def overlap_ratio(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """The common part of two ranges over their union's span; 0 if they are apart or touch."""
    common = F.least(end_a, end_b) - F.greatest(start_a, start_b)
    span = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    return F.when((common <= 0) | (span <= 0), 0.0).otherwise(common / span)


def contained_ratio(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """The common part over the first range's length: 1 if it lies within the second."""
    common = F.least(end_a, end_b) - F.greatest(start_a, start_b)
    return F.when((common <= 0) | (end_a <= start_a), 0.0).otherwise(common / (end_a - start_a))


def shortened(cell: Column, most: int = 32_000, note: str = "Output too long") -> Column:
    """A cell for a text table, a note if it is too long."""
    return F.when(F.length(cell) > most, note).otherwise(cell)


def protein_position(start: Column, mod_key: Column, peptide_length: Column) -> Column:
    """The residue of the protein that a modification key of a peptide names: 1 is its N-terminus, i + 1 residue i, length + 2 the C-terminus."""
    return F.when(mod_key == 1, start).when(mod_key == peptide_length + 2, start + peptide_length - 1).otherwise(start + mod_key - 2)


def normal_cdf(z: Column) -> Column:
    """The chance of at most `z` under the normal distribution (X13), by a rational approximation of the error function within 2e-7."""
    #: Coefficients of the approximation.
    c = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = ((((c[4] * t + c[3]) * t + c[2]) * t + c[1]) * t + c[0]) * t * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def chance_weight(matched: Column, tried: Column, p: float) -> Column:
    """One over the chance of at least `matched` of `tried` random hits (X12); 1 where nothing was tried or matched."""
    first = F.aggregate(F.sequence(F.lit(1), matched), F.lit(1.0), lambda acc, i: acc * (tried - matched + i) / i * p) * F.pow(F.lit(1 - p), tried - matched)
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (tried - j + 1) / j * (p / (1 - p))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    more = F.when(matched < tried, F.sequence(matched + 1, tried)).otherwise(F.array().cast("array<int>"))
    return F.when((matched > 0) & (tried > 0), 1 / F.aggregate(more, start, step, lambda acc: acc["total"])).otherwise(1.0)


def source_voltage(scan_filter: Column) -> Column:
    """The in-source fragmentation voltage that a scan's filter line names, null if none."""
    found = F.regexp_extract(scan_filter, r"sid=(\d+)", 1)
    return F.when(found != "", found.try_cast("int"))


def safe_file_name(name: Column) -> Column:
    """A name with characters that file systems don't take, control characters among them, as underscores."""
    return F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_")


def extension(path: Column) -> Column:
    """The lower-case ending of a file, a compressed one's own ending included; null without one."""
    found = F.regexp_extract(F.lower(path), r"(\.[a-z0-9_]+(?:\.gz)?)$", 1)
    return F.when(found != "", found)
