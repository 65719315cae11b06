"""Predicates on matches, masses, motifs and ions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions.masses import ISOTOPE_STEP


@dataclass(frozen=True)
class Acceptor:
    """A mass-difference acceptor: `kind` is dot, interval, open, daltons or ppm."""

    name: str
    kind: str
    shifts: tuple[float, ...] = ()
    intervals: tuple[tuple[float, float], ...] = ()
    tolerance: float = 0.0
    in_ppm: bool = True


#: The shifts of the named presets, in dalton.
PRESETS = {
    "Exact": Acceptor("Exact", "ppm", tolerance=5.0),
    "OneMissedMonoisotopicPeak": Acceptor("OneMissedMonoisotopicPeak", "dot", (0.0, 1.0029), tolerance=5.0),
    "TwoMissedMonoisotopicPeaks": Acceptor("TwoMissedMonoisotopicPeaks", "dot", (0.0, 1.0029, 2.0052), tolerance=5.0),
    "ThreeMissedMonoisotopicPeaks": Acceptor("ThreeMissedMonoisotopicPeaks", "dot", (0.0, 1.0029, 2.0052, 3.0077), tolerance=5.0),
    "PlusOrMinusThreeMissedMonoisotopicPeaks": Acceptor("PlusOrMinusThreeMissedMonoisotopicPeaks", "dot", tuple(k * ISOTOPE_STEP for k in range(-3, 4)), tolerance=5.0),
    "ModOpen": Acceptor("ModOpen", "interval", intervals=((-187.0, float("inf")),)),
    "Open": Acceptor("Open", "open"),
}


def parse_acceptor(text: str) -> Acceptor:
    """`NAME dot 5 ppm 0,1.0029`, `NAME interval [a,b];[c,d]`, `NAME OpenSearch`, `NAME daltonsAroundZero 2.1`, `NAME ppmAroundZero 5`."""
    words = text.split()
    if len(words) < 2:
        raise ValueError(f"not a mass-difference acceptor: {text!r}")
    name, kind, rest = words[0], words[1].lower(), words[2:]
    try:
        if kind == "opensearch":
            return Acceptor(name, "open")
        if kind == "daltonsaroundzero":
            return Acceptor(name, "daltons", tolerance=float(rest[0]))
        if kind == "ppmaroundzero":
            return Acceptor(name, "ppm", tolerance=float(rest[0]))
        if kind == "interval":
            found = re.findall(r"\[([^,\]]+),([^\]]+)\]", "".join(rest))
            if found:
                return Acceptor(name, "interval", intervals=tuple((float(a), float(b)) for a, b in found))
        if kind == "dot" and rest[1].lower() in ("ppm", "da"):
            return Acceptor(name, "dot", tuple(float(x) for x in "".join(rest[2:]).split(",")), tolerance=float(rest[0]), in_ppm=rest[1].lower() == "ppm")
    except (IndexError, ValueError) as e:
        raise ValueError(f"not a mass-difference acceptor: {text!r}") from e
    raise ValueError(f"not a mass-difference acceptor: {text!r}")


def accepted(acceptor: Acceptor, observed: Column, theoretical: Column) -> Column:
    """The notch of an accepted pair of masses, null if it isn't accepted.

    The notch of a shift is 100,000 times it, rounded; of several shifts that fit, the smallest counts, the positive one first. Negative
    shifts are shifts like others. The rules around zero exclude their bounds, the others include them.
    """
    difference = observed - theoretical
    if acceptor.kind == "open":
        return F.when(observed.isNotNull() & theoretical.isNotNull(), 0)
    if acceptor.kind == "daltons":
        return F.when(F.abs(difference) < acceptor.tolerance, 0)
    if acceptor.kind == "ppm":
        return F.when(F.abs(difference / theoretical * 1e6) < acceptor.tolerance, 0)
    if acceptor.kind == "interval":
        inside = [difference.between(a, b) for a, b in acceptor.intervals]
        return F.when(_any(inside), 0)
    out = F.lit(None).cast("int")
    for shift in sorted(acceptor.shifts, key=lambda s: (abs(s), s < 0), reverse=True):
        reach = (theoretical + shift) * acceptor.tolerance / 1e6 if acceptor.in_ppm else F.lit(acceptor.tolerance)
        out = F.when(F.abs(difference - shift) <= reach, round(shift * 1e5)).otherwise(out)
    return out


def allowed_intervals(acceptor: Acceptor, theoretical: Column) -> Column:
    """An array of (notch, lo, hi): the observed masses that the acceptor takes for a theoretical one, for a band join (F14 is their span)."""
    rows = []
    if acceptor.kind == "open":
        rows = [(0, F.lit(float("-inf")), F.lit(float("inf")))]
    elif acceptor.kind == "daltons":
        rows = [(0, theoretical - acceptor.tolerance, theoretical + acceptor.tolerance)]
    elif acceptor.kind == "ppm":
        rows = [(0, theoretical * (1 - acceptor.tolerance / 1e6), theoretical * (1 + acceptor.tolerance / 1e6))]
    elif acceptor.kind == "interval":
        rows = [(0, theoretical + a, theoretical + b) for a, b in acceptor.intervals]
    else:
        for s in sorted(acceptor.shifts, key=lambda s: (abs(s), s < 0)):
            reach = (theoretical + s) * acceptor.tolerance / 1e6 if acceptor.in_ppm else F.lit(acceptor.tolerance)
            rows.append((round(s * 1e5), theoretical + s - reach, theoretical + s + reach))
    return F.array(*[F.struct(F.lit(n).alias("notch"), lo.alias("lo"), hi.alias("hi")) for n, lo, hi in rows])


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def motif_pattern(motif: str) -> tuple[str, int]:
    """A regular expression for a target motif (one upper-case anchor, `X` any residue) and the anchor's offset in it."""
    anchors = [i for i, c in enumerate(motif) if c.isupper() and c != "X"] or [0]
    body = "".join("[A-Z]" if c.upper() == "X" else re.escape(c.upper()) for c in motif)
    return body, anchors[0]


def motif_sites(sequence: Column, motif: str) -> Column:
    """1-based places of the anchors of a motif, overlapping ones included."""
    body, offset = motif_pattern(motif)
    width = len(motif)
    starts = F.sequence(F.lit(1), F.greatest(F.length(sequence) - width + 1, F.lit(1)))
    hits = F.filter(starts, lambda i: F.substring(sequence, i, F.lit(width)).rlike(f"^{body}$"))
    return F.transform(hits, lambda i: i + offset)


def linker_sites(sequence: Column, residues: str, at_cleavage: bool = False) -> Column:
    """1-based places where a crosslinker can bind: its residues, the last one only where cleavage there isn't blocked; `X` stands for any."""
    places = F.sequence(F.lit(1), F.length(sequence))
    wanted = F.lit(True) if "X" in residues else None

    def fits(i: Column) -> Column:
        letter = F.substring(sequence, i, F.lit(1))
        ok = wanted if wanted is not None else letter.isin(*residues)
        return ok if at_cleavage else ok & (i < F.length(sequence))

    return F.when(F.length(sequence) > 0, F.filter(places, fits)).otherwise(F.array().cast("array<int>"))


def oxonium_ok(hexnac: Column, neuac_ions: Column, has_neuac: Column) -> Column:
    """Whether the ions of sialic acid, relative to HexNAc above 0.02, agree with the composition."""
    seen = (hexnac > 0) & (neuac_ions / hexnac > 0.02)
    return F.when(has_neuac, seen).otherwise(~seen)


def has_core(core_ions: Column) -> Column:
    """Whether the matched core ions show a trimannosyl core: more than two, or those of 83 and 203 dalton."""
    distinct = F.array_distinct(core_ions)
    return (F.size(distinct) > 2) | (F.array_contains(distinct, 83) & F.array_contains(distinct, 203))


def viewer_filter(rows: DataFrame, q: str, q_limit: float, kind: str, kinds: str, level: str | None = None, levels: tuple[str, ...] = ()) -> DataFrame:
    """Rows with q at most the limit or none, of the wanted target, decoy and contaminant letters and ambiguity levels."""
    out = rows.filter(F.col(q).isNull() | (F.col(q) <= q_limit)).filter(F.col(kind).isin(*kinds))
    return out.filter(F.col(level).isin(*levels)) if level else out


def search_filter(rows: DataFrame, text: str, scan: str, sequence: str, names: tuple[str, ...]) -> DataFrame:
    """Rows whose scan number starts with the text, or whose sequence (in any case) or names hold it."""
    hit = F.col(scan).cast("string").startswith(text) | F.contains(F.upper(F.col(sequence)), F.lit(text.upper()))
    for n in names:
        hit = hit | F.contains(F.col(n), F.lit(text))
    return rows.filter(F.coalesce(hit, F.lit(False)))


def top_peaks(peaks: DataFrame, scan: str, mz: str, intensity: str, per_window: int, window: float | None = None, least_ratio: float = 0.0) -> DataFrame:
    """The `per_window` highest peaks of each m/z window of a scan, of at least `least_ratio` of the scan's base peak."""
    bucket = F.floor(F.col(mz) / window) if window else F.lit(0)
    base = peaks.withColumn("base__", F.max(intensity).over(Window.partitionBy(scan))).withColumn("window__", bucket)
    strong = base.filter(F.col(intensity) >= F.col("base__") * least_ratio)
    place = F.row_number().over(Window.partitionBy(scan, "window__").orderBy(F.desc(intensity), F.asc(mz)))
    return strong.withColumn("place__", place).filter(F.col("place__") <= per_window).drop("base__", "window__", "place__")


def gptmd_direction(n_sites: Column, c_sites: Column, site: Column, length: Column, rule: str) -> Column:
    """Whether ions support a site: from both sides, from one, or just beside it (F8).

    `n_sites` are fragment numbers from the N-terminus, `c_sites` residues at which C-terminal fragments begin, both as 1-based residues.
    """
    n_ok = F.exists(n_sites, lambda x: x >= site)
    c_ok = F.exists(c_sites, lambda x: x <= site)
    if rule == "dual":
        return n_ok & c_ok
    if rule == "uni":
        return n_ok | c_ok
    beside = F.array_contains(n_sites, site) & (F.array_contains(n_sites, site - 1) | (site == 1))
    beside_c = F.array_contains(c_sites, site) & (F.array_contains(c_sites, site + 1) | (site == length))
    return beside | beside_c


def improved_score(new: Column, old: Column) -> Column:
    """Whether a modification raises the score (F8)."""
    return new > old


def modification_sites(rows: DataFrame, sequence: str, mods: DataFrame, known: DataFrame | None = None, keys: tuple[str, ...] = ("accession",), tolerance: float = 0.005) -> DataFrame:
    """(`keys`, modification, mass, site): where each listed modification can sit.

    `mods` has modification, motif, location (`anywhere`, `n_term` or `c_term`) and mass; it is a list of up to MOST_LISTED rows, so each motif is
    looked for in one pass over the sequences. `known` has `keys`, site and mass of what is there already: a modification of nearly the same
    mass at the same site is left out.
    """
    from massloom.operators.joins import listed

    found = []
    for name, motif, location, mass in listed(mods, "modification", "motif", "location", "mass"):
        sites = motif_sites(F.col(sequence), motif)
        if location == "n_term":
            sites = F.filter(sites, lambda s: s == 1)
        elif location == "c_term":
            sites = F.filter(sites, lambda s: s == F.length(sequence))
        found.append(F.transform(sites, _placed(name, mass)))
    if not found:
        return rows.select(*keys, F.lit("").alias("modification"), F.lit(0.0).alias("mass"), F.lit(0).alias("site")).limit(0)
    every = rows.filter(F.length(sequence) > 0).select(*keys, F.inline(F.flatten(F.array(*found))))
    if known is None:
        return every
    there = known.select(*keys, "site", F.col("mass").alias("mass__"))
    near = every.join(there, [*keys, "site"]).filter(F.abs(F.col("mass") - F.col("mass__")) < tolerance).select(*keys, "modification", "site")
    return every.join(near.distinct(), [*keys, "modification", "site"], "left_anti").select(*keys, "modification", "mass", "site")


def _placed(name: str, mass: float):
    return lambda s: F.struct(F.lit(name).alias("modification"), F.lit(float(mass)).alias("mass"), s.alias("site"))


def precursor_span(acceptor: Acceptor, theoretical: Column) -> tuple[Column, Column]:
    """The least and the greatest observed mass that an acceptor can take for a theoretical one, over all its notches: a pre-filter."""
    spans = allowed_intervals(acceptor, theoretical)
    return F.array_min(F.transform(spans, lambda s: s["lo"])), F.array_max(F.transform(spans, lambda s: s["hi"]))
