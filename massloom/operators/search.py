"""Peptides, fragments and searches."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions.masses import RESIDUES, WATER
from massloom.functions.text import bound
from massloom.operators.fdr import best_with_ties
from massloom.operators.joins import listed

#: Where enzymes cut, as a pattern of a piece with the cut at its end.
ENZYMES = {
    "trypsin": r"(?:[^KR]|[KR](?=P))*+(?:[KR](?!P)|\z)",
    "trypsin/P": r"[^KR]*+(?:[KR]|\z)",
    "Lys-C": r"[^K]*+(?:K|\z)",
    "Arg-C": r"[^R]*+(?:R|\z)",
    "Glu-C": r"[^E]*+(?:E|\z)",
    "chymotrypsin": r"(?:[^FWY]|[FWY](?=P))*+(?:[FWY](?!P)|\z)",
    "top-down": r".+",
}


def digest(proteins: DataFrame, keys: Sequence[str], sequence: str, enzyme: str = "trypsin", missed: int = 2, shortest: int = 7, longest: int = 50, clip_methionine: bool = False) -> DataFrame:
    """(`keys`, peptide, start, end, missed_cleavages) of every run of up to `missed` + 1 pieces (G1).

    Null and empty sequences give no rows. With `clip_methionine` peptides at the start also come out without a first M.
    """
    pieces = F.filter(F.regexp_extract_all(sequence, F.lit(ENZYMES[enzyme]), 0), lambda p: p != "")
    cut = proteins.filter(F.length(sequence) > 0).select(*keys, F.col(sequence).alias("seq__"), pieces.alias("p__"))
    ends = F.aggregate("p__", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    spans = cut.select(*keys, "seq__", ends.alias("e__")).select(*keys, "seq__", "e__", F.explode(F.sequence(F.lit(1), F.size("e__") - 1)).alias("i__"))
    spans = spans.select(*keys, "seq__", "e__", "i__", F.explode(F.sequence(F.lit(0), F.least(F.lit(missed), F.size("e__") - 1 - F.col("i__")))).alias("missed_cleavages"))
    start, end = F.element_at("e__", F.col("i__")) + 1, F.element_at("e__", F.col("i__") + F.col("missed_cleavages") + 1)
    found = spans.select(*keys, "seq__", start.alias("start"), end.alias("end"), "missed_cleavages")
    if clip_methionine:
        clipped = found.filter((F.col("start") == 1) & F.col("seq__").startswith("M")).withColumn("start", F.lit(2))
        found = found.unionByName(clipped)
    found = found.filter((F.col("end") - F.col("start") + 1).between(shortest, longest))
    return found.select(*keys, F.substring("seq__", F.col("start"), F.col("end") - F.col("start") + 1).alias("peptide"), "start", "end", "missed_cleavages")


def places_of(rows: DataFrame, part: str, whole: str) -> DataFrame:
    """`rows` once for each place where `part` stands in `whole`, overlapping places too, with `start` and `end` from 1.

    Null or empty parts and those found nowhere give no rows. Places after the first are looked for only where there is a second one.
    """
    first = rows.filter(F.length(part) > 0).withColumn("first__", F.expr(f"locate(`{part}`, `{whole}`)")).filter("first__ > 0")
    more = f"filter(sequence(first__, length(`{whole}`) - length(`{part}`) + 1), i -> substring(`{whole}`, i, length(`{part}`)) = `{part}`)"
    starts = F.when(F.expr(f"locate(`{part}`, `{whole}`, first__ + 1)") > 0, F.expr(more)).otherwise(F.array("first__"))
    return first.withColumn("start", F.explode(starts)).withColumn("end", F.col("start") + F.length(part) - 1).drop("first__")


def residue_masses(sequence: Column) -> Column:
    """The masses of a sequence's residues; null for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    return F.transform(F.split(sequence, ""), lambda a: F.try_element_at(table, a))


def peptide_mass(sequence: Column) -> Column:
    """The monoisotopic mass; null if a residue is unknown."""
    return F.aggregate(residue_masses(sequence), F.lit(WATER), lambda acc, m: acc + m)


def fragments(sequence: Column, kinds: str = "by") -> Column:
    """An array of (kind, number, mass) of the neutral fragments at every bond (G2); those with an unknown residue have a null mass."""
    return bound(residue_masses(sequence), lambda masses: _ladders(masses, kinds))


def _sums(masses: Column) -> Column:
    """The sums of the first 0, 1, 2, ... masses; null from an unknown one on."""
    return F.aggregate(masses, F.array(F.lit(0.0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def _ladders(masses: Column, kinds: str) -> Column:
    def ladder(kind: str, front: Column, back: Column) -> Column:
        sums, base = front if kind in "abc" else back, LADDER_OFFSETS[kind]
        return F.transform(F.slice(sums, F.lit(2), F.size(sums) - 2), lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("number"), (x + base).alias("mass")))

    def of(both: Column) -> Column:
        lists = [ladder(k, both["front"], both["back"]) for k in kinds]
        return F.when(F.size(masses) > 1, F.concat(*lists)).otherwise(F.slice(F.array(F.struct(F.lit("b").alias("kind"), F.lit(0).alias("number"), F.lit(0.0).alias("mass"))), 1, 0))

    return bound(F.struct(_sums(masses).alias("front"), _sums(F.reverse(masses)).alias("back")), of)


def internal_fragments(sequence: Column, shortest: int = 4) -> Column:
    """The masses of the stretches of `shortest` residues or more that hold neither end."""
    return bound(residue_masses(sequence), lambda masses: _stretches(masses, shortest))


def _stretches(masses: Column, shortest: int) -> Column:
    n = F.size(masses)

    def of(sums: Column) -> Column:
        firsts = F.when(n - shortest >= 2, F.sequence(F.lit(2), n - shortest)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(firsts, lambda i: F.transform(F.sequence(i + shortest - 1, n - 1), lambda j: F.struct(i.alias("first"), j.alias("last"), (F.element_at(sums, j + 1) - F.element_at(sums, i)).alias("mass")))))

    return bound(_sums(masses), of)


def decoys(proteins: DataFrame, accession: str, sequence: str, keep_methionine: bool = True) -> DataFrame:
    """Reversed proteins under `DECOY_` names (G4); a first M stays in its place."""
    s = F.col(sequence)
    turned = F.when(s.startswith("M"), F.concat(F.lit("M"), F.reverse(F.expr(f"substring(`{sequence}`, 2)")))).otherwise(F.reverse(s)) if keep_methionine else F.reverse(s)
    return proteins.withColumn(accession, F.concat(F.lit("DECOY_"), F.col(accession))).withColumn(sequence, turned)


def scrambled(sequence: str, seed: int) -> str:
    """A permutation of a peptide that keeps its last residue and depends on nothing but the seed."""
    rng = np.random.default_rng(seed)
    return "".join(rng.permutation(list(sequence[:-1]))) + sequence[-1:]


def mass_shifts(mods: DataFrame, mass: str, existing: DataFrame, combos: DataFrame, digits: int = 5) -> DataFrame:
    """The distinct mass shifts that a search for new modifications allows: none, each modification, each less an existing one, and pairs."""
    one = mods.select(F.col(mass).alias("shift"))
    off = F.explode(F.array(*[F.lit(m) for (m,) in listed(existing, mass)]).cast("array<double>"))
    less = one.select("shift", off.alias("off")).select((F.col("shift") - F.col("off")).alias("shift"))
    pair = combos.select((F.col("first") + F.col("second")).alias("shift"))
    every = one.unionByName(less).unionByName(pair).unionByName(mods.sparkSession.createDataFrame([(0.0,)], "shift double"))
    return every.select(F.round("shift", digits).alias("shift")).distinct()


def isoforms(sequence: str, variable: dict[str, Sequence[str]], most_mods: int = 2, most: int = 1024) -> list[str]:
    """A peptide with every choice of up to `most_mods` variable modifications, fewest first; `most` forms come out, as a parameter of the search (G1)."""
    return [text for text, _ in modified_forms(sequence, {a: [(m, 0.0) for m in ms] for a, ms in variable.items()}, most_mods, most)]


def modified_forms(sequence: str, variable: dict[str, Sequence[tuple[str, float]]], most_mods: int, most: int) -> list[tuple[str, list[tuple[int, float]]]]:
    """(written form, (residue, mass) of its modifications) of each form; `variable` maps residues to names and masses."""
    sites = [(i, name, mass) for i, a in enumerate(sequence, 1) for name, mass in variable.get(a, ())]
    out: list[tuple[str, list[tuple[int, float]]]] = []
    for k in range(most_mods + 1):
        for chosen in itertools.combinations(sites, k):
            if len({c[0] for c in chosen}) < k:
                continue
            names = {i: n for i, n, _ in chosen}
            out.append(("".join(a + (f"[{names[i]}]" if i in names else "") for i, a in enumerate(sequence, 1)), [(i, x) for i, _, x in chosen]))
            if len(out) == most:
                return out
    return out


def with_isoforms(peptides: DataFrame, variable: dict[str, Sequence[tuple[str, float]]], most_mods: int = 2, most: int = 1024) -> DataFrame:
    """`peptides` (peptide, mass, ...) once for each form: with full_sequence, `mods` (residue, mass) and the form's mass (G1).

    `most_mods` and `most` are the limits of the search, as a user sets them. Peptides without a modifiable residue never leave the JVM.
    """
    letters = "".join(sorted(variable))
    bare = F.array(F.struct(F.col("peptide").alias("form"), F.array().cast("array<struct<residue:int,shift:double>>").alias("mods")))

    @F.pandas_udf("array<struct<form:string,mods:array<struct<residue:int,shift:double>>>>")
    def forms(peptide: pd.Series) -> pd.Series:
        return pd.Series([[{"form": t, "mods": [{"residue": i, "shift": x} for i, x in ms]} for t, ms in modified_forms(p, variable, most_mods, most)] for p in peptide])

    has = F.col("peptide").rlike(f"[{letters}]") if letters else F.lit(False)
    plain = peptides.filter(~has).withColumn("f__", F.explode(bare))
    rich = peptides.filter(has).withColumn("f__", F.explode(forms("peptide")))
    out = plain.unionByName(rich) if letters else plain
    added = F.aggregate("f__.mods", F.lit(0.0), lambda acc, m: acc + m["shift"])
    return out.withColumn("full_sequence", F.col("f__.form")).withColumn("mods", F.col("f__.mods")).withColumn("mass", F.col("mass") + added).drop("f__")


def nonspecific_peptides(proteins: DataFrame, keys: Sequence[str], sequence: str, shortest: int = 7, longest: int = 50, ends: str | None = None) -> DataFrame:
    """(`keys`, peptide, start, end, mass) of every stretch of a protein, or with `ends`, an enzyme, of those with one specific end at least.

    Masses come from the protein's prefix sums, so a stretch costs a subtraction. Stretches with an unknown residue have no mass.
    """
    rows = proteins.filter(F.length(sequence) >= shortest).select(*keys, F.col(sequence).alias("seq__"), _sums(residue_masses(F.col(sequence))).alias("sums__"))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("seq__") - shortest + 1)))
    rows = rows.withColumn("end", F.explode(F.sequence(F.col("start") + shortest - 1, F.least(F.length("seq__"), F.col("start") + longest - 1))))
    if ends is not None:
        after = {"trypsin": ("KR", "P"), "trypsin/P": ("KR", ""), "Lys-C": ("K", ""), "Arg-C": ("R", ""), "Glu-C": ("E", ""), "chymotrypsin": ("FWY", "P")}[ends]

        def cut(place: Column) -> Column:
            """Whether the bond behind a residue is one that the enzyme cuts; the protein's ends count."""
            blocked = F.substring("seq__", place + 1, F.lit(1)).isin(*after[1]) if after[1] else F.lit(False)
            return (place == 0) | (place == F.length("seq__")) | (F.substring("seq__", place, F.lit(1)).isin(*after[0]) & ~blocked)

        rows = rows.filter(cut(F.col("start") - 1) | cut(F.col("end")))
    mass = F.element_at("sums__", F.col("end") + 1) - F.element_at("sums__", F.col("start")) + WATER
    return rows.select(*keys, F.substring("seq__", F.col("start"), F.col("end") - F.col("start") + 1).alias("peptide"), "start", "end", mass.alias("mass"))


#: Masses of the residues of RNA (nucleoside monophosphates less water), and of HPO3.
NUCLEOTIDES = {"A": 329.05252, "C": 305.04129, "G": 345.04744, "U": 306.02530}
METAPHOSPHATE = 79.96633
#: What a kind of RNA fragment adds to its nucleotides: a to d hold the 5' end, w to z the 3' end.
RNA_OFFSETS = {"d": WATER, "c": 0.0, "b": WATER - METAPHOSPHATE, "a": -METAPHOSPHATE, "w": WATER, "x": 0.0, "y": WATER - METAPHOSPHATE, "z": -METAPHOSPHATE}


def nucleotide_masses(sequence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NUCLEOTIDES.items() for x in pair])
    return F.transform(F.split(sequence, ""), lambda a: F.try_element_at(table, a))


def oligo_mass(sequence: Column) -> Column:
    """The mass of RNA with a hydroxyl at either end; null with an unknown nucleotide (Q12)."""
    return F.aggregate(nucleotide_masses(sequence), F.lit(WATER - METAPHOSPHATE), lambda acc, x: acc + x)


def _rna_ion(kind: str):
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("number"), (x + RNA_OFFSETS[kind]).alias("mass"))


def oligo_fragments(sequence: Column, kinds: str = "dwy") -> Column:
    """An array of (kind, number, mass) of the neutral fragments of RNA at every bond (Q12)."""

    def of(both: Column) -> Column:
        lists = []
        for k in kinds:
            sums = both["front"] if k in "abcd" else both["back"]
            lists.append(F.transform(F.slice(sums, F.lit(2), F.greatest(F.size(sums) - 2, F.lit(0))), _rna_ion(k)))
        return F.concat(*lists)

    masses = nucleotide_masses(sequence)
    return bound(F.struct(_sums(masses).alias("front"), _sums(F.reverse(masses)).alias("back")), of)


def _matches(observed: np.ndarray, theory: np.ndarray, ppm: float) -> np.ndarray:
    """For each theoretical mass the place of the closest observed one, of two as close the lower, or -1 if it isn't within the tolerance."""
    if not len(observed):
        return np.full(len(theory), -1)
    right = np.clip(np.searchsorted(observed, theory), 1, max(len(observed) - 1, 1))
    right = np.minimum(right, len(observed) - 1)
    left = np.maximum(right - 1, 0)
    near = np.where(theory - observed[left] > observed[right] - theory, right, left)
    return np.where(np.abs(observed[near] - theory) <= theory * ppm / 1e6, near, -1)


_MASS_OF = np.full(128, np.nan)
_MASS_OF[[ord(a) for a in RESIDUES]] = list(RESIDUES.values())


#: What a kind of fragment adds to its residues' masses.
LADDER_OFFSETS = {"a": -27.99491462, "b": 0.0, "c": 17.02654911, "x": WATER + 25.97926456, "y": WATER, "z": WATER - 17.02654911 + 1.00782503}


def ladder_masses(sequence: str, shift: float = 0.0, site: int = 0, kinds: str = "by") -> np.ndarray:
    """The b, c, y and z masses of a peptide, `shift` on its 1-based residue `site`; those with an unknown residue are NaN."""
    codes = np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)
    masses = _MASS_OF[np.minimum(codes, 127)]
    if site:
        masses[site - 1] += shift
    front, back = np.cumsum(masses)[:-1], np.cumsum(masses[::-1])[:-1]
    return np.concatenate([(front if k in "abc" else back) + LADDER_OFFSETS[k] for k in kinds])


def ladder_bins(peptides: Sequence[str], per_dalton: int, kinds: str = "by") -> tuple[np.ndarray, np.ndarray]:
    """(bin, place of the peptide) of every known fragment of a list of peptides, also where some share a bin; peptides of a length are worked out at once."""
    lengths = np.fromiter(map(len, peptides), np.int64, len(peptides))
    bins, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(lengths[lengths > 1]):
        places = np.flatnonzero(lengths == n)
        codes = np.frombuffer("".join([peptides[i] for i in places]).encode("ascii", "replace"), np.uint8)
        masses = _MASS_OF[np.minimum(codes, 127)].reshape(-1, n)
        front, back = np.cumsum(masses, axis=1)[:, :-1], np.cumsum(masses[:, ::-1], axis=1)[:, :-1]
        for k in kinds:
            ions = (front if k in "abc" else back) + LADDER_OFFSETS[k]
            known = ~np.isnan(ions)
            bins.append(np.rint(ions[known] * per_dalton).astype(np.int64))
            owners.append(np.broadcast_to(places[:, None], ions.shape)[known])
    return np.concatenate(bins), np.concatenate(owners)


def list_scores(observed: np.ndarray, intensity: np.ndarray, total: float | None, peptides: Sequence[str], ppm: float, kinds: str = "by") -> np.ndarray:
    """The Morpheus scores of many peptides against one spectrum, all ladders at once."""
    text = "".join(peptides)
    lengths = np.fromiter(map(len, peptides), np.int64, len(peptides))
    masses = _MASS_OF[np.minimum(np.frombuffer(text.encode("ascii", "replace"), np.uint8), 127)]
    unknown = np.isnan(masses)
    sums, gaps = np.r_[0.0, np.cumsum(np.where(unknown, 0.0, masses))], np.r_[0, np.cumsum(unknown)]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(peptides)), np.maximum(lengths - 1, 0))
    # The bonds of all peptides: behind every residue but a peptide's last one.
    bond = np.arange(1, len(text) + 1)
    bond = bond[~np.isin(bond, ends)]
    score = np.zeros(len(peptides))
    for k in kinds:
        front = k in "abc"
        other = starts[owner] if front else ends[owner]
        theory = np.abs(sums[bond] - sums[other]) + LADDER_OFFSETS[k]
        at = _matches(observed, theory, ppm)
        hit = (at >= 0) & (gaps[bond] == gaps[other])
        score += np.bincount(owner[hit], minlength=len(peptides))
        if total:
            score += np.bincount(owner[hit], weights=intensity[at[hit]], minlength=len(peptides)) / total
    return score


#: Candidates of a scan that are scored at once: a spectrum is carried once for so many.
CANDIDATES_AT_ONCE = 2000
#: The width of a block of masses in the logarithm, many times a precursor's window.
BLOCK_WIDTH = 1e-3


def candidate_lists(pairs: DataFrame, scans: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(scan_id, candidates__ (peptide, `extra`), peaks, intensities, total): the candidates of each scan in lists of up to CANDIDATES_AT_ONCE.

    Pairs are shuffled once, by scan. The lists are the hashed side of the join, so spectra are neither sorted nor spilled, and where `scans` is
    partitioned by scan_id already they aren't shuffled either.
    """
    number = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.lit(0)))
    part = F.floor((number - 1) / CANDIDATES_AT_ONCE).alias("part__")
    lists = pairs.select("scan_id", F.struct("peptide", *extra).alias("c__"), part).groupBy("scan_id", "part__").agg(F.collect_list("c__").alias("candidates__"))
    return lists.drop("part__").hint("shuffle_hash").join(scans.select("scan_id", "peaks", "intensities", "total"), "scan_id")


def scored_candidates(pairs: DataFrame, scans: DataFrame, ppm: float = 20.0, kinds: str = "by", extra: Sequence[str] = ()) -> DataFrame:
    """(scan_id, peptide, `extra`, score) of each pair of `pairs` (scan_id, peptide, `extra`).

    Candidates are gathered by scan in lists of up to CANDIDATES_AT_ONCE, so that a spectrum's arrays are joined to a list and not to each pair.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(observed: pd.Series, intensity: pd.Series, total: pd.Series, peptides: pd.Series) -> pd.Series:
        return pd.Series([list_scores(np.asarray(o, float), np.asarray(x, float), t, list(p), ppm, kinds) for o, x, t, p in zip(observed, intensity, total, peptides, strict=True)])

    full = candidate_lists(pairs, scans, extra)
    scores = score("peaks", "intensities", "total", F.transform("candidates__", lambda c: c["peptide"]))
    zipped = F.arrays_zip(F.col("candidates__").alias("c"), scores.alias("s"))
    out = full.select("scan_id", F.explode(zipped).alias("x"))
    return out.select("scan_id", *[F.col("x.c")[c].alias(c) for c in ("peptide", *extra)], F.col("x.s").alias("score"))


def classic_search(scans: DataFrame, peptides: DataFrame, precursor_ppm: float = 5.0, product_ppm: float = 20.0, cutoff: float = 5.0, notches: Sequence[float] = (0.0,), kinds: str = "by") -> DataFrame:
    """The best peptides of each scan, ties included (Q1): masses are compared first, and ladders are built only for pairs that fit.

    Scans and peptides meet in blocks by mass, a peptide in each block that one of its notches touches, so neither pairs nor their scores are
    shuffled, and a spectrum is once. `scans` has scan_id, precursor_mass, peaks (masses ascending), intensities and total; `peptides` has peptide and mass, each peptide once.
    """
    block = lambda m: F.floor(F.log(F.greatest(m, F.lit(1e-3))) / BLOCK_WIDTH)
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("notch"), F.lit(float(s)).alias("shift")) for i, s in enumerate(notches)]))
    near = lambda ppm: F.col("mass") * (1 + ppm / 1e6) + F.col("n__.shift")
    asked = scans.filter("precursor_mass IS NOT NULL AND NOT isnan(precursor_mass)").select("scan_id", "precursor_mass", "peaks", "intensities", "total", block(F.col("precursor_mass")).alias("block__"))
    able = peptides.filter("mass > 0 AND NOT isnan(mass)").select("peptide", "mass", shifts.alias("n__"))
    able = able.select("peptide", "mass", F.col("n__.notch").alias("notch"), F.explode(F.sequence(block(near(-2 * precursor_ppm)), block(near(2 * precursor_ppm)))).alias("block__"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        by_notch = []
        for i, rows in right.sort_values("mass", kind="stable").groupby("notch"):
            by_notch.append((int(i), notches[int(i)], rows["mass"].to_numpy(float), rows["peptide"].to_numpy()))
        out: list[tuple] = []
        for scan_id, mass, peaks, intensities, total in zip(left["scan_id"], left["precursor_mass"], left["peaks"], left["intensities"], left["total"], strict=True):
            names, notch = [], []
            for i, shift, masses, all_names in by_notch:
                lo, hi = (mass - shift) / (1 + precursor_ppm / 1e6), (mass - shift) / (1 - precursor_ppm / 1e6)
                some = all_names[np.searchsorted(masses, lo) : np.searchsorted(masses, hi, side="right")].tolist()
                names += some
                notch += [i] * len(some)
            if not names:
                continue
            o, x = np.asarray(peaks, float), np.asarray(intensities, float)
            scores = np.concatenate([list_scores(o, x, total, names[k : k + CANDIDATES_AT_ONCE], product_ppm, kinds) for k in range(0, len(names), CANDIDATES_AT_ONCE)])
            rounded = np.where(scores >= cutoff, np.round(scores, 9), -np.inf)
            if (best := rounded.max()) == -np.inf:
                continue
            below = rounded[rounded < best].max(initial=-np.inf)
            out += [(scan_id, names[k], notch[k], scores[k], cutoff if below == -np.inf else below) for k in np.flatnonzero(rounded == best)]
        return pd.DataFrame(out, columns=["scan_id", "peptide", "notch", "score", "runner_up"])

    kind = scans.schema["scan_id"].dataType.simpleString()
    return asked.groupBy("block__").cogroup(able.groupBy("block__")).applyInPandas(search, f"scan_id {kind}, peptide string, notch int, score double, runner_up double")


#: Of one task of `nonspecific_search`: residues of proteins, stretches in order of mass and steps of their search at most; and the ranges of masses.
RESIDUES_AT_ONCE = 12_000_000
STRETCHES_AT_ONCE = 4_000_000
SPANS_AT_ONCE = 2_000_000
MASS_RANGES = 24
#: Units a dalton: masses have up to nine decimals, so sums of units are exact. Bins a dalton in which matches are looked up before they are scored.
_UNITS = 10**9
_BINS = 100


def nonspecific_search(scans: DataFrame, proteins: DataFrame, sequence: str, shortest: int = 7, longest: int = 50, precursor_ppm: float = 5.0, product_ppm: float = 20.0, cutoff: float = 5.0) -> DataFrame:
    """(scan_id, peptide, score): the best stretches of each scan among all those of the proteins, ties included (Q3).

    The result is that of `classic_search` over every stretch without an unknown residue. Stretches are never rows: a range of scans by mass meets the
    proteins, and the stretches within its scans' windows are found there by prefix sums. Those that can't reach the best score any more are left.
    """
    asked = scans.filter("precursor_mass > 0 AND NOT isnan(precursor_mass)").select("scan_id", "precursor_mass", "peaks", "intensities", "total")
    held = proteins.filter(F.length(sequence) >= shortest).select(F.col(sequence).alias("seq__"))
    residues = held.agg(F.sum(F.length("seq__").cast("bigint"))).first()[0] or 0
    chunks = max(1, -(-residues // RESIDUES_AT_ONCE))
    # Any bounds give the same result.
    cuts = asked.agg(F.percentile_approx("precursor_mass", [i / MASS_RANGES for i in range(1, MASS_RANGES)])).first()[0] or []
    cuts = sorted(set(cuts))
    range_of = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < F.col("precursor_mass")))
    left = asked.withColumn("range__", range_of).withColumn("chunk__", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = held.withColumn("chunk__", F.pmod(F.xxhash64("seq__"), F.lit(chunks)).cast("int")).withColumn("range__", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))))

    def search(some: pa.Table, texts: pa.Table) -> pa.Table:
        at, found, scores = best_stretches(some["precursor_mass"].to_numpy(), some["peaks"], some["intensities"], some["total"].to_pylist(), texts["seq__"].to_pylist(), shortest, longest, precursor_ppm, product_ppm, cutoff)
        return pa.table({"scan_id": some["scan_id"].take(pa.array(at, pa.int64())), "peptide": pa.array(found, pa.string()), "score": pa.array(scores, pa.float64())})

    kind = scans.schema["scan_id"].dataType
    shape = T.StructType([T.StructField("scan_id", kind), T.StructField("peptide", T.StringType()), T.StructField("score", T.DoubleType())])
    found = left.groupBy("range__", "chunk__").cogroup(right.groupBy("range__", "chunk__")).applyInArrow(search, shape)
    if chunks == 1:
        return found
    best = found.withColumn("best__", F.max(F.round("score", 9)).over(Window.partitionBy("scan_id"))).filter(F.round("score", 9) == F.col("best__"))
    return best.drop("best__").dropDuplicates(["scan_id", "peptide"])


def best_stretches(precursors: np.ndarray, peaks: Sequence, intensities: Sequence, totals: Sequence, texts: Sequence[str], shortest: int, longest: int, precursor_ppm: float, product_ppm: float, cutoff: float) -> tuple[list[int], list[str], list[float]]:
    """(place of the scan, stretch, score) of the best stretches of `texts` for each scan."""
    out: tuple[list[int], list[str], list[float]] = ([], [], [])
    if not len(texts) or not len(precursors):
        return out
    text = "\n".join(texts).encode("ascii", "replace") + b"\n"
    masses = _MASS_OF[np.minimum(np.frombuffer(text, np.uint8), 127)]
    stops = np.flatnonzero(np.isnan(masses))
    sums = np.zeros(len(masses) + 1, np.int64)
    np.cumsum(np.rint(np.nan_to_num(masses) * _UNITS).astype(np.int64), out=sums[1:])
    del masses
    # A stretch ends before the next unknown residue, which the ends of the proteins are too.
    ends = np.repeat(stops, np.diff(np.r_[-1, stops])).astype(np.int32)
    ends = np.minimum(ends, np.arange(len(ends), dtype=np.int32) + longest)
    starts = np.flatnonzero(ends - np.arange(len(ends)) >= shortest).astype(np.int32)
    ends = ends[starts]
    order = np.argsort(precursors, kind="stable")
    water = round(WATER * _UNITS)
    lows, highs = precursors[order] / (1 + precursor_ppm / 1e6), precursors[order] / (1 - precursor_ppm / 1e6)
    # Some of the starts tell how many stretches the windows hold.
    few = slice(None, None, 64)
    n = 64 * sum(len(x) for x, _, _ in _stretches_within(sums, starts[few], ends[few], shortest, lows, highs, water))
    parts = min(len(order), max(1, -(-n // STRETCHES_AT_ONCE)))
    for part in np.array_split(np.arange(len(order)), parts):
        pieces = list(_stretches_within(sums, starts, ends, shortest, lows[part], highs[part], water))
        units, first, last = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else [np.zeros(0, np.int64)] * 3
        del pieces
        sort = np.argsort(units)
        units, first, last = units[sort] / _UNITS, first[sort], last[sort]
        a, b = np.searchsorted(units, lows[part]), np.searchsorted(units, highs[part], side="right")
        _score_stretches(out, order[part], a, b, text, sums, first, last, water, peaks, intensities, totals, shortest, product_ppm, cutoff)
    return out


def _stretches_within(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int, lows: np.ndarray, highs: np.ndarray, water: int):
    """Yields (mass in units, first place, place behind the last one) of the stretches whose mass is in one of the ascending windows, or by less than a bin beside it."""
    per = _UNITS // (10 * _BINS)
    least, most = int(np.floor(lows[0] * _UNITS)) - per, int(np.ceil(highs[-1] * _UNITS)) + per
    # Bins of masses that a window touches.
    lo, hi = (np.floor(lows * _UNITS).astype(np.int64) - least) // per, (np.ceil(highs * _UNITS).astype(np.int64) - least) // per
    depth = np.zeros((most - least) // per + 2, np.int32)
    np.add.at(depth, lo, 1)
    np.add.at(depth, hi + 1, -1)
    wanted = np.cumsum(depth) > 0
    step = 1 << 20
    for k in range(0, len(starts), step):
        s = starts[k : k + step]
        base = sums[s]
        a = np.maximum(np.searchsorted(sums, base + (least - water)), s + shortest)
        b = np.minimum(np.searchsorted(sums, base + (most - water), side="right") - 1, ends[k : k + step])
        sizes = np.maximum(b - a + 1, 0)
        total = np.cumsum(sizes)
        at = 0
        while at < len(s):
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + SPANS_AT_ONCE, side="right")))
            z = sizes[at:to]
            first = np.repeat(s[at:to], z)
            last = (np.arange(len(first)) + np.repeat(a[at:to] - (total[at:to] - z - before), z)).astype(np.int32)
            units = sums[last] - np.repeat(base[at:to], z) + water
            keep = np.flatnonzero(wanted[np.clip((units - least) // per, 0, len(wanted) - 1)])
            yield units[keep], first[keep], last[keep]
            at = to


def _score_stretches(out: tuple[list, list, list], places: np.ndarray, a: np.ndarray, b: np.ndarray, text: bytes, sums: np.ndarray, first: np.ndarray, last: np.ndarray, water: int, peaks: Sequence, intensities: Sequence, totals: Sequence, shortest: int, ppm: float, cutoff: float) -> None:
    """Adds to `out` the best of the stretches `a` to `b` of each scan.

    A bin that no peak touches can't match, so the fragments in touched bins bound the score; only stretches whose bound reaches the best score are scored.
    """
    scale = _BINS / _UNITS
    bins_of = lambda kind, i, j, n: ((sums[i + n] - sums[i] if kind == "b" else sums[j] - sums[j - n] + water) * scale).astype(np.int32)
    known = range(max(1, shortest - 4), shortest)
    bins = np.empty((2 * len(known), len(first)), np.int32)
    for k, (kind, n) in enumerate(itertools.product("by", known)):
        bins[k] = bins_of(kind, first, last, n)
    length = (last - first).astype(np.int32)
    rest = 2 * (length - 1) - len(bins)
    most = int(max(((sums[last] - sums[first]).max(initial=0) + water) * scale, 0)) + 2
    touched = np.zeros(most, np.uint8)
    for place, lo, hi in zip(places.tolist(), a.tolist(), b.tolist(), strict=True):
        if lo == hi:
            continue
        o, x, total = (np.asarray(v[place].as_py() if hasattr(v[place], "as_py") else v[place], float) for v in (peaks, intensities, totals))
        total = None if np.isnan(total) else float(total)
        worth = 1.0 + (max(float(x.max(initial=0.0)), 0.0) / total if total and total > 0 else 0.0)
        near = ((o / (1 + ppm / 1e6) - 1e-6) * _BINS).astype(np.int64)
        far = ((o / (1 - ppm / 1e6) + 1e-6) * _BINS).astype(np.int64)
        marks = np.minimum(near[:, None] + np.arange(int((far - near).max(initial=0)) + 1), far[:, None]).ravel()
        marks = marks[(marks >= 0) & (marks < most)]
        touched[marks] = 1
        hits = touched[bins[:, lo:hi]].sum(axis=0, dtype=np.int32)

        def scored(some: np.ndarray) -> tuple[list[str], np.ndarray]:
            names = list(dict.fromkeys(text[i:j].decode() for i, j in zip(first[lo + some].tolist(), last[lo + some].tolist(), strict=True)))
            return names, np.concatenate([list_scores(o, x, total, names[k : k + CANDIDATES_AT_ONCE], ppm) for k in range(0, len(names), CANDIDATES_AT_ONCE)])

        # The stretch with most hits tells how good the best one is at least.
        least = max(cutoff, float(scored(np.array([hits.argmax()]))[1].max())) - 1e-6
        some = np.flatnonzero((hits + rest[lo:hi]) * worth >= least)
        hits, left = hits[some], rest[lo:hi][some]
        i, j, size = first[lo + some], last[lo + some], length[lo + some]
        n = 0
        while len(some) and left.max() > 0:
            n += 1
            if n in known:
                continue
            on = size > n
            more = np.zeros(len(some), np.int32)
            for kind in "by":
                more[on] += touched[bins_of(kind, i[on], j[on], n)]
            hits, left = hits + more, left - 2 * on
            keep = (hits + left) * worth >= least
            some, hits, left, i, j, size = some[keep], hits[keep], left[keep], i[keep], j[keep], size[keep]
        touched[marks] = 0
        if not len(some):
            continue
        names, scores = scored(some)
        rounded = np.round(scores, 9)
        if (best := rounded.max()) >= cutoff:
            for k in np.flatnonzero(rounded == best).tolist():
                out[0].append(place)
                out[1].append(names[k])
                out[2].append(float(scores[k]))


def fragment_index(peptides: DataFrame, per_dalton: int = 1000, kinds: str = "by") -> DataFrame:
    """(bin, peptide, mass): the postings of an inverted index of fragments, one for each fragment, also where some share a bin (K17); write it bucketed by bin to keep it."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def bins(peptide: pd.Series) -> pd.Series:
        ladders = (ladder_masses(p, kinds=kinds) for p in peptide)
        return pd.Series([np.sort(np.rint(m[~np.isnan(m)] * per_dalton).astype(np.int64)) for m in ladders])

    return peptides.select(F.explode(bins("peptide")).alias("bin"), "peptide", "mass")


def block_search(scans: DataFrame, peptides: DataFrame, precursor_ppm: float, product_ppm: float, cutoff: int, per_dalton: int) -> DataFrame:
    """(scan_id, peptide, score) of the pairs that share `cutoff` bins of fragments, by an index within each block of masses.

    Peptides and scans meet in blocks by mass, a scan in each block that its window touches. The postings are made within the block, so they are
    never shuffled or stored; a scan's window is a run of the peptides in order of mass.
    """
    block = lambda m: F.floor(F.log(m) / BLOCK_WIDTH)
    touched = F.sequence(block(F.col("precursor_mass") * (1 - 2 * precursor_ppm / 1e6)), block(F.col("precursor_mass") * (1 + 2 * precursor_ppm / 1e6)))
    asked = scans.filter("precursor_mass > 0").select("scan_id", "precursor_mass", "peaks", "intensities", "total", F.explode(touched).alias("block__"))
    listed_ = peptides.filter("mass > 0").select("peptide", "mass", block(F.col("mass")).alias("block__"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("mass", kind="stable")
        names, masses = right["peptide"].to_numpy(), right["mass"].to_numpy(float)
        scan_ids, found, scores = [], [], []
        if len(names):
            ladders: dict[int, np.ndarray] = {}
            for scan_id, mass, peaks, intensities, total in zip(left["scan_id"], left["precursor_mass"], left["peaks"], left["intensities"], left["total"], strict=True):
                # Somewhat wide, then by the exact rule.
                near = np.arange(*np.searchsorted(masses, [mass * (1 - 2 * precursor_ppm / 1e6), mass * (1 + 2 * precursor_ppm / 1e6)]))
                near = near[np.abs(mass - masses[near]) <= masses[near] * precursor_ppm / 1e6]
                if not len(near):
                    continue
                o = np.asarray(peaks, float)
                lo, hi = np.floor(o * (1 - 2 * product_ppm / 1e6) * per_dalton), np.ceil(o * (1 + 2 * product_ppm / 1e6) * per_dalton)
                for i in near:
                    if i not in ladders:
                        ions = ladder_masses(names[i])
                        ladders[i] = np.rint(ions[~np.isnan(ions)] * per_dalton)
                # A bin is seen if the last peak whose first bin is no higher reaches it; peaks ascend, and so do both bounds.
                owner = np.repeat(np.arange(len(near)), [len(ladders[i]) for i in near])
                bins = np.concatenate([ladders[i] for i in near])
                last = np.searchsorted(lo, bins, side="right") - 1
                seen = (last >= 0) & (hi[np.maximum(last, 0)] >= bins) if len(o) else np.zeros(len(bins), bool)
                enough = near[np.bincount(owner[seen], minlength=len(near)) >= cutoff]
                if len(enough):
                    x = np.asarray(intensities, float)
                    for start in range(0, len(enough), CANDIDATES_AT_ONCE):
                        some = names[enough[start : start + CANDIDATES_AT_ONCE]].tolist()
                        scan_ids += [scan_id] * len(some)
                        found += some
                        scores += list_scores(o, x, total, some, product_ppm).tolist()
        return pd.DataFrame({"scan_id": pd.Series(scan_ids, dtype=left["scan_id"].dtype), "peptide": pd.Series(found, dtype=object), "score": pd.Series(scores, dtype=float)})

    kind = scans.schema["scan_id"].dataType.simpleString()
    return asked.groupBy("block__").cogroup(listed_.groupBy("block__")).applyInPandas(search, f"scan_id {kind}, peptide string, score double")


def modern_search(scans: DataFrame, peptides: DataFrame, index: DataFrame | None = None, precursor_ppm: float = 5.0, product_ppm: float = 20.0, cutoff: int = 5, per_dalton: int = 1000) -> DataFrame:
    """The same matches from an index (Q2): fragments in a scan's bins are counted first, and only pairs with enough of them are scored.

    The count is at least the number of matched fragments, so no pair that reaches the cutoff is lost. Without a kept `index` one is made for each
    block of masses (`block_search`): no posting is shuffled then.
    """
    if index is None:
        return best_with_ties(block_search(scans, peptides, precursor_ppm, product_ppm, cutoff, per_dalton), ["scan_id"], "score", float(cutoff))
    # A coarse bin of the peptide's mass is part of the key, so postings far from the precursor are never read into a pair.
    log_width = 8 * precursor_ppm / 1e6
    coarse = lambda m: F.floor(F.log(m) / log_width)
    near_bins = F.sequence(coarse(F.col("precursor_mass") * (1 - precursor_ppm / 1e6)), coarse(F.col("precursor_mass") * (1 + 2 * precursor_ppm / 1e6)))
    peaks = scans.select("scan_id", "precursor_mass", near_bins.alias("near__"), F.explode("peaks").alias("peak"))
    bins = F.sequence(F.floor(F.col("peak") * (1 - 2 * product_ppm / 1e6) * per_dalton), F.ceil(F.col("peak") * (1 + 2 * product_ppm / 1e6) * per_dalton))
    hits = peaks.select("scan_id", "precursor_mass", "near__", F.explode(bins).alias("bin")).distinct().withColumn("near__", F.explode("near__"))
    hits = hits.join(index.withColumn("near__", coarse(F.col("mass"))), ["bin", "near__"])
    near = hits.filter(F.abs(F.col("precursor_mass") - F.col("mass")) <= F.col("mass") * precursor_ppm / 1e6)
    rough = near.groupBy("scan_id", "peptide").agg(F.count(F.lit(1)).alias("n_near")).filter(F.col("n_near") >= cutoff)
    return best_with_ties(scored_candidates(rough.select("scan_id", "peptide"), scans, product_ppm), ["scan_id"], "score", float(cutoff))


def site_scores(observed: np.ndarray, intensity: np.ndarray, total: float | None, peptide: str, shift: float, ppm: float) -> np.ndarray:
    """The Morpheus score of a peptide with `shift` on each of its residues in turn, all at once.

    Every b and y mass is matched with and without the shift; the score for a residue takes the shifted ones of the fragments that hold it.
    """
    n = len(peptide)

    def worth(theory: np.ndarray) -> np.ndarray:
        at = _matches(observed, theory, ppm)
        hit = at >= 0
        return hit + (np.where(hit, intensity[at], 0.0) / total if total and len(intensity) else 0.0)

    def by_site(kind: str) -> np.ndarray:
        """Of the sites 1 to n from the end that the fragments of this kind hold."""
        theory = ladder_masses(peptide, kinds=kind)
        without, with_it = np.r_[0.0, np.cumsum(worth(theory))], np.r_[0.0, np.cumsum(worth(theory + shift))]
        return without[:n] + with_it[-1] - with_it[:n]

    return by_site("b") + by_site("y")[::-1]


#: Peptides whose fragments `bond_matches` takes at once: few, so that sums and keys keep their digits.
TEXTS_AT_ONCE = 64


def flat_spectra(peaks: Sequence, intensities: Sequence, totals: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(masses, intensities, offsets, totals) of many spectra; an unknown total is 0, masses that are no number are left out."""
    lists = [np.asarray(o, float) for o in peaks]
    at = np.r_[0, np.cumsum([len(o) for o in lists], dtype=np.int64)]
    flat, x = np.concatenate([np.zeros(0), *lists]), np.concatenate([np.zeros(0), *[np.asarray(x, float) for x in intensities]])
    if not (known := np.isfinite(flat)).all():
        flat, x, at = flat[known], x[known], np.r_[0, np.cumsum(known)][at]
    return flat, x, at, np.nan_to_num(np.asarray(totals, float))


def bond_matches(spectra: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, texts: Sequence[str], shifts: np.ndarray, ppm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(b, y, offsets): the places of the peaks that the b and the y mass at each bond of many peptides match, their shift added, or -1.

    `rows` are the peptides' spectra, ascending. Spectra lie one behind the other on a line, so that a search finds the fragments of many peptides.
    """
    flat, _, at, _ = spectra
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(0, len(texts), TEXTS_AT_ONCE):
        some = texts[k : k + TEXTS_AT_ONCE]
        text = "".join(some)
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        masses = _MASS_OF[np.minimum(np.frombuffer(text.encode("ascii", "replace"), np.uint8), 127)]
        unknown = np.isnan(masses)
        sums, gaps = np.r_[0.0, np.cumsum(np.where(unknown, 0.0, masses))], np.r_[0, np.cumsum(unknown)]
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(some)), np.maximum(lengths - 1, 0))
        inner = np.ones(len(text) + 1, bool)
        inner[np.r_[0, ends]] = False
        bond = np.flatnonzero(inner)
        start, end, n = (ends - lengths)[owner], ends[owner], len(bond)
        theory = np.r_[sums[bond] - sums[start] + LADDER_OFFSETS["b"], sums[end] - sums[bond] + LADDER_OFFSETS["y"]] + np.tile(shifts[k : k + TEXTS_AT_ONCE][owner], 2)
        known = np.r_[gaps[bond] == gaps[start], gaps[bond] == gaps[end]]
        row = np.tile(rows[k : k + TEXTS_AT_ONCE][owner], 2)
        got = np.full(2 * n, -1)
        if n and (first := rows[k]) <= (last := rows[min(k + TEXTS_AT_ONCE, len(texts)) - 1]) and at[last + 1] > at[first]:
            peaks = flat[at[first] : at[last + 1]]
            step = 2.0 ** np.ceil(np.log2(2 * max(np.abs(peaks).max(), np.abs(theory).max()) + 2))
            place = np.searchsorted(peaks + np.repeat(np.arange(last - first + 1), np.diff(at[first : last + 2])) * step, theory + (row - first) * step)
            lo, hi = at[row] - at[first], at[row + 1] - at[first] - 1
            right = np.maximum(np.minimum(place, hi), 0)
            left = np.maximum(right - 1, np.minimum(lo, right))
            near = np.where(theory - peaks[left] > peaks[right] - theory, right, left)
            hit = known & (hi >= lo) & (np.abs(peaks[near] - theory) <= theory * ppm / 1e6)
            got[hit] = at[first] + near[hit]
        out.append((got[:n], got[n:]))
    b, y = (np.concatenate(x) for x in zip(*out, strict=True))
    return b, y, np.r_[0, np.cumsum(np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)) - 1, 0))]


def localized(scans: DataFrame, matches: DataFrame, product_ppm: float = 20.0) -> DataFrame:
    """Each match's mass shift put on each residue in turn, and the residues with the best score.

    `matches` has scan_id, peptide and shift. The ladder's masses from the residue on carry the shift.
    """

    @F.pandas_udf("struct<score:double,sites:string>")
    def best(observed: pd.Series, intensity: pd.Series, total: pd.Series, peptide: pd.Series, shift: pd.Series) -> pd.DataFrame:
        rows = []
        for o, x, t, p, d in zip(observed, intensity, total, peptide, shift, strict=True):
            scores = np.round(site_scores(np.asarray(o, float), np.asarray(x, float), t, p, d, product_ppm), 9)
            rows.append((scores.max(), ",".join(str(i + 1) for i in np.flatnonzero(scores == scores.max()))))
        return pd.DataFrame(rows, columns=["score", "sites"])

    full = matches.filter(F.length("peptide") > 0).hint("shuffle_hash").join(scans.select("scan_id", "peaks", "intensities", "total"), "scan_id")
    return full.select("scan_id", "peptide", best("peaks", "intensities", "total", "peptide", "shift").alias("b")).select("scan_id", "peptide", "b.score", "b.sites").distinct()


def spectral_angle(pairs: Column, a: str, b: str) -> Column:
    """The normalized spectral angle of matched intensities, after square roots: 1 for equal, 0 for orthogonal ones, -1 for none."""
    dot = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.sqrt(p[a]) * F.sqrt(p[b]))
    na = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p[a]))
    nb = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p[b]))
    return F.when((F.size(pairs) == 0) | (na == 0) | (nb == 0), -1.0).otherwise(1 - 2 * F.acos(F.least(dot / (na * nb), F.lit(1.0))) / np.pi)


#: Retention coefficients of residues at the middle of a peptide, for reversed-phase gradients.
RETENTION = {"W": 11.0, "F": 10.5, "L": 9.6, "I": 8.4, "M": 5.8, "V": 5.0, "Y": 4.0, "A": 0.8, "T": 0.4, "P": 0.2, "E": 0.0, "D": -0.5, "C": -0.8, "S": -0.8, "Q": -0.9, "G": -0.9, "N": -1.2, "R": -1.3, "H": -1.3, "K": -1.9}


def hydrophobicity(sequence: Column) -> Column:
    """A retention estimate: the sum of the residues' coefficients, corrected for length."""
    table = F.create_map(*[F.lit(x) for pair in RETENTION.items() for x in pair])
    total = F.aggregate(F.transform(F.split(sequence, ""), lambda a: F.coalesce(F.try_element_at(table, a), F.lit(0.0))), F.lit(0.0), lambda acc, c: acc + c)
    n = F.length(sequence)
    return total * F.when(n < 10, 1 - 0.027 * (10 - n)).when(n > 20, 1 / (1 + 0.015 * (n - 20))).otherwise(1.0)


def xcorr_spectrum(mz: np.ndarray, intensity: np.ndarray, precursor: float, bins: int = 1969, reach: int = 75) -> np.ndarray:
    """A binned spectrum less the mean of its surroundings: square roots, highest peak of each bin, ten windows scaled to 50."""
    out = np.zeros(bins)
    at = np.rint(mz / 1.0005079).astype(int)
    ok = (at >= 0) & (at < bins) & (np.abs(mz - precursor) > 1.5)
    np.maximum.at(out, at[ok], np.sqrt(intensity[ok]))
    width = max(1, -(-int(at[ok].max() + 1 if ok.any() else 1) // 10))
    least = 0.05 * out.max() if out.any() else 0.0
    for i in range(0, bins, width):
        window = out[i : i + width]
        if (top := window.max(initial=0.0)) > 0:
            window[window < least] = 0
            window *= 50 / top
    sums = np.r_[0.0, np.cumsum(np.pad(out, reach))]
    around = sums[2 * reach + 1 :] - sums[: len(sums) - 2 * reach - 1]
    return out - (around - out) / (2 * reach)

