"""Crosslink search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.operators.fdr import best_with_ties
from massloom.operators.filters import linker_sites
from massloom.operators.joins import band_join, first_case
from massloom.operators.search import _MASS_OF, LADDER_OFFSETS, _matches, ladder_bins, ladder_masses, site_scores
from massloom.operators.windows import top_with_ties
from massloom.session import materialize


@dataclass(frozen=True)
class Linker:
    """A crosslinker's sites and masses in dalton."""

    name: str
    residues: str
    total: float
    dead_end_h2o: float
    dead_end_nh2: float
    dead_end_tris: float
    loop: float
    short: float = 0.0
    long: float = 0.0


def pair_candidates(scans: DataFrame, alphas: DataFrame, peptides: DataFrame, linker: Linker, ppm: float = 5.0) -> DataFrame:
    """(scan_id, alpha, beta) whose masses and the linker make up the precursor.

    `scans` has scan_id and precursor_mass, `alphas` (scan_id, alpha, alpha_mass), `peptides` (peptide, mass). The second arm is found by a band join
    on what the first leaves; alpha is the first by name where both arms are candidates of the scan.
    """
    need = alphas.join(scans, "scan_id").withColumn("rest", F.col("precursor_mass") - F.col("alpha_mass") - linker.total)
    need = need.filter("rest > 0").withColumn("lo", F.col("rest") - F.col("precursor_mass") * ppm / 1e6).withColumn("hi", F.col("rest") + F.col("precursor_mass") * ppm / 1e6)
    betas = peptides.filter(F.size(linker_sites(F.col("peptide"), linker.residues)) > 0).select(F.col("peptide").alias("beta"), F.col("mass").alias("beta_mass"))
    found = band_join(need, betas, "lo", "hi", "beta_mass", 0.05)
    return found.select("scan_id", F.least("alpha", "beta").alias("alpha"), F.greatest("alpha", "beta").alias("beta")).distinct()


def cross_types(candidates: DataFrame, linker: Linker, ppm: float = 5.0) -> DataFrame:
    """`candidates` (precursor_mass, alpha_mass) with the first kind of product whose mass fits: single, dead ends, loop, else cross."""
    fits = lambda extra: F.abs(F.col("precursor_mass") - F.col("alpha_mass") - extra) <= F.col("precursor_mass") * ppm / 1e6
    case = first_case([("single", fits(0.0)), ("dead_end_tris", fits(linker.dead_end_tris)), ("dead_end_h2o", fits(linker.dead_end_h2o)), ("dead_end_nh2", fits(linker.dead_end_nh2)), ("loop", fits(linker.loop)), ("cross", F.col("precursor_mass") - F.col("alpha_mass") > linker.total)])
    return candidates.withColumn("cross_type", case)


def site_pairs(rows: DataFrame, alpha: str, beta: str, residues: str) -> DataFrame:
    """A row for each pair of binding sites of two arms."""
    a = rows.withColumn("alpha_site", F.explode(linker_sites(F.col(alpha), residues)))
    return a.withColumn("beta_site", F.explode(linker_sites(F.col(beta), residues)))


def loop_pairs(rows: DataFrame, peptide: str, residues: str) -> DataFrame:
    """A row for each two binding sites of one peptide, the first before the second."""
    one = rows.withColumn("sites__", linker_sites(F.col(peptide), residues))
    return one.withColumn("first_site", F.explode("sites__")).withColumn("second_site", F.explode("sites__")).filter("first_site < second_site").drop("sites__")


def exclusive_ions(rows: DataFrame, alpha_ions: str, beta_ions: str, alpha_score: str, beta_score: str) -> DataFrame:
    """The arm with the lower score gives up the m/z that both have; it loses score only if more was counted than ions are left."""
    a_wins = F.col(alpha_score) >= F.col(beta_score)
    a = F.when(a_wins, F.col(alpha_ions)).otherwise(F.array_except(alpha_ions, beta_ions))
    b = F.when(a_wins, F.array_except(beta_ions, alpha_ions)).otherwise(F.col(beta_ions))
    out = rows.withColumn("a__", a).withColumn("b__", b)
    lower = lambda score, ions: F.when(F.floor(score) > F.size(ions), F.size(ions) + F.col(score) - F.floor(score)).otherwise(F.col(score))
    return out.withColumn(alpha_score, lower(alpha_score, "a__")).withColumn(beta_score, lower(beta_score, "b__")).drop(alpha_ions, beta_ions).withColumnsRenamed({"a__": alpha_ions, "b__": beta_ions})


#: Of one task of a search: scans and arms at most; arms whose fragments are indexed at once; bins a dalton in which fragments are looked up before pairs are scored.
SCANS_AT_ONCE = 20_000
ARMS_AT_ONCE = 2_000_000
ARMS_INDEXED = 50_000
_BINS = 100


def _blocks(scans: DataFrame, arms: DataFrame) -> tuple[Callable[..., DataFrame], Callable[..., DataFrame], int]:
    """What puts scans and what puts arms in blocks, and the number of blocks of arms: each part of the scans meets each block once.

    A part holds up to SCANS_AT_ONCE scans, fewer where there would be less than two parts a core: arms are copied to each part, so parts don't grow in number before that.
    """
    n, cores = scans.count(), scans.sparkSession.sparkContext.defaultParallelism
    parts, blocks = max(1, -(-n // SCANS_AT_ONCE), min(-(-n // 500), 2 * cores)), max(1, -(-arms.count() // ARMS_AT_ONCE))
    spread = lambda c, n: F.pmod(F.xxhash64(c, F.lit("block")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = lambda df, *c: df.select(*c, spread("scan_id", parts).alias("part__"), every(blocks).alias("block__"))
    right = lambda df: df.select("peptide", "mass", spread("peptide", blocks).alias("block__"), every(parts).alias("part__"))
    return left, right, blocks


def _rough_lists(scans: DataFrame, arms: DataFrame, linker: Linker, product_ppm: float, cutoff: int, most: int, per_dalton: int) -> DataFrame:
    """(scan_id, arms__ (alpha, alpha_mass, n)): of each scan the `most` arms of a block with the most hits, and their ties."""
    reach = product_ppm * 2 / 1e6
    known = arms.filter("mass IS NOT NULL AND NOT isnan(mass)")
    left, right, _ = _blocks(scans, known)

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("mass")
        names, masses = b["peptide"], b["mass"].to_numpy()
        able = np.searchsorted(masses, a["precursor_mass"].to_numpy() - linker.total, side="right")
        spans, least, found = [], np.full(len(a), max(cutoff, 1)), [[] for _ in range(len(a))]
        for peaks in a["peaks"]:
            o = np.asarray(peaks.values, float)
            o = np.sort(o[~np.isnan(o)])
            # Runs of seen bins; a bin that several peaks cover counts once.
            lo, hi = np.floor(o * (1 - reach) * per_dalton).astype(np.int64), np.ceil(o * (1 + reach) * per_dalton).astype(np.int64)
            first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]]) if len(o) else np.zeros(0, np.int64)
            spans.append((lo[first], hi[np.r_[first[1:] - 1, len(o) - 1]] + 1 if len(o) else lo))
        for k in range(0, len(masses), ARMS_INDEXED):
            some = names.slice(k, ARMS_INDEXED).to_pylist()
            bins, owner = ladder_bins(some, per_dalton)
            order = np.argsort(bins, kind="stable")
            bins, owner = bins[order], owner[order].astype(np.int32)
            for i in np.flatnonzero(able > k).tolist():
                if not len(spans[i][0]):
                    continue
                begin, end = np.searchsorted(bins, spans[i][0]).tolist(), np.searchsorted(bins, spans[i][1]).tolist()
                n = np.bincount(np.concatenate([owner[x:y] for x, y in zip(begin, end, strict=True)]), minlength=len(some))[: able[i] - k]
                at = np.flatnonzero(n >= least[i])
                if len(at):
                    found[i].append((at + k, n[at]))
                    if sum(len(x) for x, _ in found[i]) > most:
                        at, n = (np.concatenate(x) for x in zip(*found[i], strict=True))
                        least[i] = np.partition(n, -most)[-most]
                        found[i] = [(at[n >= least[i]], n[n >= least[i]])]
        rows = [i for i, x in enumerate(found) if x]
        at, n = (np.concatenate([np.zeros(0, np.int64), *[y[k] for i in rows for y in found[i]]]) for k in (0, 1))
        ends = np.r_[0, np.cumsum([sum(len(y) for y, _ in found[i]) for i in rows], dtype=np.int64)]
        each = pa.StructArray.from_arrays([names.take(pa.array(at)).combine_chunks(), pa.array(masses[at]), pa.array(n)], ["alpha", "alpha_mass", "n"])
        return pa.table({"scan_id": a["scan_id"].take(pa.array(rows, pa.int64())), "arms__": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)})

    asked = left(scans.filter("precursor_mass IS NOT NULL AND NOT isnan(precursor_mass) AND size(peaks) > 0"), "scan_id", "precursor_mass", "peaks")
    arm = T.StructType([T.StructField("alpha", T.StringType()), T.StructField("alpha_mass", T.DoubleType()), T.StructField("n", T.LongType())])
    shape = T.StructType([T.StructField("scan_id", scans.schema["scan_id"].dataType), T.StructField("arms__", T.ArrayType(arm))])
    return asked.groupBy("part__", "block__").cogroup(right(known).groupBy("part__", "block__")).applyInArrow(count, shape)


def rough_arms(scans: DataFrame, arms: DataFrame, linker: Linker, product_ppm: float, cutoff: int, most: int, per_dalton: int = 200) -> DataFrame:
    """(scan_id, alpha, alpha_mass) of the first round (Q4): peptides lighter than the precursor whose unshifted fragments are seen, the `most` with the most hits and their ties.

    Scans and arms, each once, meet in blocks of SCANS_AT_ONCE and ARMS_AT_ONCE. The index of fragments lives in a block only and hits are counted there; what
    leaves it are the `most` arms of a scan and their ties, so neither postings nor hits are shuffled.
    """
    found = _rough_lists(scans, arms, linker, product_ppm, cutoff, most, per_dalton).select("scan_id", F.inline("arms__"))
    return top_with_ties(found, ["scan_id"], "n", most).drop("n")


def _best_sites(peaks: np.ndarray, intensities: np.ndarray, total: float | None, arm: str, sites: list[int], shift: float, ppm: float) -> tuple[float, int, set[int]]:
    """(score, site, matched peaks) of the first site with the best score of an arm that carries `shift`."""
    scores = np.round(site_scores(peaks, intensities, total, arm, shift, ppm)[np.array(sites) - 1], 9)
    place = int(scores.argmax())
    at = _matches(peaks, ladder_masses(arm, shift, sites[place]), ppm)
    return float(scores[place]), sites[place], set(at[at >= 0].tolist())


def _sites(peptide: str, residues: str) -> list[int]:
    """`linker_sites` of one peptide."""
    return [i for i, a in enumerate(peptide[:-1], 1) if "X" in residues or a in residues]


def _pair_score(o: np.ndarray, x: np.ndarray, t: float | None, a: str, b: str, wa: float, wb: float, linker: Linker, ppm: float) -> tuple[int, int, float, float]:
    """The best sites and the scores of both arms.

    Each arm is scored at each of its sites with the other arm and the linker as the shift. Peaks that both arms match count for the better one only.
    """
    one = _best_sites(o, x, t, a, _sites(a, linker.residues), wb + linker.total, ppm)
    two = _best_sites(o, x, t, b, _sites(b, linker.residues), wa + linker.total, ppm)
    scores = [one[0], two[0]]
    if a != b:
        shared = one[2] & two[2]
        lower = 1 if scores[0] >= scores[1] else 0
        kept = len((one, two)[lower][2]) - len(shared)
        if np.floor(scores[lower]) > kept:
            scores[lower] -= len(shared) + (float(x[list(shared)].sum()) / t if t and shared else 0.0)
    return one[1], two[1], *scores


def _seen(o: np.ndarray, ppm: float, more: float) -> np.ndarray:
    """Whether a peak may match a mass in a bin that is known to within `more`; the last bin is none."""
    lo, hi = np.floor((o * (1 - 2 * ppm / 1e6) - more) * _BINS).astype(np.int64), np.ceil((o * (1 + 2 * ppm / 1e6) + more) * _BINS).astype(np.int64) + 1
    out = np.zeros(max(int(hi.max(initial=0)), 0) + 1, bool)
    for i, j in zip(np.maximum(lo, 0).tolist(), np.maximum(hi, 0).tolist(), strict=True):
        out[i:j] = True
    return out


def _most_matches(names: pa.StringArray, shifts: np.ndarray, bare: np.ndarray, shifted: np.ndarray) -> np.ndarray:
    """At most so many fragments of each arm are seen, bare or with its shift, by the bins of either."""
    texts = names.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    masses = _MASS_OF[np.minimum(np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8), 127)]
    unknown = np.isnan(masses)
    sums, gaps = np.r_[0.0, np.cumsum(np.where(unknown, 0.0, masses))], np.r_[0, np.cumsum(unknown)]
    ends = np.cumsum(lengths)
    owner, inner = np.repeat(np.arange(len(texts)), np.maximum(lengths - 1, 0)), np.ones(len(masses) + 1, bool)
    inner[np.r_[0, ends]] = False
    bond = np.flatnonzero(inner)
    n = np.zeros(len(texts), np.int64)
    for other, sign, kind in (((ends - lengths)[owner], 1, "b"), (ends[owner], -1, "y")):
        ions = sign * (sums[bond] - sums[other]) + LADDER_OFFSETS[kind]
        at = lambda m, seen: seen[np.clip(np.rint(m * _BINS).astype(np.int64), 0, len(seen) - 1)]
        hit = (at(ions, bare) | at(ions + shifts[owner], shifted)) & (gaps[bond] == gaps[other])
        n += np.bincount(owner[hit], minlength=len(texts))
    return n


def _best_pairs(scans: DataFrame, lists: DataFrame, arms: DataFrame, linker: Linker, precursor_ppm: float, product_ppm: float, cutoff: float) -> DataFrame:
    """(scan_id, alpha, beta, sites, scores, score) of the pairs of `pair_candidates` with the best score of a scan and a block of arms, ties included, and one with the next.

    Scans with their first arms meet the second arms in blocks. The bins of both arms' fragments bound a pair's score, and pairs are scored from the highest bound
    down, as long as one can reach the second best: the others are neither scored nor shuffled.
    """
    known = arms.filter("mass IS NOT NULL AND NOT isnan(mass)")
    left, right, _ = _blocks(lists, known)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("mass")
        names, masses = b["peptide"].combine_chunks(), b["mass"].to_numpy()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        rows, out = [], []
        for s, (precursor, peaks, intensities, t, firsts) in enumerate(zip(a["precursor_mass"].to_pylist(), a["peaks"], a["intensities"], a["total"].to_pylist(), a["arms__"], strict=True)):
            o, x = np.asarray(peaks.values, float), np.asarray(intensities.values, float)
            alphas, own = firsts.values.field("alpha"), firsts.values.field("alpha_mass").to_numpy()
            rest, reach = precursor - own - linker.total, precursor * precursor_ppm / 1e6
            begin, end = np.searchsorted(masses, rest - reach), np.where(rest > 0, np.searchsorted(masses, rest + reach, side="right"), 0)
            size = np.maximum(end - begin, 0)
            if not (total := int(size.sum())):
                continue
            first = np.repeat(np.arange(len(own)), size)
            second = np.repeat(begin, size) + np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            heavy = o[np.isfinite(o)]
            bare, shifted = _seen(heavy, product_ppm, 0.0), _seen(heavy, product_ppm, reach + 1e-6)
            betas, place = np.unique(second, return_inverse=True)
            # Where intensities aren't known or below zero, nothing bounds a score.
            share = x / t if t else np.zeros(len(x))
            worth = 1 + share.max(initial=0.0) if (share >= 0).all() else np.inf
            n = _most_matches(alphas, precursor - own, bare, shifted)[first] + _most_matches(names.take(pa.array(betas)), precursor - masses[betas], bare, shifted)[place]
            bounds = np.where(n > 0, n * worth, 0.0) + 1e-6
            best: dict[tuple[str, str], tuple] = {}
            levels: list[float] = []
            order = np.flatnonzero(bounds >= cutoff)
            for k in order[np.argsort(-bounds[order], kind="stable")].tolist():
                if len(levels) == 2 and bounds[k] < levels[1]:
                    break
                (p, wp), (q, wq) = sorted([(alphas[int(first[k])].as_py(), float(own[first[k]])), (names[int(second[k])].as_py(), float(masses[second[k]]))])
                if (p, q) not in best:
                    found = _pair_score(o, x, t, p, q, wp, wq, linker, product_ppm)
                    best[p, q] = (p, q, *found, found[2] + found[3])
                    if best[p, q][-1] >= cutoff:
                        levels = sorted({*levels, round(best[p, q][-1], 9)}, reverse=True)[:2]
            passed = sorted((r for r in best.values() if r[-1] >= cutoff), key=lambda r: -round(r[-1], 9))
            n_best = sum(round(r[-1], 9) == levels[0] for r in passed)
            out += passed[: n_best + 1]
            rows += [s] * len(passed[: n_best + 1])
        columns = list(zip(*out, strict=True)) or [[]] * 7
        return pa.table({"scan_id": a["scan_id"].take(pa.array(rows, pa.int64()))} | {f.name: pa.array(c, kind) for f, kind, c in zip(shape.fields[1:], (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), columns, strict=True)})

    shape = T.StructType([T.StructField("scan_id", scans.schema["scan_id"].dataType), *T.StructType.fromDDL("alpha string, beta string, alpha_site int, beta_site int, alpha_score double, beta_score double, score double").fields])
    asked = left(lists.hint("shuffle_hash").join(scans, "scan_id"), "scan_id", "precursor_mass", "peaks", "intensities", "total", "arms__")
    return asked.groupBy("part__", "block__").cogroup(right(known).groupBy("part__", "block__")).applyInArrow(search, shape)


def crosslink_search(scans: DataFrame, peptides: DataFrame, linker: Linker, precursor_ppm: float = 5.0, product_ppm: float = 20.0, rough_cutoff: int = 3, most: int = 50, cutoff: float = 6.0) -> DataFrame:
    """(scan_id, alpha, beta, sites, scores, score, runner_up): the best pairs of each scan, ties included (Q4). Each scan and each peptide is there once.

    Round one counts unshifted fragments for first arms; round two finds the second arm by what the first leaves of the precursor and scores both
    arms at their sites. `most` first arms and their ties go on, as a parameter of the search.
    """
    arms = materialize(peptides.filter(F.size(linker_sites(F.col("peptide"), linker.residues)) > 0).select("peptide", "mass"), "arms")
    lists = _rough_lists(scans, arms, linker, product_ppm, rough_cutoff, most, 200).groupBy("scan_id").agg(F.flatten(F.collect_list("arms__")).alias("arms__"))
    # Of all blocks' lists the `most` and their ties; written once, since it is counted too.
    last = F.element_at(F.sort_array(F.transform("arms__", lambda x: x["n"]), asc=False), F.least(F.lit(most), F.size("arms__")))
    lists = materialize(lists.withColumn("least__", last).select("scan_id", F.filter("arms__", lambda x: x["n"] >= F.col("least__")).alias("arms__")), "first-arms")
    found = _best_pairs(scans, lists, arms, linker, precursor_ppm, product_ppm, cutoff)
    # Both arms of a pair may be first ones, in blocks of their own.
    return best_with_ties(found.dropDuplicates(["scan_id", "alpha", "beta"]), ["scan_id"], "score", cutoff)
