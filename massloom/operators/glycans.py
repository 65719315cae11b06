"""Glycans: compositions, boxes, motifs, localization graphs."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Masses of the monosaccharides in units of 1e-5 dalton, and their letters in structures.
MONOSACCHARIDES = {"Hex": 16205282, "HexNAc": 20307937, "NeuAc": 29109542, "NeuGc": 30709033, "Fuc": 14605791, "Phospho": 7996633, "Sulfo": 7995681, "Na": 2298977, "Ac": 4201056, "Xylose": 15005282, "Kdn": 25006897}
LETTERS = {"H": "Hex", "N": "HexNAc", "A": "NeuAc", "G": "NeuGc", "F": "Fuc", "P": "Phospho", "S": "Sulfo", "Y": "Na", "C": "Ac", "X": "Xylose", "K": "Kdn"}


def parse_composition(text: str) -> dict[str, int]:
    """`HexNAc(2)Hex(3)` as numbers of monosaccharides; unknown names and bad text raise ValueError."""
    text = text.strip()
    found = re.findall(r"([A-Za-z]+)\((\d+)\)", text)
    if not found or "".join(f"{n}({k})" for n, k in found) != text or any(n not in MONOSACCHARIDES for n, _ in found):
        raise ValueError(f"not a composition: {text!r}")
    out: Counter[str] = Counter()
    for n, k in found:
        out[n] += int(k)
    return dict(out)


def parse_structure(text: str) -> dict[str, int]:
    """`(N(H(A))(N))` as numbers of monosaccharides, its brackets checked."""
    text, depth, out = text.strip(), 0, Counter()
    for before, ch in zip(" " + text, text, strict=False):
        if ch in "()":
            depth += 1 if ch == "(" else -1
            if depth < 0:
                raise ValueError(f"not a structure: {text!r}")
        elif ch in LETTERS and before == "(":
            out[LETTERS[ch]] += 1
        else:
            raise ValueError(f"not a structure: {text!r}")
    if depth or not out:
        raise ValueError(f"not a structure: {text!r}")
    return dict(out)


def parse_tree(text: str) -> tuple:
    """A structure as (letter, children)."""
    stack: list[tuple[str, list]] = [("", [])]
    for ch in text.strip():
        if ch == "(":
            stack.append(("", []))
        elif ch == ")":
            node = stack.pop()
            stack[-1][1].append(node)
        else:
            stack[-1] = (ch, stack[-1][1])
    return stack[0][1][0]


def mass_e5(composition: dict[str, int]) -> int:
    return sum(MONOSACCHARIDES[n] * k for n, k in composition.items())


def y_ions(text: str) -> list[int]:
    """The masses of the parts of a structure that hold its root: what is left on the peptide after cleavages (G9), ascending, with 0."""

    def parts(node: tuple) -> set[int]:
        letter, children = node
        own = {MONOSACCHARIDES[LETTERS[letter]]}
        for c in children:
            below = parts(c) | {0}
            own = {a + b for a in own for b in below}
        return own

    return sorted(parts(parse_tree(text)) | {0})


def boxes(glycans: Sequence[int], most: int) -> list[tuple[int, ...]]:
    """Multisets of 1 to `most` glycans (G7, G8): combinations with repetition, in order."""
    return [b for k in range(1, most + 1) for b in itertools.combinations_with_replacement(sorted(glycans), k)]


def sub_boxes(box: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The distinct parts of a box, the empty one and itself included."""
    return sorted({c for k in range(len(box) + 1) for c in itertools.combinations(box, k)}, key=lambda b: (len(b), b))


def motif_feasible(box_motifs: Sequence[str], site_motifs: Sequence[str]) -> bool:
    """Whether a peptide has enough sites of each motif that a box asks for."""
    need, have = Counter(box_motifs), Counter(site_motifs)
    return all(have[m] >= n for m, n in need.items())


def child_ions(composition: dict[str, int]) -> list[dict[str, int]]:
    """The parts of an O-glycan that can be ions (I23): at least one HexNAc, no more Fuc than HexNAc, twice NeuAc at least the acetyls."""
    names = list(composition)
    out = []
    for counts in itertools.product(*[range(composition[n] + 1) for n in names]):
        c = {n: k for n, k in zip(names, counts, strict=True) if k}
        if c.get("HexNAc", 0) >= 1 and c.get("Fuc", 0) <= c.get("HexNAc", 0) and 2 * c.get("NeuAc", 0) >= c.get("Ac", 0):
            out.append(c)
    return sorted(out, key=mass_e5)


def n_glycan_ladder(composition: dict[str, int]) -> list[dict[str, int]]:
    """The Y-ion ladder of an N-glycan by composition (I27): HexNAc, then the core's Hex, then more of both, each with and without Fuc and Xylose."""
    nac, hexose = composition.get("HexNAc", 0), composition.get("Hex", 0)
    core = [{"HexNAc": i} for i in range(min(nac, 2) + 1)]
    if nac >= 2:
        core += [{"HexNAc": 2, "Hex": h} for h in range(1, min(hexose, 3) + 1)]
        core += [{"HexNAc": 2 + a, "Hex": min(hexose, 3) + b} for a in range(nac - 1) for b in range(hexose - min(hexose, 3) + 1) if a + b and hexose >= 3]
    out = []
    for base in core:
        for fuc in range(2 if composition.get("Fuc") and base.get("HexNAc") else 1):
            for xyl in range(2 if composition.get("Xylose") and base.get("Hex") else 1):
                out.append({k: v for k, v in {**base, "Fuc": fuc, "Xylose": xyl}.items() if v})
    return out


def binomial_weight(matched: int, tried: int, p: float) -> float:
    """One over the chance of at least `matched` of `tried` random hits."""
    if tried <= 0 or matched <= 0:
        return 1.0
    logs = [math.lgamma(tried + 1) - math.lgamma(k + 1) - math.lgamma(tried - k + 1) + k * math.log(p) + (tried - k) * math.log1p(-p) for k in range(matched, tried + 1)]
    top = max(logs)
    return math.exp(-(top + math.log(sum(math.exp(x - top) for x in logs))))


def best_routes(costs: Sequence[Sequence[float]], options: Sequence[Sequence[int]], box: tuple[int, ...], tolerance: float = 1e-8) -> tuple[float, list[tuple[tuple[int, int], ...]]]:
    """The best total and all placements of a box's glycans on sites that reach it (I8).

    `costs[site][glycan]` is what a glycan on a site adds; `options[site]` are the glycans a site can have. Sites are passed in order; a state is the
    part of the box placed so far, kept with its best total and every way to it.
    """
    if len(box) == 1:  # each route is one site
        best, routes = float("-inf"), []
        for site, allowed in enumerate(options):
            if box[0] in allowed:
                value = 0.0 + costs[site][box[0]]
                if not routes or value > best + tolerance:
                    best, routes = value, [((site, box[0]),)]
                elif abs(value - best) <= tolerance:
                    routes.append(((site, box[0]),))
        return best, routes
    states: dict[tuple[int, ...], tuple[float, list[tuple[tuple[int, int], ...]]]] = {(): (0.0, [()])}
    for site, allowed in enumerate(options):
        after = dict(states)
        for placed, (total, routes) in states.items():
            left = Counter(box) - Counter(placed)
            for g in sorted(set(allowed) & set(left)):
                key = tuple(sorted((*placed, g)))
                value = total + costs[site][g]
                mine = [(*r, (site, g)) for r in routes]
                if key not in after or value > after[key][0] + tolerance:
                    after[key] = (value, mine)
                elif abs(value - after[key][0]) <= tolerance:
                    after[key] = (after[key][0], after[key][1] + mine)
        states = after
    return states.get(tuple(sorted(box)), (float("-inf"), []))


def all_routes(options: Sequence[Sequence[int]], box: tuple[int, ...]) -> list[tuple[tuple[int, int], ...]]:
    """Every placement of a box's glycans on sites."""
    return best_routes([{g: 0.0 for g in set(box)} for _ in options], options, box)[1]


def placements(box: tuple[int, ...], options: Sequence[Sequence[int]], costs: Sequence[dict[int, float]]) -> list[tuple[float, int, int, int, float]]:
    """(best, n_routes, site, glycan, probability) of each site and glycan that a route passes."""
    best, routes = best_routes(costs, options, box)
    if not routes:
        return []
    every = all_routes(options, box) if len(box) > 1 else [((s, box[0]),) for s, o in enumerate(options) if box[0] in o]
    totals = [sum(costs[s][g] for s, g in r) for r in every]
    weights = [math.exp(t - max(totals)) for t in totals]
    share: Counter = Counter()
    for r, w in zip(every, weights, strict=True):
        for pair in r:
            share[pair] += w
    return [(best, len(routes), s, g, w / sum(weights)) for (s, g), w in sorted(share.items())]


def localize(candidates: DataFrame, key: str) -> DataFrame:
    """(`key`, best, n_routes, site, glycan, probability) of each candidate.

    `candidates` has `key`, box (array of glycan ids), options (array of arrays) and costs (array of maps from glycan id to cost). The weight of
    a route is e to its total; a site's probability is the weight of the routes through it over that of all.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, box, options, costs in zip(b[key], b["box"], b["options"], b["costs"], strict=True):
                rows += [(k, *r) for r in placements(tuple(box), [list(o) for o in options], [dict(c) for c in costs])]
            yield pd.DataFrame(rows, columns=[key, "best", "n_routes", "site", "glycan", "probability"])

    kind = candidates.schema[key].dataType.simpleString()
    return candidates.select(key, "box", "options", "costs").mapInPandas(place, f"{key} {kind}, best double, n_routes int, site int, glycan int, probability double")


def glycan_table(lines: DataFrame, column: str) -> DataFrame:
    """(`column`, composition, mass_e5) of composition lines, by built-in functions (S10); lines of another form have a null mass."""
    table = F.create_map(*[F.lit(x) for pair in MONOSACCHARIDES.items() for x in pair])
    names = F.regexp_extract_all(column, F.lit(r"([A-Za-z]+)\((\d+)\)"), 1)
    counts = F.regexp_extract_all(column, F.lit(r"([A-Za-z]+)\((\d+)\)"), 2)
    terms = F.zip_with(names, counts, lambda n, k: F.try_element_at(table, n) * k.cast("bigint"))
    ok = F.btrim(F.col(column)).rlike(r"^(?:[A-Za-z]++\(\d++\))++\z")
    return lines.select(column, F.when(ok, F.map_from_arrays(names, F.transform(counts, lambda k: k.cast("int")))).alias("composition"), F.when(ok, F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("mass_e5"))


#: Bins a dalton in which a glycopeptide's fragments are looked up before it is scored.
_BINS = 100


def glyco_search(scans: DataFrame, peptides: DataFrame, boxes_: Sequence[tuple[int, ...]], glycan_masses: dict[int, float], residues: str = "ST", precursor_ppm: float = 5.0, product_ppm: float = 20.0, cutoff: float = 5.0, spectra: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(scan_id, peptide, box, score, n_routes, site, glycan, probability): the best glycopeptides of each scan with where their glycans sit (Q5).

    A peptide fits with each box of glycans that makes up the rest of the precursor and for which it has enough sites. Fragments without glycans are
    scored, and one more for each sum of the peptide with a part of the box that is seen (Y ions); candidates tied for the best go on. A site's
    evidence for a glycan is what the ladder with the glycan on it scores beyond the bare one, and routes are placed over the sites.
    `boxes_` are multisets of glycan ids, `glycan_masses` their masses.

    Scans, each once, and peptides meet in blocks by the precursor's mass, a peptide in each block that one of its boxes touches, so pairs are never shuffled. There
    the bins of a candidate's fragments bound its score, and only those that can be the best are scored. `spectra` adds peaks (ascending), intensities
    and total to rows of `scans`, where they follow from other columns: they are then made behind the shuffle.
    """
    from massloom.operators.search import BLOCK_WIDTH, _matches, bond_matches, flat_spectra, ladder_bins, list_scores

    sums, sizes = [sum(glycan_masses[g] for g in b) for b in boxes_], [len(b) for b in boxes_]
    parts = [sorted({sum(glycan_masses[g] for g in p) for p in sub_boxes(b) if p}) for b in boxes_]
    block = lambda m: F.floor(F.log(F.greatest(m, F.lit(1e-3))) / BLOCK_WIDTH)
    asked = scans.filter("scan_id IS NOT NULL AND precursor_mass IS NOT NULL AND NOT isnan(precursor_mass)").withColumn("block__", block(F.col("precursor_mass")))
    if spectra is not None:
        # Laid out by block first, so spectra are neither shuffled nor sorted.
        asked = spectra(asked.repartition("block__").sortWithinPartitions("block__"))
    # Without a total no share of the intensity is counted; pandas would make NaN of null.
    asked = asked.select("scan_id", "precursor_mass", "peaks", "intensities", F.coalesce("total", F.lit(0.0)).alias("total"), "block__")
    places = F.length("peptide") - F.length(F.translate(F.col("peptide"), residues, ""))
    with_box = lambda x, ppm: (F.col("mass") + x) * (1 + ppm / 1e6)
    touched = F.array_distinct(F.flatten(F.array(*[F.sequence(block(with_box(x, -2 * precursor_ppm)), block(with_box(x, 2 * precursor_ppm))) for x in sums])))
    able = peptides.filter("mass IS NOT NULL AND NOT isnan(mass)").select("peptide", "mass", places.alias("n_sites")).filter("n_sites > 0").withColumn("block__", F.explode(touched))

    def candidates(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("mass")
        masses, n_sites, names = b["mass"].to_numpy(), b["n_sites"].to_numpy(), b["peptide"].to_pylist()
        bins, owner = ladder_bins(names, _BINS)
        bins, ends = bins[np.argsort(owner, kind="stable")], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(names)))]
        seen = np.zeros(int(bins.max(initial=0)) + 1, bool)
        precursors, totals = a["precursor_mass"].to_numpy(), a["total"].to_pylist()
        peaks, intensities = a["peaks"].combine_chunks(), a["intensities"].combine_chunks()
        reach = precursors * precursor_ppm / 1e6
        lows, highs = [precursors - x - reach for x in sums], [precursors - x + reach for x in sums]
        begin = np.array([np.searchsorted(masses, lo) for lo in lows]).reshape(len(sums), -1)
        end = np.array([np.where(lo > 0, np.searchsorted(masses, hi, side="right"), 0) for lo, hi in zip(lows, highs, strict=True)]).reshape(len(sums), -1)
        rows, counts, found, box_no = [], [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for s in np.flatnonzero((end > begin).any(axis=0)).tolist():
            o, x, t = np.asarray(peaks[s].values if peaks[s].is_valid else [], float), np.asarray(intensities[s].values if intensities[s].is_valid else [], float), totals[s]
            most = float((x / t).max()) if t and len(x) else 0.0
            # A fragment is worth one and its share of the intensity; unknown shares bound nothing.
            worth = np.inf if np.isnan(most) else 1 + max(most, 0.0)
            heavy = o[o > 0]
            first, last = np.floor(heavy * (1 - 2 * product_ppm / 1e6) * _BINS).astype(np.int64).tolist(), np.ceil(heavy * (1 + 2 * product_ppm / 1e6) * _BINS).astype(np.int64).tolist()
            for i, j in zip(first, last, strict=True):
                seen[i : j + 1] = True
            near, kinds, bounds = [], [], []
            for k, (i, j) in enumerate(zip(begin[:, s].tolist(), end[:, s].tolist(), strict=True)):
                if i < j:
                    hits = np.r_[0, np.cumsum(seen[bins[ends[i] : ends[j]]])][ends[i : j + 1] - ends[i]]
                    hits = np.diff(hits)
                    bound = np.where(hits > 0, hits * worth, 0.0) + len(parts[k])
                    some = np.flatnonzero((n_sites[i:j] >= sizes[k]) & (bound >= cutoff))
                    near.append(some + i)
                    kinds.append(np.full(len(some), k, np.int32))
                    bounds.append(bound[some])
            for i, j in zip(first, last, strict=True):
                seen[i : j + 1] = False
            near, kinds, bounds = np.concatenate(near), np.concatenate(kinds), np.concatenate(bounds)
            if len(near):
                # Whatever can't reach what the first one has is not the best.
                low = list_scores(o, x, t, [names[near[bounds.argmax()]]], product_ppm)[0]
                some = ~(bounds < low - 1e-6)
                rows.append(s)
                found.append(near[some])
                box_no.append(kinds[some])
                counts.append(len(found[-1]))
        at, no = np.concatenate(found), np.concatenate(box_no)
        each = pa.StructArray.from_arrays([pa.array([names[i] for i in at], pa.string()), pa.array(no), pa.array(masses[at])], ["peptide", "box_no", "mass"])
        return a.select(["scan_id", "peaks", "intensities", "total"]).take(pa.array(rows, pa.int64())).append_column("candidates__", pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), each))

    @F.pandas_udf("array<double>")
    def score(peaks: pd.Series, intensities: pd.Series, total: pd.Series, peptides: pd.Series, masses: pd.Series, boxes: pd.Series) -> pd.Series:
        spectra = flat_spectra(peaks, intensities, total)
        sizes = [len(p) for p in peptides]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        b, y, at = bond_matches(spectra, rows, [p for ps in peptides for p in ps], np.zeros(len(rows)), product_ppm)
        owner, scores, totals = np.repeat(np.arange(len(rows)), np.diff(at)), np.zeros(len(rows)), spectra[3][rows]
        for ions in (b, y):
            hit = ions >= 0
            scores += np.bincount(owner[hit], minlength=len(rows))
            scores += np.divide(np.bincount(owner[hit], weights=spectra[1][ions[hit]], minlength=len(rows)), totals, out=np.zeros(len(rows)), where=totals != 0)
        y_ions = [int((_matches(spectra[0][spectra[2][r] : spectra[2][r + 1]], m + np.array(parts[k]), product_ppm) >= 0).sum()) for r, m, k in zip(rows.tolist(), itertools.chain(*masses), itertools.chain(*boxes), strict=False)]
        return pd.Series(np.split(scores + y_ions, np.cumsum(sizes)[:-1]))

    @F.pandas_udf("array<struct<n_routes:int,site:int,glycan:int,probability:double>>")
    def evidence(peaks: pd.Series, intensities: pd.Series, total: pd.Series, peptide: pd.Series, box_no: pd.Series) -> pd.Series:
        spectra, names, boxes = flat_spectra(peaks, intensities, total), peptide.tolist(), [boxes_[k] for k in box_no]
        rows = np.arange(len(names))
        # What a match is worth: one, and the peak's share of the total where that is known; none is worth nothing.
        totals = np.repeat(spectra[3], np.diff(spectra[2]))
        worth = np.r_[1 + np.divide(spectra[1], totals, out=np.zeros(len(totals)), where=totals != 0), 0.0]
        b, y, at = bond_matches(spectra, rows, names, np.zeros(len(rows)), product_ppm)
        sites = [[i for i, a in enumerate(p) if a in residues] for p in names]
        costs: list[list[dict[int, float]]] = [[{} for _ in s] for s in sites]
        for g in sorted({g for k in boxes for g in k}):
            some = np.array([r for r in rows if g in boxes[r]])
            b1, y1, at1 = bond_matches(spectra, some, [names[r] for r in some], np.full(len(some), float(glycan_masses[g])), product_ppm)
            bonds = np.repeat(at[some], np.diff(at1)) + np.arange(len(b1)) - np.repeat(at1[:-1], np.diff(at1))
            # Beyond the bare ladder: the b masses from the site on and the y masses before it are shifted.
            more_b, more_y = np.r_[0.0, np.cumsum(worth[b1] - worth[b[bonds]])], np.r_[0.0, np.cumsum(worth[y1] - worth[y[bonds]])]
            for k, r in enumerate(some):
                lo, hi = at1[k], at1[k + 1]
                at_sites = lo + np.array(sites[r])
                gains = np.round(more_b[hi] - more_b[at_sites] + more_y[at_sites] - more_y[lo], 9).tolist()
                for i, x in enumerate(gains):
                    costs[r][i][g] = x
        # The sites of a peptide can have any glycan of its box.
        return pd.Series([[x[1:] for x in placements(k, [sorted(set(k))] * len(s), c)] for k, s, c in zip(boxes, sites, costs, strict=True)])

    # All candidates of a scan are in its list, of which only what ties for the best goes on. Marked, so that the plan doesn't work scores out again for a filter.
    once, evidence_once = score.asNondeterministic(), evidence.asNondeterministic()
    listed = T.ArrayType(T.StructType([T.StructField("peptide", T.StringType()), T.StructField("box_no", T.IntegerType()), T.StructField("mass", T.DoubleType())]))
    shape = T.StructType([*[T.StructField(c, asked.schema[c].dataType) for c in ("scan_id", "peaks", "intensities", "total")], T.StructField("candidates__", listed)])
    lists = asked.groupBy("block__").cogroup(able.groupBy("block__")).applyInArrow(candidates, shape)
    scores = once("peaks", "intensities", "total", *[F.col("candidates__")[n] for n in ("peptide", "mass", "box_no")])
    spectrum = ("peaks", "intensities", "total")
    zipped = lists.select("scan_id", *spectrum, "candidates__", scores.alias("s__")).select("scan_id", *spectrum, F.arrays_zip(F.col("candidates__").alias("c"), F.col("s__").alias("s")).alias("z__"))
    top = F.array_max(F.transform("z__", lambda z: F.round(z["s"], 9)))
    tied = zipped.withColumn("top__", top).select("scan_id", *spectrum, F.explode(F.filter("z__", lambda z: (F.round(z["s"], 9) == F.col("top__")) & (z["s"] >= cutoff))).alias("z"))
    best = tied.select("scan_id", *spectrum, "z.c.peptide", "z.c.box_no", F.col("z.s").alias("score"))
    boxes_column = F.array(*[F.array(*[F.lit(g) for g in b]) for b in boxes_])
    placed = best.withColumn("e", evidence_once(*spectrum, "peptide", "box_no")).select("scan_id", "peptide", "box_no", "score", F.inline("e"))
    site_of = F.filter(F.sequence(F.lit(1), F.length("peptide")), lambda i: F.substring("peptide", i, F.lit(1)).isin(*residues))
    out = placed.withColumn("box", F.element_at(boxes_column, F.col("box_no") + 1)).withColumn("sites", site_of)
    return out.select("scan_id", "peptide", "box", "score", "n_routes", F.element_at("sites", F.col("site") + 1).alias("site"), "glycan", "probability")
