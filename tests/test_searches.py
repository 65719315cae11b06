"""Searches, isotopes and sequences against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import masses, sequences
from massloom.operators import aggregates, crosslinks, filters, isotopes, ordered, search
from massloom.plans import composite_queries


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (6, 6)):
        costs = rng.integers(0, 9, (n, m)).astype(float)
        chosen = isotopes.assign(costs)
        total = sum(costs[r, c] for r, c in enumerate(chosen) if c >= 0)
        small, large = (n, m) if n <= m else (m, n)
        table = costs if n <= m else costs.T
        assert total == min(sum(table[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len({c for c in chosen if c >= 0}) == small


def test_planted_envelopes_come_back():
    rng = np.random.default_rng(2)
    planted = [(742.31, 1, 1e4), (1480.72, 2, 3e4), (2210.05, 3, 5e4), (4803.4, 5, 9e4)]
    mz, intensity = [], []
    for mass, z, height in planted:
        p = isotopes.average_pattern(round(mass / 10))
        mz += [(mass + k * masses.ISOTOPE_STEP) / z + masses.PROTON for k in range(len(p))]
        intensity += (p * height).tolist()
    mz += rng.uniform(300, 1500, 40).tolist()
    intensity += rng.uniform(1, 50, 40).tolist()
    found = isotopes.deconvolute(np.array(mz), np.array(intensity), (1, 2, 3, 4, 5, 6))
    for mass, z, _ in planted:
        assert any(abs(m - mass) < 1e-3 and c == z for m, c, _, _ in found)
    assert isotopes.deconvolute(np.array([]), np.array([]), (1, 2)) == []


def test_deconvolution_of_nulls_and_empty_spectra(spark):
    df = spark.createDataFrame([(1, None, None), (2, [], []), (3, [500.0], [1.0])], "id int, mz array<double>, intensity array<double>")
    assert isotopes.deconvoluted(df, "id").count() == 0


def test_pattern_of_a_formula():
    p = isotopes.isotope_pattern({"C": 10, "S": 1}, 4)
    c, s = isotopes.ISOTOPES["C"], isotopes.ISOTOPES["S"]
    assert p[0] == pytest.approx(c[0] ** 10 * s[0]) and p[1] == pytest.approx(10 * c[0] ** 9 * c[1] * s[0] + c[0] ** 10 * s[1])


def test_averaging_drops_outliers(spark):
    rows = [("f", i, 500.0, 10.0) for i in range(5)] + [("f", 9, 500.001, 1000.0), ("f", 1, None, 5.0), ("f", 1, 600.0, None)]
    got = isotopes.averaged(spark.createDataFrame(rows, "file string, scan int, mz double, i double"), ["file"], "scan", "mz", "i", 0.1, 1.5).collect()
    assert [(r.mz, r.intensity, r.n_kept) for r in got] == [(500.0, 10.0, 5)]


def _plain_score(observed, intensity, total, theory, ppm):
    at = search._matches(observed, theory, ppm)
    at = at[at >= 0]
    return len(at) + (intensity[at].sum() / total if total else 0.0)


def test_scores_of_lists_and_sites_are_those_of_single_ladders():
    rng = np.random.default_rng(3)
    peptides = ["PEPTIDEK", "AGAK", "MX", "ACDEFGHIKLMNPQRSTVWY", "K", "AXAK"]
    theory = np.concatenate([search.ladder_masses(p) for p in peptides])
    observed = np.sort(np.r_[theory[~np.isnan(theory)][::2], rng.uniform(100, 2000, 30)])
    intensity = rng.uniform(0, 5, len(observed))
    scores = search.list_scores(observed, intensity, 40.0, peptides, 20.0)
    for p, s in zip(peptides, scores, strict=True):
        assert s == pytest.approx(_plain_score(observed, intensity, 40.0, search.ladder_masses(p), 20.0))
    for p in ("PEPTIDEK", "AXAK"):
        for site, s in enumerate(search.site_scores(observed, intensity, 40.0, p, 15.994915, 20.0), 1):
            assert s == pytest.approx(_plain_score(observed, intensity, 40.0, search.ladder_masses(p, 15.994915, site), 20.0))
    assert search.list_scores(np.array([]), np.array([]), None, ["PEPK"], 20.0).tolist() == [0.0]


def test_isoforms_against_every_choice(spark):
    variable = {"M": [("Ox", 16.0)], "S": [("Ph", 80.0), ("Su", 80.1)]}
    df = spark.createDataFrame([("AMSK", 100.0), ("AAK", 50.0), ("SS", 10.0)], "peptide string, mass double")
    got = {}
    for r in search.with_isoforms(df, variable, 2).collect():
        got.setdefault(r.peptide, []).append((r.full_sequence, round(r.mass, 3)))
    assert got["AAK"] == [("AAK", 50.0)]
    assert sorted(got["AMSK"]) == sorted([("AMSK", 100.0), ("AM[Ox]SK", 116.0), ("AMS[Ph]K", 180.0), ("AMS[Su]K", 180.1), ("AM[Ox]S[Ph]K", 196.0), ("AM[Ox]S[Su]K", 196.1)])
    assert len(got["SS"]) == 1 + 4 + 4
    assert search.with_isoforms(df, {}, 2).count() == 3


def test_nonspecific_and_places(spark):
    df = spark.createDataFrame([("a", "MKAAR"), ("b", ""), ("c", None), ("d", "AB")], "id string, s string")
    every = {(r.peptide, r.start, r.end) for r in search.nonspecific_peptides(df, ["id"], "s", 3, 4).collect()}
    assert every == {("MKA", 1, 3), ("KAA", 2, 4), ("AAR", 3, 5), ("MKAA", 1, 4), ("KAAR", 2, 5)}
    semi = {r.peptide for r in search.nonspecific_peptides(df, ["id"], "s", 3, 4, "trypsin").collect()}
    assert semi == {"MKA", "MKAA", "AAR", "KAAR"}
    rows = spark.createDataFrame([(1, "AA", "AAACAA"), (2, "X", "AAA"), (3, "", "A"), (4, None, "A"), (5, "A", None)], "id int, p string, w string")
    assert sorted((r.id, r.start, r.end) for r in search.places_of(rows, "p", "w").collect()) == [(1, 1, 2), (1, 2, 3), (1, 5, 6)]


def test_nonspecific_search_takes_every_stretch(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    proteins = ["".join(rng.choice("GASPVTLIK") for _ in range(rng.randint(5, 40))) for _ in range(60)] + ["", None, "MK", "A" * 70, "GAAILVVKS", "GAALIVVKS"]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(proteins)], "id string, s string")
    truths = [p[3 : 3 + rng.randint(5, 14)] for p in proteins[:60] if len(p) > 20] + ["GGGGGG", "WWWWWW", "AAAAAAA", "AAILVVK"]
    ladders = [sorted(search.ladder_masses(t)) for t in truths]
    scans = spark.createDataFrame([(i, float(search._MASS_OF[[ord(a) for a in t]].sum() + masses.WATER), [float(m) for m in x], [float(k % 3) for k in range(len(x))], float(len(x))) for i, (t, x) in enumerate(zip(truths, ladders))], "scan_id int, precursor_mass double, peaks array<double>, intensities array<double>, total double")
    stretches = search.nonspecific_peptides(df, ["id"], "s", 5, 20).select("peptide", "mass").dropDuplicates(["peptide"])
    want = sorted((r.scan_id, r.peptide, round(r.score, 6)) for r in search.classic_search(scans, stretches, cutoff=3.0).collect())
    got = lambda: sorted((r.scan_id, r.peptide, round(r.score, 6)) for r in search.nonspecific_search(scans, df, "s", 5, 20, cutoff=3.0).collect())
    assert got() == want and len({w[0] for w in want}) > 20 and len(want) > len({w[0] for w in want})
    monkeypatch.setattr(search, "RESIDUES_AT_ONCE", 300)
    assert got() == want
    args = [[r[k] for r in scans.collect()] for k in range(1, 5)]
    monkeypatch.setattr(search, "STRETCHES_AT_ONCE", 50)
    monkeypatch.setattr(search, "SPANS_AT_ONCE", 7)
    at, names, scores = search.best_stretches(np.array(args[0]), *args[1:], [p for p in proteins if p], 5, 20, 5.0, 20.0, 3.0)
    assert sorted((i, n, round(s, 6)) for i, n, s in zip(at, names, scores)) == want
    # An unknown residue doesn't hide the stretches behind it.
    spark.createDataFrame([("p", "MKXAACDEFGHIKL")], "accession string, base_sequence string").write.parquet(f"{tmp_path}/proteins.parquet")
    spark.createDataFrame([(1, "ACDEFGH"), (2, "KXAACDE"), (3, "DEFGHIKL"), (4, "WWWWWWWW")], "psm_id long, base_sequence string").write.parquet(f"{tmp_path}/psms.parquet")
    assert [tuple(r) for r in composite_queries.nonspecific_search(spark, str(tmp_path)).collect()] == [(2,)]


def test_modifications_with_nested_brackets(spark):
    df = spark.createDataFrame([("[Ac on X]PEC[Common Fixed:Carb on C]S[Metal:Fe[III] on S]K",), ("PEPK",), (None,)], "s string")
    got = [r[0] for r in df.select(sequences.modifications(F.col("s"))).collect()]
    assert [[tuple(m) for m in g] if g is not None else None for g in got] == [[(0, "Ac on X"), (4, "Metal:Fe[III] on S")], [], None]
    assert df.select(sequences.bare_sequence(F.col("s"))).first()[0] == "PECSK"


def test_fragment_coverage_against_the_rules(spark):
    def plain(n, c, length):
        n, c, out = sorted(set(n)), sorted(set(c)), set()
        if n and length - 1 in n or length in c:
            out.add(length)
        if 1 in n or 2 in c:
            out.add(1)
        for a, b in itertools.pairwise(n):
            out |= {b} if b - a == 1 or b in c else set()
            out |= {b + 1} if b + 2 in c else set()
        for a, b in itertools.pairwise(c):
            out |= {a} if b - a == 1 else set()
        return sorted(out)

    rng = random.Random(4)
    rows = [([rng.randrange(1, 9) for _ in range(rng.randrange(6))], [rng.randrange(2, 10) for _ in range(rng.randrange(6))]) for _ in range(200)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, n array<int>, c array<int>")
    got = {r.id: r.x for r in df.select("id", aggregates.fragment_coverage(F.col("n"), F.col("c"), F.lit(9)).alias("x")).collect()}
    assert got == {i: plain(n, c, 9) for i, (n, c) in enumerate(rows)}


def test_chances(spark):
    df = spark.createDataFrame([(3, 10), (10, 10), (0, 5), (1, 200)], "k int, n int")
    got = [r[0] for r in df.select(masses.chance_weight(F.col("k"), F.col("n"), 0.2)).collect()]
    want = [1 / sum(math.comb(n, j) * 0.2**j * 0.8 ** (n - j) for j in range(k, n + 1)) if k else 1.0 for k, n in ((3, 10), (10, 10), (0, 5), (1, 200))]
    assert got == pytest.approx(want)
    z = spark.createDataFrame([(x / 4,) for x in range(-16, 17)], "z double")
    assert all(abs(r.p - (1 + math.erf(r.z / math.sqrt(2))) / 2) < 2e-7 for r in z.select("z", masses.normal_cdf(F.col("z")).alias("p")).collect())


def test_running_extremes_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.random(), rng.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, x double, v int")
    laid = ordered.lay_out(df, ["g"], [F.col("x"), F.col("id")])
    got = {r.id: (r.s, r.low, r.high) for r in ordered.running(laid, ["g"], {"s": F.col("v")}, {"low": (F.col("s") % 7, True, False), "high": (F.col("s") % 5, False, True)}).collect()}
    for g in "ab":
        mine = sorted((x, i, v) for i, h, x, v in rows if h == g)
        sums = list(itertools.accumulate(v for _, _, v in mine))
        for k, (_, i, _) in enumerate(mine):
            assert got[i] == (sums[k], min(s % 7 for s in sums[k:]), max(s % 5 for s in sums[: k + 1]))


def test_shared_peaks_count_for_the_better_arm(spark):
    linker = crosslinks.Linker("L", "K", 100.0, 0.0, 0.0, 0.0, 0.0)
    a, b = "AKGGGR", "SKVVR"
    wa, wb = search.ladder_masses(a)[-1], search.ladder_masses(b)[-1]
    mass = lambda p: float(sum(masses.RESIDUES[x] for x in p) + masses.WATER)
    peaks = sorted([*search.ladder_masses(a, mass(b) + 100.0, 2), *search.ladder_masses(b, mass(a) + 100.0, 2)])
    scans = spark.createDataFrame([("s", mass(a) + mass(b) + 100.0, [float(x) for x in peaks], [1.0] * len(peaks), float(len(peaks)))], "scan_id string, precursor_mass double, peaks array<double>, intensities array<double>, total double")
    peptides = spark.createDataFrame([(a, mass(a)), (b, mass(b)), ("GKAGGR", mass("GKAGGR"))], "peptide string, mass double")
    best = crosslinks.crosslink_search(scans, peptides, linker, rough_cutoff=1).collect()
    assert [(r.alpha, r.beta, r.alpha_site, r.beta_site) for r in best] == [(a, b, 2, 2)]
    assert wa > 0 and wb > 0 and crosslinks.crosslink_search(scans.limit(0), peptides, linker).count() == 0


def test_modification_sites_and_known_ones(spark):
    mods = spark.createDataFrame([("P", "S", "anywhere", 79.97), ("N", "K", "n_term", 1.0)], "modification string, motif string, location string, mass double")
    rows = spark.createDataFrame([("a", "KSS"), ("b", ""), ("c", None)], "accession string, s string")
    known = spark.createDataFrame([("a", 2, 79.9701)], "accession string, site int, mass double")
    assert {(r.modification, r.site) for r in filters.modification_sites(rows, "s", mods, known).collect()} == {("P", 3), ("N", 1)}
    assert filters.modification_sites(rows, "s", mods.limit(0)).count() == 0


def test_rough_arms_counts_in_blocks_and_shuffles_no_hits(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = sorted({"".join(rng.choice(list("ACDEGKLMPUX"), rng.integers(2, 9))) for _ in range(60)})
    arms = spark.createDataFrame([(p, None if "X" in p else float(sum(search.ladder_masses(p[0] + p)[:1]) + search.ladder_masses(p + "G")[len(p) - 1])) for p in names], "peptide string, mass double")
    scans = spark.createDataFrame([(i, float(rng.uniform(300, 1500)), [float(x) for x in search.ladder_masses(names[i]).round(2) if x == x] + [100.0, 100.001, 250.0]) for i in range(20)], "scan_id long, precursor_mass double, peaks array<double>")
    linker = crosslinks.Linker("x", "K", 100.0, 0, 0, 0, 0)
    want = set()
    for r in scans.collect():
        seen = {b for o in r.peaks for b in range(int(np.floor(o * (1 - 4e-5) * 200)), int(np.ceil(o * (1 + 4e-5) * 200)) + 1)}
        n = {a.peptide: sum(int(np.rint(m * 200)) in seen for m in search.ladder_masses(a.peptide) if m == m) for a in arms.collect() if a.mass is not None and a.mass <= r.precursor_mass - 100.0}
        want |= {(r.scan_id, p) for p, k in n.items() if k >= 2 and sum(x > k for x in n.values()) < 3}
    monkeypatch.setattr(crosslinks, "SCANS_AT_ONCE", 5)
    monkeypatch.setattr(crosslinks, "ARMS_AT_ONCE", 7)
    found = crosslinks.rough_arms(scans, arms, linker, 20.0, 2, 3)
    assert {(r.scan_id, r.alpha) for r in found.collect()} == want and want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
