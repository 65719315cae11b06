import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from massloom.functions.masses import overlap_ratio, to_mass, to_mz
from massloom.operators import aggregates, chromatograms, fdr, filters, glycans, inference, joins, quantification, search, windows


def test_running_counts_and_q_values(spark):
    rows = [(i, float(100 - i), i % 4 == 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, score double, d boolean")
    got = {r.id: r for r in fdr.with_q(df, [-F.col("score"), F.col("id")], F.col("d"), {"few": "traditional", "many": "inverted"}).collect()}
    t = d = 0
    for i, _, decoy in rows:
        t, d = t + (not decoy), d + decoy
        assert (got[i].cumulative_target, got[i].cumulative_decoy) == (t, d)
    assert all(got[i].few <= got[i + 1].few and got[i].many <= got[i + 1].many for i in range(39))
    assert got[39].few == pytest.approx(10 / 30) and got[0].many == pytest.approx(min((d + 1) / max(t, 1) for t, d in ((got[i].cumulative_target, got[i].cumulative_decoy) for i in range(40))))
    assert fdr.target_decoy_counts(df.limit(0), [F.col("id")], F.col("d")).count() == 0


def test_notch_shares(spark):
    """A match with two notches counts one half for each."""
    df = spark.createDataFrame([(1, "0"), (2, "1"), (3, "0|1"), (4, "0|0|1"), (5, None)], "id int, notch string")
    got = {(r.id, r.value): r.weight for r in fdr.hypothesis_weights(df, "id", "notch").collect()}
    assert got[3, "0"] == got[3, "1"] == 0.5 and got[4, "0"] == pytest.approx(2 / 3) and got[1, "0"] == 1 and (5, None) not in got


def test_acceptors(spark):
    one = filters.parse_acceptor("x dot 5 ppm 0,1.0029,-1.0029")
    df = spark.createDataFrame([(1000.0, 1000.0), (1001.0029, 1000.0), (998.9971, 1000.0), (1000.4, 1000.0), (None, 1.0)], "o double, t double")
    assert [r.n for r in df.select(filters.accepted(one, F.col("o"), F.col("t")).alias("n")).collect()] == [0, 100290, -100290, None, None]
    assert filters.parse_acceptor("x interval [-1,1];[2,3]").intervals == ((-1.0, 1.0), (2.0, 3.0))
    for bad in ("", "x", "x dot", "x nonsense 1", "x dot 5 parsec 0"):
        with pytest.raises(ValueError):
            filters.parse_acceptor(bad)


@pytest.mark.parametrize("scale", [None, F.log])
def test_band_join_is_cross_join_and_filter(spark, scale):
    rng = np.random.default_rng(1)
    a = [(i, float(lo), float(lo + w)) for i, (lo, w) in enumerate(zip(rng.uniform(1, 50, 200), rng.uniform(0, 2, 200), strict=True))]
    b = [(i, float(v)) for i, v in enumerate(rng.uniform(1, 52, 300))]
    left = spark.createDataFrame([*a, (900, None, 1.0), (901, 5.0, 4.0), (902, float("nan"), 2.0)], "a int, lo double, hi double")
    right = spark.createDataFrame([*b, (900, None), (901, float("nan"))], "b int, v double")
    got = {(r.a, r.b) for r in joins.band_join(left, right, "lo", "hi", "v", 0.1, scale=scale).collect()}
    assert got == {(i, j) for i, lo, hi in a for j, v in b if lo <= v <= hi}


def test_nearest_takes_the_lower_of_two_as_close(spark):
    left = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 5.1), ("k", 3, 0.0), ("k", 4, 99.0), ("none", 5, 1.0), ("k", 6, 6.0)], "k string, id int, at double")
    right = spark.createDataFrame([("k", 4.0), ("k", 6.0), ("k", 6.0)], "k string, v double")
    got = {r.id: r.nearest and r.nearest.value for r in joins.nearest_join(left, right, ["k"], "at", "v").collect()}
    assert got == {1: 4.0, 2: 6.0, 3: 4.0, 4: 6.0, 5: None, 6: 6.0}


def greedy(links):
    prots, peps = {}, {}
    for p, q in links:
        prots.setdefault(p, set()).add(q)
        peps.setdefault(q, set()).add(p)
    taken = {p for q, held in peps.items() if len(held) == 1 for p in held}
    left = set(peps) - set().union(*[prots[p] for p in taken], set())
    while left:
        p = min((p for p in prots if prots[p] & left), key=lambda p: (-len(prots[p] & left), -len(prots[p]), p))
        taken.add(p)
        left -= prots[p]
    return taken | {p for p in prots if any(prots[p] == prots[t] for t in taken)}


@pytest.mark.parametrize("seed", [1, 2])
def test_parsimony_is_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    links = list({(f"P{rng.randrange(25):02d}", f"q{rng.randrange(30)}") for _ in range(110)})
    df = spark.createDataFrame([*links, links[0], (None, "q1"), ("P1", None)], "protein string, peptide string")
    assert {r.protein for r in inference.parsimonious(df, "protein", "peptide").collect()} == greedy(links)
    assert inference.parsimonious(df.limit(0), "protein", "peptide").count() == 0


def test_parsimony_keeps_digests_apart(spark):
    """A peptide that only A gives in one digest is A's own, though B gives it in another."""
    rows = [("A", "x", "trypsin"), ("A", "x", "Arg-C"), ("B", "x", "Arg-C"), ("C", "y", "trypsin"), ("D", "y", "trypsin"), ("C", "z", None)]
    df = spark.createDataFrame(rows, "protein string, peptide string, protease string")
    got = {(r.protein, r.reason) for r in inference.parsimonious(df, "protein", "peptide", "protease").collect()}
    assert got == {("A", "unique"), ("C", "unique")}
    kept = spark.createDataFrame([("A",)], "protein string")
    matches = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B")], "id int, protein string")
    assert [(r.id, r.protein) for r in inference.trimmed(matches, "id", "protein", kept).collect()] == [(1, "A")]


def test_density_peaks_against_the_plain_way(spark):
    rng = np.random.default_rng(3)
    v = np.round(np.r_[rng.normal(0, 0.002, 60), rng.normal(1.0, 0.002, 40), rng.normal(1.006, 0.001, 20), rng.uniform(2, 90, 15)], 4)
    d = 0.00305  # no two of the rounded values are just this far apart
    dens = np.array([(np.abs(v - x) <= d).sum() - 1 for x in v])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id int, v double")
    assert {r.id: r.density for r in windows.density_neighbours(df, "v", d).collect()} == dict(enumerate(dens.tolist()))
    peaks = sorted((round(r.peak, 4), r.n_members) for r in windows.density_peaks(df, "id", "v", d).collect())
    assert all(n == (np.abs(v - p) <= d).sum() for p, n in peaks)
    assert all(b - a > d for (a, _), (b, _) in zip(peaks, peaks[1:], strict=False))
    assert {round(p) for p, n in peaks if n > 10} == {0, 1}


def test_windows(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 2.0, 0.0, None, 8.0, 0.0])], "k string, t int, v double")
    assert [r.imputed for r in windows.gap_imputed(df, ["k"], "t", "v").orderBy("t").collect()] == [2, 2, 4, 6, 8, 8]
    runs = spark.createDataFrame([("a", x) for x in (1, 2, 3, 7, 8, 3)], "k string, p int")
    assert windows.longest_run(runs, ["k"], "p").first().longest_run == 3
    mz = spark.createDataFrame([(1, 100.0, 1), (1, 100.0005, 2), (1, 100.1, 3), (2, 100.0, 4)], "scan int, mz double, id int")
    assert sorted(r.id for r in windows.greedy_dedupe(mz, ["scan"], "mz", 10.0, ["id"]).collect()) == [1, 3, 4]


def test_digest_and_fragments(spark):
    df = spark.createDataFrame([("P", "MAKRPEPKTIDER"), ("E", ""), ("N", None)], "acc string, s string")
    got = {r.peptide for r in search.digest(df, ["acc"], "s", "trypsin", 1, 1).collect()}
    assert got == {"MAK", "MAKRPEPK", "RPEPK", "RPEPKTIDER", "TIDER"}
    one = df.filter("acc = 'P'")
    row = one.select(search.fragments(F.lit("PEPTIDE")).alias("f"), search.peptide_mass(F.lit("PEPTIDE")).alias("m"), search.peptide_mass(F.lit("PXP")).alias("x")).first()
    assert row.m == pytest.approx(799.35997, abs=1e-4) and row.x is None and len(row.f) == 12
    by_hand = dict(((i.kind, i.number), i.mass) for i in row.f)
    assert by_hand["b", 2] + by_hand["y", 5] == pytest.approx(row.m, abs=1e-6)
    assert np.allclose(sorted(by_hand.values()), sorted(search.ladder_masses("PEPTIDE")))
    assert search.isoforms("MAM", {"M": ["ox"]}, 2) == ["MAM", "M[ox]AM", "MAM[ox]", "M[ox]AM[ox]"]
    assert sorted(search.scrambled("PEPTIDEK", 1)) == sorted("PEPTIDEK") and search.scrambled("PEPTIDEK", 1) == search.scrambled("PEPTIDEK", 1)


def test_searches_find_the_truth(spark):
    peptides = ["PEPTIDEK", "PEPTLDEK", "SAMPLERR", "EDITPEPK", "GGGGSSSSK"]
    pep = spark.createDataFrame([(p,) for p in peptides], "peptide string").withColumn("mass", search.peptide_mass(F.col("peptide")))
    scans = []
    for i, p in enumerate(("PEPTIDEK", "SAMPLERR")):
        peaks = sorted(search.ladder_masses(p).tolist())
        mass = float(search.ladder_masses(p + "G")[len(p) - 1]) + 18.010564684
        scans.append((i, mass, peaks, [1.0] * len(peaks), float(len(peaks))))
    s = spark.createDataFrame(scans, "scan_id int, precursor_mass double, peaks array<double>, intensities array<double>, total double")
    want = {(0, "PEPTIDEK"), (0, "PEPTLDEK"), (1, "SAMPLERR")}  # I and L weigh the same
    assert {(r.scan_id, r.peptide) for r in search.classic_search(s, pep).collect()} == want
    assert {(r.scan_id, r.peptide) for r in search.modern_search(s, pep, search.fragment_index(pep)).collect()} == want
    moved = search.ladder_masses("PEPTIDEK", 79.966, 4)
    m = spark.createDataFrame([(0, 1000.0, sorted(moved.tolist()), [1.0] * 14, 14.0)], s.schema)
    hit = search.localized(m, spark.createDataFrame([(0, "PEPTIDEK", 79.966)], "scan_id int, peptide string, shift double")).first()
    assert hit.sites == "4"


def test_glycans():
    assert glycans.parse_composition("HexNAc(2)Hex(3)") == {"HexNAc": 2, "Hex": 3}
    assert glycans.parse_structure("(N(H(A))(N))") == {"HexNAc": 2, "Hex": 1, "NeuAc": 1}
    for bad in ("", "Foo(1)", "HexNAc"):
        with pytest.raises(ValueError):
            glycans.parse_composition(bad)
    for bad in ("", "(N", "N)", "(Q)"):
        with pytest.raises(ValueError):
            glycans.parse_structure(bad)
    assert len(glycans.boxes([1, 2, 3], 2)) == 3 + 6
    assert glycans.motif_feasible(["S", "S"], ["S", "T"]) is False
    rng = random.Random(2)
    for _ in range(40):
        options = [[g for g in (0, 1, 2) if rng.random() < 0.7] for _ in range(4)]
        costs = [{g: rng.choice([0.0, 1.0, 2.0]) for g in (0, 1, 2)} for _ in range(4)]
        box = tuple(sorted(rng.choice((0, 1, 2)) for _ in range(2)))
        every = {tuple(sorted(zip(sites, gs, strict=True))) for sites in itertools.combinations(range(4), 2) for gs in set(itertools.permutations(box)) if all(g in options[s] for s, g in zip(sites, gs, strict=True))}
        assert {tuple(r) for r in glycans.all_routes(options, box)} == every
        best, routes = glycans.best_routes(costs, options, box)
        if every:
            total = lambda r, costs=costs: sum(costs[s][g] for s, g in r)
            assert best == max(map(total, every)) and {tuple(r) for r in routes} == {r for r in every if total(r) == best}


def test_chromatograms(spark):
    a = [{"scan": i, "intensity": x} for i, x in enumerate([1.0, 4.0, 9.0, 4.0, 1.0, 0.5, 0.1])]
    assert chromatograms.pearson(a, [{**p, "intensity": 3 * p["intensity"]} for p in a]) == pytest.approx(1)
    assert np.isnan(chromatograms.pearson(a[:2], a[:2])) and np.isnan(chromatograms.umpire_correlation(a, a))
    long = [{"scan": i, "intensity": float(1 + (i * 7) % 5)} for i in range(24)]
    other = [{"scan": i + 4, "intensity": 2 * p["intensity"]} for i, p in enumerate(long)]
    assert chromatograms.umpire_correlation(long, long, 2) == pytest.approx(1)
    # Twelve intervals of length 1 from the later start; points on inner borders are in none, so only the first interval has one.
    assert chromatograms.umpire_correlation(long, other, 2) == pytest.approx(np.corrcoef(*[[x, *(x / 2**k for k in range(1, 11)), 0.0] for x in (4.0, 2.0)])[0, 1])
    pairs = spark.createDataFrame([(a, long), (long, other), (a[:2], a[:2]), ([{"scan": i, "intensity": 1.0} for i in range(5)], a)], "a array<struct<scan:int,intensity:double>>, b array<struct<scan:int,intensity:double>>")
    for got, (x, y) in zip([r[0] for r in pairs.select(chromatograms.correlation_of("a", "b")).collect()], [(a, long), (long, other), (a[:2], a[:2]), ([{"scan": i, "intensity": 1.0} for i in range(5)], a)], strict=True):
        assert got == pytest.approx(chromatograms.pearson(x, y), nan_ok=True)
    peaks = spark.createDataFrame([("f", s, 500.0 + 1e-4 * s, float(s)) for s in (1, 2, 3, 5, 9, 10, 11)] + [("f", 2, 600.0, 1.0)], "file string, scan int, mz double, i double")
    got = sorted((r.start, r.end, r.n_peaks, r.apex_scan) for r in chromatograms.traces(peaks, ["file"], "scan", "mz", "i").collect())
    assert got == [(1, 5, 4, 5), (9, 11, 3, 11)]


def test_masses_polish_and_reporters(spark):
    row = spark.range(1).select(to_mz(to_mass(F.lit(500.25), F.lit(2)), F.lit(2)).alias("mz"), overlap_ratio(F.lit(0), F.lit(4), F.lit(2), F.lit(6)).alias("o"), quantification.reporter_intensities(F.array(F.lit(126.1277), F.lit(126.13), F.lit(127.2)), F.array(F.lit(5.0), F.lit(9.0), F.lit(1.0)), [126.1277, 127.1311]).alias("r")).first()
    assert row.mz == pytest.approx(500.25) and row.o == pytest.approx(2 / 6) and row.r == [9.0, 0.0]
    r, c = np.array([1.0, 5.0, 9.0]), np.array([0.0, 2.0])
    overall, rows, cols, rest = aggregates.median_polish(r[:, None] + c[None, :])
    assert np.allclose(rest, 0) and np.allclose(overall + rows[:, None] + cols[None, :], r[:, None] + c[None, :])
    long = pd.DataFrame([("A", f"p{i}", f"s{j}", 2.0 ** (a + b)) for i, a in enumerate(r) for j, b in enumerate(c)], columns=["protein", "peptide", "sample", "x"])
    got = {x["sample"]: x["abundance"] for x in aggregates.protein_rollup(spark.createDataFrame(long), "protein", "peptide", "sample", "x").collect()}
    assert got["s1"] - got["s0"] == pytest.approx(2)


def test_pairs_to_sum_never_shuffles_the_targets(spark):
    mods = spark.createDataFrame([("A", 1.0), ("B", 2.5), ("None", 0.0)], "mod string, mass double")
    shifts = spark.range(200).select("id", (F.col("id") / 20).alias("shift"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.pairs_to_sum(mods, shifts, "mass", "mod", "shift", 0.002)
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = sorted((round(s * 20), a, b) for a, x in (("A", 1.0), ("B", 2.5), ("None", 0.0)) for b, y in (("A", 1.0), ("B", 2.5), ("None", 0.0)) if a <= b and (s := x + y) < 10)
    assert sorted((r.id, r.first, r.second) for r in out.collect()) == want


def test_modern_search_by_blocks_equals_the_kept_index_without_postings_in_the_shuffle(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randint(7, 12))) for _ in range(300)})
    pep = spark.createDataFrame([(p,) for p in [*names, *(p[::-1] for p in names)]], "peptide string").distinct().withColumn("mass", search.peptide_mass(F.col("peptide")))
    masses = {r.peptide: r.mass for r in pep.collect()}
    ladders = [(i, p, sorted(search.ladder_masses(p).tolist())) for i, p in enumerate(names)]
    s = spark.createDataFrame([(i, masses[p], x, [1.0] * len(x), float(len(x))) for i, p, x in ladders], "scan_id int, precursor_mass double, peaks array<double>, intensities array<double>, total double")
    rows = lambda found: sorted((r.scan_id, r.peptide, round(r.score, 9)) for r in found.collect())
    blocks = search.modern_search(s, pep, cutoff=5, per_dalton=50)
    want = rows(search.modern_search(s, pep, search.fragment_index(pep, 50), cutoff=5, per_dalton=50))
    assert {(i, p) for i, p, _ in ladders} <= {x[:2] for x in want} and rows(blocks) == want
    assert "Generate explode(bins" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_classic_search_never_shuffles_pairs(spark):
    pep = spark.createDataFrame([("PEPTIDEK",), ("PEPTLDEK",), ("SAMPLERR",)], "peptide string").distinct().withColumn("mass", search.peptide_mass(F.col("peptide")))
    peaks = F.array_sort(F.transform(search.fragments(F.col("peptide")), lambda f: f["mass"]))
    scans = pep.select(F.col("peptide").alias("scan_id"), F.col("mass").alias("precursor_mass"), peaks.alias("peaks"), F.transform(peaks, lambda p: F.lit(1.0)).alias("intensities"), F.size(peaks).cast("double").alias("total"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.classic_search(scans, pep)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # Scans and peptides are shuffled by block, pairs never.
        assert plan.count("Exchange hashpartitioning(block__") == 2 and "bin__" not in plan and "Exchange hashpartitioning(scan_id" not in plan
        assert sorted((r.scan_id, r.peptide) for r in found.collect()) == [("PEPTIDEK", "PEPTIDEK"), ("PEPTIDEK", "PEPTLDEK"), ("PEPTLDEK", "PEPTIDEK"), ("PEPTLDEK", "PEPTLDEK"), ("SAMPLERR", "SAMPLERR")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_glyco_search_scores_and_places_each_candidate_once(spark):
    pep = spark.createDataFrame([("PEPTIDEK",), ("PEPSLDEK",), ("SAMPLERR",)], "peptide string").distinct().withColumn("mass", search.peptide_mass(F.col("peptide")))
    scans = pep.select(F.col("peptide").alias("scan_id"), (F.col("mass") + 203.07937).alias("precursor_mass"), F.array_sort(F.transform(search.fragments(F.col("peptide")), lambda f: f["mass"])).alias("peaks"))
    scans = scans.withColumn("intensities", F.transform("peaks", lambda p: F.lit(1.0))).withColumn("total", F.size("peaks").cast("double"))
    found = glycans.glyco_search(scans, pep, [(1,)], {1: 203.07937})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [score(") == 1 and plan.count("ArrowEvalPython [evidence(") == 1
    got = found.collect()
    assert sorted((r.scan_id, r.peptide, list(r.box), r.site, r.glycan) for r in got) == [("PEPSLDEK", "PEPSLDEK", [1], 4, 1), ("PEPTIDEK", "PEPTIDEK", [1], 4, 1), ("SAMPLERR", "SAMPLERR", [1], 1, 1)]
    assert all(r.score == 15.0 and r.n_routes == 1 and r.probability == 1.0 for r in got)


@pytest.mark.parametrize("dense", [1 << 26, 0])
def test_index_count_join_counts_in_blocks_and_shuffles_no_hits(spark, monkeypatch, dense):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(12)]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(400)]
    listed = [(rng.choice([None, *"abcdefghij"]), rng.choice([None, *range(12)]), rng.choice([None, 1.0, 2.0])) for _ in range(150)]
    for name, value in (("PEPTIDES_AT_ONCE", 4), ("SCANS_AT_ONCE", 10), ("DENSE_BYTES", dense)):
        monkeypatch.setattr(joins, name, value)
    for residual, holds in ((None, lambda x, y: True), (F.abs(F.col("seen") - F.col("held")) <= 1, lambda x, y: None not in (x, y) and abs(x - y) <= 1)):
        want: dict = {}
        for (s, b, x), (p, c, y) in itertools.product(rows, listed):
            if b is not None and b == c and holds(x, y):
                want[s, p] = want.get((s, p), 0) + 1
        found = joins.index_count_join(spark.createDataFrame(rows, "scan long, bin int, seen double"), spark.createDataFrame(listed, "peptide string, bin int, held double"), "scan", "peptide", 12, residual)
        got = {(r.scan, r.peptide): r.n_hits for r in found.collect()}
        assert got == {k: n for k, n in want.items() if n >= 12} and got
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange hashpartitioning(scan" not in plan
    assert joins.index_count_join(spark.createDataFrame([], "scan long, bin int"), spark.createDataFrame([], "peptide string, bin int"), "scan", "peptide", 1).count() == 0
