"""Searches and joins whose sides meet in blocks: nothing that grows as pairs is shuffled, and nothing is left out."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from massloom.functions import masses
from massloom.operators import crosslinks, glycans, joins, search


def test_glyco_search_meets_in_blocks_and_shuffles_no_pairs(spark):
    rng = np.random.default_rng(8)
    names = sorted({"".join(rng.permutation(list(w))) for w in ("AGSTPEK", "AGSSPEK", "AGTVPLEK", "GGSSPEEKX", "AGVPEK") for _ in range(12)})
    weigh = lambda p: float(sum(masses.RESIDUES.get(x, 100.0) for x in p) + masses.WATER)
    peptides = spark.createDataFrame([(p, weigh(p)) for p in names] + [("TSTSK", None)], "peptide string, mass double")
    boxes, glycan = [(1,), (2,), (1, 1)], {1: 203.07937, 2: 203.08}
    rows = []
    for i in range(60):
        p, shift = names[rng.integers(len(names))], (203.07937, 203.08, 406.15874)[i % 3]
        ions = [float(x) for x in search.ladder_masses(p) if x == x and rng.random() < 0.7] + [weigh(p) + shift] * (i % 2) + [float(x) for x in rng.uniform(100, 900, 5)]
        rows.append((i, weigh(p) + shift + float(rng.normal()) * 1e-3, sorted(ions), [float(x) for x in rng.integers(0, 3, len(ions))], None if i % 7 == 0 else 20.0))
    rows += [(60, 900.0, [], [], None), (61, None, [100.0], [1.0], 1.0), (62, 50.0, [100.0], [1.0], 1.0)]
    scans = spark.createDataFrame(rows, "scan_id int, precursor_mass double, peaks array<double>, intensities array<double>, total double")
    want = set()
    for i, m, o, x, t in rows:
        mine = {}
        for p, (no, b) in itertools.product(names, enumerate(boxes)):
            w = weigh(p) + sum(glycan[g] for g in b)
            if m is not None and abs(m - w) <= m * 5e-6 and sum(c in "ST" for c in p) >= len(b):
                y = sorted({sum(glycan[g] for g in k) for k in glycans.sub_boxes(b) if k})
                n = sum(search._matches(np.array(o), weigh(p) + np.array(y), 20.0) >= 0)
                mine[p, b] = round(float(search.list_scores(np.array(o), np.array(x), t, [p], 20.0)[0] + n), 9)
        want |= {(i, p, b, k) for (p, b), k in mine.items() if k >= 4 and k == max(mine.values())}
    plain = glycans.glyco_search(scans, peptides, boxes, glycan, cutoff=4.0)
    late = glycans.glyco_search(scans.select("scan_id", "precursor_mass", F.struct("peaks", "intensities", "total").alias("s")), peptides, boxes, glycan, cutoff=4.0, spectra=lambda d: d.select("*", "s.*"))
    for found in (plain, late):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "hashpartitioning(scan_id" not in plan and plan.count("Exchange hashpartitioning(block__") == 2
        assert {(r.scan_id, r.peptide, tuple(r.box), round(r.score, 9)) for r in found.collect()} == want and len({i for i, *_ in want}) > 30


def test_crosslink_search_scores_in_blocks_what_all_pairs_give(spark, monkeypatch):
    rng = np.random.default_rng(4)
    names = sorted({"".join(rng.permutation(list(w))) + "R" for w in ("AGKPE", "AGKKE", "GVKLTE") for _ in range(9)})
    weigh = {p: float(sum(masses.RESIDUES[x] for x in p) + masses.WATER) for p in names}
    linker = crosslinks.Linker("x", "K", 100.0, 0, 0, 0, 0)
    rows = []
    for i in range(25):
        a, b = (names[k] for k in rng.integers(len(names), size=2))
        ions = [x for p, q in ((a, b), (b, a)) for x in search.ladder_masses(p, weigh[q] + 100.0, p.index("K") + 1) if rng.random() < 0.8]
        o = sorted(float(x) for x in [*ions, *rng.uniform(100, 900, 6)])
        rows.append((i, weigh[a] + weigh[b] + 100.0 + float(rng.normal()) * 1e-3, o, [float(x) for x in rng.integers(0, 3, len(o))], None if i % 6 == 0 else 30.0))
    rows += [(25, 1000.0, [], [], None), (26, None, [100.0], [1.0], 1.0)]
    scans = spark.createDataFrame(rows, "scan_id int, precursor_mass double, peaks array<double>, intensities array<double>, total double")
    peptides = spark.createDataFrame([*weigh.items(), ("XKX", None)], "peptide string, mass double")
    alphas = {(r.scan_id, r.alpha) for r in crosslinks.rough_arms(scans, peptides, linker, 20.0, 2, 5).collect()}
    want = set()
    for i, m, o, x, t in rows:
        mine = {}
        for p, q in itertools.combinations_with_replacement(names, 2):
            if m is not None and abs(m - weigh[p] - weigh[q] - 100.0) <= m * 5e-6 and {(i, p), (i, q)} & alphas and "K" in p[:-1] and "K" in q[:-1]:
                mine[p, q] = crosslinks._pair_score(np.array(o), np.array(x), t, p, q, weigh[p], weigh[q], linker, 20.0)
        levels = sorted({round(r[2] + r[3], 9) for r in mine.values() if r[2] + r[3] >= 6}, reverse=True)
        want |= {(i, *k, r[0], r[1], round(r[2] + r[3], 9), levels[1] if levels[1:] else 6.0) for k, r in mine.items() if levels and round(r[2] + r[3], 9) == levels[0]}
    for sizes in ({}, {"SCANS_AT_ONCE": 7, "ARMS_AT_ONCE": 9, "ARMS_INDEXED": 4}):
        for k, v in sizes.items():
            monkeypatch.setattr(crosslinks, k, v)
        found = crosslinks.crosslink_search(scans, peptides, linker, rough_cutoff=2, most=5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "bin__" not in plan and "ArrowEvalPython" not in plan
        assert {(r.scan_id, r.alpha, r.beta, r.alpha_site, r.beta_site, round(r.score, 9), round(r.runner_up, 9)) for r in found.collect()} == want and len(want) > 20


def test_index_count_join_sends_equal_lists_once(spark, monkeypatch):
    sent = []
    kept = joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, name: sent.append((name, kept(df, name))) or sent[-1][1])
    monkeypatch.setattr(joins, "PAIRS_AT_ONCE", 30)
    rows = [(None if i == 0 else i, b) for i in range(40) for b in (i % 2, 2, 3)]
    listed = [(None if p == 1 else f"p{p}", b) for p in range(30) for b in (p % 3, 2, 2 if p % 5 == 0 else 3)]
    found = joins.index_count_join(spark.createDataFrame(rows, "scan long, bin int"), spark.createDataFrame(listed, "peptide string, bin int"), "scan", "peptide", 3)
    want = {(s, p): sum(b == c for t, b in rows if t == s for q, c in listed if q == p) for s in {s for s, _ in rows} for p in {p for p, _ in listed}}
    assert {(r.scan, r.peptide): r.n_hits for r in found.collect()} == {k: n for k, n in want.items() if n >= 3} and found.count() == sum(n >= 3 for n in want.values())
    # Two kinds of scans and six of peptides, however many there are of each.
    assert {name: df.count() for name, df in sent if name != "kinds"} == {"scan-kinds": 2, "peptide-kinds": 6}
