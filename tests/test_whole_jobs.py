"""Queries and operators take part in the whole of their tables."""

import datetime as dt
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import chromatograms, search
from massloom.plans import aggregate_queries, fdr_queries, join_queries, search_queries


def _plain_traces(peaks, ppm, missed, least):
    """(key, n, mean m/z, apex, start, end, points) of (key, scan, m/z, intensity), one peak after the other."""
    out = []
    for key in {p[0] for p in peaks}:
        chains, last = [], None
        for _, scan, mz, i in sorted((p for p in peaks if p[0] == key), key=lambda p: (p[2], p[1])):
            if last is None or mz - last > mz * ppm / 1e6:
                chains.append([])
            chains[-1].append((scan, mz, i))
            last = mz
        for chain in chains:
            parts, before = [], None
            for p in sorted(chain):
                if before is None or p[0] - before > missed + 1:
                    parts.append([])
                parts[-1].append(p)
                before = p[0]
            for part in (x for x in parts if len(x) >= least):
                points = defaultdict(float)
                for scan, _, i in part:
                    points[scan] += i
                apex = min(points, key=lambda s: (-points[s], s))
                out.append((key, len(part), pytest.approx(sum(p[1] for p in part) / len(part)), apex, part[0][0], part[-1][0], sorted(points.items())))
    return sorted(out, key=lambda r: (r[0], r[4], r[5], r[6]))


def test_traces_count_every_peak_of_a_scan(spark):
    rng = random.Random(5)
    peaks = [(rng.choice("ab"), rng.choice([*range(1, 9), *range(12, 20)]), rng.choice([500.0, 500.003, 500.02, 600.0]), float(rng.randint(1, 9))) for _ in range(150)]
    df = spark.createDataFrame(peaks, "file string, scan int, mz double, i double")
    rows = chromatograms.traces(df, ["file"], "scan", "mz", "i").collect()
    got = sorted(((r.file, r.n_peaks, r.mean_mz, r.apex_scan, r.start, r.end, [(p.scan, p.intensity) for p in r.points]) for r in rows), key=lambda r: (r[0], r[4], r[5], r[6]))
    assert got == _plain_traces(peaks, 10.0, 1, 3) and got


def test_traces_and_spectra_of_blocks_are_the_whole_ones(spark, monkeypatch):
    rng = random.Random(8)
    peaks = [(rng.choice("ab"), rng.choice([*range(1, 9), *range(12, 20)]), rng.choice([500.0, 500.003, 500.02, 600.0]), float(rng.randint(1, 9))) for _ in range(150)]
    # A long chain over many borders of blocks, and elution peaks in pairs of near scans.
    peaks += [("a", k % 7, 300.0 * (1 + 8e-6) ** k, float(k % 5)) for k in range(60)]
    for k in range(40):
        peaks += [(f, 30 + 3 * k + step, m + (k % 3), float(h)) for f in "ab" for m in (450.0, 700.0, 910.0 + k % 5) for step, h in enumerate((1, 5, 9 + k % 4, 4, 1))]
    df = spark.createDataFrame(peaks, "file string, scan int, mz double, i double")
    monkeypatch.setattr(chromatograms, "TRACE_BLOCK", 1e-4)
    monkeypatch.setattr(chromatograms, "APEX_BLOCK", 4)
    key = lambda r: (r[0], r[4], r[5], r[6], round(getattr(r[2], "expected", r[2]), 4))
    blocks = chromatograms.block_traces(df, ["file"], "scan", "mz", "i")
    got = sorted(((r.file, r.n_peaks, r.mean_mz, r.apex_scan, r.start, r.end, [(p.scan, p.intensity) for p in r.points]) for r in blocks.collect()), key=key)
    assert got == sorted(_plain_traces(peaks, 10.0, 1, 3), key=key) and got
    whole = chromatograms.traces(df, ["file"], "scan", "mz", "i").localCheckpoint()
    survey, product = "mean_mz > 600", "mean_mz < 800"
    groups = chromatograms.precursor_groups(whole.filter(survey), whole.filter(product), ["file"], 2.0, 0.2, 0.3, 1)
    named = whole.select("file", F.col("trace").alias("precursor"), F.col("mean_mz").alias("m"), "apex_scan")
    spectra = chromatograms.pseudo_spectra(groups, whole, ["file"]).join(named, ["file", "precursor"])
    want = sorted((r.file, round(r.m, 6), r.apex_scan, [(round(p.mz, 6), p.intensity) for p in r.peaks]) for r in spectra.collect())
    made = chromatograms.block_spectra(blocks.filter(survey), blocks.filter(product), ["file"], 2.0, 0.2, 0.3, 1).collect()
    assert sorted((r.file, round(r.precursor_mass, 6), r.apex_scan, [(round(m, 6), x) for m, x in zip(r.peaks, r.intensities)]) for r in made) == want and len(want) > 20
    assert all(r.total == pytest.approx(sum(r.intensities)) for r in made)


def test_trace_extraction_takes_all_events(spark, tmp_path):
    rng = random.Random(6)
    events = [(n, dt.datetime(2024, 1, rng.randint(1, 12), 3), rng.choice(["view", "click"]), rng.choice([1.5, 2.5, 7.25, 14.0, 33.0])) for n in range(120)]
    spark.createDataFrame(events, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    peaks = [(kind, (ts - dt.datetime(1990, 1, 1)).days, float(value // 10 + 1), value) for _, ts, kind, value in events]
    got = sorted(tuple(r) for r in search_queries.trace_extraction(spark, str(tmp_path)).collect())
    assert got == sorted((key, round(mz.expected, 4), n, apex, start, end) for key, n, mz, apex, start, end, _ in _plain_traces(peaks, 10.0, 1, 3))


def test_time_band_join_takes_all_charges(spark, tmp_path):
    rng = random.Random(7)
    rows = [(n, rng.choice(["f", "g"]), rng.randint(1, 6), rng.choice([None, *[rng.randint(0, 600) / 100] * 9])) for n in range(80)]
    spark.createDataFrame(rows, "psm_id long, full_file_path string, precursor_charge int, scan_retention_time double").write.parquet(f"{tmp_path}/psms.parquet")
    want = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[2] and None not in (a[3], b[3]) and a[3] - 0.5 <= b[3] <= a[3] + 0.5]
    assert sorted(tuple(r) for r in join_queries.time_band_join(spark, str(tmp_path)).collect()) == sorted(want)


def _plain_occupancy(proteins, psms):
    """(accession, site, modification, n_modified, n_spanning, occupancy), residue by residue."""
    modified, spanning = defaultdict(int), defaultdict(int)
    for cell, base, full, decoy in psms:
        for accession in set(re.findall(r"[A-Za-z0-9_-]+", cell)) & set(proteins):
            at = proteins[accession].find(base)
            if decoy != "N" or at < 0 or "|" in full:
                continue
            for i in range(len(base)):
                spanning[accession, at + 1 + i] += 1
            n, found = 0, set()
            for piece in re.findall(r"\[[^\]]+\]|[A-Z]", full):
                if piece.startswith("["):
                    found.add((accession, at + max(n, 1), piece[1:-1]))
                else:
                    n += 1
            for f in found:
                modified[f] += 1
    return sorted((a, s, m, n, spanning[a, s], round(n / spanning[a, s], 6)) for (a, s, m), n in modified.items())


def _write_matches(spark, path, proteins, psms):
    spark.createDataFrame(list(proteins.items()), "accession string, base_sequence string").write.parquet(f"{path}/proteins.parquet")
    spark.createDataFrame(psms, "accession string, base_sequence string, full_sequence string, decoy string").write.parquet(f"{path}/psms.parquet")


def test_mod_occupancy_counts_every_modification(spark, tmp_path):
    proteins = {"P1": "MKACDEMFGHIKLMNPR", "P2": "AAACDEMFGHIK"}
    psms = [("P1", "ACDEMFGHIK", "AC[Carb]DEM[Ox]FGHIK", "N"), ("P1", "ACDEMFGHIK", "AC[Carb]DEMFGHIK", "N"), ("P1", "LMNPR", "[Ace]LM[Ox]NPR-[Ami]", "N"), ("P1", "LMNPR", "[Ace]L[Ace]MNPR", "N"), ("P2", "ACDEMFGHIK", "A[X][Y]CDEM[Ox]FGHIK", "N"), ("P2", "ACDEMFGHIK", "AC[Carb]DEM[Ox]FGHIK", "Y"), ("P2", "FGHIK", "F[Q]GHIK|FG[Q]HIK", "N")]
    _write_matches(spark, tmp_path, proteins, psms)
    assert sorted(tuple(r) for r in aggregate_queries.mod_occupancy(spark, str(tmp_path)).collect()) == _plain_occupancy(proteins, psms)


def test_coverage_and_occupancy_take_every_accession_of_a_cell(spark, tmp_path):
    proteins = {"P1": "MKACDEMFGHIKLMNPR", "P2-2": "AAACDEMFGHIK"}
    psms = [("P1|P2-2", "ACDEMFGHIK", "AC[Carb]DEMFGHIK", "N"), ("P1; P1", "LMNPR", "LM[Ox]NPR", "N"), (' "P2-2"\t"P9"', "AAAC", "AAAC[Carb]", "N"), ("P2-2|", "GHIK", "GHIK", "N"), ("P1,P2-2", "FGHIK", "F[Q]GHIK", "Y")]
    _write_matches(spark, tmp_path, proteins, psms)
    assert sorted(tuple(r) for r in aggregate_queries.mod_occupancy(spark, str(tmp_path)).collect()) == _plain_occupancy(proteins, psms)
    assert sorted(tuple(r) for r in aggregate_queries.coverage_fraction(spark, str(tmp_path)).collect()) == [("P1", 15, round(15 / 17, 6)), ("P2-2", 12, 1.0)]


def test_protein_scores_and_pairs_take_every_accession_of_a_cell(spark, tmp_path):
    cells = ["P1", "P1|P2-3", '"P2-3"', "P3;", "DECOY_P1/DECOY_P3", "DECOY_P3||DECOY_P3", "P4\tP1", "DECOY_P5", "", None]
    rng = random.Random(8)
    rows = [(n, c, float(rng.randint(1, 99)), "Y" if "DECOY" in (c or "") else "N") for n, c in enumerate(rng.choices(cells, k=60))]
    spark.createDataFrame(rows, "psm_id long, accession string, score double, decoy string").write.parquet(f"{tmp_path}/psms.parquet")
    best, pairs = {}, defaultdict(lambda: [0, 0])
    for _, cell, score, _ in rows:
        for a in set(re.findall(r"[A-Za-z0-9_-]+", cell or "")):
            best[a] = max(best.get(a, 0.0), score)
            pairs[a.removeprefix("DECOY_")][a.startswith("DECOY_")] += 1
    ratios, t, d = [], 0, 0
    for a in sorted(best, key=lambda a: (-best[a], a)):
        t, d = t + (not a.startswith("DECOY_")), d + a.startswith("DECOY_")
        ratios.append((a, d / max(t, 1)))
    want = {a: min(r for _, r in ratios[i:]) for i, (a, _) in enumerate(ratios)}
    assert {r.accession: r.q_value for r in fdr_queries.protein_qvalue(spark, str(tmp_path)).collect()} == pytest.approx(want)
    winners = {a for a in best if a == max((x for x in best if x.removeprefix("DECOY_") == a.removeprefix("DECOY_")), key=lambda x: (best[x], not x.startswith("DECOY_")))}
    assert winners <= {r.accession for r in fdr_queries.picked_fdr(spark, str(tmp_path)).collect()} <= set(best)
    assert sorted(tuple(r) for r in join_queries.decoy_pairs(spark, str(tmp_path)).collect()) == sorted((a, *n) for a, n in pairs.items())


def test_overlap_join_takes_every_pair_of_customers(spark, tmp_path):
    rng = random.Random(9)
    orders = [(c, dt.date(2024, 1, rng.randint(1, 9))) for c in range(30) for _ in range(rng.randint(1, 3))]
    customers = [(c, rng.randint(1, 2), rng.choice("xy")) for c in range(31)] + [(40, 3, "x")]
    orders.append((40, dt.date(2024, 1, 1)))
    spark.createDataFrame(orders, "o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    groups = defaultdict(list)
    for c, nation, segment in customers:
        days = [d.toordinal() for k, d in orders if k == c]
        if days:
            for a, b in [*groups[nation, segment]]:
                common, span = min(b, max(days)) - max(a, min(days)), max(b, max(days)) - min(a, min(days))
                groups[nation, segment, "pairs"].append(common / span if common > 0 else 0.0)
            groups[nation, segment].append((min(days), max(days)))
    want = {k[:2]: (len(v), pytest.approx(sum(v) / len(v), abs=1e-6)) for k, v in groups.items() if len(k) == 3 and v}
    assert {(r.c_nationkey, r.c_mktsegment): (r.n_pairs, r.mean_overlap) for r in join_queries.overlap_join(spark, str(tmp_path)).collect()} == want


def test_pair_mass_join_takes_every_part(spark, tmp_path):
    rng = random.Random(10)
    parts = [(n, f"Brand#{n % 2}", rng.randint(9000, 12000) / 10 + rng.choice([0.0, 0.01])) for n in range(40)]
    parts += [(40, "Brand#1", parts[0][2]), (41, "Brand#0", parts[3][2])]
    lines = [(n, 1, rng.choice([rng.randint(180000, 240000) / 100, parts[n % 40][2] * 2, parts[0][2] + parts[n % 40][2] + 0.03])) for n in range(60)] + [(60, 1, 90000.0), (61, 1, 3.0)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = defaultdict(int)
    for order, line, target in lines:
        for i, (_, _, x) in enumerate(parts):
            for _, _, y in parts[i:]:
                a, b = sorted((round(x, 2), round(y, 2)))
                want[order, line, a, b] += target - a - 0.05 <= b <= target - a + 0.05
    assert {tuple(r)[:4]: r.n_pairs for r in join_queries.pair_mass_join(spark, str(tmp_path)).collect()} == {k: n for k, n in want.items() if n}


def test_modern_search_counts_fragments_that_share_a_bin(spark):
    p = "INEHMDEDLACEMDMTK"
    masses = np.sort(search.ladder_masses(p))
    bins = np.rint(masses * 50).astype(int)
    shared = [m for m, b in zip(masses, bins, strict=True) if (bins == b).sum() > 1][:2]
    peaks = sorted([*shared, *[m for m, b in zip(masses, bins, strict=True) if (bins == b).sum() == 1][::5][:3]])
    pep = spark.createDataFrame([(p,)], "peptide string").withColumn("mass", search.peptide_mass(F.col("peptide")))
    scan = spark.createDataFrame([(0, float(pep.first().mass), [float(x) for x in peaks], [1.0] * 5, 5.0)], "scan_id int, precursor_mass double, peaks array<double>, intensities array<double>, total double")
    want = [(r.peptide, r.score) for r in search.classic_search(scan, pep, cutoff=5.0).collect()]
    assert want and [(r.peptide, r.score) for r in search.modern_search(scan, pep, search.fragment_index(pep, 50), cutoff=5, per_dalton=50).collect()] == want
