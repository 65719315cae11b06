import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import crosslinks, pep, quantification
from massloom.operators.glycans import glycan_table, localize


def test_posterior_errors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{i % 150}", bool(i % 3 == 0), float(x), float(rng.normal())) for i, x in enumerate(np.where(np.arange(600) % 3 == 0, rng.normal(5, 1, 600), rng.normal(8, 1, 600)))]
    df = spark.createDataFrame(rows, "id int, seq string, d boolean, score double, noise double")
    out = pep.posterior_errors(df, "id", "seq", "d", "score", ["score", "noise"], trees=5, depth=2).join(df, "id").toPandas()
    assert len(out) == 600 and out.pep.between(0, 1).all()
    assert out[out.score > 8].pep.mean() < 0.3 < out[out.score < 5].pep.mean()


def test_calibration_steps(spark):
    points = spark.createDataFrame([("f", s, 1e-5, 3.0) for s in (1, 2, 3, 6)] + [("f", 2, 3e-5, 3.0)], "file string, scan int, error double, li double")
    errors = pep.smoothed_errors(points, ["file"], "scan", "error", "li", 1)
    got = {r.scan: r.smoothed for r in errors.collect()}
    assert got[1] == pytest.approx(1.5e-5) and got[6] == pytest.approx(1e-5)
    scans = spark.createDataFrame([("f", s, 500.0) for s in (0, 1, 4)], "file string, scan int, mz double")
    mz = {r.scan: r.mz for r in pep.shifted(scans, errors, ["file"], "scan", "mz").collect()}
    assert mz[0] == 500.0 and mz[1] == mz[4] == pytest.approx(500 / (1 + 1.5e-5))
    assert pep.enough_points(16, 40, 80) and not pep.enough_points(15, 40, 80)


def test_new_modifications(spark):
    matches = spark.createDataFrame([(1, "AMSM", 15.995), (2, "AAA", 15.995), (3, "AMA", 50.0)], "match_id int, sequence string, shift double")
    mods = spark.createDataFrame([("Ox", 15.994915, "M"), ("Any", 15.99, "X")], "modification string, mass double, residue string")
    got = {(r.match_id, r.modification, r.site) for r in pep.new_modifications(matches, mods).collect()}
    assert got == {(1, "Ox", 2), (1, "Ox", 4), *[(1, "Any", i) for i in range(1, 5)], *[(2, "Any", i) for i in range(1, 4)]}


def test_quantities(spark):
    matches = spark.createDataFrame([("f", "PEP", 2, 500.0, 10.0)], "file string, sequence string, charge int, mz double, rt double")
    peaks = spark.createDataFrame([("f", 500.001, 10.5, 7.0), ("f", 500.001, 13.0, 99.0), ("f", 501.0, 10.0, 99.0), ("g", 500.0, 10.0, 5.0)], "file string, mz double, rt double, intensity double")
    assert [r.intensity for r in quantification.apex_intensities(matches, peaks).collect()] == [7.0]
    shifts = spark.createDataFrame([("f", "g", 0.2)], "from_file string, to_file string, shift double")
    assert [(r.file, r.intensity) for r in quantification.matched_between_runs(matches, shifts, peaks).collect()] == [("g", 5.0)]
    forms = spark.createDataFrame([("p", 0, 2, 10.0), ("p", 1, 2, 4.0), ("q", 1, 2, 4.0)], "seq string, heavy int, sites int, x double")
    got = {r.seq: (r.old, r.new) for r in quantification.turnover(forms, ["seq"], "heavy", "sites", "x").collect()}
    assert got == {"p": (12.0, 2.0), "q": (0.0, 0.0)}
    seen = spark.createDataFrame([("p", 1, "L", 1.0), ("p", 1, "H", 2.0), ("p", 2, "L", 50.0)], "seq string, scan int, label string, x double")
    assert {(r.label, r.x) for r in quantification.shared_scan_intensity(seen, ["seq"], "scan", "label", "x", 2).collect()} == {("L", 1.0), ("H", 2.0)}


def test_crosslinks(spark):
    linker = crosslinks.Linker("DSS", "K", 138.0, 156.0, 155.0, 259.0, 138.0)
    scans = spark.createDataFrame([(1, 1000.0 + 800.0 + 138.0)], "scan_id int, precursor_mass double")
    alphas = spark.createDataFrame([(1, "AKA", 1000.0)], "scan_id int, alpha string, alpha_mass double")
    peptides = spark.createDataFrame([("BKB", 800.0), ("BBB", 800.0), ("CKC", 900.0)], "peptide string, mass double")
    assert [(r.alpha, r.beta) for r in crosslinks.pair_candidates(scans, alphas, peptides, linker).collect()] == [("AKA", "BKB")]
    one = spark.createDataFrame([(1000.0, 1000.0), (1156.0, 1000.0), (1138.0, 1000.0), (1938.0, 1000.0), (1001.0, 1000.0)], "precursor_mass double, alpha_mass double")
    assert [r.cross_type for r in crosslinks.cross_types(one, linker).collect()] == ["single", "dead_end_h2o", "loop", "cross", None]
    arms = spark.createDataFrame([([1.0, 2.0], [2.0, 3.0], 5.0, 2.5)], "a array<double>, b array<double>, sa double, sb double")
    r = crosslinks.exclusive_ions(arms, "a", "b", "sa", "sb").first()
    assert r.a == [1.0, 2.0] and r.b == [3.0] and r.sb == 1.5
    assert crosslinks.loop_pairs(peptides.limit(1).withColumn("peptide", F.lit("KAKAA")), "peptide", "K").count() == 1


def test_glycan_tables(spark):
    lines = spark.createDataFrame([("HexNAc(2)Hex(3)",), ("nonsense",), (None,)], "c string")
    assert [r.mass_e5 for r in glycan_table(lines, "c").collect()] == [2 * 20307937 + 3 * 16205282, None, None]
    cand = spark.createDataFrame([(1, [0], [[0], [0]], [{0: 1.0}, {0: 1.0}]), (2, [0, 0], [[0]], [{0: 1.0}])], "id int, box array<int>, options array<array<int>>, costs array<map<int,double>>")
    got = [(r.id, r.n_routes, r.site, r.probability) for r in localize(cand, "id").orderBy("site").collect()]
    assert got == [(1, 2, 0, 0.5), (1, 2, 1, 0.5)]
