import base64
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.session import local_path, shared_folder
from massloom.sources import readers, writers
from massloom.streaming.matches import arriving, counts_by_window, refreshed_q_values


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_kinds(tmp_path):
    assert readers.kind_of("a/b.mzML") == readers.kind_of("x.d/") == "spectra" and readers.kind_of("a.fasta.gz") == "database"
    with pytest.raises(ValueError):
        readers.kind_of("a.txt")
    (tmp_path / "s" / "x.d").mkdir(parents=True)
    (tmp_path / "s" / "x.d" / "in.raw").write_text("")
    _file(tmp_path, "s/a.raw", "")
    assert [p.rsplit("/", 1)[1] for p in readers.spectra_in([str(tmp_path)])] == ["a.raw", "x.d"]


def test_fasta(spark, tmp_path):
    path = _file(tmp_path, "x.fasta", ">sp|P1|A_B Some name OS=Homo sapiens OX=9606 GN=G1 PE=1\nPEP\nTIDE\n>P2 other\n>xx|P3|c\nAC*\n")
    rows, empty = readers.with_sequence([readers.read_fasta(spark, path)])
    got = {r.accession: r for r in rows.collect()}
    assert set(got) == {"P1", "P3"} and empty == 1
    assert (got["P1"].base_sequence, got["P1"].organism, got["P1"].gene, got["P1"].full_name) == ("PEPTIDE", "Homo sapiens", "G1", "Some name")


def test_mgf_and_back(spark, tmp_path):
    path = _file(tmp_path, "x.mgf", "BEGIN IONS\nTITLE=a b\nRTINSECONDS=90\nPEPMASS=500.5 1000\nCHARGE=2+\n100.5 7\n200.25\t8.5\nEND IONS\nBEGIN IONS\nTITLE=e\nPEPMASS=1\nEND IONS\n")
    df = readers.read_mgf(spark, path)
    a = {r.title: r for r in df.collect()}
    assert a["a b"].mz == [100.5, 200.25] and a["a b"].intensity == [7.0, 8.5] and a["a b"].charge == 2 and a["a b"].retention_time == 1.5 and a["e"].mz == []
    writers.write_mgf(df.filter("title = 'a b'"), str(tmp_path / "out"))
    assert readers.read_mgf(spark, str(tmp_path / "out")).first().mz == [100.5, 200.25]


def test_mzml(spark, tmp_path):
    pack = lambda v, z: base64.b64encode(zlib.compress(v.tobytes()) if z else v.tobytes()).decode()
    cv = lambda a, v="", u="": f'<cvParam accession="{a}" value="{v}" unitName="{u}"/>'
    arrays = f'<binaryDataArrayList><binaryDataArray>{cv("MS:1000523")}{cv("MS:1000574")}{cv("MS:1000514")}<binary>{pack(np.array([1.5, 2.5]), True)}</binary></binaryDataArray><binaryDataArray>{cv("MS:1000521")}{cv("MS:1000515")}<binary>{pack(np.array([3, 4], "f4"), False)}</binary></binaryDataArray></binaryDataArrayList>'
    text = f'<mzML><run><spectrumList><spectrum id="scan=1" index="0">{cv("MS:1000511", "2")}<scanList><scan>{cv("MS:1000016", "30", "second")}</scan></scanList><precursorList><precursor><isolationWindow>{cv("MS:1000827", "500")}</isolationWindow><selectedIonList><selectedIon>{cv("MS:1000744", "500.2")}{cv("MS:1000041", "2")}</selectedIon></selectedIonList></precursor></precursorList>{arrays}</spectrum></spectrumList></run></mzML>'
    r = readers.read_mzml(spark, _file(tmp_path, "x.mzML", text)).first()
    assert (r.scan_id, r.ms_level, r.retention_time, r.precursor_mz, r.charge, r.mz, r.intensity) == ("scan=1", 2, 0.5, 500.2, 2, [1.5, 2.5], [3.0, 4.0])


def test_library_modifications_combos(spark, tmp_path):
    msp = _file(tmp_path, "x.msp", 'Name: PEPK/2\nMW: 900.5\nComment: Parent=450 iRT=12.5\nNum peaks: 2\n100.1\t0.5\t"b2/0ppm"\n200.2\t1\t"y3/0ppm"\n\nName: AAK/1\nMW: 1\nNum peaks: 0\n')
    df = readers.read_msp(spark, msp)
    r = df.filter("sequence = 'PEPK'").first()
    assert (r.charge, r.mz, r.ions, r.retention_time) == (2, [100.1, 200.2], ["b2", "y3"], 12.5)
    writers.write_msp(df.filter("sequence = 'PEPK'"), str(tmp_path / "lib"))
    assert readers.read_msp(spark, str(tmp_path / "lib")).first().ions == ["b2", "y3"]
    mods = _file(tmp_path, "m.txt", "ID   Ox\nTG   M or W\nPP   Anywhere.\nMT   Common\nCF   O1\n//\nID   Ac\nTG   X\nPP   N-terminal.\nMT   Common\n//\n")
    assert {(m.modification_id, m.target, m.formula) for m in readers.read_modifications(spark, mods).collect()} == {("Ox", "M", "O1"), ("Ox", "W", "O1"), ("Ac", "X", None)}
    combos = _file(tmp_path, "c.txt", "﻿15.99 14.01\n1 2\n")
    masses = spark.createDataFrame([(15.99,), (14.0105,)], "mass double")
    assert [(c.first, c.second) for c in readers.read_combos(spark, combos, masses).collect()] == [(15.99, 14.01)]


def test_design(spark, tmp_path):
    path = _file(tmp_path, "ExperimentalDesign.tsv", "FileName\tCondition\tBiorep\tFraction\tTechrep\na.raw\tWT\t1\t1\t1\nb.raw\tWT\t3\t1\t1\nc.raw\tWT\t1\t1\t1\nbad\n")
    good, bad = readers.read_design(spark, path)
    assert good.count() == 3 and bad.count() == 1
    files = spark.createDataFrame([("a.raw",), ("b.raw",), ("c.raw",), ("z.raw",)], "FileName string")
    assert {(r.error, r.detail) for r in readers.design_errors(good, files).collect()} == {("missing_file", "z.raw"), ("repeated_place", "WT/1/1/1"), ("gap_in_biorep", "WT")}


def test_config(tmp_path):
    a = _file(tmp_path, "t.toml", 'TaskType = "Search"\n[CommonParameters]\nTol = "±5.0000 PPM"\nN = 1\n')
    b = _file(tmp_path, "f.toml", "N = 2\n")
    assert readers.read_config(a, b)["CommonParameters"] == {"Tol": "±5.0000 PPM", "N": 2}
    assert readers.parse_tolerance("±5.0000 PPM") == (5.0, True) and readers.parse_tolerance("±0.35 Absolute") == (0.35, False)


def test_written_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.23456789, None), (1, float("nan"), "a\tb")], "Scan int, Score double, Name string")
    writers.write_tsv(df, str(tmp_path / "t"), [F.col("Scan")], 3, files=1)
    back = [r.asDict() for r in readers.read_table(spark, str(tmp_path / "t")).collect()]
    assert back == [{"Scan": "1", "Score": "NaN", "Name": "a b"}, {"Scan": "2", "Score": "1.235", "Name": None}]
    rows = spark.createDataFrame([("f", 3, 2, 900.0, "PEP<K", "P1", 5.0, 0.001), ("f", 1, 2, 900.0, "AAK", None, 4.0, 0.5)], "file_name string, scan_number int, precursor_charge int, precursor_mass double, peptide string, protein string, score double, q_value double")
    writers.write_pepxml(rows, str(tmp_path / "pepxml"))
    writers.write_mzidentml(rows, str(tmp_path / "mzid"))
    import xml.etree.ElementTree as ET

    def document(folder):
        """The parts of a written document one after another."""
        return ET.fromstring("".join(p.read_text() for p in sorted((tmp_path / folder).glob("part-*"))))

    assert len(list(document("pepxml").iter("{http://regis-web.systemsbiology.net/pepXML}search_hit"))) == 2
    assert len(list(document("mzid").iter("{http://psidev.info/psi/pi/mzIdentML/1.1}SpectrumIdentificationItem"))) == 2
    keys = "accession string, position int, modification string, mod_type string"
    db, seen = spark.createDataFrame([("A", 1, "m", "t1"), ("A", 2, "m", "t2"), ("A", 3, "m", "t0")], keys), spark.createDataFrame([("A", 1, "m", "t1"), ("A", 9, "m", "t3")], keys)
    assert {r.position for r in writers.pruned(db, seen, {"t0": 0, "t1": 1, "t2": 2, "t3": 3}).collect()} == {1, 2, 9}


def test_documents_are_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("f", n, 2, 900.0, f"A[Common:Ox on A]K{'A' * (n % 3)}", "P&1", 5.0, 0.001, [{"residue": 1, "mass": 87.0}] if n % 2 else []) for n in (9, 10, 100, 2)], "file_name string, scan_number int, precursor_charge int, precursor_mass double, peptide string, protein string, score double, q_value double, mods array<struct<residue:int,mass:double>>").repartition(4)
    writers.write_pepxml(rows, str(tmp_path / "p"), settings={"a": "b & c"})
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*")))
    assert [int(x.split('"')[0]) for x in text.split('start_scan="')[1:]] == [2, 9, 10, 100]
    assert text.count("<mod_aminoacid_mass") == 1 and "b &amp; c" in text
    writers.write_mzidentml(rows.drop("mods"), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text.count("<Modification ") == 3 and text.count("<SpectraData ") == 1
    writers.write_summary(spark, ["one", "two"], str(tmp_path / "s"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*"))) == "one\ntwo\n"
    matches = spark.createDataFrame([(0.5, "b", 2, "x"), (0.25, "a", 1, "y")], "q_value double, file_name string, scan_number int, other string")
    writers.write_matches(matches, str(tmp_path / "t"), [F.col("`File Name`")])
    back = readers.read_matches(spark, str(tmp_path / "t"))
    assert back.columns == ["File Name", "Scan Number", "QValue"] and sorted(tuple(r) for r in back.collect()) == [("a", 1, 0.25), ("b", 2, 0.5)]


def test_filtered_spectra(spark):
    """The highest peaks of each window of 10 against a plain selection; null and empty spectra stay."""
    rng = np.random.default_rng(1)
    spectra = [(i, sorted(set(np.round(rng.uniform(0, 40, 30), 3).tolist()))) for i in range(20)]
    rows = [(i, mz, np.round(rng.uniform(0, 9, len(mz)), 1).tolist()) for i, mz in spectra]
    df = spark.createDataFrame([*rows, (98, [], []), (99, None, None)], "id int, mz array<double>, intensity array<double>")
    got = {r.id: (r.mz, r.intensity) for r in readers.filtered_spectra(df, ["id"], 3, 10.0, 0.2).collect()}
    assert got[98] == ([], []) and got[99] == (None, None)
    for i, mz, intensity in rows:
        ok = [(m, x) for m, x in zip(mz, intensity, strict=True) if x >= 0.2 * max(intensity)]
        kept = sorted(p for w in range(4) for p in sorted((q for q in ok if q[0] // 10 == w), key=lambda q: (-q[1], q[0]))[:3])
        assert list(zip(*got[i], strict=True)) == kept
    assert readers.filtered_spectra(df, ["id"], low_cid=True).count() == 22


def test_readers_survive_bad_cells(spark, tmp_path):
    """A bad cell is null and never ends the read; marks of a record's end count only at the beginning of a line."""
    msp = _file(tmp_path, "x.msp", 'Name: PEPK/2\nMW: 900.5\nComment: FullName: x Parent=450 iRT=-\nNum peaks: 1\n1.0.1\t0.5\t"b2/0ppm"\n\nName: AAK/1\nMW: 1\nNum peaks: 0\n')
    got = {r.sequence: (r.charge, r.mz, r.retention_time) for r in readers.read_msp(spark, msp).collect()}
    assert got == {"PEPK": (2, [None], None), "AAK": (1, [], None)}
    mods = _file(tmp_path, "m.txt", "ID   Ox\nTG   M\nDR   http://x.org//y\nMT   Common\nCF   O1\n//\nID   Ac\nTG   X\nMT   Common\n//\n")
    assert {(m.modification_id, m.formula) for m in readers.read_modifications(spark, mods).collect()} == {("Ox", "O1"), ("Ac", None)}
    mgf = _file(tmp_path, "x.mgf", "BEGIN IONS\nTITLE=a\nPEPMASS=5e.1\nCHARGE=99999999999+\n1.2.3 5\nEND IONS\n")
    r = readers.read_mgf(spark, mgf).first()
    assert (r.precursor_mz, r.charge, r.mz, r.intensity) == (None, None, [None], [5.0])


def test_design_records_with_line_breaks(spark, tmp_path):
    head = "FileName\tCondition\tBiorep\tFraction\tTechrep\r\n"
    path = _file(tmp_path, "ExperimentalDesign.tsv", head + 'a.raw\t"two\nlines"\t1\t1\t1\r\n\r\nb.raw\t"open\t2\t1\t1\nc.raw\tx"y\t1\t1\t1\n')
    good, bad = readers.read_design(spark, path)
    assert [(r.FileName, r.Condition) for r in good.collect()] == [("a.raw", "two\nlines")]
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [(2, "column_count"), (3, "quoting"), (4, "quoting")]


def test_streams(spark, tmp_path):
    schema = "psm_id long, full_file_path string, score double, q_value double, decoy string, loaded_at timestamp"
    make = lambda n, a: spark.range(a, a + n).selectExpr("id AS psm_id", "'f' AS full_file_path", "double(1000 - id) AS score", "0.001D AS q_value", "if(id % 5 = 4, 'Y', 'N') AS decoy", "timestamp'2024-01-01 10:00:00' AS loaded_at")
    folder = str(tmp_path / "in")
    make(20, 0).write.parquet(folder)
    make(20, 100).write.mode("append").parquet(folder)
    stream = arriving(spark, folder, spark.createDataFrame([], schema).schema, 1)
    q = counts_by_window(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.n_psms, r.n_good) for r in spark.table("counts").collect()] == [(40, 32)]
    sizes = {}
    left = set(os.listdir(local_path(shared_folder(spark))))
    q = refreshed_q_values(stream, str(tmp_path / "store"), lambda df, n: sizes.__setitem__(n, df.count()), str(tmp_path / "cp"))
    q.awaitTermination(90)
    assert max(sizes.values()) == 40
    assert set(os.listdir(local_path(shared_folder(spark)))) == left  # what the batches wrote on the way is gone


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())


def test_protein_xml_parts_without_a_root_give_all_their_entries(spark, tmp_path):
    entry = '<entry>\n<accession>{0}</accession><name>n &amp; {0}</name><feature type="t" description="a &lt;b&gt;"><location><position position="3"/></location></feature><sequence length="3">PE\nP</sequence></entry>\n'
    (tmp_path / "part-0").write_text('<?xml version="1.0" encoding="UTF-8"?>\n<uniprot>\n' + entry.format("A1") + entry.format("A2"))
    (tmp_path / "part-1").write_text("".join(entry.format(f"B{i}") for i in range(3)))
    (tmp_path / "part-2").write_text(entry.format("C1").replace("<entry>", '<entry dataset="x">') + "</uniprot>\n")
    got = sorted((r.accession, r.full_name, r.base_sequence, r.features[0].description, r.features[0].begin) for r in readers.read_protein_xml(spark, str(tmp_path)).collect())
    assert got == [(a, f"n & {a}", "PEP", "a <b>", 3) for a in ("A1", "A2", "B0", "B1", "B2", "C1")]
