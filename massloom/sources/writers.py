"""Writers of result files (K1-K18). All are written by Spark into folders, documents as parts in order, so the driver never holds a result."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.masses import shortened
from massloom.functions.sequences import bare_sequence, modifications


def _cell(df: DataFrame, name: str, digits: int) -> Column:
    """A cell of a text table: numbers with a fixed number of digits, null empty, long cells noted."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("double", "float"):
        return F.when(F.isnan(name), "NaN").otherwise(F.format_string(f"%.{digits}f", F.col(name)))
    if kind == "array":
        return F.array_join(F.transform(name, lambda x: x.cast("string")), "|")
    return shortened(F.translate(F.col(name).cast("string"), "\t\r\n", "   "))


def write_tsv(df: DataFrame, path: str, order: Sequence[Column] = (), digits: int = 5, per: str | None = None, files: int | None = None, compressed: bool = False) -> None:
    """A tab-separated table (K1, K3, K9, K10, K12-K15, K18), sorted by `order`, one folder for each value of `per`, in `files` files if given."""
    text = df.select(*[F.coalesce(_cell(df, c, digits), F.lit("")).alias(c) for c in df.columns], *[o.alias(f"order__{i}") for i, o in enumerate(order)])
    if order:
        text = text.orderBy(*[f"order__{i}" for i in range(len(order))]).drop(*[f"order__{i}" for i in range(len(order))])
    if files:
        text = text.coalesce(files)
    out = text.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("compression", "gzip" if compressed else "none")
    (out.partitionBy(per) if per else out).csv(path)


def write_percolator(df: DataFrame, path: str, key: str, label: Column, features: dict[str, int], peptide: str, protein: str) -> None:
    """A Percolator table: header, default directions, then a row for each hypothesis, label 1 or -1 (K2)."""
    names = ["SpecId", "Label", "ScanNr", *features, "Peptide", "Proteins"]
    head = df.sparkSession.createDataFrame([(0, "\t".join(names)), (1, "\t".join(["DefaultDirection", "-", "-", *[str(d) for d in features.values()], "", ""]))], "o int, line string")
    cells = [F.col(key).cast("string"), F.when(label, "1").otherwise("-1"), F.coalesce(F.col("scan_number").cast("string"), F.lit("0")), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).cast("string") for f in features], F.concat(F.lit("-."), F.coalesce(peptide, F.lit("")), F.lit(".-")), F.coalesce(F.col(protein), F.lit(""))]
    rows = df.select(F.lit(2).alias("o"), F.concat_ws("\t", *cells).alias("line"))
    head.unionByName(rows).orderBy("o", "line").select("line").write.mode("overwrite").text(path)


def msp_records(df: DataFrame) -> DataFrame:
    """(value): a library record for each row of (sequence, charge, mw, retention_time, mz, intensity, ions)."""
    peaks = F.arrays_zip(F.col("mz").alias("mz"), F.col("intensity").alias("intensity"), F.col("ions").alias("ions"))
    lines = F.array_join(F.transform(peaks, lambda p: F.concat(p["mz"].cast("string"), F.lit("\t"), p["intensity"].cast("string"), F.lit('\t"'), p["ions"], F.lit('/0ppm"'))), "\n")
    head = F.concat(F.lit("Name: "), "sequence", F.lit("/"), F.col("charge").cast("string"), F.lit("\nMW: "), F.coalesce(F.col("mw").cast("string"), F.lit("0")), F.lit("\nComment: iRT="), F.coalesce(F.col("retention_time").cast("string"), F.lit("0")), F.lit("\nNum peaks: "), F.size("mz").cast("string"))
    return df.select(F.concat(head, F.lit("\n"), lines, F.lit("\n")).alias("value"))


def write_msp(df: DataFrame, path: str) -> None:
    """A spectral library (K7)."""
    msp_records(df).write.mode("overwrite").text(path)


def write_mgf(df: DataFrame, path: str) -> None:
    """Spectra as MGF, such as calibrated ones (K6)."""
    lines = F.array_join(F.zip_with("mz", "intensity", lambda m, i: F.concat(m.cast("string"), F.lit(" "), i.cast("string"))), "\n")
    head = F.concat(F.lit("BEGIN IONS\nTITLE="), F.coalesce("title", F.lit("")), F.lit("\nRTINSECONDS="), F.coalesce((F.col("retention_time") * 60).cast("string"), F.lit("0")), F.lit("\nPEPMASS="), F.coalesce(F.col("precursor_mz").cast("string"), F.lit("0")), F.lit("\nCHARGE="), F.coalesce(F.col("charge").cast("string"), F.lit("1")), F.lit("+\n"))
    df.select(F.concat(head, lines, F.lit("\nEND IONS\n")).alias("value")).write.mode("overwrite").text(path)


def xml_text(col: Column) -> Column:
    """A value as text or attribute of an XML document; null as empty."""
    out = F.coalesce(col.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    # Other control characters can't stand in XML at all.
    return F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def _write_document(parts: Sequence[str | tuple[DataFrame, Sequence[str], Column]], spark: SparkSession, path: str) -> None:
    """A document of fixed lines and of lines made from rows, each in order of its keys: a folder of parts that read one after another are the document."""
    every = None
    for i, part in enumerate(parts):
        if isinstance(part, str):
            rows = spark.createDataFrame([(i, part)], "part int, line string").withColumn("keys", F.lit(""))
        else:
            df, keys, line = part
            # Numbers are padded, so that as text they sort as numbers.
            rows = df.select(F.lit(i).alias("part"), line.alias("line"), F.concat_ws("\x00", *[F.lpad(F.col(k).cast("string"), 20, "0") if df.schema[k].dataType.typeName() in ("integer", "long") else F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("keys"))
        every = rows if every is None else every.unionByName(rows)
    every.orderBy("part", "keys", "line").select("line").write.mode("overwrite").text(path)


def write_pepxml(df: DataFrame, path: str, enzyme: str = "trypsin", settings: dict[str, str] | None = None) -> None:
    """pepXML of matches (file_name, scan_number, precursor_charge, precursor_mass, peptide, protein, score, q_value) by file and scan (K5), as a folder of parts.

    `settings` are written as parameters of the search; an optional column `mods`, (residue, mass) each, as modified residues.
    """
    x = lambda c: xml_text(F.col(c))
    spectrum = F.concat(x("file_name"), F.lit("."), x("scan_number"), F.lit("."), x("scan_number"), F.lit("."), x("precursor_charge"))
    mods = F.lit("")
    if "mods" in df.columns:
        each = F.array_join(F.transform("mods", lambda m: F.concat(F.lit('<mod_aminoacid_mass position="'), m["residue"].cast("string"), F.lit('" mass="'), m["mass"].cast("string"), F.lit('"/>'))), "")
        mods = F.when(F.size("mods") > 0, F.concat(F.lit("<modification_info>"), each, F.lit("</modification_info>"))).otherwise("")
    line = F.concat(
        F.lit('<spectrum_query spectrum="'), spectrum, F.lit('" start_scan="'), x("scan_number"), F.lit('" end_scan="'), x("scan_number"), F.lit('" precursor_neutral_mass="'), x("precursor_mass"), F.lit('" assumed_charge="'), x("precursor_charge"),
        F.lit('"><search_result><search_hit hit_rank="1" peptide="'), x("peptide"), F.lit('" protein="'), x("protein"), F.lit('">'), mods, F.lit('<search_score name="score" value="'), x("score"), F.lit('"/><search_score name="q_value" value="'), x("q_value"), F.lit('"/></search_hit></search_result></spectrum_query>'),
    )
    parameters = "".join(f"<parameter name={quoteattr(k)} value={quoteattr(v)}/>" for k, v in (settings or {}).items())
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<msms_pipeline_analysis xmlns="http://regis-web.systemsbiology.net/pepXML">\n<msms_run_summary base_name="run" raw_data_type="raw" raw_data="mzML">\n<sample_enzyme name={quoteattr(enzyme)}/>\n<search_summary base_name="run" search_engine="massloom">{parameters}</search_summary>'
    _write_document([head, (df, ["file_name", "scan_number"], line), "</msms_run_summary>\n</msms_pipeline_analysis>"], df.sparkSession, path)


def write_mzidentml(df: DataFrame, path: str) -> None:
    """mzIdentML of the same rows (K4), as a folder of parts: sequences, peptides with their modifications, evidence, inputs and items, each from its own distinct rows."""
    x = lambda c: xml_text(F.col(c))
    ref = lambda kind, *cols: F.concat(F.lit(kind + "_"), F.substring(F.md5(F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("")) for c in cols])), 1, 16))
    bare, mods = xml_text(bare_sequence(F.coalesce("peptide", F.lit("")))), modifications(F.coalesce("peptide", F.lit("")), with_fixed=True)
    each = F.array_join(F.transform(mods, lambda m: F.concat(F.lit('<Modification location="'), m["residue"].cast("string"), F.lit('"><cvParam cvRef="PSI-MS" accession="MS:1001460" name="unknown modification" value="'), xml_text(m["name"]), F.lit('"/></Modification>'))), "")
    protein = F.concat(F.lit('<DBSequence id="'), ref("DBS", "protein"), F.lit('" accession="'), x("protein"), F.lit('" searchDatabase_ref="SDB"/>'))
    peptide = F.concat(F.lit('<Peptide id="'), ref("PEP", "peptide"), F.lit('"><PeptideSequence>'), bare, F.lit("</PeptideSequence>"), each, F.lit("</Peptide>"))
    evidence = F.concat(F.lit('<PeptideEvidence id="'), ref("EV", "peptide", "protein"), F.lit('" peptide_ref="'), ref("PEP", "peptide"), F.lit('" dBSequence_ref="'), ref("DBS", "protein"), F.lit('"/>'))
    spectra = F.concat(F.lit('<SpectraData id="'), ref("SD", "file_name"), F.lit('" location="'), x("file_name"), F.lit('"/>'))
    name = F.concat(ref("SII", "file_name", "peptide"), F.lit("_"), x("scan_number"))
    item = F.concat(
        F.lit('<SpectrumIdentificationResult id="'), F.replace(name, F.lit("SII_"), F.lit("SIR_")), F.lit('" spectrumID="scan='), x("scan_number"), F.lit('" spectraData_ref="'), ref("SD", "file_name"), F.lit('"><SpectrumIdentificationItem id="'), name, F.lit('" chargeState="'), x("precursor_charge"),
        F.lit('" rank="1" passThreshold="'), F.when(F.col("q_value") <= 0.01, "true").otherwise("false"), F.lit('" peptide_ref="'), ref("PEP", "peptide"), F.lit('"><PeptideEvidenceRef peptideEvidence_ref="'), ref("EV", "peptide", "protein"), F.lit('"/><cvParam accession="MS:1002354" name="PSM-level q-value" cvRef="PSI-MS" value="'), x("q_value"), F.lit('"/></SpectrumIdentificationItem></SpectrumIdentificationResult>'),
    )
    parts = [
        '<?xml version="1.0" encoding="UTF-8"?>\n<MzIdentML version="1.1.1" id="result" xmlns="http://psidev.info/psi/pi/mzIdentML/1.1">\n<SequenceCollection>',
        (df.select("protein").distinct(), ["protein"], protein), (df.select("peptide").distinct(), ["peptide"], peptide), (df.select("peptide", "protein").distinct(), ["peptide", "protein"], evidence),
        '</SequenceCollection>\n<AnalysisProtocolCollection><SpectrumIdentificationProtocol id="SIP" analysisSoftware_ref="AS"><Threshold><cvParam accession="MS:1001448" name="pep:FDR threshold" cvRef="PSI-MS" value="0.01"/></Threshold></SpectrumIdentificationProtocol></AnalysisProtocolCollection>\n<DataCollection><Inputs><SearchDatabase id="SDB" location=""/>',
        (df.select("file_name").distinct(), ["file_name"], spectra), '</Inputs><AnalysisData><SpectrumIdentificationList id="SIL">',
        (df, ["file_name", "scan_number"], item), "</SpectrumIdentificationList></AnalysisData></DataCollection>\n</MzIdentML>",
    ]
    _write_document(parts, df.sparkSession, path)


def write_protein_xml(df: DataFrame, path: str) -> None:
    """A protein XML database with modified residues as features: (accession, full_name, base_sequence, features of (type, description, begin)) (K8), as a folder of parts."""
    spans = F.array_join(F.transform("features", lambda f: F.concat(F.lit('<feature type="'), xml_text(f["type"]), F.lit('" description="'), xml_text(f["description"]), F.lit('"><location><position position="'), f["begin"].cast("string"), F.lit('"/></location></feature>'))), "")
    x = lambda c: xml_text(F.col(c))
    line = F.concat(F.lit("<entry><accession>"), x("accession"), F.lit("</accession><name>"), x("full_name"), F.lit("</name>"), F.coalesce(spans, F.lit("")), F.lit('<sequence length="'), F.length("base_sequence").cast("string"), F.lit('">'), x("base_sequence"), F.lit("</sequence></entry>"))
    _write_document(['<?xml version="1.0" encoding="UTF-8"?>\n<uniprot>', (df, ["accession"], line), "</uniprot>"], df.sparkSession, path)


#: The columns of a written table of matches in their order, by the names of this engine's columns.
MATCH_HEADER = {
    "file_name": "File Name", "scan_number": "Scan Number", "scan_retention_time": "Scan Retention Time", "num_experimental_peaks": "Num Experimental Peaks", "total_ion_current": "Total Ion Current", "precursor_scan_number": "Precursor Scan Number", "precursor_charge": "Precursor Charge", "precursor_mz": "Precursor MZ", "precursor_mass": "Precursor Mass",
    "score": "Score", "delta_score": "Delta Score", "notch": "Notch", "base_sequence": "Base Sequence", "full_sequence": "Full Sequence", "ambiguity_level": "Ambiguity Level", "missed_cleavages": "Missed Cleavages", "peptide_monoisotopic_mass": "Peptide Monoisotopic Mass", "mass_diff_da": "Mass Diff (Da)", "mass_diff_ppm": "Mass Diff (ppm)",
    "accession": "Protein Accession", "protein_name": "Protein Name", "gene_name": "Gene Name", "organism_name": "Organism Name", "identified_sequence_variations": "Identified Sequence Variations", "contaminant": "Contaminant", "decoy": "Decoy", "decoy_contaminant_target": "Decoy/Contaminant/Target", "matched_ion_counts": "Matched Ion Counts",
    "cumulative_target": "Cumulative Target", "cumulative_decoy": "Cumulative Decoy", "q_value": "QValue", "q_value_notch": "QValue Notch", "pep": "PEP", "pep_q_value": "PEP_QValue",
}


def write_matches(df: DataFrame, path: str, order: Sequence[Column] = (), per_file: bool = False) -> None:
    """A table of matches or peptides with the columns of MATCH_HEADER that `df` has, in that order (K1); with `per_file` one folder for each file."""
    names = {c: h for c, h in MATCH_HEADER.items() if c in df.columns}
    out = df.select(*[F.col(c).alias(h) for c, h in names.items()], *([F.col("file_name").alias("file")] if per_file else []))
    write_tsv(out, path, order, per="file" if per_file else None)


def pruned(database: DataFrame, observed: DataFrame, rules: dict[str, int]) -> DataFrame:
    """(accession, position, modification, mod_type) to write (Q13, K8): by type never (0), if listed and observed (1), if listed (2), if observed (3).

    Both tables have those columns, `database` the listed ones; types without a rule are never written.
    """
    keys = ["accession", "position", "modification", "mod_type"]
    both = database.select(*keys, F.lit(True).alias("listed")).distinct().join(observed.select(*keys, F.lit(True).alias("seen")).distinct(), keys, "full_outer")
    table = F.create_map(*[F.lit(x) for pair in (rules or {"": 0}).items() for x in pair])
    rule = F.coalesce(F.try_element_at(table, F.col("mod_type")), F.lit(0))
    listed, seen = F.coalesce("listed", F.lit(False)), F.coalesce("seen", F.lit(False))
    return both.filter(F.when(rule == 1, listed & seen).when(rule == 2, listed).when(rule == 3, seen).otherwise(False)).select(*keys)


def index_path(spark: SparkSession, folder: str, parameters: str) -> tuple[str, bool]:
    """Where an index with these parameters belongs, and whether a finished one is there."""
    path = f"{folder.rstrip('/')}/index-{hashlib.sha256(parameters.encode()).hexdigest()[:24]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return path, bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def cached_index(build, spark: SparkSession, folder: str, parameters: str) -> DataFrame:
    """The index that `build` makes, written once for each text of parameters (K17), in ranges of bins so that row groups can be skipped."""
    path, there = index_path(spark, folder, parameters)
    if not there:
        build().repartitionByRange("bin").sortWithinPartitions("bin").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_summary(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    """results.txt (K16), as a folder with one part."""
    _write_document(list(lines), spark, path)
