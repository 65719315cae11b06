"""Queries that write files of each format from the test tables and read them back, named after the formats. What comes back is what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators.search import fragment_index, peptide_mass
from massloom.session import new_path, table
from massloom.sources import readers, writers


def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins and contaminants as FASTA, with sequences in lines of 60, and an entry without a sequence."""
    rows = table(spark, sf_dir, "proteins").select("accession", "base_sequence", F.lit("db").alias("kind")).unionByName(table(spark, sf_dir, "contaminants").select("accession", F.lit("").alias("base_sequence"), F.lit("cont").alias("kind")))
    record = F.concat(F.lit(">"), "kind", F.lit("|"), "accession", F.lit("|NAME A name OS=Some species GN=abc\n"), F.regexp_replace("base_sequence", "(.{60})", "$1\n"))
    path = new_path(spark, "fasta")
    rows.select("kind", record.alias("value")).write.partitionBy("kind").text(path)
    read = [readers.read_fasta(spark, f"{path}/kind={k}", k == "cont") for k in ("db", "cont")]
    counts = readers.database_counts(read)
    every, _ = readers.with_sequence(read)
    lengths = every.groupBy("is_contaminant").agg(F.sum(F.length("base_sequence")).alias("residues"), F.min("gene").alias("gene"), F.min("organism").alias("organism"))
    return counts.join(lengths, "is_contaminant", "left")


def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spectral library of the matched sequences."""
    rows = table(spark, sf_dir, "psms").filter("base_sequence RLIKE '^[A-Z]+$' AND precursor_charge IS NOT NULL").groupBy(F.col("base_sequence").alias("sequence"), F.col("precursor_charge").alias("charge")).agg(F.max("matched_ion_counts").alias("n"))
    ions = F.sequence(F.lit(1), F.col("n"))
    full = rows.filter("n > 0").select("sequence", "charge", (F.length("sequence") * 100.5).alias("mw"), F.col("charge").cast("double").alias("retention_time"), F.transform(ions, lambda i: i * 10.5).alias("mz"), F.transform(ions, lambda i: i / 2.0).alias("intensity"), F.transform(ions, lambda i: F.concat(F.lit("b"), i.cast("string"))).alias("ions"))
    path = new_path(spark, "library")
    writers.write_msp(full, path)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return readers.read_msp(spark, path).select("sequence", "charge", "mw", "retention_time", F.round(total("mz"), 3).alias("mz"), F.round(total("intensity"), 3).alias("intensity"), F.element_at("ions", -1).alias("last_ion"))


def mgf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as spectra with their five highest peaks."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: (i + 100).cast("double")).alias("mz"), F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) + 0.01, 4)).alias("intensity"))
    spectra = readers.filtered_spectra(rows, ["vec_id"], 5).select(F.col("vec_id").cast("string").alias("title"), F.lit(1.5).alias("retention_time"), (F.col("vec_id") + 0.25).alias("precursor_mz"), F.lit(2).alias("charge"), "mz", "intensity")
    path = new_path(spark, "mgf")
    writers.write_mgf(spectra, path)
    return readers.read_mgf(spark, path).select(F.col("title").cast("bigint").alias("vec_id"), "precursor_mz", "charge", "retention_time", F.size("mz").alias("n_peaks"), F.round(F.aggregate("intensity", F.lit(0.0), lambda acc, x: acc + x), 4).alias("intensity"))


def protein_xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protein database with a feature."""
    feature = F.array(F.struct(F.lit("modified residue").alias("type"), F.lit("Phospho & <more>").alias("description"), F.length("base_sequence").alias("begin")))
    rows = table(spark, sf_dir, "proteins").select("accession", F.col("protein_name").alias("full_name"), "base_sequence", feature.alias("features"))
    path = new_path(spark, "proteins")
    writers.write_protein_xml(rows, path)
    return readers.read_protein_xml(spark, path).select("accession", "base_sequence", F.col("features")[0]["description"].alias("description"), F.col("features")[0]["begin"].alias("begin"))


def match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by file, read back with their types."""
    rows = table(spark, sf_dir, "psms").select("file_name", "scan_number", "precursor_charge", "score", "base_sequence", "q_value").filter("file_name IS NOT NULL")
    path = new_path(spark, "matches")
    writers.write_matches(rows, path, [F.col("`File Name`"), F.col("`Scan Number`")])
    back = readers.read_matches(spark, path)
    return back.groupBy(F.col("File Name").alias("file_name")).agg(F.count(F.lit(1)).alias("n"), F.sum("Scan Number").alias("scans"), F.sum("Precursor Charge").alias("charges"), F.round(F.sum(F.when(~F.isnan("Score"), F.col("Score"))), 3).alias("score"))


def compressed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by flag as compressed tables, one folder for each flag."""
    path = new_path(spark, "tables")
    writers.write_tsv(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity"), path, per="l_returnflag", compressed=True)
    return readers.read_table(spark, path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("try_cast(l_orderkey AS bigint)")).alias("keys"), F.sum(F.expr("try_cast(l_quantity AS double)")).alias("quantity"))


def percolator_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: labels of a Percolator table, its two heading lines apart."""
    rows = table(spark, sf_dir, "psms").filter("decoy IS NOT NULL").select("psm_id", "scan_number", "score", "full_sequence", "accession", "decoy")
    path = new_path(spark, "percolator")
    writers.write_percolator(rows.withColumn("full_sequence", F.translate("full_sequence", "\t\r\n", "   ")).withColumn("accession", F.translate("accession", "\t\r\n", "   ")), path, "psm_id", F.col("decoy") == "N", {"score": 1}, F.col("full_sequence"), "accession")
    cells = F.split("value", "\t")
    return spark.read.text(path).groupBy(cells[1].alias("label")).agg(F.count(F.lit(1)).alias("n"))


def identification_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: items of an mzIdentML and queries of a pepXML document of good matches."""
    rows = table(spark, sf_dir, "psms").filter("q_value <= 0.01 AND NOT isnan(q_value) AND scan_number IS NOT NULL AND full_sequence IS NOT NULL AND NOT contains(full_sequence, '|')").select(F.coalesce("file_name", F.lit("")).alias("file_name"), "scan_number", "precursor_charge", F.lit(1000.5).alias("precursor_mass"), F.col("full_sequence").alias("peptide"), F.coalesce("accession", F.lit("")).alias("protein"), "score", "q_value")
    one, two = new_path(spark, "mzid"), new_path(spark, "pepxml")
    writers.write_mzidentml(rows, one)
    writers.write_pepxml(rows, two, settings={"tolerance": "5 ppm"})
    kinds = F.regexp_extract("value", "^<(SpectrumIdentificationResult|PeptideEvidence|Peptide|DBSequence|SpectraData|spectrum_query) ", 1)
    lines = spark.read.text(one).unionByName(spark.read.text(two)).select(kinds.alias("kind"), (F.size(F.split("value", "<Modification ")) - 1).alias("mods"))
    return lines.filter("kind <> ''").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("mods").alias("n_modifications"))


def modification_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of a modification list with two targets each."""
    record = F.concat(F.lit("ID   Mod "), F.col("p_partkey").cast("string"), F.lit("\nTG   S or T\nPP   Anywhere.\nMT   "), "p_type", F.lit("\nDR   http://x.org//y\nCF   H1 O"), F.col("p_size").cast("string"), F.lit("\n//"))
    path = new_path(spark, "mods")
    table(spark, sf_dir, "part").select(record.alias("value")).write.text(path)
    return readers.read_modifications(spark, path).groupBy("mod_type", "target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("modification_id").alias("n_ids"), F.countDistinct("formula").alias("n_formulas"))


def combination_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of prices both of which are prices of small parts."""
    parts = table(spark, sf_dir, "part")
    path = new_path(spark, "combos")
    parts.select(F.concat_ws(" ", F.round("p_retailprice", 2).cast("string"), (F.col("p_size") + 900.0).cast("string")).alias("value")).write.text(path)
    known = parts.filter("p_size <= 10").select(F.round("p_retailprice", 2).alias("mass"))
    return readers.read_combos(spark, path, known, tolerance=0.001).groupBy("second").agg(F.count(F.lit(1)).alias("n"))


def fragment_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the matched sequences' fragments, built once for its settings."""
    rows = table(spark, sf_dir, "psms").select(F.col("base_sequence").alias("peptide")).distinct().filter("peptide RLIKE '^[ACDEFGHIKLMNPQRSTVWY]{2,}$'")
    folder = new_path(spark, "index")
    build = lambda: fragment_index(rows.withColumn("mass", peptide_mass(F.col("peptide"))), 100)
    first, again = (writers.cached_index(build, spark, folder, "by 100") for _ in range(2))
    return first.unionByName(again).groupBy("peptide").agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n_fragments"))


QUERIES = {f.__name__: f for f in (fasta_files, library_files, mgf_files, protein_xml_files, match_files, compressed_tables, percolator_files, identification_files, modification_files, combination_files, fragment_index_files)}
_GOOD = "q_value <= 0.01 AND NOT isnan(q_value) AND scan_number IS NOT NULL AND full_sequence IS NOT NULL AND NOT contains(full_sequence, '|')"
SQL = {
    "fasta_files": "SELECT false AS is_contaminant, count(*) AS n_targets, 0::BIGINT AS n_decoys, 0::BIGINT AS n_empty, CAST(sum(length(base_sequence)) AS BIGINT) AS residues, 'abc' AS gene, 'Some species' AS organism FROM proteins UNION ALL SELECT true, 0, 0, count(*), NULL, NULL, NULL FROM contaminants",
    "library_files": "SELECT base_sequence AS sequence, precursor_charge AS charge, length(base_sequence) * 100.5::DOUBLE AS mw, CAST(precursor_charge AS DOUBLE) AS retention_time, round(n * (n + 1) / 2 * 10.5::DOUBLE, 3) AS mz, round(n * (n + 1) / 4.0::DOUBLE, 3) AS intensity, 'b' || n AS last_ion FROM (SELECT base_sequence, precursor_charge, max(matched_ion_counts) AS n FROM psms WHERE regexp_full_match(base_sequence, '[A-Z]+') AND precursor_charge IS NOT NULL GROUP BY 1, 2) WHERE n > 0",
    "mgf_files": "WITH p AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: round(abs(CAST(x AS DOUBLE)) + 0.01, 4))) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), t AS (SELECT * FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS top FROM p) WHERE x >= top * 0.01 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 5) SELECT vec_id, vec_id + 0.25::DOUBLE AS precursor_mz, 2 AS charge, 1.5::DOUBLE AS retention_time, CAST(count(*) AS INTEGER) AS n_peaks, round(sum(x), 4) AS intensity FROM t GROUP BY 1",
    "protein_xml_files": "SELECT accession, base_sequence, 'Phospho & <more>' AS description, CAST(length(base_sequence) AS INTEGER) AS begin FROM proteins",
    "match_files": "SELECT file_name, count(*) AS n, CAST(sum(scan_number) AS BIGINT) AS scans, CAST(sum(precursor_charge) AS BIGINT) AS charges, round(sum(CASE WHEN NOT isnan(score) THEN score END), 3) AS score FROM psms WHERE file_name IS NOT NULL GROUP BY 1",
    "compressed_tables": "SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
    "percolator_files": "SELECT CASE WHEN decoy = 'N' THEN '1' ELSE '-1' END AS label, count(*) AS n FROM psms WHERE decoy IS NOT NULL GROUP BY 1 UNION ALL SELECT 'Label', 1 UNION ALL SELECT '-', 1",
    "identification_files": f"WITH k AS (SELECT coalesce(file_name, '') AS f, full_sequence AS p, coalesce(accession, '') AS a FROM psms WHERE {_GOOD}) SELECT 'SpectrumIdentificationResult' AS kind, count(*) AS n, 0::BIGINT AS n_modifications FROM k UNION ALL SELECT 'spectrum_query', count(*), 0 FROM k UNION ALL SELECT 'PeptideEvidence', count(DISTINCT (p, a)), 0 FROM k UNION ALL SELECT 'DBSequence', count(DISTINCT a), 0 FROM k UNION ALL SELECT 'SpectraData', count(DISTINCT f), 0 FROM k UNION ALL SELECT 'Peptide', count(*), CAST(sum(length(p) - length(replace(p, '[', ''))) AS BIGINT) FROM (SELECT DISTINCT p FROM k)",
    "modification_files": "SELECT p_type AS mod_type, t AS target, count(*) AS n, count(DISTINCT p_partkey) AS n_ids, count(DISTINCT p_size) AS n_formulas FROM part, (VALUES ('S'), ('T')) v(t) GROUP BY 1, 2",
    "combination_files": "WITH p AS (SELECT round(p_retailprice, 2) AS a, p_size + 900.0::DOUBLE AS b, p_size FROM part), k AS (SELECT DISTINCT a FROM p WHERE p_size <= 10) SELECT b AS second, count(*) AS n FROM p WHERE EXISTS (SELECT 1 FROM k WHERE abs(k.a - p.a) < 0.001) AND EXISTS (SELECT 1 FROM k WHERE abs(k.a - p.b) < 0.001) GROUP BY 1",
    "fragment_index_files": "SELECT DISTINCT base_sequence AS peptide, 2 * (length(base_sequence) - 1) AS n_fragments FROM psms WHERE regexp_full_match(base_sequence, '[ACDEFGHIKLMNPQRSTVWY]{2,}')",
}
