"""Queries on composed searches and what follows them, on isotopes, quantification and files' contents. Searches are asked for what was planted in their spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.masses import RESIDUES, WATER
from massloom.functions.text import accessions
from massloom.operators import chromatograms as xic
from massloom.operators import crosslinks as xl
from massloom.operators import glycans as gly
from massloom.operators import inference as inf
from massloom.operators import isotopes as iso
from massloom.operators import pep, search
from massloom.operators import post_search as post
from massloom.operators import quantification as quant
from massloom.plans.search_queries import _peptides, _spectra
from massloom.session import materialize, table
from massloom.sources.writers import pruned


def isotope_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas by part size; the chance of no extra neutron, and how much likelier or not one is."""
    n = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_size").distinct().filter("p_size > 0").withColumn("p", iso.pattern_of()((3 * n), (5 * n), (n % 7), (n % 11), (n % 3)))
    return rows.select("p_size", F.round(F.col("p")[0], 9).alias("none"), F.round(F.col("p")[1] / F.col("p")[0], 9).alias("ratio"))


def deconvolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of each match's precursor, and mass and charge read from it."""
    mass = F.expr("try_cast(trim(peptide_monoisotopic_mass) AS double)")
    rows = table(spark, sf_dir, "psms").select("psm_id", mass.alias("mass"), "precursor_charge").filter("mass BETWEEN 500 AND 6000 AND precursor_charge BETWEEN 1 AND 6")
    spectra = rows.select("psm_id", iso.envelopes_of()("mass", "precursor_charge").alias("e")).select("psm_id", "e.mz", "e.intensity")
    return iso.deconvoluted(spectra, "psm_id").select("psm_id", (F.floor(F.col("mass") * 1e4 + 0.25) / 1e4).alias("mass"), "charge")


def envelope_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of an order's lines against its quantities in thousands."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("a"), F.collect_list(F.col("l_quantity") * 1000).alias("b"))
    return iso.assigned(rows, "l_orderkey", "a", "b").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 2).alias("distance"))


def spectral_averaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type as peaks, their users as scans."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", (F.floor(F.col("value") * 10) / 10 + 0.05).alias("mz"), (F.col("value") * (1 + F.col("user_id") % 7)).alias("intensity"))
    out = iso.averaged(rows, ["event_type"], "user_id", "mz", "intensity", 1.0, 1.5)
    return out.select("event_type", "bin", F.round("mz", 5).alias("mz"), F.round("intensity", 5).alias("intensity"), "n_kept")


def peptide_isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: forms of the matched sequences with up to two of oxidation on M and phosphorylation on S, and the heaviest's mass."""
    rows = table(spark, sf_dir, "psms").select(F.col("base_sequence").alias("peptide")).distinct().filter("peptide RLIKE '^[ACDEFGHIKLMNPQRSTVWY]{2,}$'")
    out = search.with_isoforms(rows.withColumn("mass", search.peptide_mass(F.col("peptide"))), {"M": [("Oxidation", 15.994915)], "S": [("Phosphorylation", 79.966331)]}, 2, 4096)
    return out.groupBy("peptide").agg(F.count(F.lit(1)).alias("n_forms"), F.countDistinct("full_sequence").alias("n_distinct"), F.round(F.max("mass"), 4).alias("most"))


def digest_proline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: trypsin with the proline rule."""
    return search.digest(table(spark, sf_dir, "proteins"), ["accession"], "base_sequence", "trypsin")


def nonspecific_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 7 to 20 residues of each protein, those with a tryptic end, and the heaviest."""
    rows = table(spark, sf_dir, "proteins").select("accession", "base_sequence")
    every = search.nonspecific_peptides(rows, ["accession"], "base_sequence", 7, 20).groupBy("accession").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("mass"), 4).alias("most"))
    semi = search.nonspecific_peptides(rows, ["accession"], "base_sequence", 7, 20, "trypsin").groupBy("accession").agg(F.count(F.lit(1)).alias("n_semi"))
    return every.join(semi, "accession", "left").select("accession", "n", F.coalesce("n_semi", F.lit(0).cast("bigint")).alias("n_semi"), "most")


def nonspecific_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: ideal spectra of the matched sequences searched among all stretches of the proteins; how many came back."""
    scans = materialize(_spectra(spark, sf_dir), "scans")
    found = search.nonspecific_search(scans, table(spark, sf_dir, "proteins"), "base_sequence", cutoff=5.0)
    back = found.join(scans.select("scan_id", "truth"), "scan_id").filter("peptide = truth")
    return back.agg(F.count(F.lit(1)).alias("n_found"))


def rna_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: RNA written from the proteins: masses, and the number and sum of the d, w and y fragments."""
    rna = F.translate("base_sequence", "ACDEFGHIKLMNPQRSTVWY", "ACGUACGUACGUACGUACGU")
    rows = table(spark, sf_dir, "proteins").select("accession", rna.alias("rna")).filter("rna RLIKE '^[ACGU]{2,}$'")
    ions = rows.select("accession", search.oligo_mass(F.col("rna")).alias("mass"), F.inline(search.oligo_fragments(F.col("rna"))).alias("kind", "number", "ion"))
    return ions.groupBy("accession").agg(F.round(F.first("mass"), 3).alias("mass"), F.count(F.lit(1)).alias("n"), F.round(F.sum("ion"), 2).alias("total"))


def _arrays(peaks: Column) -> list[Column]:
    ordered = F.array_sort(peaks)
    return [ordered.alias("peaks"), F.transform(ordered, lambda p: F.lit(1.0)).alias("intensities"), F.size(ordered).cast("double").alias("total")]


def _shifted_ladder(peptide: Column, site: Column, shift: Column) -> Column:
    """The b and y masses of a peptide that carries `shift` on a residue."""
    n = F.length(peptide)
    carries = lambda f: F.when(f["kind"] == "b", f["number"] >= site).otherwise(n - f["number"] < site)
    return F.transform(search.fragments(peptide), lambda f: f["mass"] + F.when(carries(f), shift).otherwise(0.0))


_LINKER = xl.Linker("DSSO", "K", 158.00376, 176.01433, 175.03031, 279.0777, 158.00376)


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(planted crosslinks of two proteins that share a peptide, all peptides): the first peptides by name with a lysine inside, linked at it."""
    proteins = table(spark, sf_dir, "proteins").select("accession", "base_sequence")
    cut = search.digest(proteins, ["accession"], "base_sequence", "trypsin")
    peptides = cut.select("peptide").distinct().withColumn("mass", search.peptide_mass(F.col("peptide"))).filter("mass IS NOT NULL")
    arm = cut.filter("peptide RLIKE '^[ACDEFGHILMNPQRSTVWY]*K.+$'").groupBy("accession").agg(F.min("peptide").alias("peptide"))
    pairs = table(spark, sf_dir, "shared_pairs").select(F.trim("accession_a").alias("a"), F.trim("accession_b").alias("b")).filter("a < b").distinct()
    both = pairs.join(arm.select(F.col("accession").alias("a"), F.col("peptide").alias("x")), "a").join(arm.select(F.col("accession").alias("b"), F.col("peptide").alias("y")), "b")
    both = both.select(F.least("x", "y").alias("truth_a"), F.greatest("x", "y").alias("truth_b")).distinct().filter("truth_a <> truth_b")
    for side in ("a", "b"):
        both = both.withColumn(f"mass_{side}", search.peptide_mass(F.col(f"truth_{side}"))).withColumn(f"site_{side}", F.instr(f"truth_{side}", "K"))
    return both, peptides


def crosslink_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: how many planted crosslinks came back, with their sites."""
    planted, peptides = _linked(spark, sf_dir)
    peaks = F.concat(_shifted_ladder(F.col("truth_a"), F.col("site_a"), F.col("mass_b") + _LINKER.total), _shifted_ladder(F.col("truth_b"), F.col("site_b"), F.col("mass_a") + _LINKER.total))
    scan_id = F.concat_ws("-", "truth_a", "truth_b")
    scans = planted.select(scan_id.alias("scan_id"), (F.col("mass_a") + F.col("mass_b") + _LINKER.total).alias("precursor_mass"), *_arrays(peaks), "site_a", "site_b")
    scans = materialize(scans, "scans")
    found = xl.crosslink_search(scans.drop("site_a", "site_b"), peptides, _LINKER)
    back = found.join(scans.select("scan_id", "site_a", "site_b"), "scan_id").filter("concat(alpha, '-', beta) = scan_id AND alpha_site = site_a AND beta_site = site_b")
    return back.agg(F.count(F.lit(1)).alias("n_found"))


_GLYCANS = {1: 203.07937, 2: 365.13220, 3: 656.22762}


def glyco_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: each digested peptide with a serine or threonine carries a glycan at the first one; how many came back with their site.

    Spectra aren't written: they follow from a scan's peptide and are made in its block of masses, behind the shuffle.
    """
    rows = materialize(_peptides(spark, sf_dir).filter("peptide RLIKE '[ST]'"), "peptides")
    truth = rows.withColumn("site", F.length(F.regexp_extract("peptide", "^[^ST]*[ST]", 0))).withColumn("glycan", (F.length("peptide") % 3 + 1).cast("int"))
    shift = F.element_at(F.array(*[F.lit(m) for _, m in sorted(_GLYCANS.items())]), F.col("glycan"))
    scans = truth.select(F.col("peptide").alias("scan_id"), (F.col("mass") + shift).alias("precursor_mass"), "mass", "site", "glycan")
    peaks = F.array_union(F.concat(_shifted_ladder(F.col("scan_id"), F.col("site"), shift), F.transform(search.fragments(F.col("scan_id")), lambda f: f["mass"])), F.array(F.col("mass") + shift))
    found = gly.glyco_search(scans, rows, [(1,), (2,), (3,), (1, 1)], _GLYCANS, spectra=lambda s: s.select("*", *_arrays(peaks)))
    best = found.groupBy("scan_id", "peptide", "box").agg(F.max_by(F.struct("site", "glycan"), F.struct("probability", -F.col("site"))).alias("at"))
    back = best.join(scans.select("scan_id", F.col("site").alias("s"), F.col("glycan").alias("g")), "scan_id").filter("peptide = scan_id AND at.site = s AND at.glycan = g")
    return back.agg(F.count(F.lit(1)).alias("n_found"))


def gptmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: each peptide with one serine carries a phosphate there; how many were found at that place.

    Spectra aren't written: a scan is a distinct peptide, so they are made where the join finds them, behind the shuffle.
    """
    rows = _peptides(spark, sf_dir).filter("peptide RLIKE '^[^S]*S[^S]*$'").withColumn("site", F.instr("peptide", "S"))
    scans = rows.select(F.col("peptide").alias("scan_id"), (F.col("mass") + 79.966331).alias("precursor_mass"), *_arrays(_shifted_ladder(F.col("peptide"), F.col("site"), F.lit(79.966331))))
    mods = spark.createDataFrame([("Phosphorylation", 79.966331, "S"), ("Oxidation", 15.994915, "M")], "modification string, mass double, residue string")
    found = pep.gptmd(scans, rows.select("peptide", "mass"), mods)
    return found.filter("modification = 'Phosphorylation'").agg(F.count(F.lit(1)).alias("n_found"))


def dia_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: the first tryptic peptide of each protein elutes over seven scans of one of forty runs; how many came back at their apex."""
    cut = search.digest(table(spark, sf_dir, "proteins"), ["accession"], "base_sequence", "trypsin", missed=0)
    # A row becomes hundreds of peaks, so rows are kept apart in a number of parts of their own.
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = cut.groupBy("accession").agg(F.min("peptide").alias("peptide")).select("peptide").repartition(parts, "peptide")
    truth = first.distinct().withColumn("mass", search.peptide_mass(F.col("peptide"))).filter("mass IS NOT NULL")
    # Runs and times by hash; a peptide's intensity by another, so that traces differ.
    truth = truth.withColumn("file", F.pmod(F.xxhash64("peptide"), F.lit(40)).cast("int")).withColumn("apex", 10 + 10 * F.pmod(F.xxhash64("peptide", F.lit(1)), F.lit(5000)).cast("int"))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(float(h)).alias("height")) for k, h in ((-3, 1), (-2, 4), (-1, 9), (0, 12), (1, 9), (2, 4), (3, 1))]))
    seen = truth.select("peptide", "mass", "file", "apex", at.alias("p")).withColumn("scan", F.col("apex") + F.col("p.step")).withColumn("intensity", F.col("p.height"))
    survey = seen.select("file", "scan", "mass", "intensity")
    product = seen.select("file", "scan", F.explode(F.transform(search.fragments(F.col("peptide")), lambda f: f["mass"])).alias("mass"), "intensity")
    found = xic.dia_search(survey, product, ["file"], _peptides(spark, sf_dir))
    back = found.join(truth.select("peptide", "file", "apex"), ["peptide", "file"]).filter("apex = apex_scan").select("peptide").distinct()
    return back.agg(F.count(F.lit(1)).alias("n_found"))


def _post_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "psms").withColumn("is_decoy", F.col("decoy") == "Y")
    return rows.select("psm_id", "full_file_path", "scan_number", "full_sequence", "base_sequence", "score", "delta_score", "is_decoy", accessions("accession").alias("accessions"), F.col("total_ion_current").alias("intensity"))


def post_search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: the unique matches with q-values."""
    return post.matches_of(_post_rows(spark, sf_dir)).select("psm_id", "q_value")


def post_search_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: the peptides with q-values."""
    return post.peptides_of(post.matches_of(_post_rows(spark, sf_dir))).select("full_sequence", "psm_id", "q_value")


def post_search_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: the proteins that parsimony keeps, with picked q-values and abundances over the files."""
    out = post.post_search(_post_rows(spark, sf_dir))
    total = out["abundances"].groupBy("accession").agg(F.round(F.sum("intensity"), 2).alias("intensity"), F.count(F.lit(1)).alias("n_files"))
    return out["kept"].join(out["scores"].select("accession", "q_value"), "accession", "left").join(total, "accession", "left").select("accession", "reason", "q_value", "intensity", "n_files")


def parsimony_proteases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 with a digest for each parity of charge."""
    rows = table(spark, sf_dir, "psms").filter("decoy = 'N' AND q_value <= 0.01 AND NOT isnan(q_value) AND base_sequence IS NOT NULL AND trim(base_sequence) <> '' AND precursor_charge IS NOT NULL")
    links = rows.select(F.explode(accessions("accession")).alias("accession"), "base_sequence", F.when(F.col("precursor_charge") % 2 == 0, "trypsin").otherwise("Arg-C").alias("protease")).distinct()
    return inf.parsimonious(links, "accession", "base_sequence", "protease")


def completed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1, stage 0: proteins of each full sequence, with those of its base sequence's other forms."""
    rows = table(spark, sf_dir, "psms").filter("full_sequence IS NOT NULL AND base_sequence IS NOT NULL").select(F.explode(accessions("accession")).alias("accession"), "full_sequence", "base_sequence")
    return inf.completed_links(rows, "accession", "full_sequence", "base_sequence").groupBy("full_sequence").agg(F.countDistinct("accession").alias("n_proteins"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precursor m/z of files calibrated by their matches; whether each file's median error grew nowhere."""
    mass = F.expr("try_cast(trim(peptide_monoisotopic_mass) AS double)")
    rows = table(spark, sf_dir, "psms").withColumn("mass", mass).filter("mass > 0 AND NOT isnan(mass) AND precursor_charge > 0 AND precursor_mz > 0 AND scan_number IS NOT NULL AND full_file_path IS NOT NULL AND total_ion_current > 0 AND NOT isnan(total_ion_current)")
    scans = rows.groupBy("full_file_path", "scan_number").agg(F.min_by(F.struct("precursor_mz", "precursor_charge", "mass", "total_ion_current"), "psm_id").alias("r")).select("full_file_path", "scan_number", "r.*")
    theory = F.col("mass") / F.col("precursor_charge") + 1.007276466879

    def acquire(now: DataFrame) -> DataFrame:
        off = (F.col("precursor_mz") - theory) / theory
        return now.select("full_file_path", "scan_number", off.alias("error"), F.log10("total_ion_current").alias("log_intensity")).filter("abs(error) < 20e-6")

    out = pep.calibrated(scans, acquire, ["full_file_path"], "scan_number", "precursor_mz", 20)
    median = lambda df, name: acquire(df).groupBy("full_file_path").agg(F.abs(F.percentile("error", 0.5)).alias(name))
    return median(scans, "before").join(median(out, "after"), "full_file_path").select("full_file_path", (F.col("after") <= F.col("before") + 1e-12).alias("is_kept_or_better"))


def most_probable_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two glycans on the sites of each part, and how likely the first is on each."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit(1), F.lit(2)).alias("box"), F.array(*[F.array(F.lit(1), F.lit(2)) for _ in range(3)]).alias("options"), F.array(*[F.create_map(F.lit(1), (p % (k + 2)).cast("double") / 4, F.lit(2), (p % (k + 3)).cast("double") / 4) for k in range(3)]).alias("costs"))
    return gly.localize(rows, "p_partkey").select("p_partkey", "site", "glycan", F.round("best", 6).alias("best"), F.round("probability", 6).alias("probability"))


def posterior_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: errors within 0 to 1, one for each scored match with a sequence."""
    rows = table(spark, sf_dir, "psms").filter("score IS NOT NULL AND NOT isnan(score) AND base_sequence <> '' AND decoy IS NOT NULL").withColumn("is_decoy", F.col("decoy") == "Y")
    data = pep.features(rows, F.length("base_sequence"), ["matched_ion_counts"], ["score", "delta_score", "precursor_charge"])
    out = pep.posterior_errors(data, "psm_id", "base_sequence", "is_decoy", "score", ["f_matched_ion_counts", "f_score", "f_delta_score", "f_precursor_charge"], trees=10)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("pep").between(0, 1), 1).otherwise(0)).alias("n_within"))


def apex_intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier's parts the dearest line near the part's price and quantity, as peaks near m/z and time."""
    lines = table(spark, sf_dir, "lineitem")
    peaks = lines.select(F.col("l_suppkey").alias("file"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("rt"), F.col("l_tax").alias("intensity"))
    matches = lines.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("sequence"), F.col("l_linenumber").alias("charge"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("rt"))
    return quant.apex_intensities(matches, peaks, 200.0, 1.0)


def run_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median differences of retention times between the labs of the files."""
    files = table(spark, sf_dir, "spectra_files").select("full_file_path", F.col("lab_name").alias("file"))
    rows = table(spark, sf_dir, "psms").filter("scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time) AND full_sequence IS NOT NULL").join(files, "full_file_path").select("file", F.col("full_sequence").alias("sequence"), F.col("scan_retention_time").alias("rt"))
    return quant.time_shifts(rows).select("from_file", "to_file", F.round("shift", 6).alias("shift"))


def normalized_intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dearest lines of each part by flag, normalized."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_extendedprice").alias("intensity"))
    return quant.normalized(rows, "l_returnflag", ["l_partkey"], "intensity").select("l_partkey", "l_returnflag", F.round("intensity", 4).alias("intensity"))


def label_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as peptides with up to four heavy residues."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 5).alias("n_heavy"), F.lit(4).alias("n_sites"), "l_extendedprice")
    out = quant.turnover(rows, ["l_partkey"], "n_heavy", "n_sites", "l_extendedprice")
    return out.select("l_partkey", "n_evidence", F.round("old", 2).alias("old"), F.round("new", 2).alias("new"))


def shared_scan_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as peptides, days as scans, flags as labels."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.date_trunc("month", "l_shipdate").alias("scan"), "l_returnflag", "l_quantity")
    return quant.shared_scan_intensity(rows, ["l_suppkey"], "scan", "l_returnflag", "l_quantity", 3)


def reporter_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reporter channels by m/z: an order's quantities as m/z, its prices as intensities."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("mz"), F.collect_list("l_extendedprice").alias("intensity"))
    channels = quant.reporter_intensities(F.col("mz"), F.col("intensity"), [10.0, 20.0, 30.0, 40.0], 2.5)
    return rows.select("l_orderkey", *[channels[i].alias(f"channel_{i + 1}") for i in range(4)])


def protein_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as proteins, parts as peptides, flags as samples."""
    from massloom.operators.aggregates import protein_rollup

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    return protein_rollup(rows, "p_brand", "l_partkey", "l_returnflag", "l_extendedprice").select("p_brand", "l_returnflag", F.round("abundance", 4).alias("abundance"))


def pruned_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13, K8: modifications of proteins that a pruned database keeps, the flags as types."""
    key = [F.col("l_suppkey").cast("string").alias("accession"), F.col("l_linenumber").alias("position"), F.col("l_linestatus").alias("modification"), F.col("l_returnflag").alias("mod_type")]
    lines = table(spark, sf_dir, "lineitem")
    return pruned(lines.filter("l_quantity < 20").select(*key), lines.filter("l_quantity > 40").select(*key), {"A": 1, "R": 2, "N": 3})


def exclusive_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines of two flags as the ions of two arms, their places as m/z."""
    sides = table(spark, sf_dir, "lineitem").withColumn("mz", F.col("l_suppkey") % 10).groupBy("l_orderkey").agg(*[F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == k, F.col("mz")))).alias(n) for k, n in (("A", "a"), ("N", "b"))])
    rows = sides.withColumn("sa", F.size("a").cast("double")).withColumn("sb", F.size("b").cast("double"))
    return xl.exclusive_ions(rows, "a", "b", "sa", "sb").select("l_orderkey", F.size("a").alias("n_a"), F.size("b").alias("n_b"), "sa", "sb")


def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: ppm error over retention time, and predicted over observed retention time, matches with sequence variations apart."""
    ppm = F.expr("try_cast(trim(mass_diff_ppm) AS double)")
    variant = F.coalesce(F.trim("identified_sequence_variations") != "", F.lit(False))
    rows = table(spark, sf_dir, "psms").filter("scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time)").select("psm_id", variant.alias("is_variant"), F.col("scan_retention_time").alias("x"), ppm.alias("ppm"), F.when(F.col("base_sequence").rlike("^[A-Z]+$"), search.hydrophobicity(F.col("base_sequence"))).alias("predicted"))
    figure = F.inline(F.array(*[F.struct(F.lit(n).alias("figure"), F.round(c, 5).alias("y")) for n, c in (("ppm_over_time", F.col("ppm")), ("predicted_over_observed", F.col("predicted")))]))
    return rows.select("psm_id", "is_variant", F.round("x", 5).alias("x"), figure).filter("y IS NOT NULL AND NOT isnan(y)")


def ion_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: figures on fragments (ppm by 2, charge, type by count and by intensity) with lines of orders as ions."""
    ppm = (F.col("l_tax") - 0.04) * 1000 * F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.inline(F.array(*[F.struct(F.lit(n).alias("figure"), b.alias("bin"), w.alias("w")) for n, b, w in (("fragment_ppm", F.rint(ppm / 2).cast("bigint").cast("string"), F.lit(1.0)), ("fragment_charge", F.col("l_linenumber").cast("string"), F.lit(1.0)), ("ion_type_count", F.col("l_returnflag"), F.lit(1.0)), ("ion_type_intensity", F.col("l_returnflag"), F.col("l_extendedprice")))])))
    return rows.groupBy("figure", "bin").agg(F.round(F.sum("w"), 1).alias("n"))


def modification_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: modifications of unambiguous matches by file, and hydrophobicity by 2."""
    from massloom.functions.sequences import modifications

    rows = table(spark, sf_dir, "psms")
    mods = rows.filter("NOT contains(full_sequence, '|')").select("full_file_path", F.lit("modification").alias("figure"), F.explode(F.transform(modifications(F.col("full_sequence"), with_fixed=True), lambda m: m["name"])).alias("bin"))
    water = rows.filter("base_sequence RLIKE '^[A-Z]+$'").select("full_file_path", F.lit("hydrophobicity").alias("figure"), F.floor(F.round(search.hydrophobicity(F.col("base_sequence")), 6) / 2).cast("string").alias("bin"))
    return mods.unionByName(water).groupBy("full_file_path", "figure", "bin").agg(F.count(F.lit(1)).alias("n"))


_DOT_M = "try_cast(trim(peptide_monoisotopic_mass) AS DOUBLE)"
#: Trypsin with the proline rule: a bar at each cut, in two passes as cuts may follow one another; then runs of up to three pieces.
_CUT = """parts AS (SELECT accession, base_sequence AS q, string_split(regexp_replace(regexp_replace(base_sequence, '([KR])([^P|])', '\\1|\\2', 'g'), '([KR])([^P|])', '\\1|\\2', 'g'), '|') AS parts FROM {0}),
  runs AS (SELECT accession, parts, i, m FROM (SELECT accession, parts, unnest(generate_series(1, len(parts))) AS i FROM parts), generate_series(0, 2) t(m) WHERE i + m <= len(parts)),
  cut AS (SELECT accession, array_to_string(parts[i:i + m], '') AS peptide, CAST(coalesce(length(array_to_string(parts[1:i - 1], '')), 0) + 1 AS INTEGER) AS start, CAST(m AS INTEGER) AS missed_cleavages FROM runs),
  digested AS (SELECT accession, peptide, start, CAST(start + length(peptide) - 1 AS INTEGER) AS "end", missed_cleavages FROM cut WHERE length(peptide) BETWEEN 7 AND 50)"""
_BOTH = "(SELECT accession, base_sequence FROM proteins UNION ALL SELECT 'DECOY_' || accession, CASE WHEN starts_with(base_sequence, 'M') THEN 'M' || reverse(base_sequence[2:]) ELSE reverse(base_sequence) END FROM proteins)"
_KNOWN = "regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTUVWY]+')"
_ORDERED = "score DESC, CASE WHEN isnan(delta_score) OR delta_score IS NULL THEN 1e308 ELSE -delta_score END, psm_id"
_UNIQUE = f"u AS (SELECT psm_id, full_sequence, score, delta_score, decoy = 'Y' AS d FROM psms WHERE score IS NOT NULL AND NOT isnan(score) AND scan_number IS NOT NULL AND decoy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY full_file_path, scan_number, full_sequence ORDER BY {_ORDERED}) = 1)"


def _q(source: str) -> str:
    """Both rules of q-values over all rows of `source`, taken by their number."""
    return f"""c AS (SELECT *, sum(d::INT) OVER w AS nd, sum((NOT d)::INT) OVER w AS nt, count(*) OVER () AS n FROM {source} WINDOW w AS (ORDER BY {_ORDERED} ROWS UNBOUNDED PRECEDING)),
      q AS (SELECT *, CASE WHEN n < 1000 THEN max(least(nd / greatest(nt, 1), 1.0)) OVER (ORDER BY {_ORDERED} ROWS UNBOUNDED PRECEDING) ELSE min(least((nd + 1) / greatest(nt, 1), 1.0)) OVER (ORDER BY {_ORDERED} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS q_value FROM c)"""


_RNA_X = ", ".join(f"('{a}', {x!r}::DOUBLE)" for a, x in search.NUCLEOTIDES.items())
_COEF = ", ".join(f"('{a}', {x!r}::DOUBLE)" for a, x in search.RETENTION.items())
_HYDRO = f"coef(a, x) AS (VALUES {_COEF}), hq AS (SELECT DISTINCT base_sequence AS q FROM psms WHERE regexp_full_match(base_sequence, '[A-Z]+')), hl AS (SELECT q, unnest(string_split(q, '')) AS a FROM hq), ht AS (SELECT q, sum(coalesce(x, 0)) AS x FROM hl LEFT JOIN coef USING (a) GROUP BY 1), hydro AS (SELECT q, x * CASE WHEN length(q) < 10 THEN 1 - 0.027::DOUBLE * (10 - length(q)) WHEN length(q) > 20 THEN 1 / (1 + 0.015::DOUBLE * (length(q) - 20)) ELSE 1.0 END AS h FROM ht)"
_ISO = iso.ISOTOPES
_COUNTS = {"C": "3 * p_size", "H": "5 * p_size", "N": "p_size % 7", "O": "p_size % 11", "S": "p_size % 3"}

QUERIES = {
    f.__name__: f
    for f in (isotope_patterns, deconvolution, envelope_assignment, spectral_averaging, peptide_isoforms, digest_proline, nonspecific_peptides, nonspecific_search, rna_ladders, crosslink_search, glyco_search, gptmd, dia_search, post_search_matches, post_search_peptides, post_search_proteins, parsimony_proteases, completed_links, calibration, most_probable_sites, posterior_errors, apex_intensities, run_shifts, normalized_intensities, label_turnover, shared_scan_intensity, reporter_masses, protein_rollup, pruned_database, exclusive_ions, scatter_points, ion_histograms, modification_histogram)
}
SQL = {
    "isotope_patterns": "SELECT DISTINCT p_size, round(exp(" + " + ".join(f"{n} * ln({_ISO[e][0]!r}::DOUBLE)" for e, n in _COUNTS.items()) + "), 9) AS none, round(" + " + ".join(f"({n}) * ({_ISO[e][1]!r}::DOUBLE / {_ISO[e][0]!r})" for e, n in _COUNTS.items()) + ", 9) AS ratio FROM part WHERE p_size > 0",
    "deconvolution": f"SELECT psm_id, floor({_DOT_M} * 1e4 + 0.25) / 1e4 AS mass, precursor_charge AS charge FROM psms WHERE {_DOT_M} BETWEEN 500 AND 6000 AND precursor_charge BETWEEN 1 AND 6",
    "envelope_assignment": "WITH r AS (SELECT l_orderkey, l_extendedprice AS a, l_quantity * 1000 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS j FROM lineitem) SELECT x.l_orderkey, count(*) AS n, round(sum(abs(x.a - y.b)), 2) AS distance FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.i = y.j GROUP BY 1",
    "spectral_averaging": "WITH p AS (SELECT event_type, user_id, floor(value * 10) / 10 + 0.05 AS mz, value * (1 + user_id % 7) AS i FROM events WHERE value IS NOT NULL), t AS (SELECT event_type, CAST(floor(mz) AS BIGINT) AS bin, user_id, arg_max(mz, i) AS mz, max(i) AS i FROM p GROUP BY 1, 2, 3), s AS (SELECT *, avg(i) OVER w AS m, coalesce(stddev_samp(i) OVER w, 0) AS sd FROM t WINDOW w AS (PARTITION BY event_type, bin)) SELECT event_type, bin, round(CASE WHEN sum(i) > 0 THEN sum(mz * i) / sum(i) ELSE avg(mz) END, 5) AS mz, round(avg(i), 5) AS intensity, count(*) AS n_kept FROM s WHERE abs(i - m) <= 1.5 * sd + 1e-9 * abs(m) GROUP BY 1, 2",
    "peptide_isoforms": "WITH s AS (SELECT DISTINCT base_sequence AS q FROM psms WHERE regexp_full_match(base_sequence, '[ACDEFGHIKLMNPQRSTVWY]{2,}')), r(a, x) AS (VALUES " + ", ".join(f"('{a}', {x!r}::DOUBLE)" for a, x in RESIDUES.items()) + f"), l AS (SELECT q, unnest(string_split(q, '')) AS a FROM s), m AS (SELECT q, sum(x) + {WATER!r} AS mass, CAST(sum((a = 'M')::INT) AS BIGINT) AS nm, CAST(sum((a = 'S')::INT) AS BIGINT) AS ns FROM l JOIN r USING (a) GROUP BY 1) SELECT q AS peptide, 1 + nm + ns + (nm + ns) * (nm + ns - 1) // 2 AS n_forms, 1 + nm + ns + (nm + ns) * (nm + ns - 1) // 2 AS n_distinct, round(mass + least(ns, 2) * 79.966331::DOUBLE + least(2 - least(ns, 2), nm) * 15.994915::DOUBLE, 4) AS most FROM m",
    "digest_proline": f"WITH {_CUT.format('proteins')} SELECT * FROM digested",
    "nonspecific_peptides": "WITH p AS (SELECT accession, base_sequence AS q, unnest(generate_series(1, length(base_sequence) - 6)) AS s FROM proteins), e AS (SELECT accession, q, s, unnest(generate_series(s + 6, least(s + 19, length(q)))) AS e FROM p), r(a, x) AS (VALUES " + ", ".join(f"('{a}', {x!r}::DOUBLE)" for a, x in RESIDUES.items()) + f"), l AS (SELECT accession, base_sequence AS q, unnest(generate_series(1, length(base_sequence))) AS i FROM proteins), c AS (SELECT accession, i, sum(x) OVER (PARTITION BY accession ORDER BY i) AS c FROM l JOIN r ON a = q[i]), t AS (SELECT e.*, (s = 1 OR (q[s - 1] IN ('K', 'R') AND q[s] <> 'P')) OR (e = length(q) OR (q[e] IN ('K', 'R') AND q[e + 1] <> 'P')) AS is_semi, b.c - coalesce(a.c, 0) + {WATER!r} AS mass FROM e JOIN c b ON b.accession = e.accession AND b.i = e LEFT JOIN c a ON a.accession = e.accession AND a.i = s - 1) SELECT accession, count(*) AS n, CAST(sum(is_semi::INT) AS BIGINT) AS n_semi, round(max(mass), 4) AS most FROM t GROUP BY 1",
    "nonspecific_search": "WITH s AS (SELECT DISTINCT base_sequence AS q FROM psms WHERE regexp_full_match(base_sequence, '[ACDEFGHIKLMNPQRSTVWY]{7,50}')) SELECT count(*) AS n_found FROM s WHERE EXISTS (SELECT 1 FROM proteins WHERE contains(base_sequence, q))",
    "rna_ladders": f"WITH r(a, x) AS (VALUES {_RNA_X}), p AS (SELECT accession, translate(base_sequence, 'ACDEFGHIKLMNPQRSTVWY', 'ACGUACGUACGUACGUACGU') AS q FROM proteins), k AS (SELECT * FROM p WHERE regexp_full_match(q, '[ACGU]{{2,}}')), l AS (SELECT accession, q, unnest(generate_series(1, length(q))) AS i FROM k), c AS (SELECT accession, i, length(q) AS n, sum(x) OVER (PARTITION BY accession ORDER BY i) AS f, sum(x) OVER (PARTITION BY accession ORDER BY i DESC) AS b FROM l JOIN r ON a = q[i]) SELECT accession, round(max(f) + {WATER!r} - 79.96633::DOUBLE, 3) AS mass, 3 * (max(n) - 1) AS n, round(sum(CASE WHEN i < n THEN f + {WATER!r} ELSE 0 END) + sum(CASE WHEN i > 1 THEN 2 * (b + {WATER!r}) - 79.96633::DOUBLE ELSE 0 END), 2) AS total FROM c GROUP BY 1",
    "crosslink_search": f"WITH {_CUT.format('proteins')}, arm AS (SELECT accession, min(peptide) AS p FROM digested WHERE regexp_full_match(peptide, '[ACDEFGHILMNPQRSTVWY]*K.+') GROUP BY 1), s AS (SELECT DISTINCT trim(accession_a) AS a, trim(accession_b) AS b FROM shared_pairs WHERE trim(accession_a) < trim(accession_b)) SELECT count(DISTINCT (least(x.p, y.p), greatest(x.p, y.p))) AS n_found FROM s JOIN arm x ON x.accession = a JOIN arm y ON y.accession = b WHERE x.p <> y.p",
    "glyco_search": f"WITH {_CUT.format(_BOTH)} SELECT count(DISTINCT peptide) AS n_found FROM digested WHERE {_KNOWN} AND regexp_matches(peptide, '[ST]')",
    "gptmd": f"WITH {_CUT.format(_BOTH)} SELECT count(DISTINCT peptide) AS n_found FROM digested WHERE {_KNOWN} AND regexp_full_match(peptide, '[^S]*S[^S]*')",
    "dia_search": f"WITH {_CUT.format('proteins')}, f AS (SELECT accession, min(peptide) AS peptide FROM digested WHERE missed_cleavages = 0 GROUP BY 1) SELECT count(DISTINCT peptide) AS n_found FROM f WHERE {_KNOWN}",
    "post_search_matches": f"WITH {_UNIQUE}, {_q('u')} SELECT psm_id, q_value FROM q",
    "post_search_peptides": f"WITH {_UNIQUE}, b AS (SELECT * FROM u WHERE full_sequence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY full_sequence ORDER BY {_ORDERED}) = 1), {_q('b')} SELECT full_sequence, psm_id, q_value FROM q",
    "completed_links": "WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(accession, '[A-Za-z0-9_-]+')) AS a, full_sequence, base_sequence FROM psms WHERE full_sequence IS NOT NULL AND base_sequence IS NOT NULL) SELECT x.full_sequence, count(DISTINCT y.a) AS n_proteins FROM (SELECT DISTINCT full_sequence, base_sequence FROM l) x JOIN l y ON x.base_sequence = y.base_sequence GROUP BY 1",
    "calibration": f"WITH r AS (SELECT full_file_path, scan_number, arg_min(struct_pack(mz := precursor_mz, z := precursor_charge, m := {_DOT_M}), psm_id) AS r FROM psms WHERE {_DOT_M} > 0 AND NOT isnan({_DOT_M}) AND precursor_charge > 0 AND precursor_mz > 0 AND scan_number IS NOT NULL AND full_file_path IS NOT NULL AND total_ion_current > 0 AND NOT isnan(total_ion_current) GROUP BY 1, 2) SELECT DISTINCT full_file_path, true AS is_kept_or_better FROM r WHERE abs((r.mz - (r.m / r.z + 1.007276466879)) / (r.m / r.z + 1.007276466879)) < 20e-6",
    "most_probable_sites": "WITH g AS (SELECT p_partkey, i, j, exp((p_partkey % (i + 2)) / 4.0 + (p_partkey % (j + 3)) / 4.0) AS w FROM part, generate_series(0, 2) a(i), generate_series(0, 2) b(j) WHERE i <> j), t AS (SELECT *, sum(w) OVER (PARTITION BY p_partkey) AS total, ln(max(w) OVER (PARTITION BY p_partkey)) AS best FROM g) SELECT p_partkey, CAST(i AS INTEGER) AS site, 1 AS glycan, round(max(best), 6) AS best, round(sum(w) / max(total), 6) AS probability FROM t GROUP BY 1, 2 UNION ALL SELECT p_partkey, CAST(j AS INTEGER), 2, round(max(best), 6), round(sum(w) / max(total), 6) FROM t GROUP BY 1, 2",
    "posterior_errors": "SELECT count(*) AS n, count(*) AS n_within FROM psms WHERE score IS NOT NULL AND NOT isnan(score) AND base_sequence <> '' AND decoy IS NOT NULL",
    "apex_intensities": "SELECT a.l_suppkey AS file, a.l_partkey AS sequence, a.l_linenumber AS charge, max(b.l_tax) AS intensity FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND b.l_extendedprice BETWEEN a.l_extendedprice * (1 - 200.0::DOUBLE / 1e6) AND a.l_extendedprice * (1 + 200.0::DOUBLE / 1e6) AND abs(a.l_quantity - b.l_quantity) <= 1 GROUP BY 1, 2, 3",
    "run_shifts": "WITH a AS (SELECT lab_name AS f, full_sequence AS s, avg(scan_retention_time) AS rt FROM psms JOIN spectra_files USING (full_file_path) WHERE scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time) AND full_sequence IS NOT NULL GROUP BY 1, 2) SELECT x.f AS from_file, y.f AS to_file, round(median(y.rt - x.rt), 6) AS shift FROM a x JOIN a y ON x.s = y.s AND x.f <> y.f GROUP BY 1, 2",
    "normalized_intensities": "WITH r AS (SELECT l_partkey, l_returnflag, max(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2), c AS (SELECT l_partkey, avg(ln(x)) AS c FROM r WHERE x > 0 GROUP BY 1 HAVING count(*) > 1), f AS (SELECT l_returnflag, median(ln(x) - c) AS f FROM r JOIN c USING (l_partkey) WHERE x > 0 GROUP BY 1) SELECT l_partkey, l_returnflag, round(x / exp(coalesce(f, 0)), 4) AS intensity FROM r LEFT JOIN f USING (l_returnflag)",
    "label_turnover": "WITH t AS (SELECT l_partkey, CAST(sum(CASE WHEN l_suppkey % 5 IN (0, 4) THEN 2 ELSE 1 END) AS BIGINT) AS n, sum(l_extendedprice * (1 - (l_suppkey % 5) / 4)) AS o, sum(l_extendedprice * (l_suppkey % 5) / 4) AS w FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1) SELECT l_partkey, n AS n_evidence, round(CASE WHEN n >= 2 THEN o ELSE 0 END, 2) AS old, round(CASE WHEN n >= 2 THEN w ELSE 0 END, 2) AS new FROM t",
    "shared_scan_intensity": "WITH r AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS s, l_returnflag, l_quantity FROM lineitem), f AS (SELECT l_suppkey, s FROM r WHERE l_quantity > 0 GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = 3) SELECT l_suppkey, l_returnflag, sum(l_quantity) AS l_quantity FROM r JOIN f USING (l_suppkey, s) GROUP BY 1, 2",
    "reporter_masses": "SELECT l_orderkey, " + ", ".join(f"coalesce(max(CASE WHEN l_quantity > {10 * k - 2.5} AND l_quantity <= {10 * k + 2.5} THEN l_extendedprice END), 0.0) AS channel_{k}" for k in (1, 2, 3, 4)) + " FROM lineitem GROUP BY 1",
    "pruned_database": "WITH k AS (SELECT CAST(l_suppkey AS VARCHAR) AS accession, l_linenumber AS position, l_linestatus AS modification, l_returnflag AS mod_type, bool_or(l_quantity < 20) AS listed, bool_or(l_quantity > 40) AS seen FROM lineitem GROUP BY 1, 2, 3, 4) SELECT accession, position, modification, mod_type FROM k WHERE CASE mod_type WHEN 'A' THEN listed AND seen WHEN 'R' THEN listed WHEN 'N' THEN seen END",
    "exclusive_ions": "WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey % 10) FILTER (WHERE l_returnflag = 'A'), []) AS a, coalesce(list(DISTINCT l_suppkey % 10) FILTER (WHERE l_returnflag = 'N'), []) AS b FROM lineitem GROUP BY 1), t AS (SELECT *, CAST(len(list_intersect(a, b)) AS INTEGER) AS k, len(a) >= len(b) AS wins FROM s) SELECT l_orderkey, CAST(len(a) - CASE WHEN wins THEN 0 ELSE k END AS INTEGER) AS n_a, CAST(len(b) - CASE WHEN wins THEN k ELSE 0 END AS INTEGER) AS n_b, CAST(len(a) - CASE WHEN wins THEN 0 ELSE k END AS DOUBLE) AS sa, CAST(len(b) - CASE WHEN wins THEN k ELSE 0 END AS DOUBLE) AS sb FROM t",
    "scatter_points": f"WITH {_HYDRO}, r AS (SELECT psm_id, coalesce(trim(identified_sequence_variations) <> '', false) AS is_variant, round(scan_retention_time, 5) AS x, try_cast(trim(mass_diff_ppm) AS DOUBLE) AS ppm, h FROM psms LEFT JOIN hydro ON q = base_sequence WHERE scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time)) SELECT psm_id, is_variant, x, 'ppm_over_time' AS figure, round(ppm, 5) AS y FROM r WHERE ppm IS NOT NULL AND NOT isnan(ppm) UNION ALL SELECT psm_id, is_variant, x, 'predicted_over_observed', round(h, 5) FROM r WHERE h IS NOT NULL",
    "ion_histograms": "SELECT 'fragment_ppm' AS figure, CAST(CAST(round_even((l_tax - 0.04::DOUBLE) * 1000 * l_linenumber / 2, 0) AS BIGINT) AS VARCHAR) AS bin, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT 'fragment_charge', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 1, 2 UNION ALL SELECT 'ion_type_count', l_returnflag, count(*) FROM lineitem GROUP BY 1, 2 UNION ALL SELECT 'ion_type_intensity', l_returnflag, round(sum(l_extendedprice), 1) FROM lineitem GROUP BY 1, 2",
    "modification_histogram": f"WITH {_HYDRO} SELECT full_file_path, 'modification' AS figure, bin, count(*) AS n FROM (SELECT full_file_path, unnest(regexp_extract_all(full_sequence, '\\[([^\\]]*)\\]', 1)) AS bin FROM psms WHERE NOT contains(full_sequence, '|')) GROUP BY 1, 2, 3 UNION ALL SELECT full_file_path, 'hydrophobicity', CAST(CAST(floor(round(h, 6) / 2) AS BIGINT) AS VARCHAR), count(*) FROM psms JOIN hydro ON q = base_sequence GROUP BY 1, 2, 3",
}
