"""Queries on scalar functions, predicates and ion aggregates, named after the operators of the survey. Where the tables have no ions, an order is a spectrum and its lines are ions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import masses as m
from massloom.functions import sequences as seq
from massloom.operators import aggregates as agg
from massloom.operators import filters as flt
from massloom.operators import quantification as quant
from massloom.operators import search
from massloom.operators.crosslinks import loop_pairs, site_pairs
from massloom.operators.glycans import glycan_table
from massloom.operators.pep import features
from massloom.session import table


def _masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "psms").withColumn("mass", F.expr("try_cast(trim(peptide_monoisotopic_mass) AS double)")).withColumn("observed", m.to_mass(F.col("precursor_mz"), F.col("precursor_charge")))
    return rows.filter("mass > 0 AND NOT isnan(mass) AND observed > 0 AND NOT isnan(observed)")


def tolerance_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 ppm and 0.02 dalton around the theoretical mass, and whether the observed one is within."""
    lo, hi = m.tolerance_bounds(F.col("mass"), 10.0)
    a, b = m.tolerance_bounds(F.col("mass"), 0.02, ppm=False)
    return _masses(spark, sf_dir).select("psm_id", F.round(lo, 6).alias("lo_ppm"), F.round(hi, 6).alias("hi_ppm"), F.round(a, 6).alias("lo_da"), F.round(b, 6).alias("hi_da"), m.within(F.col("observed"), F.col("mass"), 10.0).alias("is_within"))


def mass_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, X4."""
    return _masses(spark, sf_dir).select("psm_id", m.low_res_bin(F.col("mass")).alias("low_res"), m.mass_bin(F.col("mass")).alias("bin"))


def mass_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 by file: the mean of the rounded errors."""
    rows = _masses(spark, sf_dir).filter("abs(observed - mass) < 10").select("full_file_path", m.mass_error_da(F.col("observed"), F.col("mass")).alias("da"), m.mass_error_ppm(F.col("observed"), F.col("mass")).alias("ppm"))
    return rows.groupBy("full_file_path").agg(F.round(F.avg("da"), 7).alias("mean_da"), F.round(F.avg("ppm"), 5).alias("mean_ppm"), F.count(F.lit(1)).alias("n"))


def capped_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: retention times against their file's mean."""
    rows = table(spark, sf_dir, "psms").filter("scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time)")
    stats = rows.groupBy("full_file_path").agg(F.avg("scan_retention_time").alias("mean"), F.stddev_samp("scan_retention_time").alias("stdev"))
    return rows.join(stats, "full_file_path").select("psm_id", F.round(m.capped_z(F.col("scan_retention_time"), F.col("mean"), F.col("stdev"), 2.0), 6).alias("z"))


def chance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched ions of each peptide length as random hits."""
    tried = 2 * (F.length("base_sequence") - 1)
    rows = table(spark, sf_dir, "psms").select(F.col("matched_ion_counts").alias("matched"), tried.alias("tried")).filter("matched > 0 AND matched <= tried AND tried <= 200").distinct()
    return rows.select("matched", "tried", F.round(F.log10(m.chance_weight(F.col("matched"), F.col("tried"), 0.1)), 6).alias("log_weight"))


def decoy_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each score bin how far its share of decoys is below one half, with the chance of that."""
    rows = table(spark, sf_dir, "psms").filter("score IS NOT NULL AND NOT isnan(score) AND decoy IS NOT NULL").groupBy(F.floor("score").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("decoy") == "Y", 1).otherwise(0)).alias("n_decoy"))
    z = m.decoy_share_z(F.col("n_decoy"), F.col("n"))
    return rows.select("bin", "n", "n_decoy", F.round(z, 6).alias("z"), F.round(m.normal_cdf(z), 6).alias("chance"))


def contained_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each priority's days in a year lies within the span of another status."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01"))
    spans = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 50).alias("k")).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    other = spans.filter("o_orderstatus = 'F'").select("o_orderpriority", "k", F.col("a").alias("a2"), F.col("b").alias("b2"))
    return spans.join(other, ["o_orderpriority", "k"]).select("o_orderpriority", "o_orderstatus", "k", F.round(m.contained_ratio(F.col("a"), F.col("b"), F.col("a2"), F.col("b2")), 6).alias("ratio"))


def sequence_modifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each modification and residue of unambiguous sequences, fixed ones aside."""
    rows = table(spark, sf_dir, "psms").filter("full_sequence IS NOT NULL AND NOT contains(full_sequence, '|')")
    return rows.select(F.inline(seq.modifications(F.col("full_sequence")))).groupBy("residue", "name").agg(F.count(F.lit(1)).alias("n"))


def source_voltages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter lines written from the lines of orders."""
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("FTMS + p NSI sid="), F.col("l_quantity").cast("int").cast("string"), F.lit(".00 Full ms"))).otherwise("FTMS + p NSI Full ms")
    return table(spark, sf_dir, "lineitem").groupBy(m.source_voltage(line).alias("voltage")).agg(F.count(F.lit(1)).alias("n"))


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with heavy lysine and arginine, and how many forms turnover gives them."""
    rows = table(spark, sf_dir, "psms").filter("base_sequence <> ''").select("base_sequence").distinct()
    forms = quant.label_series(rows, "base_sequence", "K", "a").groupBy("base_sequence").agg(F.count(F.lit(1)).alias("n_forms"))
    return forms.select("base_sequence", quant.relabelled(F.col("base_sequence"), "KR", "ab").alias("heavy_sequence"), "n_forms")


def shortened_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts too long for a cell of a table."""
    return table(spark, sf_dir, "documents").groupBy((m.shortened(F.col("text"), 5000) == "Output too long").alias("is_note")).agg(F.count(F.lit(1)).alias("n"))


def safe_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20."""
    return table(spark, sf_dir, "spectra_files").select("file_id", m.safe_file_name(F.col("full_file_path")).alias("safe_name"), m.extension(F.col("full_file_path")).alias("extension"))


def spectral_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's positive part against its label's mean of positive parts."""
    parts = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("at", "x")).select("vec_id", "label", "at", F.greatest(F.col("x").cast("double"), F.lit(0.0)).alias("x"))
    centre = parts.groupBy("label", "at").agg(F.avg("x").alias("y"))
    pairs = parts.join(centre, ["label", "at"]).groupBy("vec_id").agg(F.collect_list(F.struct("x", "y")).alias("pairs"))
    return pairs.select("vec_id", F.round(search.spectral_angle(F.col("pairs"), "x", "y"), 5).alias("angle"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10."""
    rows = table(spark, sf_dir, "psms").filter("base_sequence RLIKE '^[A-Z]+$'").select("base_sequence").distinct()
    return rows.select("base_sequence", F.round(search.hydrophobicity(F.col("base_sequence")), 6).alias("hydrophobicity"))


def fractional_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order the share of its lines of flag A among those of quantity 10 to 30."""
    peaks = F.collect_list(F.struct(F.col("l_quantity").alias("mz"), F.col("l_extendedprice").alias("intensity")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(peaks.alias("peaks"), F.sum(F.when((F.col("l_returnflag") == "A") & F.col("l_quantity").between(10, 30), F.col("l_extendedprice")).otherwise(0.0)).alias("own"))
    return rows.select("l_orderkey", F.round(quant.fractional_intensity(F.col("peaks"), F.lit(10.0), F.lit(30.0), F.col("own")), 6).alias("share"))


def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X22."""
    rows = table(spark, sf_dir, "psms").filter("base_sequence <> ''").select("psm_id", "base_sequence", "matched_ion_counts", "delta_score", "precursor_charge")
    out = features(rows, F.length("base_sequence"), ["matched_ion_counts"], ["delta_score", "precursor_charge"])
    return out.select("psm_id", F.round("f_matched_ion_counts", 6).alias("f_ions"), F.round("f_delta_score", 6).alias("f_delta"), F.col("f_precursor_charge").alias("f_charge"))


def modification_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sites of listed modifications on the proteins, those at which a known one of the same mass sits left out."""
    mods = spark.createDataFrame([("Phospho S", "S", "anywhere", 79.966331), ("Glyco", "Nxs", "anywhere", 203.079373), ("Acetyl", "M", "n_term", 42.010565), ("Amide", "K", "c_term", -0.984016)], "modification string, motif string, location string, mass double")
    rows = table(spark, sf_dir, "proteins").select("accession", "base_sequence")
    known = rows.select("accession", F.lit(10).alias("site"), F.lit(79.9650).alias("mass"))
    return flt.modification_sites(rows, "base_sequence", mods, known).select("accession", "modification", "site")


def _ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order its ions: kind by flag, number by line, and the cleavage they show."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("number"), (F.col("l_partkey") % 12 + 1).cast("int").alias("place"), F.col("l_extendedprice").alias("intensity"))


def ion_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: orders whose ions support residue 6 from both sides, from one, and beside it; and whether their dearest line beats the mean."""
    sides = _ions(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("kind") == "A", F.col("place"))).alias("n"), F.collect_set(F.when(F.col("kind") == "R", F.col("place"))).alias("c"), F.max("intensity").alias("top"), F.avg("intensity").alias("mean"))
    marks = [F.sum(F.when(flt.gptmd_direction(F.col("n"), F.col("c"), F.lit(6), F.lit(12), r), 1).otherwise(0)).alias(r) for r in ("dual", "uni", "flanking")]
    return sides.agg(*marks, F.sum(F.when(flt.improved_score(F.col("top"), 2 * F.col("mean")), 1).otherwise(0)).alias("improved"))


def oxonium_and_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag A as HexNAc ions, R as sialic acid's, the quantities as core ions."""
    total = lambda k: F.sum(F.when(F.col("l_returnflag") == k, F.col("l_discount")).otherwise(0.0))
    cores = F.collect_list(F.when(F.col("l_quantity") > 40, (F.col("l_quantity") + 33).cast("int")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(total("A").alias("hexnac"), total("R").alias("neuac"), cores.alias("cores"))
    ok = flt.oxonium_ok(F.col("hexnac"), F.col("neuac"), F.col("l_orderkey") % 2 == 0)
    return rows.groupBy(F.coalesce(ok, F.lit(False)).alias("is_oxonium"), flt.has_core(F.col("cores")).alias("has_core")).agg(F.count(F.lit(1)).alias("n"))


def precursor_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matches in the span over all notches, and those in a notch itself."""
    acceptor = flt.PRESETS["PlusOrMinusThreeMissedMonoisotopicPeaks"]
    lo, hi = flt.precursor_span(acceptor, F.col("mass"))
    rows = _masses(spark, sf_dir).filter(F.col("observed").between(lo, hi))
    return rows.agg(F.count(F.lit(1)).alias("n_in_span"), F.sum(F.when(flt.accepted(acceptor, F.col("observed"), F.col("mass")).isNotNull(), 1).otherwise(0)).alias("n_accepted"))


def preset_acceptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many matches each named preset takes."""
    rows = _masses(spark, sf_dir)
    return rows.agg(*[F.sum(F.when(flt.accepted(a, F.col("observed"), F.col("mass")).isNotNull(), 1).otherwise(0)).alias(n) for n, a in flt.PRESETS.items()])


def ion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3, with flag N as diagnostic ions."""
    kind = F.when(F.col("kind") == "N", "D").otherwise(F.col("kind"))
    per = _ions(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(kind.alias("kind"), "number", "intensity")).alias("ions"), F.sum("intensity").alias("total"))
    return per.select("l_orderkey", F.round(agg.morpheus_score(F.col("ions"), "intensity", "kind", F.col("total")), 6).alias("morpheus"), F.round(agg.xcorr_score(F.col("ions"), "intensity", "kind"), 2).alias("xcorr"), F.round(agg.all_charge_score(F.col("ions"), "kind", "number", "intensity", F.col("total")), 6).alias("all_charges"))


def complementary_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    sides = _ions(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("kind") == "A", F.col("place"))).alias("n"), F.collect_set(F.when(F.col("kind") == "R", F.col("place"))).alias("c"))
    return sides.select("l_orderkey", agg.complementary_ions(F.col("n"), F.col("c"), F.lit(13)).alias("n_pairs"))


def fragment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues of a peptide of 13 that the ions of each order pin down."""
    sides = _ions(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("kind") == "A", F.col("place"))).alias("n"), F.collect_set(F.when(F.col("kind") == "R", F.col("place"))).alias("c"))
    covered = agg.fragment_coverage(F.col("n"), F.col("c"), F.lit(13))
    return sides.select("l_orderkey", F.array_join(F.transform(covered, lambda x: x.cast("string")), ",").alias("residues"))


def mobility_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the predicted mobility in retention time bins of each file."""
    rows = _masses(spark, sf_dir).filter("precursor_charge > 0 AND scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time)").withColumn("mobility", agg.mobility(F.col("precursor_charge"), F.col("mass")))
    out = agg.binned_statistics(rows, ["full_file_path"], (2 * F.rint(F.col("scan_retention_time") / 2)).cast("int"), "mobility", least_stdev=0.05)
    return out.select("full_file_path", "bin", "n", F.round("mean", 5).alias("mean"), F.round("stdev", 5).alias("stdev"))


def most_intense_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each precursor scan its most intense fragment scan, of equal ones the first by id."""
    rows = table(spark, sf_dir, "psms").filter("precursor_scan_number IS NOT NULL AND total_ion_current IS NOT NULL AND NOT isnan(total_ion_current)")
    return agg.most_intense_child(rows, ["full_file_path", "precursor_scan_number"], "total_ion_current", "psm_id")


def fragment_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every b and y ion of each matched sequence."""
    rows = table(spark, sf_dir, "psms").select("base_sequence").distinct().filter("base_sequence RLIKE '^[ACDEFGHIKLMNPQRSTVWY]{2,}$'")
    return rows.select("base_sequence", F.inline(search.fragments(F.col("base_sequence")))).select("base_sequence", "kind", "number", F.round("mass", 4).alias("mass"))


def internal_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and greatest mass of the internal fragments of each matched sequence."""
    rows = table(spark, sf_dir, "psms").select("base_sequence").distinct().filter("base_sequence RLIKE '^[ACDEFGHIKLMNPQRSTVWY]{2,}$'")
    return rows.select("base_sequence", F.inline(search.internal_fragments(F.col("base_sequence")))).groupBy("base_sequence").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("mass"), 4).alias("most"))


def crosslink_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site pairs of each pair of accessions' peptide with itself, and its loops."""
    rows = table(spark, sf_dir, "psms").filter("base_sequence <> ''").select("base_sequence").distinct().withColumn("beta", F.reverse("base_sequence"))
    pairs = site_pairs(rows, "base_sequence", "beta", "K").groupBy("base_sequence").agg(F.count(F.lit(1)).alias("n_pairs"))
    loops = loop_pairs(rows, "base_sequence", "K").groupBy("base_sequence").agg(F.count(F.lit(1)).alias("n_loops"))
    return pairs.join(loops, "base_sequence", "left").select("base_sequence", "n_pairs", F.coalesce("n_loops", F.lit(0).cast("bigint")).alias("n_loops"))


def glycan_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compositions written from the lines of orders, with their masses."""
    n = lambda c, k: (F.col(c).cast("bigint") % k + 1).cast("string")
    text = F.concat(F.lit("HexNAc("), n("l_partkey", 5), F.lit(")Hex("), n("l_suppkey", 7), F.lit(")Fuc("), n("l_quantity", 3), F.lit(")Ac("), n("l_linenumber", 2), F.lit(")"))
    return glycan_table(table(spark, sf_dir, "lineitem").select(text.alias("line")).distinct(), "line").select("line", "mass_e5")


_M = "masses AS (SELECT * FROM (SELECT *, try_cast(trim(peptide_monoisotopic_mass) AS DOUBLE) AS mass, precursor_mz * abs(precursor_charge) - precursor_charge * 1.007276466879 AS observed FROM psms) WHERE mass > 0 AND NOT isnan(mass) AND observed > 0 AND NOT isnan(observed))"
_SIDES = "sides AS (SELECT l_orderkey, coalesce(list(DISTINCT p ORDER BY p) FILTER (WHERE l_returnflag = 'A'), []) AS n, coalesce(list(DISTINCT p ORDER BY p) FILTER (WHERE l_returnflag = 'R'), []) AS c, max(l_extendedprice) AS top, avg(l_extendedprice) AS mean FROM (SELECT *, CAST(l_partkey % 12 + 1 AS INTEGER) AS p FROM lineitem) GROUP BY 1)"
_STEP = 1.00335483810
_RES = ", ".join(f"('{a}', {x!r}::DOUBLE)" for a, x in m.RESIDUES.items())
_ONE_SEQ = "s AS (SELECT DISTINCT base_sequence AS q FROM psms WHERE regexp_full_match(base_sequence, '[ACDEFGHIKLMNPQRSTVWY]{2,}'))"
_LETTERS = f"r(a, x) AS (VALUES {_RES}), {_ONE_SEQ}, l AS (SELECT q, unnest(generate_series(1, length(q))) AS i FROM s), w AS (SELECT q, i, x FROM l JOIN r ON a = substring(q, i, 1))"
_COEF = ", ".join(f"('{a}', {x!r}::DOUBLE)" for a, x in search.RETENTION.items())


def _dot(shifts: list[float]) -> str:
    return "(" + " OR ".join(f"abs(observed - mass - {s!r}::DOUBLE) <= (mass + {s!r}::DOUBLE) * 5e-6" for s in shifts) + ")"


def _count(condition: str, name: str) -> str:
    return f"CAST(sum(({condition})::INT) AS BIGINT) AS {name}"


QUERIES = {
    f.__name__: f
    for f in (tolerance_bounds, mass_bins, mass_errors, capped_z, chance_weights, decoy_share, contained_overlap, sequence_modifications, source_voltages, relabelled, shortened_cells, safe_file_names, spectral_angles, retention, fractional_intensity, ml_features, modification_sites, ion_support, oxonium_and_core, precursor_span, preset_acceptors, ion_scores, complementary_ions, fragment_coverage, mobility_bins, most_intense_child, fragment_ladders, internal_fragments, crosslink_sites, glycan_masses)
}
SQL = {
    "tolerance_bounds": f"WITH {_M} SELECT psm_id, round(mass * (1 - 10.0::DOUBLE / 1e6), 6) AS lo_ppm, round(mass * (1 + 10.0::DOUBLE / 1e6), 6) AS hi_ppm, round(mass - 0.02::DOUBLE, 6) AS lo_da, round(mass + 0.02::DOUBLE, 6) AS hi_da, observed BETWEEN mass * (1 - 10.0::DOUBLE / 1e6) AND mass * (1 + 10.0::DOUBLE / 1e6) AS is_within FROM masses",
    "mass_bins": f"WITH {_M} SELECT psm_id, CAST(round_even(mass / 1.0005079::DOUBLE, 0) AS BIGINT) AS low_res, CAST(round_even(mass * 1000, 0) AS BIGINT) AS bin FROM masses",
    "mass_errors": f"WITH {_M} SELECT full_file_path, round(avg(round(observed - mass, 5)), 7) AS mean_da, round(avg(round((observed - mass) / mass * 1e6, 2)), 5) AS mean_ppm, count(*) AS n FROM masses WHERE abs(observed - mass) < 10 GROUP BY 1",
    "capped_z": "WITH r AS (SELECT * FROM psms WHERE scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time) AND full_file_path IS NOT NULL), s AS (SELECT full_file_path, avg(scan_retention_time) AS mu, stddev_samp(scan_retention_time) AS sd FROM r GROUP BY 1) SELECT psm_id, round(CASE WHEN sd IS NULL OR sd = 0 THEN 2.0 ELSE least(abs(scan_retention_time - mu) / sd, 2.0) END, 6) AS z FROM r JOIN s USING (full_file_path)",
    "chance_weights": "WITH r AS (SELECT DISTINCT matched_ion_counts AS matched, CAST(2 * (length(base_sequence) - 1) AS INTEGER) AS tried FROM psms) SELECT matched, tried, round(-log10(list_sum(list_transform(generate_series(matched, tried), lambda j: exp(lgamma(tried + 1) - lgamma(j + 1) - lgamma(tried - j + 1) + j * ln(0.1::DOUBLE) + (tried - j) * ln(0.9::DOUBLE))))), 6) AS log_weight FROM r WHERE matched > 0 AND matched <= tried AND tried <= 200",
    "decoy_share": "WITH b AS (SELECT CAST(floor(score) AS BIGINT) AS bin, count(*) AS n, CAST(sum((decoy = 'Y')::INT) AS BIGINT) AS n_decoy FROM psms WHERE score IS NOT NULL AND NOT isnan(score) AND decoy IS NOT NULL GROUP BY 1), z AS (SELECT *, (0.5::DOUBLE - n_decoy / n) / sqrt(0.25::DOUBLE / n) AS z FROM b), t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z), c AS (SELECT *, ((((1.061405429::DOUBLE * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2) / 2 AS tail FROM t) SELECT bin, n, n_decoy, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 6) AS chance FROM c",
    "contained_overlap": "WITH s AS (SELECT o_orderpriority, o_orderstatus, o_custkey % 50 AS k, min(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))) AS a, max(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))) AS b FROM orders GROUP BY 1, 2, 3) SELECT s.o_orderpriority, s.o_orderstatus, s.k, round(CASE WHEN least(s.b, f.b) - greatest(s.a, f.a) <= 0 OR s.b <= s.a THEN 0.0::DOUBLE ELSE (least(s.b, f.b) - greatest(s.a, f.a)) / (s.b - s.a) END, 6) AS ratio FROM s JOIN s f ON f.o_orderstatus = 'F' AND f.o_orderpriority = s.o_orderpriority AND f.k = s.k",
    "sequence_modifications": "WITH x AS (SELECT regexp_extract_all(full_sequence, '([^\\[\\]]*)\\[([^\\]]*)\\]', 1) AS b, regexp_extract_all(full_sequence, '([^\\[\\]]*)\\[([^\\]]*)\\]', 2) AS m FROM psms WHERE full_sequence IS NOT NULL AND NOT contains(full_sequence, '|')), y AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM x) SELECT CAST(length(regexp_replace(array_to_string(b[1:i], ''), '[^A-Z]', '', 'g')) AS INTEGER) AS residue, m[i] AS name, count(*) AS n FROM y WHERE NOT starts_with(m[i], 'Common Fixed:') GROUP BY 1, 2",
    "source_voltages": "SELECT CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) END AS voltage, count(*) AS n FROM lineitem GROUP BY 1",
    "relabelled": "SELECT DISTINCT base_sequence, translate(base_sequence, 'KR', 'ab') AS heavy_sequence, length(base_sequence) - length(replace(base_sequence, 'K', '')) + 1 AS n_forms FROM psms WHERE base_sequence <> ''",
    "shortened_cells": "SELECT CASE WHEN text IS NOT NULL THEN length(text) > 5000 END AS is_note, count(*) AS n FROM documents GROUP BY 1",
    "safe_file_names": r"""SELECT file_id, regexp_replace(full_file_path, '[<>:"/\\|?*\x00-\x1F]', '_', 'g') AS safe_name, nullif(regexp_extract(lower(full_file_path), '(\.[a-z0-9_]+(?:\.gz)?)$', 1), '') AS extension FROM spectra_files""",
    "spectral_angles": "WITH p AS (SELECT vec_id, label, greatest(CAST(unnest(embedding) AS DOUBLE), 0.0) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS y FROM p GROUP BY 1, 2), d AS (SELECT vec_id, sum(sqrt(x) * sqrt(y)) AS dot, sqrt(sum(x)) AS a, sqrt(sum(y)) AS b FROM p JOIN c USING (label, i) GROUP BY 1) SELECT vec_id, round(CASE WHEN a = 0 OR b = 0 THEN -1.0 ELSE 1 - 2 * acos(least(dot / (a * b), 1.0)) / pi() END, 5) AS angle FROM d",
    "retention": f"WITH c(a, x) AS (VALUES {_COEF}), s AS (SELECT DISTINCT base_sequence AS q FROM psms WHERE regexp_full_match(base_sequence, '[A-Z]+')), l AS (SELECT q, unnest(string_split(q, '')) AS a FROM s), t AS (SELECT q, sum(coalesce(x, 0)) AS x FROM l LEFT JOIN c USING (a) GROUP BY 1) SELECT q AS base_sequence, round(x * CASE WHEN length(q) < 10 THEN 1 - 0.027::DOUBLE * (10 - length(q)) WHEN length(q) > 20 THEN 1 / (1 + 0.015::DOUBLE * (length(q) - 20)) ELSE 1.0 END, 6) AS hydrophobicity FROM t",
    "fractional_intensity": "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'A' AND l_quantity BETWEEN 10 AND 30 THEN l_extendedprice ELSE 0 END) / nullif(sum(CASE WHEN l_quantity BETWEEN 10 AND 30 THEN l_extendedprice ELSE 0 END), 0), 6) AS share FROM lineitem GROUP BY 1",
    "ml_features": "SELECT psm_id, round(coalesce(10 * matched_ion_counts / length(base_sequence), 0), 6) AS f_ions, round(CASE WHEN delta_score IS NULL OR isnan(delta_score) THEN 0.0 ELSE delta_score END, 6) AS f_delta, coalesce(CAST(precursor_charge AS DOUBLE), 0.0) AS f_charge FROM psms WHERE base_sequence <> ''",
    "modification_sites": "WITH p AS (SELECT accession, base_sequence AS q, unnest(generate_series(1, length(base_sequence))) AS i FROM proteins) SELECT accession, 'Phospho S' AS modification, i::INT AS site FROM p WHERE q[i] = 'S' AND i <> 10 UNION ALL SELECT accession, 'Glyco', i::INT FROM p WHERE q[i] = 'N' AND q[i + 2] = 'S' AND i + 2 <= length(q) UNION ALL SELECT accession, 'Acetyl', i::INT FROM p WHERE q[i] = 'M' AND i = 1 UNION ALL SELECT accession, 'Amide', i::INT FROM p WHERE q[i] = 'K' AND i = length(q)",
    "ion_support": f"WITH {_SIDES} SELECT {_count('list_max(n) >= 6 AND list_min(c) <= 6', 'dual')}, {_count('coalesce(list_max(n) >= 6, false) OR coalesce(list_min(c) <= 6, false)', 'uni')}, {_count('list_contains(n, 6) AND list_contains(n, 5) OR list_contains(c, 6) AND list_contains(c, 7)', 'flanking')}, {_count('top > 2 * mean', 'improved')} FROM sides",
    "oxonium_and_core": "WITH o AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_discount ELSE 0 END) AS h, sum(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END) AS s, list(DISTINCT CAST(l_quantity + 33 AS INTEGER)) FILTER (WHERE l_quantity > 40) AS c FROM lineitem GROUP BY 1) SELECT CASE WHEN h = 0 THEN l_orderkey % 2 <> 0 ELSE (s / h > 0.02) = (l_orderkey % 2 = 0) END AS is_oxonium, coalesce(len(c) > 2 OR (list_contains(c, 83) AND list_contains(c, 203)), false) AS has_core, count(*) AS n FROM o GROUP BY 1, 2",
    "precursor_span": f"WITH {_M}, k AS (SELECT * FROM masses WHERE observed BETWEEN least(mass + 3 * {_STEP!r} - (mass + 3 * {_STEP!r}) * 5e-6, mass - 3 * {_STEP!r} - (mass - 3 * {_STEP!r}) * 5e-6) AND mass + 3 * {_STEP!r} + (mass + 3 * {_STEP!r}) * 5e-6) SELECT count(*) AS n_in_span, {_count(_dot([i * _STEP for i in range(-3, 4)]), 'n_accepted')} FROM k",
    "preset_acceptors": f"""WITH {_M} SELECT {_count('abs((observed - mass) / mass * 1e6) < 5', '"Exact"')}, {_count(_dot([0.0, 1.0029]), '"OneMissedMonoisotopicPeak"')}, {_count(_dot([0.0, 1.0029, 2.0052]), '"TwoMissedMonoisotopicPeaks"')}, {_count(_dot([0.0, 1.0029, 2.0052, 3.0077]), '"ThreeMissedMonoisotopicPeaks"')}, {_count(_dot([i * _STEP for i in range(-3, 4)]), '"PlusOrMinusThreeMissedMonoisotopicPeaks"')}, {_count('observed - mass >= -187', '"ModOpen"')}, count(*) AS "Open" FROM masses""",
    "ion_scores": "WITH t AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE 1 + l_extendedprice / total END), 6) AS morpheus, round(sum(l_extendedprice), 2) AS xcorr, round(count(DISTINCT l_returnflag || l_linenumber) + sum(l_extendedprice) / any_value(total), 6) AS all_charges FROM lineitem JOIN t USING (l_orderkey) GROUP BY 1",
    "complementary_ions": f"WITH {_SIDES} SELECT l_orderkey, CAST(len(list_intersect(n, list_transform(c, lambda x: 13 - x))) AS INTEGER) AS n_pairs FROM sides",
    "fragment_coverage": f"WITH {_SIDES}, r AS (SELECT *, unnest(generate_series(1, 14)) AS x FROM sides), k AS (SELECT l_orderkey, x FROM r WHERE (x = 13 AND (list_contains(n, 12) OR list_contains(c, 13))) OR (x = 1 AND (list_contains(n, 1) OR list_contains(c, 2))) OR (list_contains(n, x) AND n[1] <> x AND (list_contains(n, x - 1) OR list_contains(c, x))) OR (list_contains(n, x - 1) AND n[1] <> x - 1 AND list_contains(c, x + 1)) OR (list_contains(c, x) AND list_contains(c, x + 1))) SELECT l_orderkey, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x), '') AS residues FROM sides LEFT JOIN k USING (l_orderkey) GROUP BY 1",
    "mobility_bins": f"WITH {_M}, r AS (SELECT full_file_path, CAST(2 * round_even(scan_retention_time / 2, 0) AS INTEGER) AS bin, ln(1 + 0.35::DOUBLE * precursor_charge) / pow(mass, 0.411) * 100 AS y FROM masses WHERE full_file_path IS NOT NULL AND precursor_charge > 0 AND scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time)), g AS (SELECT full_file_path, stddev_samp(y) AS o FROM r GROUP BY 1), b AS (SELECT full_file_path, bin, count(*) AS n, avg(y) AS m, stddev_samp(y) AS s FROM r GROUP BY 1, 2) SELECT full_file_path, bin, n, round(m, 5) AS mean, round(CASE WHEN s IS NULL OR s < 0.05 OR s > 3 * o THEN o ELSE s END, 5) AS stdev FROM b JOIN g USING (full_file_path)",
    "most_intense_child": "SELECT full_file_path, precursor_scan_number, psm_id FROM psms WHERE precursor_scan_number IS NOT NULL AND total_ion_current IS NOT NULL AND NOT isnan(total_ion_current) QUALIFY row_number() OVER (PARTITION BY full_file_path, precursor_scan_number ORDER BY total_ion_current DESC, psm_id) = 1",
    "fragment_ladders": f"WITH {_LETTERS}, f AS (SELECT q, i, length(q) AS n, sum(x) OVER (PARTITION BY q ORDER BY i) AS b, sum(x) OVER (PARTITION BY q ORDER BY i DESC) AS y FROM w) SELECT q AS base_sequence, 'b' AS kind, CAST(i AS INTEGER) AS number, round(b, 4) AS mass FROM f WHERE i < n UNION ALL SELECT q, 'y', CAST(n - i + 1 AS INTEGER), round(y + {m.WATER!r}, 4) FROM f WHERE i > 1",
    "internal_fragments": f"WITH {_LETTERS}, c AS (SELECT q, i, length(q) AS n, sum(x) OVER (PARTITION BY q ORDER BY i) AS s FROM w), f AS (SELECT a.q, b.s - a.s AS mass FROM c a JOIN c b ON a.q = b.q AND b.i - a.i >= 4 AND a.i >= 1 AND b.i <= b.n - 1) SELECT q AS base_sequence, count(*) AS n, round(max(mass), 4) AS most FROM f GROUP BY 1",
    "crosslink_sites": "WITH s AS (SELECT DISTINCT base_sequence AS q FROM psms WHERE base_sequence <> ''), k AS (SELECT q, length(left(q, length(q) - 1)) - length(replace(left(q, length(q) - 1), 'K', '')) AS a, length(q[2:]) - length(replace(q[2:], 'K', '')) AS b FROM s) SELECT q AS base_sequence, a * b AS n_pairs, a * (a - 1) // 2 AS n_loops FROM k WHERE a * b > 0",
    "glycan_masses": "WITH l AS (SELECT DISTINCT l_partkey % 5 + 1 AS a, l_suppkey % 7 + 1 AS b, CAST(l_quantity AS BIGINT) % 3 + 1 AS c, l_linenumber % 2 + 1 AS d FROM lineitem) SELECT 'HexNAc(' || a || ')Hex(' || b || ')Fuc(' || c || ')Ac(' || d || ')' AS line, CAST(a * 20307937 + b * 16205282 + c * 14605791 + d * 4201056 AS BIGINT) AS mass_e5 FROM l",
}
