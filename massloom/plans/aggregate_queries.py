"""Queries on windows and aggregations, named after the operators of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massloom.functions.text import accessions
from massloom.operators import aggregates as agg
from massloom.operators import windows as win
from massloom.operators.search import places_of
from massloom.session import table


def second_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    rows = table(spark, sf_dir, "spectral_matches").filter("full_file_path IS NOT NULL AND scan_number IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").select("match_id", "full_file_path", "scan_number", "score")
    return win.second_best(rows, ["full_file_path", "scan_number"], "score", 5.0, F.asc("match_id")).select("match_id", "second_score")


def intensity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peaks of each spectrum by intensity, equal ones by place."""
    peaks = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("peak", "intensity"))
    return win.rank_within(peaks, ["vec_id"], [F.desc("intensity"), F.asc("peak")], "intensity_rank").select("vec_id", "peak", "intensity_rank")


def fragment_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order by price and orders of a part by price, kept up to rank 3 in both."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    ranked = win.rank_within(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], "fragment_rank")
    ranked = win.rank_within(ranked, ["l_partkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "precursor_rank")
    return ranked.filter("fragment_rank <= 3 AND precursor_rank <= 3").select("l_orderkey", "l_linenumber", "fragment_rank", "precursor_rank")


def topn_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return win.top_with_ties(rows, ["user_id"], "value", 3).select("event_id", "user_id")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each shipping day of each supplier's lines; days without a large enough one are gaps."""
    day = F.datediff(F.col("l_shipdate"), F.lit("1990-01-01"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", day.alias("day")).agg(F.max(F.when(F.col("l_quantity") > 47, F.round("l_extendedprice", 2))).alias("value"))
    return rows


def gap_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    return win.gap_imputed(_daily(spark, sf_dir), ["l_returnflag"], "day", "value").select("l_returnflag", "day", F.round("imputed", 4).alias("imputed"))


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.datediff(F.col("l_shipdate"), F.lit("1990-01-01")).alias("day")).agg(F.sum("l_quantity").alias("value"))
    return win.moving_average(rows, ["l_returnflag"], "day", "value", 10).select("l_returnflag", "day", F.round("smoothed", 4).alias("smoothed"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the value of its user's last purchase."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return win.carried_forward(rows, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase").select("event_id", "last_purchase")


def density_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16 over all prices, whatever their order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice")).cast("double").alias("price"))
    return win.density_neighbours(rows, "price", 25.0).select("o_orderkey", "density")


def mass_shift_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I7 with W16 and W17: density peaks of the matches' mass shifts, in dalton."""
    from massloom.plans.join_queries import _observed

    rows = _observed(spark, sf_dir).select("psm_id", (F.col("observed") - F.col("mass")).alias("shift"))
    out = win.density_peaks(rows, "psm_id", "shift", 0.003)
    return out.select(F.round("peak", 6).alias("peak"), "n_members", F.round("mean_value", 6).alias("mean_value"))


def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18."""
    rows = table(spark, sf_dir, "psms").filter("score IS NOT NULL AND NOT isnan(score) AND base_sequence IS NOT NULL").select("base_sequence", (F.coalesce(F.col("decoy") == "Y", F.lit(False))).alias("is_decoy"), "score")
    return win.folds(rows, "base_sequence", "is_decoy", "score")


def group_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    rows = table(spark, sf_dir, "psms").filter("score IS NOT NULL AND NOT isnan(score) AND accession IS NOT NULL")
    out = agg.group_score(rows, "accession", "base_sequence", "score")
    return out.select("accession", F.round("group_score", 4).alias("group_score"), "n_sequences")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where the base sequence of a match stands in the protein of each of its accessions, with the number `n` of matches."""
    proteins = table(spark, sf_dir, "proteins").select("accession", F.col("base_sequence").alias("protein_sequence"))
    rows = table(spark, sf_dir, "psms").filter("decoy = 'N' AND base_sequence <> ''").select(F.explode(accessions("accession")).alias("accession"), "base_sequence", "full_sequence")
    # A match is counted before the join, so a repeated one doesn't carry the protein's sequence again.
    rows = rows.groupBy("accession", "base_sequence", "full_sequence").agg(F.count(F.lit(1)).alias("n")).join(proteins, "accession")
    return places_of(rows, "base_sequence", "protein_sequence")


def coverage_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    spans = _spans(spark, sf_dir).select("accession", "start", "end", F.length("protein_sequence").alias("length")).distinct()
    return agg.coverage(spans, ["accession"], "start", "end", F.col("length")).select("accession", "n_covered", F.round("coverage", 6).alias("coverage"))


def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest stretch of consecutive order days of each customer."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.datediff(F.col("o_orderdate"), F.lit("1990-01-01")).alias("day"))
    return win.longest_run(rows, ["o_orderpriority", "o_orderstatus"], "day")


def mod_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 with X15 and X23: occupancy of each modified residue of the matched proteins, all modifications of a sequence; one before the first residue is at the first."""
    spans = _spans(spark, sf_dir).filter("full_sequence IS NOT NULL AND NOT contains(full_sequence, '|')").select("accession", "start", "end", "full_sequence", "n")
    pattern = F.lit(r"([^\[\]]*)\[([^\]]+)\]")
    between, named = F.regexp_extract_all("full_sequence", pattern, 1), F.regexp_extract_all("full_sequence", pattern, 2)
    residues = lambda i: F.length(F.regexp_replace(F.array_join(F.slice(between, 1, i + 1), ""), "[^A-Z]", ""))
    mods = F.array_distinct(F.transform(named, lambda m, i: F.struct(F.greatest(residues(i), F.lit(1)).alias("residue"), m.alias("modification"))))
    sites = spans.select("accession", "start", "n", F.inline(mods)).withColumn("site", F.col("start") + F.col("residue") - 1)
    out = agg.occupancy(sites.select("accession", "site", "modification", "n"), spans.select("accession", "start", "end", "n"), ["accession"], "site", "start", "end", "n")
    return out.select("accession", "site", "modification", "n_modified", "n_spanning", F.round("occupancy", 6).alias("occupancy"))


def modification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localized modifications of unambiguous matches at 1 %, and the ambiguous ones apart."""
    rows = table(spark, sf_dir, "psms").filter("q_value <= 0.01 AND NOT isnan(q_value) AND full_sequence IS NOT NULL").select("psm_id", "full_sequence")
    mods = rows.select("psm_id", F.contains(F.col("full_sequence"), F.lit("|")).alias("is_ambiguous"), F.explode(F.regexp_extract_all("full_sequence", F.lit(r"\[([^\]]+)\]"), 1)).alias("modification"))
    return mods.groupBy("modification").agg(F.sum(F.when(F.col("is_ambiguous"), 0).otherwise(1)).alias("n_localized"), F.countDistinct(F.when(F.col("is_ambiguous"), F.col("psm_id"))).alias("n_ambiguous"))


def charge_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent charge of good targets of each file, of equal ones the lowest."""
    n = table(spark, sf_dir, "psms").filter("q_value <= 0.01 AND NOT isnan(q_value) AND decoy = 'N'").groupBy("full_file_path", "precursor_charge").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("full_file_path").agg(F.max_by("precursor_charge", F.struct("n", -F.col("precursor_charge"))).alias("charge"))


def variant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each class of variation the rows, once each, and the distinct (accession, variation) sites."""
    cell = F.split(F.regexp_replace("identified_sequence_variations", r"[|,;\s]+", "|"), r"\|")
    rows = table(spark, sf_dir, "psms").select("psm_id", "accession", F.explode(cell).alias("v")).filter("v <> ''")
    kind = F.when(F.col("v").contains("fs*"), "frameshift").when(F.col("v").endswith("*"), "stop_gained").when(F.col("v").endswith("del"), "deletion").when(F.col("v").rlike("ins"), "insertion").when(F.col("v").rlike(r"^[A-Z]\d+[A-Z]$"), "missense").otherwise("other")
    return rows.groupBy(kind.alias("variant_class")).agg(F.countDistinct("psm_id").alias("n_rows"), F.countDistinct("accession", "v").alias("n_sites"))


def median_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median over a file's scans of their mean ppm error."""
    ppm = F.expr("try_cast(trim(mass_diff_ppm) AS double)")
    rows = table(spark, sf_dir, "psms").withColumn("ppm", ppm).filter("ppm IS NOT NULL AND NOT isnan(ppm) AND scan_number IS NOT NULL")
    per_scan = rows.groupBy("full_file_path", "scan_number").agg(F.avg("ppm").alias("ppm"))
    return per_scan.groupBy("full_file_path").agg(F.round(F.median("ppm"), 6).alias("median_ppm"))


def time_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of peaks in 2-minute bins of each file."""
    rows = table(spark, sf_dir, "psms").filter("scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time) AND num_experimental_peaks IS NOT NULL AND NOT isnan(num_experimental_peaks)")
    out = agg.binned_statistics(rows, ["full_file_path"], (2 * F.rint(F.col("scan_retention_time") / 2)).cast("int"), "num_experimental_peaks")
    return out.select("full_file_path", "bin", "n", F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"))


def chimera_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that share file, scan and precursor scan."""
    rows = table(spark, sf_dir, "psms").filter("scan_number IS NOT NULL").select("psm_id", "full_file_path", "scan_number", "precursor_scan_number")
    n = F.count(F.lit(1)).over(Window.partitionBy("full_file_path", "scan_number", "precursor_scan_number"))
    return rows.select("psm_id", n.alias("chimera_count"))


def weighted_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    ppm = F.expr("try_cast(trim(mass_diff_ppm) AS double)")
    rows = table(spark, sf_dir, "psms").withColumn("ppm", ppm).filter("ppm IS NOT NULL AND NOT isnan(ppm) AND total_ion_current > 0 AND NOT isnan(total_ion_current)").withColumn("log_intensity", F.log10("total_ion_current"))
    return agg.weighted_error(rows, ["full_file_path"], "ppm", "log_intensity").select("full_file_path", F.round("mean_error", 6).alias("mean_error"))


def tolerance_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A33."""
    ppm = F.expr("try_cast(trim(mass_diff_ppm) AS double)")
    rows = table(spark, sf_dir, "psms").withColumn("ppm", ppm).filter("ppm IS NOT NULL AND NOT isnan(ppm)")
    out = agg.new_tolerance(rows, ["full_file_path"], "ppm", 3.0)
    return out.select("full_file_path", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"), "tolerance")


def digestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many proteins have how many of the matched peptides."""
    rows = table(spark, sf_dir, "psms").filter("accession IS NOT NULL AND base_sequence IS NOT NULL").groupBy("accession").agg(F.countDistinct("base_sequence").alias("n_peptides"))
    return rows.groupBy("n_peptides").agg(F.count(F.lit(1)).alias("n_proteins"))


def best_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of each sequence and charge."""
    rows = table(spark, sf_dir, "psms").filter("score IS NOT NULL AND NOT isnan(score) AND full_sequence IS NOT NULL")
    return rows.groupBy("full_sequence", "precursor_charge").agg(F.max_by("psm_id", F.struct("score", -F.col("psm_id"))).alias("psm_id"))


def site_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each protein and peptide whether any match is unambiguous, the least q-value, the best level and the best score."""
    rows = table(spark, sf_dir, "psms").filter("accession IS NOT NULL AND base_sequence IS NOT NULL AND q_value IS NOT NULL AND NOT isnan(q_value)")
    return rows.groupBy("accession", "base_sequence").agg(F.bool_or(F.coalesce(F.col("ambiguity_level") == "1", F.lit(False))).alias("is_localized"), F.min("q_value").alias("least_q"), F.min("ambiguity_level").alias("best_level"))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches, their lines as routes, the parts as sites and the flags as modifications."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("route"), (F.col("l_suppkey") % 4).alias("site"), F.col("l_returnflag").alias("modification"), F.floor(1e6 / F.col("l_quantity")).alias("weight"))


def localization_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    return agg.localization_level(_routes(spark, sf_dir), ["l_orderkey"], "site", "modification", "route").groupBy("level").agg(F.countDistinct("l_orderkey").alias("n_orders"), F.sum(F.col("sure").cast("int")).alias("n_sure"))


def site_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    out = agg.site_probability(_routes(spark, sf_dir), ["l_orderkey"], "site", "modification", "weight")
    return out.select("l_orderkey", "site", "modification", (F.floor(F.col("probability") * 1e6 + 0.5) / 1e6).alias("probability"))


def psm_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: fixed-width histograms of each file, one row for each figure and bin."""
    ppm, mass = F.expr("try_cast(trim(mass_diff_ppm) AS double)"), F.expr("try_cast(trim(peptide_monoisotopic_mass) AS double)")
    figures = [("precursor_ppm", ppm, 0.1), ("mass", mass, 100.0), ("mz", F.col("precursor_mz"), 50.0), ("charge", F.col("precursor_charge").cast("double"), 1.0), ("retention_time", F.col("scan_retention_time"), 1.0), ("missed_cleavages", F.expr("try_cast(trim(missed_cleavages) AS double)"), 1.0)]
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("figure"), F.when(~F.isnan(c), F.rint(c / w).cast("bigint")).alias("bin")) for n, c, w in figures]))
    return table(spark, sf_dir, "psms").select("full_file_path", cells).filter("bin IS NOT NULL").groupBy("full_file_path", "figure", "bin").agg(F.count(F.lit(1)).alias("n"))


def viewer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 and F4."""
    from massloom.operators.filters import search_filter, viewer_filter

    rows = viewer_filter(table(spark, sf_dir, "psms").filter("NOT isnan(q_value) OR q_value IS NULL"), "q_value", 0.05, "decoy_contaminant_target", "TC", "ambiguity_level", ("1", "2A"))
    return search_filter(rows, "12", "scan_number", "full_sequence", ("protein_name", "organism_name")).select("psm_id")


def motif_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-glycosylation motifs Nxs and Nxt of the proteins."""
    from massloom.operators.filters import motif_sites

    rows = table(spark, sf_dir, "proteins").select("accession", F.inline(F.array(*[F.struct(F.lit(m).alias("motif"), motif_sites(F.col("base_sequence"), m).alias("sites")) for m in ("Nxs", "Nxt")])))
    return rows.select("accession", "motif", F.explode("sites").alias("site"))


def linker_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """places of a lysine-specific linker in the matched peptides."""
    from massloom.operators.filters import linker_sites

    rows = table(spark, sf_dir, "psms").select("base_sequence").distinct().filter("base_sequence IS NOT NULL")
    return rows.select("base_sequence", F.size(linker_sites(F.col("base_sequence"), "K")).alias("n_sites"))


def peak_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two highest peaks of each window of 16, of a fifth of the base peak at least."""
    from massloom.operators.filters import top_peaks

    peaks = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("mz", "intensity"))
    return top_peaks(peaks, "vec_id", "mz", "intensity", 2, 16.0, 0.2).select("vec_id", "mz")


def precursor_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each scan the precursors more than 10 ppm apart, the highest m/z first seen by id."""
    rows = table(spark, sf_dir, "psms").filter("scan_number IS NOT NULL AND precursor_mz IS NOT NULL AND NOT isnan(precursor_mz)").select("psm_id", "full_file_path", "scan_number", "precursor_charge", "precursor_mz")
    return win.greedy_dedupe(rows, ["full_file_path", "scan_number", "precursor_charge"], "precursor_mz", 10.0, ["psm_id"]).select("psm_id")


def isolation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precursor m/z of all scans, in hundredths, chained into windows wherever a gap of 5 units is exceeded."""
    rows = table(spark, sf_dir, "psms").filter("precursor_mz IS NOT NULL AND NOT isnan(precursor_mz)").select(F.floor(F.col("precursor_mz") * 100).cast("double").alias("centre"))
    return win.chained_windows(rows, "centre", 5.0)


_Q = "q_value <= 0.01 AND NOT isnan(q_value)"
_PPM = "p AS (SELECT *, try_cast(trim(mass_diff_ppm) AS DOUBLE) AS ppm FROM psms)"
_SPANS = "cells AS (SELECT unnest(list_distinct(regexp_extract_all(accession, '[A-Za-z0-9_-]+'))) AS accession, base_sequence, full_sequence FROM psms WHERE decoy = 'N' AND base_sequence <> ''), placed AS (SELECT c.*, r.base_sequence AS protein, unnest(generate_series(1, length(r.base_sequence) - length(c.base_sequence) + 1)) AS s FROM cells c JOIN proteins r ON c.accession = r.accession), spans AS (SELECT accession, base_sequence, full_sequence, length(protein) AS n, s FROM placed WHERE substring(protein, s, length(base_sequence)) = base_sequence)"
_DAY = "date_diff('day', DATE '1990-01-01', CAST({} AS DATE))"

QUERIES = {
    f.__name__: f
    for f in (second_best, intensity_ranks, fragment_ranks, topn_with_ties, gap_impute, moving_average, carry_forward, density_neighbors, mass_shift_peaks, cv_folds, group_score, coverage_fraction, longest_run, mod_occupancy, modification_counts, charge_mode, variant_counts, median_error, time_bins, chimera_count, weighted_error, tolerance_update, digestion_counts, best_spectrum, site_rollup, localization_level, site_probability, psm_histograms, viewer_filter, motif_sites, linker_sites, peak_filter, precursor_dedupe, isolation_windows)
}
SQL = {
    "second_best": "SELECT match_id, second_score FROM (SELECT match_id, coalesce(lead(score) OVER w, 5.0) AS second_score, row_number() OVER w AS rn FROM spectral_matches WHERE full_file_path IS NOT NULL AND scan_number IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) WINDOW w AS (PARTITION BY full_file_path, scan_number ORDER BY score DESC, match_id)) WHERE rn = 1",
    "intensity_ranks": "SELECT vec_id, CAST(k - 1 AS INTEGER) AS peak, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) AS INTEGER) AS intensity_rank FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)",
    "fragment_ranks": "SELECT l_orderkey, l_linenumber, CAST(fragment_rank AS INTEGER) AS fragment_rank, CAST(precursor_rank AS INTEGER) AS precursor_rank FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS fragment_rank, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS precursor_rank FROM lineitem) WHERE fragment_rank <= 3 AND precursor_rank <= 3",
    "topn_with_ties": "SELECT event_id, user_id FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY value DESC) <= 3",
    "gap_impute": f"""WITH d AS (SELECT l_returnflag, {_DAY.format('l_shipdate')} AS day, max(CASE WHEN l_quantity > 47 THEN round(l_extendedprice, 2) END) AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY day) AS pos FROM d),
        s AS (SELECT *, last_value(CASE WHEN v <> 0 THEN pos END IGNORE NULLS) OVER b AS ia, last_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) OVER b AS va, first_value(CASE WHEN v <> 0 THEN pos END IGNORE NULLS) OVER f AS ib, first_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) OVER f AS vb FROM n
          WINDOW b AS (PARTITION BY l_returnflag ORDER BY day ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT l_returnflag, day, round(CASE WHEN ia = pos THEN va ELSE coalesce(va + (vb - va) * ((pos - ia) / (ib - ia)), va, vb) END, 4) AS imputed FROM s""",
    "moving_average": f"SELECT l_returnflag, day, round(avg(v) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 4) AS smoothed FROM (SELECT l_returnflag, {_DAY.format('l_shipdate')} AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "carry_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events",
    "density_neighbors": "SELECT o_orderkey, count(*) OVER (ORDER BY floor(o_totalprice) RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - 1 AS density FROM orders",
    "cv_folds": "WITH g AS (SELECT base_sequence, count(*) AS n, max(score) AS best, bool_or(coalesce(decoy = 'Y', false)) AS d FROM psms WHERE score IS NOT NULL AND NOT isnan(score) AND base_sequence IS NOT NULL GROUP BY 1) SELECT base_sequence, CAST((row_number() OVER (PARTITION BY d ORDER BY n DESC, best DESC, base_sequence) - 1) % 4 AS INTEGER) AS fold FROM g",
    "group_score": "SELECT accession, round(sum(b), 4) AS group_score, count(*) AS n_sequences FROM (SELECT accession, base_sequence, max(score) AS b FROM psms WHERE score IS NOT NULL AND NOT isnan(score) AND accession IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "coverage_fraction": f"WITH {_SPANS}, r AS (SELECT DISTINCT accession, n, unnest(generate_series(s, s + length(base_sequence) - 1)) AS x FROM spans) SELECT accession, count(*) AS n_covered, round(count(*) / max(n), 6) AS coverage FROM r GROUP BY 1",
    "longest_run": f"WITH d AS (SELECT DISTINCT o_orderpriority, o_orderstatus, {_DAY.format('o_orderdate')} AS day FROM orders), i AS (SELECT *, day - row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY day) AS isl FROM d) SELECT o_orderpriority, o_orderstatus, max(n) AS longest_run FROM (SELECT o_orderpriority, o_orderstatus, isl, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1, 2",
    "mod_occupancy": f"WITH {_SPANS}, u AS (SELECT *, s + length(base_sequence) - 1 AS e, row_number() OVER () AS id FROM spans WHERE full_sequence IS NOT NULL AND NOT contains(full_sequence, '|')), x AS (SELECT accession, s, id, regexp_extract_all(full_sequence, '([^\\[\\]]*)\\[([^\\]]+)\\]', 1) AS b, regexp_extract_all(full_sequence, '([^\\[\\]]*)\\[([^\\]]+)\\]', 2) AS m FROM u), y AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM x), z AS (SELECT DISTINCT id, accession, s + greatest(length(regexp_replace(array_to_string(b[1:i], ''), '[^A-Z]', '', 'g')), 1) - 1 AS site, m[i] AS modification FROM y), m AS (SELECT accession, site, modification, count(*) AS n_modified FROM z GROUP BY 1, 2, 3), t AS (SELECT k.accession, site, count(*) AS n_spanning FROM (SELECT DISTINCT accession, site FROM m) k JOIN u ON u.accession = k.accession AND site BETWEEN s AND e GROUP BY ALL) SELECT accession, CAST(site AS INTEGER) AS site, modification, n_modified, n_spanning, round(n_modified / n_spanning, 6) AS occupancy FROM m JOIN t USING (accession, site)",
    "modification_counts": f"WITH m AS (SELECT psm_id, contains(full_sequence, '|') AS amb, unnest(regexp_extract_all(full_sequence, '\\[([^\\]]+)\\]', 1)) AS modification FROM psms WHERE {_Q} AND full_sequence IS NOT NULL) SELECT modification, CAST(sum((NOT amb)::INT) AS BIGINT) AS n_localized, count(DISTINCT CASE WHEN amb THEN psm_id END) AS n_ambiguous FROM m GROUP BY 1",
    "charge_mode": f"SELECT full_file_path, arg_max(precursor_charge, n * 1000 - precursor_charge) AS charge FROM (SELECT full_file_path, precursor_charge, count(*) AS n FROM psms WHERE {_Q} AND decoy = 'N' GROUP BY 1, 2) GROUP BY 1",
    "variant_counts": "WITH v AS (SELECT psm_id, accession, unnest(regexp_split_to_array(identified_sequence_variations, '[|,;\\s]+')) AS v FROM psms) SELECT CASE WHEN contains(v, 'fs*') THEN 'frameshift' WHEN suffix(v, '*') THEN 'stop_gained' WHEN suffix(v, 'del') THEN 'deletion' WHEN contains(v, 'ins') THEN 'insertion' WHEN regexp_full_match(v, '[A-Z][0-9]+[A-Z]') THEN 'missense' ELSE 'other' END AS variant_class, count(DISTINCT psm_id) AS n_rows, count(DISTINCT CASE WHEN accession IS NOT NULL THEN (accession, v) END) AS n_sites FROM v WHERE v <> '' GROUP BY 1",
    "median_error": f"WITH {_PPM}, s AS (SELECT full_file_path, avg(ppm) AS m FROM p WHERE ppm IS NOT NULL AND NOT isnan(ppm) AND scan_number IS NOT NULL GROUP BY full_file_path, scan_number) SELECT full_file_path, round(median(m), 6) AS median_ppm FROM s GROUP BY 1",
    "time_bins": "WITH r AS (SELECT full_file_path, CAST(2 * round_even(scan_retention_time / 2, 0) AS INTEGER) AS bin, num_experimental_peaks AS y FROM psms WHERE scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time) AND num_experimental_peaks IS NOT NULL AND NOT isnan(num_experimental_peaks)), g AS (SELECT full_file_path, stddev_samp(y) AS o FROM r GROUP BY 1), b AS (SELECT full_file_path, bin, count(*) AS n, avg(y) AS m, stddev_samp(y) AS s FROM r GROUP BY 1, 2) SELECT full_file_path, bin, n, round(m, 4) AS mean, round(CASE WHEN s IS NULL OR s < 0.5 OR s > 3 * o THEN o ELSE s END, 4) AS stdev FROM b JOIN g USING (full_file_path)",
    "chimera_count": "SELECT psm_id, count(*) OVER (PARTITION BY full_file_path, scan_number, precursor_scan_number) AS chimera_count FROM psms WHERE scan_number IS NOT NULL",
    "weighted_error": f"WITH {_PPM} SELECT full_file_path, round(sum(ppm * total_ion_current) / sum(total_ion_current), 6) AS mean_error FROM p WHERE ppm IS NOT NULL AND NOT isnan(ppm) AND total_ion_current > 0 AND NOT isnan(total_ion_current) GROUP BY 1",
    "tolerance_update": f"WITH {_PPM} SELECT full_file_path, round(quantile_cont(ppm, 0.5), 6) AS median, round(quantile_cont(ppm, 0.75) - quantile_cont(ppm, 0.25), 6) AS iqr, round(3 * (quantile_cont(ppm, 0.75) - quantile_cont(ppm, 0.25)) + abs(quantile_cont(ppm, 0.5)), 1) AS tolerance FROM p WHERE ppm IS NOT NULL AND NOT isnan(ppm) GROUP BY 1",
    "digestion_counts": "SELECT n_peptides, count(*) AS n_proteins FROM (SELECT accession, count(DISTINCT base_sequence) AS n_peptides FROM psms WHERE accession IS NOT NULL AND base_sequence IS NOT NULL GROUP BY 1) GROUP BY 1",
    "best_spectrum": "SELECT full_sequence, precursor_charge, psm_id FROM psms WHERE score IS NOT NULL AND NOT isnan(score) AND full_sequence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY full_sequence, precursor_charge ORDER BY score DESC, psm_id) = 1",
    "site_rollup": "SELECT accession, base_sequence, bool_or(coalesce(ambiguity_level = '1', false)) AS is_localized, min(q_value) AS least_q, min(ambiguity_level) AS best_level FROM psms WHERE accession IS NOT NULL AND base_sequence IS NOT NULL AND q_value IS NOT NULL AND NOT isnan(q_value) GROUP BY 1, 2",
    "localization_level": "WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS site, l_returnflag AS m FROM lineitem), t AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM r GROUP BY 1), p AS (SELECT l_orderkey, site, m, count(DISTINCT l_linenumber) = any_value(n) AS sure FROM r JOIN t USING (l_orderkey) GROUP BY 1, 2, 3), l AS (SELECT l_orderkey, CASE WHEN bool_and(sure) THEN 1 WHEN bool_or(sure) THEN 2 ELSE 3 END AS level FROM p GROUP BY 1) SELECT level, count(DISTINCT l_orderkey) AS n_orders, CAST(sum(sure::INT) AS BIGINT) AS n_sure FROM p JOIN l USING (l_orderkey) GROUP BY 1",
    "site_probability": "WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS site, l_returnflag AS modification, CAST(floor(1e6::DOUBLE / l_quantity) AS BIGINT) AS w FROM lineitem), t AS (SELECT l_orderkey, sum(w) AS total FROM (SELECT l_orderkey, l_linenumber, max(w) AS w FROM r GROUP BY 1, 2) GROUP BY 1) SELECT l_orderkey, site, modification, floor(sum(w) / any_value(total) * 1e6 + 0.5) / 1e6 AS probability FROM r JOIN t USING (l_orderkey) GROUP BY 1, 2, 3",
    "psm_histograms": " UNION ALL ".join(f"SELECT full_file_path, '{n}' AS figure, CAST(round_even(v / {w}::DOUBLE, 0) AS BIGINT) AS bin, count(*) AS n FROM (SELECT full_file_path, {c} AS v FROM psms) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2, 3" for n, c, w in (("precursor_ppm", "try_cast(trim(mass_diff_ppm) AS DOUBLE)", 0.1), ("mass", "try_cast(trim(peptide_monoisotopic_mass) AS DOUBLE)", 100.0), ("mz", "precursor_mz", 50.0), ("charge", "CAST(precursor_charge AS DOUBLE)", 1.0), ("retention_time", "scan_retention_time", 1.0), ("missed_cleavages", "try_cast(trim(missed_cleavages) AS DOUBLE)", 1.0))),
    "viewer_filter": "SELECT psm_id FROM psms WHERE (q_value IS NULL OR (NOT isnan(q_value) AND q_value <= 0.05)) AND decoy_contaminant_target IN ('T', 'C') AND ambiguity_level IN ('1', '2A') AND (starts_with(CAST(scan_number AS VARCHAR), '12') OR contains(upper(full_sequence), '12') OR contains(protein_name, '12') OR contains(organism_name, '12'))",
    "motif_sites": "SELECT accession, m AS motif, CAST(i AS INTEGER) AS site FROM (SELECT accession, base_sequence, unnest(generate_series(1, length(base_sequence) - 2)) AS i FROM proteins), (VALUES ('Nxs', 'S'), ('Nxt', 'T')) t(m, z) WHERE substring(base_sequence, i, 1) = 'N' AND substring(base_sequence, i + 2, 1) = z",
    "linker_sites": "SELECT base_sequence, CAST(length(b) - length(replace(b, 'K', '')) AS INTEGER) AS n_sites FROM (SELECT DISTINCT base_sequence, left(base_sequence, greatest(length(base_sequence) - 1, 0)) AS b FROM psms WHERE base_sequence IS NOT NULL)",
    "peak_filter": "WITH p AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS mz FROM embeddings), b AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS base FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, mz // 16 ORDER BY x DESC, mz) AS rn FROM b WHERE CAST(x AS DOUBLE) >= CAST(base AS DOUBLE) * 0.2) SELECT vec_id, CAST(mz AS INTEGER) AS mz FROM k WHERE rn <= 2",
    "precursor_dedupe": "WITH l AS (SELECT list({'id': psm_id, 'v': precursor_mz} ORDER BY psm_id) AS l FROM psms WHERE scan_number IS NOT NULL AND precursor_mz IS NOT NULL AND NOT isnan(precursor_mz) GROUP BY full_file_path, scan_number, precursor_charge), k AS (SELECT unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda k: abs(b[1].v - k.v) <= k.v * 10.0::DOUBLE / 1e6)) = 0 THEN list_concat(a, b) ELSE a END)) AS x FROM l) SELECT x.id AS psm_id FROM k",
    "isolation_windows": "WITH d AS (SELECT floor(precursor_mz * 100) AS v, count(*) AS n FROM psms WHERE precursor_mz IS NOT NULL AND NOT isnan(precursor_mz) GROUP BY 1), s AS (SELECT *, CASE WHEN v - lag(v) OVER (ORDER BY v) > 5 THEN 1 ELSE 0 END AS st FROM d), w AS (SELECT *, sum(st) OVER (ORDER BY v) AS window_no FROM s) SELECT CAST(window_no AS BIGINT) AS window_no, min(v) AS lowest, max(v) AS highest, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1",
}
