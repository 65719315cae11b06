"""Queries on target-decoy statistics over psms and spectral_matches, named after the operators of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.text import accessions
from massloom.operators import fdr
from massloom.session import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with a score; the others take no part in any order."""
    return table(spark, sf_dir, "psms").filter("score IS NOT NULL AND NOT isnan(score)").withColumn("is_decoy", F.col("decoy") == "Y").filter("is_decoy IS NOT NULL")


def _order() -> list:
    """Score, then delta score, both descending, then id: total."""
    return [-F.col("score"), F.coalesce(-F.when(~F.isnan("delta_score"), F.col("delta_score")), F.lit(1e308)), F.col("psm_id")]


_SCORED = """scored AS (SELECT * EXCLUDE (q_value), decoy = 'Y' AS is_decoy, CASE WHEN isnan(delta_score) OR delta_score IS NULL THEN 1e308 ELSE -delta_score END AS second FROM psms
  WHERE score IS NOT NULL AND NOT isnan(score) AND decoy IS NOT NULL)"""
_COUNTED = f"""{_SCORED}, counted AS (SELECT *, CAST(sum((NOT is_decoy)::INT) OVER w AS BIGINT) AS cumulative_target, CAST(sum(is_decoy::INT) OVER w AS BIGINT) AS cumulative_decoy
  FROM scored WINDOW w AS (ORDER BY score DESC, second, psm_id ROWS UNBOUNDED PRECEDING))"""


def fdr_running_target_decoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = fdr.target_decoy_counts(scored(spark, sf_dir).select("psm_id", "score", "delta_score", "is_decoy"), _order(), F.col("is_decoy"))
    return counted.select("psm_id", "cumulative_target", "cumulative_decoy")


def qvalue_traditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("psm_id", "score", "delta_score", "is_decoy")
    return fdr.with_q(rows, _order(), F.col("is_decoy"), {"q_value": "traditional"}).select("psm_id", "q_value")


def qvalue_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("psm_id", "score", "delta_score", "is_decoy")
    return fdr.with_q(rows, _order(), F.col("is_decoy"), {"q_value": "inverted"}).select("psm_id", "q_value")


def qvalue_by_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-values within each charge, by the rule for its number of rows."""
    rows = scored(spark, sf_dir).select("psm_id", "score", "delta_score", "is_decoy", "precursor_charge")
    return fdr.q_values(rows, _order(), F.col("is_decoy"), ["precursor_charge"]).select("psm_id", "precursor_charge", "cumulative_target", "cumulative_decoy", "q_value")


def pep_qvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).filter("pep IS NOT NULL AND NOT isnan(pep)").select("psm_id", "pep", "is_decoy")
    return fdr.with_q(rows, [F.col("pep"), F.col("psm_id")], F.col("is_decoy"), {"pep_q_value": "pep"}).select("psm_id", "pep_q_value")


def notch_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return fdr.hypothesis_weights(scored(spark, sf_dir), "psm_id", "notch").select("psm_id", F.col("value").alias("notch"), F.round("weight", 6).alias("weight"))


def notch_qvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-values within each notch, ambiguous matches counting in parts; a match keeps 2 while its notches differ."""
    rows = scored(spark, sf_dir).select("psm_id", "score", "delta_score", "is_decoy", "notch")
    weights = fdr.hypothesis_weights(rows, "psm_id", "notch").withColumnRenamed("value", "one_notch")
    hypotheses = rows.join(weights, "psm_id")
    out = fdr.with_q(hypotheses, _order(), F.col("is_decoy"), {"hypothesis_q": "inverted"}, ["one_notch"], F.round(F.col("weight") * 1e6).cast("bigint"), 1e6)
    return out.select("psm_id", F.col("one_notch").alias("notch"), "hypothesis_q", F.when(F.col("weight") < 1, 2.0).otherwise(F.col("hypothesis_q")).alias("q_value_notch"))


def best_per_peptide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a sequence are one group."""
    order = [F.asc_nulls_last("pep"), *[o.asc() for o in _order()]]
    return fdr.first_of_each(scored(spark, sf_dir).select("psm_id", "full_sequence", "pep", "score", "delta_score").filter("NOT isnan(pep) OR pep IS NULL"), ["full_sequence"], order).select("full_sequence", "psm_id")


def psm_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    rows = table(spark, sf_dir, "psms").select("psm_id", "full_sequence", "q_value")
    return fdr.counts_joined(rows, "full_sequence", F.col("q_value") <= 0.01, "n_psms").select("psm_id", "n_psms")


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first match of each file, scan and peptide mass."""
    rows = scored(spark, sf_dir).filter("scan_number IS NOT NULL").select("psm_id", "full_file_path", "scan_number", "peptide_monoisotopic_mass", "score", "delta_score")
    return fdr.first_of_each(rows, ["full_file_path", "scan_number", "peptide_monoisotopic_mass"], [o.asc() for o in _order()]).select("psm_id")


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 by q-value; the notch q-value of the table is the match's own."""
    rows = table(spark, sf_dir, "psms").select("psm_id", "q_value", "decoy", "contaminant", "base_sequence")
    ambiguous = F.col("base_sequence").isNull()
    return fdr.quality_filter(rows, "q_value", "q_value", "q_value", decoys=F.col("decoy") == "Y", contaminants=F.col("contaminant") == "Y", ambiguous=ambiguous).select("psm_id", "filtered_by")


def quality_filter_pep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 and F2 by PEP q-value, with `pep` in its place."""
    rows = table(spark, sf_dir, "psms").select("psm_id", "q_value", "pep", "decoy")
    return fdr.quality_filter(rows.filter("NOT isnan(pep)"), "q_value", "q_value", "pep", 0.01, 0.005, decoys=F.col("decoy") == "Y").select("psm_id", "filtered_by")


def top1_ties_runnerup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 over the match records of a scan."""
    rows = table(spark, sf_dir, "spectral_matches").filter("full_file_path IS NOT NULL AND scan_number IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").select("match_id", "full_file_path", "scan_number", "score")
    out = fdr.best_with_ties(rows, ["full_file_path", "scan_number"], "score", 5.0)
    return out.select("match_id", "runner_up", F.round(F.col("score") - F.col("runner_up"), 6).alias("delta"))


def resolve_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the match records of a scan as hypotheses."""
    rows = table(spark, sf_dir, "spectral_matches").filter("full_file_path IS NOT NULL AND scan_number IS NOT NULL AND full_sequence IS NOT NULL")
    out = fdr.resolved(rows, ["full_file_path", "scan_number"], ["full_sequence", "base_sequence", "accession"], F.coalesce(F.col("accession").startswith("DECOY_"), F.lit(False)))
    return out.select("full_file_path", "scan_number", "full_sequence", "full_sequence_all", "base_sequence", "accession", "is_decoy")


def _proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each accession of the cells."""
    one = scored(spark, sf_dir).select(F.explode(accessions("accession")).alias("accession"), "score")
    return one.groupBy("accession").agg(F.max("score").alias("score")).withColumn("is_decoy", F.col("accession").startswith("DECOY_"))


def protein_qvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return fdr.with_q(_proteins(spark, sf_dir), [-F.col("score"), F.col("accession")], F.col("is_decoy"), {"q_value": "protein"}).select("accession", "q_value")


def picked_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3."""
    return fdr.picked(_proteins(spark, sf_dir), "accession", "score", "is_decoy").select("accession", "q_value", "rescued")


def crosslink_qvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    counted = fdr.target_decoy_counts(scored(spark, sf_dir).select("psm_id", "score", "delta_score", "is_decoy"), _order(), F.col("is_decoy"))
    return fdr.q_plain(counted).select("psm_id", "q_value")


def category_q_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminants as the minor category."""
    rows = table(spark, sf_dir, "psms").filter("score IS NOT NULL AND NOT isnan(score) AND q_value IS NOT NULL AND NOT isnan(q_value)").select("psm_id", "score", "q_value", "contaminant")
    minor, major = rows.filter("contaminant = 'Y'").drop("contaminant"), rows.filter("contaminant = 'N'").drop("contaminant")
    return fdr.lifted(minor, major, "score", "q_value")


def best_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search task with the lowest q of each scan."""
    rows = table(spark, sf_dir, "spectral_matches").filter("full_file_path IS NOT NULL AND scan_number IS NOT NULL AND q_value IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND NOT isnan(q_value)")
    out = fdr.best_category(rows.select("match_id", "full_file_path", "scan_number", "q_value", "score"), ["full_file_path", "scan_number"], "q_value", "score", [F.asc("match_id")])
    return out.select("full_file_path", "scan_number", "match_id")


def fdr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: best match of each file and scan, q-values within each charge, and how many pass 1 %."""
    rows = scored(spark, sf_dir).filter("scan_number IS NOT NULL").select("psm_id", "full_file_path", "scan_number", "score", "delta_score", "is_decoy", "precursor_charge")
    best = fdr.first_of_each(rows, ["full_file_path", "scan_number"], [o.asc() for o in _order()])
    valued = fdr.q_values(best, _order(), F.col("is_decoy"), ["precursor_charge"])
    return valued.groupBy("precursor_charge").agg(F.count(F.lit(1)).alias("n_psms"), F.sum(F.when((F.col("q_value") <= 0.01) & ~F.col("is_decoy"), 1).otherwise(0)).alias("n_passing"))


_PROTEINS = f"""{_SCORED}, one AS (SELECT unnest(list_distinct(regexp_extract_all(accession, '[A-Za-z0-9_-]+'))) AS accession, score FROM scored),
  prot AS (SELECT accession, max(score) AS score, starts_with(accession, 'DECOY_') AS is_decoy FROM one GROUP BY accession)"""


def _protein_q(source: str) -> str:
    return f"""SELECT accession, is_decoy, min(ratio) OVER (ORDER BY score DESC, accession ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q_value FROM (
      SELECT *, sum(is_decoy::INT) OVER w / greatest(sum((NOT is_decoy)::INT) OVER w, 1) AS ratio FROM {source} WINDOW w AS (ORDER BY score DESC, accession ROWS UNBOUNDED PRECEDING))"""


_BY_CHARGE = """counted AS (SELECT *, CAST(sum((NOT is_decoy)::INT) OVER w AS BIGINT) AS cumulative_target, CAST(sum(is_decoy::INT) OVER w AS BIGINT) AS cumulative_decoy,
    count(*) OVER (PARTITION BY precursor_charge) AS n FROM {source} WINDOW w AS (PARTITION BY precursor_charge ORDER BY score DESC, second, psm_id ROWS UNBOUNDED PRECEDING)),
  both_rules AS (SELECT *, max(least(cumulative_decoy / greatest(cumulative_target, 1), 1.0)) OVER (PARTITION BY precursor_charge ORDER BY score DESC, second, psm_id ROWS UNBOUNDED PRECEDING) AS q_few,
    min(least((cumulative_decoy + 1) / greatest(cumulative_target, 1), 1.0)) OVER (PARTITION BY precursor_charge ORDER BY score DESC, second, psm_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q_many FROM counted),
  valued AS (SELECT *, CASE WHEN n < 1000 THEN q_few ELSE q_many END AS q_value FROM both_rules)"""

_GOOD_MATCH = "full_file_path IS NOT NULL AND scan_number IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)"

QUERIES = {f.__name__: f for f in (fdr_summary, fdr_running_target_decoy, qvalue_traditional, qvalue_inverted, qvalue_by_charge, pep_qvalue, notch_weights, notch_qvalue, best_per_peptide, psm_count, dedupe_first, quality_filter, quality_filter_pep, top1_ties_runnerup, resolve_ambiguity, protein_qvalue, picked_fdr, crosslink_qvalue, category_q_lift, best_category)}
SQL = {
    "fdr_summary": f"WITH {_SCORED}, best AS (SELECT * FROM scored WHERE scan_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY full_file_path, scan_number ORDER BY score DESC, second, psm_id) = 1), {_BY_CHARGE.format(source='best')} SELECT precursor_charge, count(*) AS n_psms, CAST(sum((q_value <= 0.01 AND NOT is_decoy)::INT) AS BIGINT) AS n_passing FROM valued GROUP BY ALL",
    "fdr_running_target_decoy": f"WITH {_COUNTED} SELECT psm_id, cumulative_target, cumulative_decoy FROM counted",
    "qvalue_traditional": f"WITH {_COUNTED} SELECT psm_id, max(least(cumulative_decoy / greatest(cumulative_target, 1), 1.0)) OVER (ORDER BY score DESC, second, psm_id ROWS UNBOUNDED PRECEDING) AS q_value FROM counted",
    "qvalue_inverted": f"WITH {_COUNTED} SELECT psm_id, min(least((cumulative_decoy + 1) / greatest(cumulative_target, 1), 1.0)) OVER (ORDER BY score DESC, second, psm_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q_value FROM counted",
    "qvalue_by_charge": f"WITH {_SCORED}, {_BY_CHARGE.format(source='scored')} SELECT psm_id, precursor_charge, cumulative_target, cumulative_decoy, q_value FROM valued",
    "pep_qvalue": f"WITH {_SCORED}, counted AS (SELECT psm_id, pep, sum((NOT is_decoy)::INT) OVER w AS t, sum(is_decoy::INT) OVER w AS d FROM scored WHERE pep IS NOT NULL AND NOT isnan(pep) WINDOW w AS (ORDER BY pep, psm_id ROWS UNBOUNDED PRECEDING)) SELECT psm_id, min(CASE WHEN t = 0 THEN CAST('infinity' AS DOUBLE) ELSE (d + 1) / t END) OVER (ORDER BY pep, psm_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pep_q_value FROM counted",
    "notch_weights": f"WITH {_SCORED}, h AS (SELECT psm_id, trim(unnest(string_split(notch, '|'))) AS notch FROM scored), n AS (SELECT *, count(*) OVER (PARTITION BY psm_id) AS of FROM h WHERE notch <> '') SELECT psm_id, notch, round(count(*) / max(of), 6) AS weight FROM n GROUP BY ALL",
    "notch_qvalue": f"""WITH {_SCORED}, h AS (SELECT psm_id, score, second, is_decoy, trim(unnest(string_split(notch, '|'))) AS notch FROM scored), n AS (SELECT *, count(*) OVER (PARTITION BY psm_id) AS of FROM h WHERE notch <> ''),
        w AS (SELECT psm_id, score, second, is_decoy, notch, count(*) / max(of) AS weight FROM n GROUP BY ALL), c AS (SELECT *, sum(CASE WHEN is_decoy THEN 0 ELSE CAST(round(weight * 1e6) AS BIGINT) END) OVER v / 1e6 AS t, sum(CASE WHEN is_decoy THEN CAST(round(weight * 1e6) AS BIGINT) ELSE 0 END) OVER v / 1e6 AS d FROM w
        WINDOW v AS (PARTITION BY notch ORDER BY score DESC, second, psm_id ROWS UNBOUNDED PRECEDING)), q AS (SELECT *, min(least((d + 1) / greatest(t, 1), 1.0)) OVER (PARTITION BY notch ORDER BY score DESC, second, psm_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hypothesis_q FROM c)
        SELECT psm_id, notch, hypothesis_q, CASE WHEN weight < 1 THEN 2.0 ELSE hypothesis_q END AS q_value_notch FROM q""",
    "best_per_peptide": f"WITH {_SCORED} SELECT full_sequence, psm_id FROM scored WHERE pep IS NULL OR NOT isnan(pep) QUALIFY row_number() OVER (PARTITION BY full_sequence ORDER BY pep NULLS LAST, score DESC, second, psm_id) = 1",
    "psm_count": "SELECT psm_id, coalesce(n, 0) AS n_psms FROM psms LEFT JOIN (SELECT full_sequence AS s, count(*) AS n FROM psms WHERE q_value <= 0.01 AND NOT isnan(q_value) GROUP BY 1) ON s = full_sequence",
    "dedupe_first": f"WITH {_SCORED} SELECT psm_id FROM scored WHERE scan_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY full_file_path, scan_number, peptide_monoisotopic_mass ORDER BY score DESC, second, psm_id) = 1",
    "quality_filter": "SELECT psm_id, 'q' AS filtered_by FROM psms WHERE coalesce(decoy <> 'Y', true) AND coalesce(contaminant <> 'Y', true) AND base_sequence IS NOT NULL AND q_value <= 0.01",
    "quality_filter_pep": "WITH k AS (SELECT * FROM psms WHERE coalesce(decoy <> 'Y', true) AND NOT isnan(pep)), n AS (SELECT count(*) AS n FROM k) SELECT psm_id, CASE WHEN n >= 100 THEN 'pep_q' ELSE 'none' END AS filtered_by FROM k, n WHERE CASE WHEN n >= 100 THEN pep <= 0.005 ELSE q_value <= 1 END",
    "top1_ties_runnerup": f"WITH p AS (SELECT match_id, full_file_path, scan_number, score, round(score, 9) AS r FROM spectral_matches WHERE {_GOOD_MATCH} AND score >= 5), b AS (SELECT *, max(r) OVER (PARTITION BY full_file_path, scan_number) AS best FROM p), u AS (SELECT full_file_path, scan_number, max(r) AS nxt FROM b WHERE r < best GROUP BY ALL) SELECT match_id, coalesce(nxt, 5.0) AS runner_up, round(score - coalesce(nxt, 5.0), 6) AS delta FROM b LEFT JOIN u USING (full_file_path, scan_number) WHERE r = best",
    "resolve_ambiguity": """WITH m AS (SELECT *, coalesce(starts_with(accession, 'DECOY_'), false) AS dec FROM spectral_matches WHERE full_file_path IS NOT NULL AND scan_number IS NOT NULL AND full_sequence IS NOT NULL),
        k AS (SELECT *, bool_and(dec) OVER (PARTITION BY full_file_path, scan_number, full_sequence) AS alld FROM m)
        SELECT full_file_path, scan_number, CASE WHEN count(DISTINCT full_sequence) = 1 THEN min(full_sequence) END AS full_sequence, array_to_string(list_sort(list(DISTINCT full_sequence)), '|') AS full_sequence_all, CASE WHEN count(DISTINCT base_sequence) = 1 THEN min(base_sequence) END AS base_sequence,
        CASE WHEN count(DISTINCT accession) = 1 THEN min(accession) END AS accession, bool_or(dec) AS is_decoy FROM k WHERE NOT dec OR alld GROUP BY full_file_path, scan_number""",
    "protein_qvalue": f"WITH {_PROTEINS} SELECT accession, q_value FROM ({_protein_q('prot')})",
    "picked_fdr": f"""WITH {_PROTEINS}, classic AS ({_protein_q('prot')}), won AS (SELECT * FROM prot QUALIFY row_number() OVER (PARTITION BY regexp_replace(accession, '^DECOY_', '') ORDER BY score DESC, is_decoy, accession) = 1), valued AS ({_protein_q('won')})
        SELECT accession, q_value, false AS rescued FROM valued UNION ALL SELECT accession, q_value, true FROM classic WHERE NOT is_decoy AND accession NOT IN (SELECT accession FROM won)""",
    "crosslink_qvalue": f"WITH {_COUNTED} SELECT psm_id, least(cumulative_decoy / greatest(cumulative_target, 1), 1.0) AS q_value FROM counted",
    "category_q_lift": "WITH r AS (SELECT psm_id, score, q_value, contaminant FROM psms WHERE score IS NOT NULL AND NOT isnan(score) AND q_value IS NOT NULL AND NOT isnan(q_value)), u AS (SELECT *, max(CASE WHEN contaminant = 'N' THEN q_value END) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS above FROM r) SELECT psm_id, score, greatest(q_value, above) AS q_value FROM u WHERE contaminant = 'Y'",
    "best_category": f"SELECT full_file_path, scan_number, match_id FROM spectral_matches WHERE {_GOOD_MATCH} AND q_value IS NOT NULL AND NOT isnan(q_value) QUALIFY row_number() OVER (PARTITION BY full_file_path, scan_number ORDER BY q_value, score DESC, match_id) = 1",
}
