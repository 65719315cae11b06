"""What follows a search, as one plan (Q10): unique matches, q-values, hypotheses, peptides, proteins, groups and abundances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators import fdr
from massloom.operators.aggregates import group_score
from massloom.operators.inference import parsimonious, protein_groups, trimmed
from massloom.session import materialize


def order_of(score: str, second: str, key: str) -> list[Column]:
    """Score, then the second score, both descending, then the key: total."""
    return [-F.col(score), F.coalesce(-F.when(~F.isnan(second), F.col(second)), F.lit(1e308)), F.col(key)]


def matches_of(rows: DataFrame) -> DataFrame:
    """The first match of each file, scan and full sequence, with q-values over all.

    `rows` has psm_id, full_file_path, scan_number, full_sequence, base_sequence, score, delta_score, is_decoy, accessions (array) and intensity. Rows
    without score, scan or decoy mark take no part.
    """
    ok = rows.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("scan_number").isNotNull() & F.col("is_decoy").isNotNull())
    order = order_of("score", "delta_score", "psm_id")
    unique = fdr.first_of_each(ok, ["full_file_path", "scan_number", "full_sequence"], [o.asc() for o in order])
    return fdr.q_values(unique, order, F.col("is_decoy")).drop("cumulative_target", "cumulative_decoy")


def peptides_of(matches: DataFrame) -> DataFrame:
    """The best match of each full sequence with q-values over peptides; matches without one take no part here."""
    order = order_of("score", "delta_score", "psm_id")
    best = fdr.first_of_each(matches.filter(F.col("full_sequence").isNotNull()).drop("q_value"), ["full_sequence"], [o.asc() for o in order])
    return fdr.q_values(best, order, F.col("is_decoy")).drop("cumulative_target", "cumulative_decoy")


def proteins_of(matches: DataFrame, limit: float = 0.01) -> dict[str, DataFrame]:
    """From matches with q at most `limit`: `kept` proteins by parsimony, their `groups`, `scores` with picked q-values, and `links` after trimming."""
    good = materialize(matches.filter((F.col("q_value") <= limit) & (F.length("base_sequence") > 0)).select("psm_id", "base_sequence", "score", "intensity", F.explode("accessions").alias("accession")), "good")
    kept = materialize(parsimonious(good, "accession", "base_sequence"), "kept")
    links = trimmed(good, "psm_id", "accession", kept)
    mine = good.join(kept.select("accession"), "accession", "left_semi")
    scores = group_score(mine, "accession", "base_sequence", "score").withColumn("is_decoy", F.col("accession").startswith("DECOY_"))
    picked = fdr.picked(scores, "accession", "group_score", "is_decoy")
    return {"kept": kept, "groups": protein_groups(mine, kept, "accession", "base_sequence"), "scores": picked, "links": links}


def abundances(matches: DataFrame, kept: DataFrame, limit: float = 0.01) -> DataFrame:
    """(accession, full_file_path, intensity): the summed intensity of the peptides that only this protein of those kept has, the highest match of each peptide counting."""
    good = matches.filter((F.col("q_value") <= limit) & ~F.col("is_decoy") & (F.length("base_sequence") > 0) & F.col("intensity").isNotNull() & ~F.isnan("intensity"))
    one = good.select("full_file_path", "base_sequence", "intensity", F.explode("accessions").alias("accession")).join(kept.select("accession"), "accession", "left_semi")
    own = one.groupBy("base_sequence").agg(F.min("accession").alias("accession"), F.max("accession").alias("other")).filter("accession = other").select("base_sequence", "accession")
    top = one.groupBy("full_file_path", "base_sequence").agg(F.max("intensity").alias("intensity"))
    return top.join(own, "base_sequence").groupBy("accession", "full_file_path").agg(F.sum("intensity").alias("intensity"))


def post_search(rows: DataFrame, limit: float = 0.01) -> dict[str, DataFrame]:
    """All results of `rows` (see `matches_of`): `matches`, `peptides`, the results of `proteins_of` and `abundances`."""
    matches = materialize(matches_of(rows), "matches")
    proteins = proteins_of(matches, limit)
    return {"matches": matches, "peptides": peptides_of(matches), **proteins, "abundances": abundances(matches, proteins["kept"], limit)}
