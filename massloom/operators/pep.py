"""Posterior error probabilities by boosted trees over folds, new-modification search and calibration."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators.aggregates import weighted_error
from massloom.operators.joins import band_join, listed
from massloom.operators.search import classic_search, localized
from massloom.operators.windows import carried_forward, folds, gap_imputed, moving_average
from massloom.session import materialize


def features(rows: DataFrame, length: Column, counts: Sequence[str], plain: Sequence[str]) -> DataFrame:
    """Counts per residue times ten, other figures as they are, missing ones 0."""
    scaled = {f"f_{c}": F.coalesce(10 * F.col(c) / F.greatest(length, F.lit(1)), F.lit(0.0)) for c in counts}
    same = {f"f_{c}": F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.col(c).cast("double")) for c in plain}
    return rows.withColumns({**scaled, **same})


def posterior_errors(rows: DataFrame, key: str, group: str, decoy: str, score: str, feature_columns: Sequence[str], n_folds: int = 4, trees: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """(`key`, pep): one minus the probability of a target, from trees trained on the other folds (I4).

    Folds keep a `group` (such as a base sequence) together. Probabilities are calibrated by a logistic regression on the margins of the training
    rows. A fold whose training rows lack targets or decoys gives null.
    """
    parts = folds(rows.select(group, decoy, score), group, decoy, score, n_folds)
    data = rows.select(key, group, F.col(decoy).alias("decoy__"), *feature_columns).join(parts, group)
    data = VectorAssembler(inputCols=list(feature_columns), outputCol="features").transform(data).withColumn("label", F.when(F.col("decoy__"), 0.0).otherwise(1.0)).select(key, "fold", "label", "features")
    data = materialize(data, "features")
    out = None
    for k in range(n_folds):
        train, test = data.filter(F.col("fold") != k), data.filter(F.col("fold") == k)
        kinds = train.agg(F.countDistinct("label")).first()[0]
        if kinds < 2:
            found = test.select(key, F.lit(None).cast("double").alias("pep"))
        else:
            trees_model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=10).fit(train)
            margin = lambda df, m=trees_model: m.transform(df).select(key, "label", F.array(vector_to_array("rawPrediction")[1]).alias("m"))
            as_vector = lambda df: VectorAssembler(inputCols=["m1"], outputCol="margin").transform(df.withColumn("m1", F.col("m")[0]))
            platt = LogisticRegression(featuresCol="margin", probabilityCol="p__", rawPredictionCol="r__", predictionCol="q__").fit(as_vector(margin(train)))
            found = platt.transform(as_vector(margin(test))).select(key, (1 - vector_to_array("p__")[1]).alias("pep"))
        out = found if out is None else out.unionByName(found)
    return out


def new_modifications(matches: DataFrame, mods: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(match_id, modification, site): listed modifications whose mass makes up a match's shift, at the residues they can sit on.

    `matches` has match_id, sequence and shift; `mods` has modification, mass and residue (`X` for any).
    """
    wanted = matches.withColumn("lo", F.col("shift") - tolerance).withColumn("hi", F.col("shift") + tolerance)
    pairs = band_join(wanted, mods, "lo", "hi", "mass", 4 * tolerance)
    sites = F.explode(F.sequence(F.lit(1), F.length("sequence")))
    placed = pairs.withColumn("site", sites)
    return placed.filter((F.col("residue") == "X") | (F.substring("sequence", F.col("site"), F.lit(1)) == F.col("residue"))).select("match_id", "modification", "site")


def smoothed_errors(points: DataFrame, keys: Sequence[str], scan: str, error: str, log_intensity: str, each_side: int = 100) -> DataFrame:
    """(`keys`, `scan`, smoothed): each scan's weighted mean relative error, gaps filled, then averaged over its neighbours (Q7: A22, W13, W14)."""
    means = weighted_error(points, [*keys, scan], error, log_intensity)
    filled = gap_imputed(means, keys, scan, "mean_error")
    return moving_average(filled, keys, scan, "imputed", each_side).select(*keys, scan, "smoothed")


def shifted(scans: DataFrame, errors: DataFrame, keys: Sequence[str], scan: str, mz: str) -> DataFrame:
    """m/z corrected by the latest error up to each scan (Q7: W15); what lies before the first error stays."""
    both = scans.join(errors, [*keys, scan], "left")
    known = carried_forward(both, keys, [scan], F.col("smoothed"), "error__")
    return known.withColumn(mz, F.col(mz) / (1 + F.coalesce("error__", F.lit(0.0)))).drop("smoothed", "error__")


def enough_points(psms: int, survey: int, product: int) -> bool:
    """Whether a file can be calibrated: 16 matches, 40 survey and 80 product points at least."""
    return psms >= 16 and survey >= 40 and product >= 80


def gptmd(scans: DataFrame, peptides: DataFrame, mods: DataFrame, cutoff: float = 5.0) -> DataFrame:
    """(peptide, modification, site, n_scans): listed modifications that the spectra ask for, to be added to the database (Q6).

    The search allows each modification's mass as a notch. A match with a shift is placed on the residues where the modification can sit; it counts if
    its best place scores higher than the peptide without it. `mods` has modification, mass and residue, a list of up to MOST_LISTED rows.
    """
    masses = sorted({m for (m,) in listed(mods, "mass")})
    found = classic_search(scans, peptides, cutoff=0.0, notches=(0.0, *masses))
    shifts = F.element_at(F.array(*[F.lit(x) for x in (0.0, *masses)]), F.col("notch") + 1)
    # Written once, since it is read twice; it holds no spectra.
    shifted_ones = materialize(found.filter("notch > 0").select("scan_id", "peptide", shifts.alias("shift"), F.col("score").alias("bare_score")), "shifted")
    placed = localized(scans, shifted_ones.select("scan_id", "peptide", "shift").distinct())
    best = placed.join(shifted_ones, ["scan_id", "peptide"]).filter((F.col("score") > F.col("bare_score")) & (F.col("score") >= cutoff))
    at = best.withColumn("site", F.explode(F.transform(F.split("sites", ","), lambda x: x.cast("int"))))
    fits = at.join(mods.withColumnRenamed("mass", "mass__"), F.round(F.col("shift"), 5) == F.round(F.col("mass__"), 5))
    fits = fits.filter((F.col("residue") == "X") | (F.substring("peptide", F.col("site"), F.lit(1)) == F.col("residue")))
    return fits.groupBy("peptide", "modification", "site").agg(F.countDistinct("scan_id").alias("n_scans"))


def calibrated(scans: DataFrame, acquire: Callable[[DataFrame], DataFrame], keys: Sequence[str], scan: str, mz: str, each_side: int = 100, rounds: int = 3, survey_points: int = 40) -> DataFrame:
    """`scans` with m/z corrected file by file, in up to `rounds` rounds of acquiring points, shifting and acquiring again.

    `acquire` gives (`keys`, `scan`, error, log_intensity) of the matches found in scans, relative errors. A file takes part while it has 16 points and
    `survey_points` at least, and a round's shift is kept for it only if its points don't get fewer and their median error doesn't grow (A34); a file that isn't bettered ends.
    """
    figures = lambda points: points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.abs(F.percentile("error", 0.5)).alias("off"))
    now, points = scans, materialize(acquire(scans), "points")
    for _ in range(rounds):
        before = materialize(figures(points).filter(F.col("n") >= max(16, survey_points)), "figures")
        if before.isEmpty():
            break
        errors = smoothed_errors(points.join(before.select(*keys), list(keys), "left_semi"), keys, scan, "error", "log_intensity", each_side)
        moved = materialize(shifted(now, errors, keys, scan, mz), "shifted")
        after_points = acquire(moved)
        both = before.join(figures(after_points).withColumnsRenamed({"n": "n2", "off": "off2"}), list(keys))
        better = materialize(both.filter("n2 >= n AND off2 < off").select(*keys), "better")
        if better.isEmpty():
            break
        now = materialize(moved.join(better, list(keys), "left_semi").unionByName(now.join(better, list(keys), "left_anti")), "calibrated")
        points = materialize(acquire(now).join(better, list(keys), "left_semi"), "points")
    return now
