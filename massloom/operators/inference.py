"""Protein inference: parsimony, groups, collisions and disambiguation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import materialize


def parsimonious(links: DataFrame, protein: str, peptide: str, protease: str | None = None) -> DataFrame:
    """(`protein`, reason) of the proteins that explain all peptides (I1): `unique`, `greedy` or `indistinguishable`.

    Proteins with a peptide of their own come first. Then the protein with the most unexplained peptides, of equal ones that with the most in
    all, then the first by name, again and again. A round takes at once every protein that no rival sharing an unexplained peptide outranks:
    ranks only fall, so those are just the ones that the loop over single proteins would take. Last come proteins with the
    same peptides as one taken. Null ends are left out, repeated links count once. With `protease` a peptide of two digests is two peptides, so one
    that only one protein gives in a digest is that protein's own, whatever the other digests give.
    """
    if protease is not None:  # a length before the first part keeps the joined names apart
        name = F.coalesce(F.col(protease).cast("string"), F.lit(""))
        links = links.select(protein, F.when(F.col(peptide).isNotNull(), F.concat(F.length(name).cast("string"), F.lit(":"), name, peptide)).alias(peptide))
    all_links = materialize(links.filter(F.col(protein).isNotNull() & F.col(peptide).isNotNull()).select(F.col(protein).alias("protein"), F.col(peptide).alias("peptide")).distinct(), "links")
    totals = all_links.groupBy("protein").agg(F.count(F.lit(1)).alias("total"))
    alone = all_links.groupBy("peptide").agg(F.count(F.lit(1)).alias("n"), F.min("protein").alias("protein")).filter("n = 1")
    taken = [materialize(alone.select("protein", F.lit("unique").alias("reason")).distinct(), "taken")]
    explained = all_links.join(taken[0], "protein", "left_semi").select("peptide").distinct()
    left = materialize(all_links.join(explained, "peptide", "left_anti").join(totals, "protein"), "left")
    while not left.isEmpty():
        counts = left.groupBy("protein").agg(F.count(F.lit(1)).alias("n"))
        ranked = left.join(counts, "protein").withColumn("rank", F.struct((-F.col("n")).alias("n"), (-F.col("total")).alias("t"), F.col("protein").alias("p")))
        best = ranked.groupBy("peptide").agg(F.min("rank").alias("best"))
        wins = ranked.join(best, "peptide").groupBy("protein").agg(F.bool_and(F.col("rank") == F.col("best")).alias("wins"))
        chosen = materialize(wins.filter("wins").select("protein", F.lit("greedy").alias("reason")), "taken")
        taken.append(chosen)
        explained = left.join(chosen, "protein", "left_semi").select("peptide").distinct()
        left = materialize(left.join(explained, "peptide", "left_anti"), "left")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    sets = all_links.groupBy("protein").agg(F.array_sort(F.collect_list("peptide")).alias("peptides"))
    kept = sets.join(out, "protein")
    twins = sets.join(out, "protein", "left_anti").join(kept.select("peptides").distinct(), "peptides", "left_semi")
    result = out.unionByName(twins.select("protein", F.lit("indistinguishable").alias("reason")))
    return result.withColumnRenamed("protein", protein)


def protein_groups(links: DataFrame, kept: DataFrame, protein: str, peptide: str) -> DataFrame:
    """One row for each set of proteins with the same peptides: members joined by bars, numbers of peptides and of unique ones."""
    mine = links.filter(F.col(peptide).isNotNull()).select(protein, peptide).distinct().join(kept.select(protein).distinct(), protein, "left_semi")
    sets = mine.groupBy(protein).agg(F.array_sort(F.collect_list(peptide)).alias("peptides"))
    groups = sets.groupBy("peptides").agg(F.array_join(F.array_sort(F.collect_list(protein)), "|").alias("protein_group"))
    exploded = groups.select("protein_group", F.explode("peptides").alias("peptide"))
    unique = exploded.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("peptide")))
    return unique.groupBy("protein_group").agg(F.count(F.lit(1)).alias("n_peptides"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n_unique"))


def one_per_accession(proteins: DataFrame, accession: str, contaminant: Column, mods: Column, last: Sequence[Column], prefer_contaminants: bool = True) -> DataFrame:
    """One entry of each accession: of a target and a contaminant the preferred kind, then the one with most modifications."""
    kind = F.when(contaminant, 0 if prefer_contaminants else 1).otherwise(1 if prefer_contaminants else 0)
    w = Window.partitionBy(accession).orderBy(kind, F.desc(mods), *last)
    return proteins.withColumn("place__", F.row_number().over(w)).filter("place__ = 1").drop("place__")


def renamed_duplicates(proteins: DataFrame, accession: str, last: Sequence[Column]) -> DataFrame:
    """Later entries of an accession get `_D2`, `_D3` and so on."""
    n = F.row_number().over(Window.partitionBy(accession).orderBy(*last))
    return proteins.withColumn("n__", n).withColumn(accession, F.when(F.col("n__") > 1, F.concat(F.col(accession), F.lit("_D"), F.col("n__").cast("string"))).otherwise(F.col(accession))).drop("n__")


def disambiguated(hypotheses: DataFrame, keys: Sequence[str], value: str, margin: float) -> DataFrame:
    """Hypotheses whose value is at most `margin` above their match's best."""
    best = F.min(value).over(Window.partitionBy(*keys))
    return hypotheses.withColumn("best__", best).filter(F.col(value) - F.col("best__") <= margin).drop("best__")


def enough_ions(hypotheses: DataFrame, keys: Sequence[str], ions: str) -> DataFrame:
    """Hypotheses with at most one ion fewer than the best of their match (I16)."""
    most = F.max(ions).over(Window.partitionBy(*keys))
    return hypotheses.withColumn("most__", most).filter(F.col(ions) + 1 >= F.col("most__")).drop("most__")


def tied_for_best(candidates: DataFrame, keys: Sequence[str], score: str, tolerance: float, most: int, last: Sequence[Column]) -> DataFrame:
    """Up to `most` candidates of a scan that are tied with the best."""
    w = Window.partitionBy(*keys)
    tied = candidates.withColumn("best__", F.max(score).over(w)).filter(F.col("best__") - F.col(score) <= tolerance)
    return tied.withColumn("place__", F.row_number().over(w.orderBy(*last))).filter(F.col("place__") <= most).drop("best__", "place__")


def is_intra(alpha: Column, beta: Column) -> Column:
    """Whether two arms' accessions (arrays) have one in common once decoy prefixes are off."""
    bare = lambda a: F.transform(a, lambda x: F.regexp_replace(x, "^DECOY_", ""))
    return F.arrays_overlap(bare(alpha), bare(beta))


def collapsed_pairs(rows: DataFrame, keys: Sequence[str], alpha: str, beta: str, protein: str) -> DataFrame:
    """Crosslinks of a scan with the same two sequences as one row, their proteins joined."""
    return rows.groupBy(*keys, F.concat_ws("-", alpha, beta).alias("pair")).agg(F.array_join(F.array_sort(F.collect_set(protein)), "|").alias("proteins"), F.count(F.lit(1)).alias("n"))


def completed_links(links: DataFrame, protein: str, sequence: str, base: str) -> DataFrame:
    """`links` with those that a modified form lacks: every protein of a base sequence is one of all its forms (I1, stage 0, where modifications are ignored)."""
    forms = links.filter(F.col(base).isNotNull()).select(sequence, base).distinct()
    owners = links.filter(F.col(base).isNotNull()).select(protein, base).distinct()
    return forms.join(owners, base).select(protein, sequence, base)


def trimmed(matches: DataFrame, key: str, protein: str, kept: DataFrame) -> DataFrame:
    """Matches (`key`, `protein`, one row for each) without the proteins that parsimony left out (I1, stage 5); a match all of whose proteins went keeps none."""
    return matches.join(kept.select(protein).distinct(), protein, "left_semi").select(key, protein).distinct()
