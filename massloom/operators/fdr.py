"""Target-decoy statistics: cumulative counts and q-values (W1-W9), best rows and ties (A4-A8, F15), quality filters (F1, F2)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.ordered import bare, lay_out, running, running_extreme, running_sums
from massloom.session import materialize

#: Fixed value: with fewer rows than this the running maximum is used, else the running minimum from the end with one decoy added.
FEW_ROWS = 1000
#: Fixed value: the q-value filter replaces the PEP filter where fewer rows than this would be filtered.
FEW_FOR_PEP = 100


def _counts(decoy: Column, weight: Column | None) -> dict[str, Column]:
    one = F.lit(1).cast("bigint") if weight is None else weight
    zero = one * 0
    return {"cumulative_target": F.when(decoy, zero).otherwise(one), "cumulative_decoy": F.when(decoy, one).otherwise(zero)}


def target_decoy_counts(rows: DataFrame, order: Sequence[Column], decoy: Column, groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """`rows` laid out in order, with `cumulative_target` and `cumulative_decoy`.

    `order` are ascending keys that together are unique; `weight` is each row's share of a match (1 if None). Ties can't occur in a total
    order; rows to leave out, such as those without score, are the caller's to filter.
    """
    return running_sums(lay_out(rows, groups, order), groups, _counts(decoy, weight))


def _rules(scale: float) -> dict[str, tuple[Column, bool, bool]]:
    """The ratio of each rule, with whether the least of them and whether from the start counts; counts are in units of one over `scale`."""
    t, d = F.col("cumulative_target") / scale, F.col("cumulative_decoy") / scale
    many = F.greatest(t, F.lit(1.0))
    return {
        # The running maximum of decoys over targets, 1 at most.
        "traditional": (F.least(d / many, F.lit(1.0)), False, True),
        # The least ratio of decoys and one more to targets from here on, 1 at most.
        "inverted": (F.least((d + 1) / many, F.lit(1.0)), True, False),
        # The same not capped, and infinite without targets.
        "pep": (F.when(t == 0, float("inf")).otherwise((d + 1) / t), True, False),
        # The least ratio of decoys to targets from here on, nothing added.
        "protein": (d / many, True, False),
    }


def with_q(rows: DataFrame, order: Sequence[Column], decoy: Column, names: dict[str, str], groups: Sequence[str] = (), weight: Column | None = None, scale: float = 1.0) -> DataFrame:
    """`rows` with cumulative counts and the q-values of `names` (column to rule: traditional, inverted, pep or protein), by one pass over the order.

    `weight` counts in units of one over `scale`.
    """
    rules = _rules(scale)
    return bare(running(lay_out(rows, groups, order), groups, _counts(decoy, weight), {n: rules[r] for n, r in names.items()}))


def q_plain(counted: DataFrame) -> DataFrame:
    """Decoys over targets, 1 at most, not made monotone: the crosslink rule."""
    return counted.withColumn("q_value", F.least(F.col("cumulative_decoy") / F.greatest("cumulative_target", F.lit(1)), F.lit(1.0)))


def q_values(rows: DataFrame, order: Sequence[Column], decoy: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Counts and q-values by the rule for the size of each group."""
    both = with_q(rows, order, decoy, {"q_few": "traditional", "q_many": "inverted"}, groups)
    size = both.groupBy(*groups).agg(F.count(F.lit(1)).alias("group_rows"))
    renamed = size.select(*[F.col(g).alias(f"{g}__g") for g in groups], "group_rows")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__g"))
    # Without groups the sizes are one row.
    sized = both.join(F.broadcast(renamed) if not groups else renamed, same).drop(*[f"{g}__g" for g in groups])
    return sized.withColumn("q_value", F.when(F.col("group_rows") < FEW_ROWS, F.col("q_few")).otherwise(F.col("q_many"))).drop("q_few", "q_many", "group_rows")


def hypothesis_weights(rows: DataFrame, key: str, cell: str, separator: str = "|") -> DataFrame:
    """One row for each different value of an ambiguous cell, with the share of the cell's values that it has."""
    values = F.filter(F.transform(F.split(cell, f"\\{separator}"), lambda v: F.btrim(v)), lambda v: v != "")
    out = rows.select(key, F.explode(values).alias("value"), F.size(values).alias("of")).groupBy(key, "value", "of").agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, "value", (F.col("n") / F.col("of")).alias("weight"))


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in `order`; null keys are a group (A6, F15). A partial top 1 precedes the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place__", F.row_number().over(w)).filter("place__ = 1").drop("place__")


def best_with_ties(rows: DataFrame, keys: Sequence[str], score: str, cutoff: float, digits: int = 9) -> DataFrame:
    """All rows tied for the best score of at least `cutoff`, with `runner_up`: the next score, `cutoff` if there is none (A4)."""
    # Windows over the keys, so `rows`, mostly the scores of a search, are worked out once; rows without a key are no group.
    known = [F.col(k).isNotNull() for k in keys]
    passed = rows.filter(reduce(and_, known, F.col(score) >= cutoff)).withColumn("rounded__", F.round(score, digits))
    w = Window.partitionBy(*keys)
    ranked = passed.withColumn("best__", F.max("rounded__").over(w))
    ranked = ranked.withColumn("runner_up", F.coalesce(F.max(F.when(F.col("rounded__") < F.col("best__"), F.col("rounded__"))).over(w), F.lit(cutoff)))
    return ranked.filter(F.col("rounded__") == F.col("best__")).drop("rounded__", "best__")


def resolved(rows: DataFrame, key: Sequence[str], columns: Sequence[str], decoy: Column) -> DataFrame:
    """The hypotheses of a match as one row: a column's value where all agree, else null, and all values joined by bars (A5).

    A decoy of the same full sequence (`columns[0]`) as a target is dropped first; the match is a decoy if any left is.
    """
    marked = rows.withColumn("decoy__", decoy)
    mixed = marked.groupBy(*key, columns[0]).agg(F.bool_and("decoy__").alias("all_decoys__"))
    kept = marked.join(mixed, [*key, columns[0]]).filter(~F.col("decoy__") | F.col("all_decoys__"))
    aggregates = []
    for c in columns:
        aggregates += [F.when(F.min(c) == F.max(c), F.min(c)).alias(c), F.array_join(F.array_sort(F.collect_set(c)), "|").alias(f"{c}_all")]
    return kept.groupBy(*key).agg(*aggregates, F.bool_or("decoy__").alias("is_decoy"))


def counts_joined(rows: DataFrame, key: str, counted: Column, name: str) -> DataFrame:
    """`rows` with the number of rows of the same key for which `counted` holds (A7); null keys count 0."""
    n = rows.filter(counted).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return rows.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def quality_filter(rows: DataFrame, q: str, q_notch: str, pep_q: str, q_limit: float = 0.01, pep_q_limit: float = 1.0, decoys: Column | None = None, contaminants: Column | None = None, ambiguous: Column | None = None) -> DataFrame:
    """Rows at the quality asked for (F1), with `filtered_by`.

    Rows for which `decoys`, `contaminants` or `ambiguous` holds go first, where given. The PEP filter is used if its limit is the smaller one;
    with fewer than 100 rows left, or if no row has a PEP q-value (F2), no filter is applied but q at most 1.
    """
    kept = rows
    for unwanted in (decoys, contaminants, ambiguous):
        if unwanted is not None:
            kept = kept.filter(~F.coalesce(unwanted, F.lit(False)))
    if pep_q_limit < q_limit:
        n, usable = kept.agg(F.count(F.lit(1)), F.coalesce(F.bool_or(F.col(pep_q) < 2), F.lit(False))).first()
        if n >= FEW_FOR_PEP and usable:
            return kept.filter(F.col(pep_q) <= pep_q_limit).withColumn("filtered_by", F.lit("pep_q"))
        return kept.filter((F.col(q) <= 1) & (F.col(q_notch) <= 1)).withColumn("filtered_by", F.lit("none"))
    return kept.filter((F.col(q) <= q_limit) & (F.col(q_notch) <= q_limit)).withColumn("filtered_by", F.lit("q"))


def lifted(minor: DataFrame, major: DataFrame, score: str, q: str) -> DataFrame:
    """`minor` with q at least that of the last `major` row with a score no lower (W8), by an as-of join on the score.

    A minor row above all major rows keeps its q.
    """
    both = minor.withColumn("from_major__", F.lit(0)).unionByName(major.select(*[F.col(c) if c in (score, q) else F.lit(None).cast(minor.schema[c].dataType).alias(c) for c in minor.columns]).withColumn("from_major__", F.lit(1)))
    laid = lay_out(both, [], [-F.col(score), F.lit(1) - F.col("from_major__"), F.xxhash64(*[c for c in minor.columns])])
    # q-values of the major category rise as scores fall, so the last one is the greatest so far.
    seen = running_extreme(laid, [], "major_q__", F.when(F.col("from_major__") == 1, F.col(q)), least=False, forward=True)
    out = bare(seen.filter("from_major__ = 0"))
    return out.withColumn(q, F.greatest(q, "major_q__")).drop("from_major__", "major_q__")


def best_category(rows: DataFrame, keys: Sequence[str], q: str, score: str, last: Sequence[Column] = ()) -> DataFrame:
    """Of each scan the category with the lowest q, then the highest score."""
    return first_of_each(rows, keys, [F.asc(q), F.desc(score), *last])


def picked(proteins: DataFrame, accession: str, score: str, decoy: str, prefix: str = "DECOY_") -> DataFrame:
    """The better of each target and decoy pair, with its q-value; losing targets come back with the q-value of all proteins."""
    base = materialize(proteins.withColumn("pair__", F.regexp_replace(accession, f"^{prefix}", "")), "proteins")
    order = [-F.col(score), F.col(accession)]
    classic = with_q(base, order, F.col(decoy), {"classic_q__": "protein"}).select(*base.columns, "classic_q__")
    winner = first_of_each(classic, ["pair__"], [F.desc(score), F.asc(decoy), F.asc(accession)])
    scored = with_q(winner, order, F.col(decoy), {"q_value": "protein"}).drop("cumulative_target", "cumulative_decoy")
    losers = classic.filter(~F.col(decoy)).join(winner.select(F.col(accession).alias("won__")), F.col(accession) == F.col("won__"), "left_anti")
    out = scored.withColumn("rescued", F.lit(False)).unionByName(losers.withColumn("q_value", F.col("classic_q__")).withColumn("rescued", F.lit(True)))
    return out.drop("pair__", "classic_q__")
