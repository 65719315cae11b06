"""One surviving record of each duplicate group, built from whole bundles of fields.

A bundle is a set of fields that must come from one record. Of each bundle the candidates are its distinct filled values, each
with the most trusted record that has it; the loss of a candidate is the number of more trusted ones. The result has the least total loss
among the choices that keep the given dependencies: a dependency between fields of two bundles holds if the two values occur together in
some record of the group. The search is branch-and-bound over lists of the k best candidates of each bundle, k growing round by round. In
the first round k is 1 and the candidates are partial minima of the JVM whatever the size of the group, so a hot group is never collected.
Outside its lists any choice loses at least k, so a solution that loses less is the best of all; the groups left over are searched
again with a larger k.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions.text import is_blank
from massloom.session import materialize

FIRST_K = 8


class _None(tuple):
    """A bundle left empty: each of its fields is None."""

    def __getitem__(self, _):
        return None


NONE = _None()


def _filled(rows: DataFrame, field: str) -> Column:
    col = F.col(field)
    kind = rows.schema[field].dataType
    if isinstance(kind, T.StringType):
        return ~is_blank(col)
    return col.isNotNull() & ~F.isnan(col) if isinstance(kind, (T.DoubleType, T.FloatType)) else col.isNotNull()


def descending(col: Column) -> Column:
    """A sort key, smallest first, of a number or time with the largest first and null and NaN last."""
    number = col.cast("double")
    missing = number.isNull() | F.isnan(number)
    return F.struct(missing.alias("missing"), F.when(~missing, -number).alias("value"))


def best_choice(candidates: Sequence[Sequence[tuple]], allowed: Iterable[tuple[int, int, int, int, set]]) -> tuple[int, list[int]]:
    """Branch-and-bound: (loss, place of the candidate for each bundle) with the least loss, the earlier bundles' losses deciding ties.

    `candidates[i]` are the values of bundle i in trust order; `allowed` has (bundle, field, bundle, field, pairs): the pairs of values that
    may stand together. A value of None is not filled and goes with anything.
    """
    checks: dict[int, list] = {}
    for a, fa, b, fb, pairs in allowed:
        checks.setdefault(max(a, b), []).append((a, fa, b, fb, pairs))
    best: tuple[int, list[int]] = (1 << 60, [])
    chosen: list[int] = []

    def fits(i: int) -> bool:
        for a, fa, b, fb, pairs in checks.get(i, ()):
            x, y = candidates[a][chosen[a]][fa], candidates[b][chosen[b]][fb]
            if x is not None and y is not None and (x, y) not in pairs:
                return False
        return True

    def branch(i: int, loss: int) -> None:
        nonlocal best
        if i == len(candidates):
            best = (loss, chosen.copy())
            return
        for place in range(len(candidates[i])):
            if loss + place >= best[0]:  # the rest loses 0 at least
                return
            chosen.append(place)
            if fits(i):
                branch(i + 1, loss + place)
            chosen.pop()

    branch(0, 0)
    return best


def survivors(rows: DataFrame, keys: Sequence[str], record: str, trust: Sequence[Column], bundles: dict[str, Sequence[str]], dependencies: Sequence[tuple[str, str]] = (), at_least: int = 2) -> DataFrame:
    """(`keys`, bundle_name, record_id) of each bundle that any record of a group of `at_least` records or more fills.

    `trust` are sort keys, most trusted first; the record's id decides last. A bundle is filled by a record that fills all its fields (not
    null, blank or NaN). `dependencies` are pairs of fields of two bundles. Null keys form groups like other keys; callers drop them where they
    don't. Only the columns used are read. A bundle none of whose candidates goes with the others stays empty and gives no row.
    """
    names = list(bundles)
    whole = [_all([_filled(rows, f) for f in bundles[b]]) for b in names]
    rank = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(trust)], F.col(record).alias("record"))
    values = [F.when(w, F.array(*[F.col(f).cast("string") for f in bundles[b]])).alias(f"b{i}") for i, (b, w) in enumerate(zip(names, whole, strict=True))]
    take = rows.select(F.struct(*keys).alias("group"), rank.alias("rank"), *values)
    best = [F.min(F.when(F.col(f"b{i}").isNotNull(), F.struct("rank", f"b{i}") if dependencies else F.struct("rank"))).alias(f"m{i}") for i in range(len(names))]
    root = take.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *best).filter(F.col("n") >= at_least)
    ids = F.array(*[F.col(f"m{i}.rank.record") for i in range(len(names))])
    place = {f: (i, j) for i, b in enumerate(names) for j, f in enumerate(bundles[b])}
    apart = [(place[x], place[y]) for x, y in dependencies if place[x][0] != place[y][0]]
    first = _first_round(root, take, len(names), apart, ids)
    if not apart:  # nothing can hold a group back, so the first round settles all
        return _as_rows(first.select("group", "ids"), keys, names)
    first = materialize(first, "searched")
    parts, unsettled, k = [first.filter("settled").select("group", "ids")], first.filter("NOT settled").select("group"), FIRST_K
    while not unsettled.isEmpty():
        found = materialize(_searched(take.join(unsettled, "group", "left_semi"), len(names), apart, k), "searched")
        parts.append(found.filter("settled").select("group", "ids"))
        unsettled, k = found.filter("NOT settled").select("group"), 4 * k
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _as_rows(out, keys, names)


def _first_round(root: DataFrame, take: DataFrame, n_bundles: int, apart: Sequence[tuple[tuple[int, int], tuple[int, int]]], ids: Column) -> DataFrame:
    """(group, ids, settled) by the search among the best candidate of each bundle."""
    values = [F.col(f"m{i}.b{i}") if apart else F.col(f"m{i}").isNotNull() for i in range(n_bundles)]
    checked = root.select("group", ids.alias("ids"), *[v.alias(f"b{i}") for i, v in enumerate(values)])
    if apart:
        checked = materialize(checked, "roots")
    for d, ((a, fa), (b, fb)) in enumerate(apart):
        seen = _together(take, (a, fa), (b, fb)).select(F.col("group").alias("g"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.lit(True).alias(f"ok{d}"))
        x, y = F.col(f"b{a}")[fa], F.col(f"b{b}")[fb]
        checked = checked.join(seen, (F.col("group") == F.col("g")) & (x == F.col("gx")) & (y == F.col("gy")), "left").withColumn(f"ok{d}", F.coalesce(f"ok{d}", F.lit(False))).drop("g", "gx", "gy")

    @F.pandas_udf("struct<taken array<boolean>, settled boolean>")
    def search(*columns: pd.Series) -> pd.DataFrame:
        bundles, fits = columns[:n_bundles], columns[n_bundles:]
        rows = []
        for g in range(len(bundles[0])):
            # Without dependencies the values don't matter, only whether there is one.
            options = [[tuple(v)] if apart and v is not None else [(True,)] if not apart and v else [] for v in (b.iat[g] for b in bundles)]
            allowed = []
            for d, ((a, fa), (b, fb)) in enumerate(apart):
                pair = {(options[a][0][fa], options[b][0][fb])} if fits[d].iat[g] and options[a] and options[b] else set()
                allowed.append((a, fa, b, fb, pair))
            loss, chosen = best_choice([o + [NONE] for o in options], allowed)
            rows.append(([c < len(o) for c, o in zip(chosen, options, strict=True)], loss < 1))
        return pd.DataFrame(rows, columns=["taken", "settled"])

    out = checked.withColumn("result", search(*[f"b{i}" for i in range(n_bundles)], *[f"ok{d}" for d in range(len(apart))]))
    taken = F.transform(F.arrays_zip(F.col("ids").alias("id"), F.col("result.taken").alias("taken")), lambda p: F.when(p["taken"], p["id"]))
    return out.select("group", taken.alias("ids"), F.col("result.settled").alias("settled"))


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _as_rows(chosen: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    pairs = F.arrays_zip(F.array(*[F.lit(b) for b in names]).alias("bundle_name"), F.col("ids").alias("record_id"))
    out = chosen.select(*[F.col("group")[k].alias(k) for k in keys], F.explode(pairs).alias("pair"))
    return out.select(*keys, F.col("pair")["bundle_name"].alias("bundle_name"), F.col("pair")["record_id"].alias("record_id")).filter("record_id IS NOT NULL")


def _together(take: DataFrame, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """The distinct (group, x, y) of values of two bundles' fields that stand in one record."""
    pairs = take.select("group", F.col(f"b{a[0]}")[a[1]].alias("x"), F.col(f"b{b[0]}")[b[1]].alias("y"))
    return pairs.filter("x IS NOT NULL AND y IS NOT NULL").distinct()


def _searched(take: DataFrame, n_bundles: int, apart: Sequence[tuple[tuple[int, int], tuple[int, int]]], k: int) -> DataFrame:
    """(group, ids, settled) by branch-and-bound among the k best candidates of each bundle."""
    w = Window.partitionBy("group").orderBy("rank")
    lists = []
    for i in range(n_bundles):
        distinct = take.filter(F.col(f"b{i}").isNotNull()).groupBy("group", F.col(f"b{i}").alias("value")).agg(F.min("rank").alias("rank"))
        lists.append(distinct.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1).select("group", F.lit(i).alias("bundle"), "place", "value", F.col("rank.record").alias("record")))
    candidates = lists[0]
    for c in lists[1:]:
        candidates = candidates.unionByName(c)
    candidates = materialize(candidates, "candidates")
    per_group = candidates.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("bundle", "place", "value", "record"))).alias("candidates"))
    for d, (a, b) in enumerate(apart):
        x = candidates.filter(F.col("bundle") == a[0]).select("group", F.col("value")[a[1]].alias("x")).distinct()
        y = candidates.filter(F.col("bundle") == b[0]).select("group", F.col("value")[b[1]].alias("y")).distinct()
        pairs = _together(take, a, b).join(x, ["group", "x"], "left_semi").join(y, ["group", "y"], "left_semi")
        pairs = pairs.groupBy("group").agg(F.collect_list(F.array("x", "y")).alias(f"pairs{d}"))
        per_group = per_group.join(pairs, "group", "left")

    @F.pandas_udf("struct<places array<int>, settled boolean>")
    def search(cands: pd.Series, *pairs: pd.Series) -> pd.DataFrame:
        rows = []
        for g, cs in enumerate(cands):
            options: list[list[tuple]] = [[] for _ in range(n_bundles)]
            for c in cs:
                options[c["bundle"]].append(tuple(c["value"]))
            complete = all(len(o) <= k for o in options)
            # A bundle can stay empty where it loses as many as it has candidates, so some choice always keeps the dependencies.
            within = [o[:k] + [NONE] * (len(o) <= k) for o in options]
            allowed = [(a, fa, b, fb, {tuple(p) for p in ([] if pairs[d][g] is None else pairs[d][g])}) for d, ((a, fa), (b, fb)) in enumerate(apart)]
            loss, chosen = best_choice(within, allowed)
            rows.append((chosen or [-1] * n_bundles, bool(chosen) and (complete or loss < k)))
        return pd.DataFrame(rows, columns=["places", "settled"])

    out = per_group.withColumn("result", search("candidates", *[f"pairs{d}" for d in range(len(apart))]))

    def record(i: int) -> Column:
        place = F.col("result.places")[i]
        mine = F.filter("candidates", lambda c: (c["bundle"] == i) & (c["place"] == place + 1))
        return F.try_element_at(mine, F.lit(1))["record"]

    return out.select("group", F.array(*[record(i) for i in range(n_bundles)]).alias("ids"), F.col("result.settled").alias("settled"))
