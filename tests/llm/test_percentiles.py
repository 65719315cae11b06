import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.llm.percentiles import Sketch, day_sketches, merged, percentiles, readable_number


def _true_ranks(values, x):
    return np.searchsorted(values, x, "left") + 1, np.searchsorted(values, x, "right")


@pytest.mark.parametrize("kind", ["random", "sorted", "falling", "ties"])
def test_sketch_keeps_its_bound(kind):
    rng = np.random.default_rng(1)
    n = 60_000
    v = {"random": rng.normal(size=n), "sorted": np.arange(n) * 1.0, "falling": -np.arange(n) * 1.0, "ties": rng.integers(0, 5, n) * 1.0}[kind]
    parts = []
    for chunk in np.array_split(v, 37):
        s = Sketch(64)
        for piece in np.array_split(chunk, 5):
            s.add(piece)
        parts.append(s)
    total = Sketch(64)
    for s in parts:
        total.merge(Sketch.from_row(s.row(), 64))
    assert total.n == n and 0 < total.error <= n * 12 / (2 * 64)
    assert sum(len(b) << level for level, held in total.buffers.items() for b in held) + sum(map(len, total.loose)) == n
    v.sort()
    for share in (0, 0.01, 0.25, 0.5, 0.9, 0.999, 1):
        lo, hi = _true_ranks(v, total.quantile(share))
        want = max(1, int(np.ceil(share * n)))
        assert lo - total.error <= want <= hi + total.error


def test_exact_while_nothing_collapses():
    s = Sketch(100)
    s.add(np.arange(99, 0, -1.0))
    assert s.quantile(0.5) == 50 and s.error == 0 and s.quantile(0) == 1 and s.quantile(1) == 99


def test_days_combine(spark):
    rng = np.random.default_rng(2)
    rows = [(f"f{0 if i % 3 else i % 7}", int(i % 5), float(x)) for i, x in enumerate(rng.normal(size=20_000))]
    df = spark.createDataFrame(rows, "file string, day int, v double").repartition(7)
    days = day_sketches(df, ["file", "day"], "v", 128)
    assert days.count() == len({r[:2] for r in rows})
    out = {r.file: r for r in percentiles(merged(days, ["file"], 128), ["file"], (0.5, 0.95), 128).collect()}
    for f in {r[0] for r in rows}:
        v = np.sort([r[2] for r in rows if r[0] == f])
        assert out[f].n_values == len(v)
        for name, share in (("p50", 0.5), ("p95", 0.95)):
            lo, hi = _true_ranks(v, out[f][name])
            assert lo - out[f].rank_error <= np.ceil(share * len(v)) <= hi + out[f].rank_error
        assert out[f].rank_error < 0.06 * len(v)
    some = percentiles(merged(days.filter("day < 2"), ["file"], 128), ["file"], (0.5,), 128)
    assert some.agg(F.sum("n_values")).first()[0] == sum(r[1] < 2 for r in rows)


def test_nulls_nan_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", float("inf")), (None, 3.0), ("b", None)], "file string, v double").withColumn("n", F.lit(1)).withColumn("levels", F.lit("x"))
    out = {r.file: (r.n_values, r.p50) for r in percentiles(day_sketches(df, ["file"], "v"), ["file"], (0.5,)).collect()}
    assert out == {"a": (1, 1.0), None: (1, 3.0)}
    assert percentiles(day_sketches(df.limit(0), ["file"], "v"), ["file"], (0.5,)).count() == 0


def test_readable_number(spark):
    cells = ["-3.5", " -5.62 ", "7.99751E+00", "+1", ".5", "5.", "1|2", "NaN", "", None, "1,5", "1e", "0x1", "Infinity"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(readable_number(F.col("c")).alias("v"))
    assert [r.v for r in df.collect()] == [-3.5, -5.62, 7.99751, 1.0, 0.5, 5.0, *[None] * 8]
