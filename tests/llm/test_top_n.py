import random

from massloom.llm import top_n as module
from massloom.llm.top_n import cluster_rows, kept_layout, skipped_row_groups, top_n


def brute(rows, n):
    groups = {}
    for k, g, s in rows:
        if g and g.strip(" \u00a0") and s is not None and s == s:
            groups.setdefault(g, []).append((-s, k))
    return sorted((k, g, i + 1) for g, held in groups.items() for i, (_, k) in enumerate(sorted(held)[:n]))


def run(spark, rows, n):
    df = spark.createDataFrame(rows, "key long, group_value string, score double")
    return sorted((r.key, r.group_value, r.place_no) for r in top_n(spark, cluster_rows(df, "key", "group_value", "score"), n).collect())


def test_against_brute_force_with_skew_and_ties(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(300)}", float(rng.randrange(40))) for i in range(6000)]
    rows += [(10_000 + i, g, s) for i, (g, s) in enumerate([(None, 1.0), ("", 2.0), (" \u00a0", 3.0), ("g1", None), ("g1", float("nan")), ("g2", float("inf")), (" g2", 1.0)])]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, rows, 1) == brute(rows, 1)


def test_skipping_loses_nothing_and_skips(spark, monkeypatch):
    """Row groups of a hot group, small ones, so that most can be skipped."""
    monkeypatch.setattr(module, "ROW_GROUP_ROWS", 200)
    rng = random.Random(6)
    rows = [(i, "hot" if i % 2 else f"g{rng.randrange(50)}", rng.random()) for i in range(20_000)]
    df = spark.createDataFrame(rows, "key long, group_value string, score double")
    path = cluster_rows(df, "key", "group_value", "score")
    out = sorted((r.key, r.group_value, r.place_no) for r in top_n(spark, path, 3).collect())
    assert out == brute(rows, 3)
    total, read, skipped = skipped_row_groups(spark, path, 3).groupBy().sum("n_row_groups", "n_read", "n_skipped").first()
    assert read + skipped == total >= 100
    # The hot group has 50 row groups, of which each file that holds it needs one or two.
    assert skipped >= 30


def test_ties_at_the_nth_score_are_not_skipped(spark, monkeypatch):
    """Only row groups strictly below the N-th score go: of equal scores the least key may be in any of them."""
    monkeypatch.setattr(module, "ROW_GROUP_ROWS", 100)
    rows = [(i, "hot", 2.0 if i >= 4000 else 1.0) for i in range(8000)]
    df = spark.createDataFrame(rows, "key long, group_value string, score double")
    path = cluster_rows(df, "key", "group_value", "score")
    assert sorted((r.key, r.place_no) for r in top_n(spark, path, 2).collect()) == [(4000, 1), (4001, 2)]
    assert skipped_row_groups(spark, path, 2).groupBy().sum("n_skipped").first()[0] > 0


def test_a_layout_is_written_once_for_the_same_files(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1.0)], "key long, group_value string, score double").write.parquet(at)
    first = kept_layout(spark.read.parquet(at), "key", "group_value", "score")
    assert kept_layout(spark.read.parquet(at), "key", "group_value", "score") == first
    assert kept_layout(spark.read.parquet(at).filter("key > 5"), "key", "group_value", "score") != first
    spark.createDataFrame([(2, "a", 2.0)], "key long, group_value string, score double").write.mode("append").parquet(at)
    again = kept_layout(spark.read.parquet(at), "key", "group_value", "score")
    assert again != first and [(r.key, r.place_no) for r in top_n(spark, again, 1).collect()] == [(2, 1)]


def test_same_scores_everywhere(spark):
    rows = [(i, "hot", 1.0) for i in range(5000, 0, -1)]
    assert run(spark, rows, 3) == [(1, "hot", 1), (2, "hot", 2), (3, "hot", 3)]


def test_empty_and_repeated(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [(1, None, 1.0)], 3) == []
    assert run(spark, [(1, "a", 1.0), (1, "a", 1.0)], 3) == [(1, "a", 1), (1, "a", 2)]
    long = "x" * 100_000
    assert run(spark, [(1, long, 1.0), (2, long + "y", 2.0), (3, long, 0.0)], 1) == sorted([(1, long, 1), (2, long + "y", 1)])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0, "k", "g")], "id long, seq string, s double, key string, place_no string")
    assert [(r.key, r.place_no) for r in top_n(spark, cluster_rows(df, "id", "seq", "s"), 2).collect()] == [(1, 1)]
