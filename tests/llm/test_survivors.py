import itertools
import random

from pyspark.sql import functions as F

from massloom.llm import survivors as module
from massloom.llm.queries import file_key
from massloom.llm.survivors import best_choice, descending, survivors

FIELDS = {"a": ("a",), "b": ("b",)}
SCHEMA = "g int, id long, score double, at long, a string, b int"


def test_field_by_field(spark):
    rows = [(1, 1, 5.0, 0, None, 7), (1, 2, 4.0, 0, "x", None), (1, 3, 4.0, 0, "y", 8), (2, 4, 1.0, 0, "z", 1), (3, 5, None, 0, " ", 1), (3, 6, float("nan"), 0, "w", None), (3, 7, 1.0, 0, "", None), (4, 8, 1.0, 0, None, None), (4, 9, 1.0, 0, None, None), (None, 10, 1.0, 0, "q", 1), (None, 11, 2.0, 0, None, 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("group", F.lit("y"))
    out = {(r.g, r.bundle_name): r.record_id for r in survivors(df, ["g"], "id", [descending(F.col("score"))], FIELDS).collect()}
    assert out == {(1, "a"): 2, (1, "b"): 1, (3, "a"): 6, (3, "b"): 5, (None, "a"): 10, (None, "b"): 11}
    assert survivors(df.limit(0), ["g"], "id", [descending(F.col("score"))], FIELDS).count() == 0


def test_hot_group(spark):
    df = spark.range(30_000).select(F.lit(1).alias("g"), F.col("id"), (F.col("id") % 100).cast("double").alias("score"), F.lit(0).cast("long").alias("at"), F.when(F.col("id") % 2 == 0, "x").alias("a"), F.lit(1).alias("b"))
    out = {r.bundle_name: r.record_id for r in survivors(df, ["g"], "id", [descending(F.col("score"))], FIELDS).collect()}
    assert out == {"a": 98, "b": 99}


def brute(rows):
    """The choice of candidates with the least loss whose values stand together in some record."""
    out = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None or r[2] != r[2], -(r[2] or 0), r[1]))
        if len(mine) < 2:
            continue
        cands = []
        for place in (4, 5):
            seen = {}
            for r in mine:
                if r[place] is not None and r[place] != "":
                    seen.setdefault(r[place], r[1])
            cands.append(list(seen.items()))
        pairs = {(r[4], r[5]) for r in mine}
        best = min(((i + j, i, j) for i, j in itertools.product(range(len(cands[0]) + 1), range(len(cands[1]) + 1)) if i == len(cands[0]) or j == len(cands[1]) or (cands[0][i][0], cands[1][j][0]) in pairs))
        for name, c, k in (("a", cands[0], best[1]), ("b", cands[1], best[2])):
            if k < len(c):
                out[g, name] = c[k][1]
    return out


def test_dependencies_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(30), i, float(rng.randrange(6)), 0, rng.choice([None, "p", "q", "r", "s", "t", "u"]), rng.choice([None, 1, 2, 3, 4, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 8):
        monkeypatch.setattr(module, "FIRST_K", k)
        out = {(r.g, r.bundle_name): r.record_id for r in survivors(df, ["g"], "id", [descending(F.col("score"))], FIELDS, [("a", "b")]).collect()}
        assert out == brute(rows)


def test_best_choice_prunes_to_the_same_result():
    rng = random.Random(9)
    for _ in range(100):
        cands = [[(v,) for v in range(rng.randrange(1, 5))] for _ in range(3)]
        allowed = [(a, 0, b, 0, {(x, y) for x in range(5) for y in range(5) if rng.random() < 0.5}) for a, b in ((0, 1), (1, 2))]
        ok = [(sum(c), list(c)) for c in itertools.product(*[range(len(x)) for x in cands]) if all((c[a], c[b]) in p for a, _, b, _, p in allowed)]
        loss, chosen = best_choice(cands, allowed)
        assert (loss, chosen) == min(ok, default=(1 << 60, []))


def test_file_key(spark):
    paths = ["D:\\Data\\delta lab\\A b_1.raw", "d:/data/A B_1.RAW ", '"D:\\Data\\a b_1.raw"', "file:///D:/x%20y/a%20b_1.raw", "D:\\\\Data\\\\a b_1.raw", ".\\a b_1.raw", "a b_1.raw", "/mnt//a b_1.raw", "\\\\store\\a b_1.raw", "file:///D:/a%zz.raw", None, "", "D:/a+b.raw"]
    got = [r.k for r in spark.createDataFrame([(p,) for p in paths], "p string").select(file_key(F.col("p")).alias("k")).collect()]
    assert got[:9] == ["a b_1.raw"] * 9 and got[9:] == [None, None, "", "a+b.raw"]
