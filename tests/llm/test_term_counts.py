import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from massloom.llm.term_counts import LastSeen, count_terms, runs_of_batch, separators

FIELDS = {"a": separators("|", False), "b": separators("|,;", True)}


def brute(rows, share=0.01):
    import re

    out = []
    for name, place, pattern in (("a", 0, r"\|"), ("b", 1, r"[|,;\s]+")):
        occ, rec, holders = Counter(), Counter(), 0
        for r in rows:
            terms = [t.strip() for t in re.split(pattern, r[place] or "") if t.strip()]
            occ.update(terms)
            rec.update(set(terms))
            holders += bool(terms)
        out += [(name, t, n, rec[t], "rare" if rec[t] == 1 else "common" if rec[t] > share * holders else None) for t, n in occ.items()]
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(((r.field_name, r.term, r.occurrences, r.n_records, r.mark) for r in count_terms(df, FIELDS, **kw).collect()), key=str)


@pytest.fixture(params=[10_000, 7])
def batch_rows(spark, request):
    """Rows of an Arrow batch: small ones let every term lie in many batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield request.param
    spark.conf.set(name, before)


def test_against_brute_force(spark, batch_rows):
    rng = random.Random(7)
    word = lambda: rng.choice(["x", "y z", "w" + str(rng.randrange(300)), " q ", "", "\u00a0"])
    rows = [("|".join(word() for _ in range(rng.randrange(4))) or None, rng.choice([",", "; ", " | ", "\u00a0"]).join(word() for _ in range(rng.randrange(5)))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(5)
    assert got(df) == brute(rows)


def test_records_over_several_rows(spark, batch_rows):
    rows = [(i % 40, "x" if i % 4 else f"t{i % 40}|x|x") for i in range(400)]
    df = spark.createDataFrame([(r, t, None) for r, t in rows], "r long, a string, b string").repartition(6)
    out = {x[1]: x[2:4] for x in got(df, record="r")}
    assert out["x"] == (300 + 200, 40)
    assert out["t4"] == (10, 1)


def test_empty_nulls_clashes_and_long_text(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert got(df) == []
    df = spark.createDataFrame([(None, None, 1, 2), ("", " ", 1, 2)], "a string, b string, term int, mark int")
    assert got(df) == []
    df = spark.createDataFrame([("x|" * 200_000, "y")], "a string, b string")
    assert got(df) == [("a", "x", 200_000, 1, "rare"), ("b", "y", 1, 1, "rare")]


def test_a_record_seen_before_counts_once():
    """The merge compares a run's first record with the last one seen, within and between batches."""
    names = ["field_name", "term", "first_record", "last_record", "occurrences", "n_records"]

    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    counter = LastSeen()
    out = [*counter.add(batch(("a", "x", 1, 5, 4, 3), ("a", "x", 5, 9, 2, 2))), *counter.add(batch(("a", "x", 9, 9, 1, 1), ("a", "y", 2, 2, 1, 1)))]
    got = [tuple(r.values()) for b in out for r in b.to_pylist()] + counter.rest()
    assert got == [("a", "x", 7, 4), ("a", "y", 1, 1)]


def test_a_repeated_term_of_a_record_is_one_record():
    found, held = runs_of_batch(pa.array(["x|x|y", None, "x"]), np.array([3, 4, 5]), separators("|", False))
    assert sorted(zip(*found.to_pydict().values(), strict=True)) == [("x", 3, 5, 3, 2), ("y", 3, 3, 1, 1)]
    assert held.tolist() == [3, 5]
