import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from massloom.llm.packing import pack, pack_sizes, step_groups


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80))
def test_nothing_overlaps_or_overflows(sizes):
    where, start, kinds = pack_sizes(sizes, (8, 64))
    for c, cap in enumerate(kinds):
        held = sorted((int(start[i]), sizes[i]) for i in range(len(sizes)) if where[i] == c and sizes[i])
        assert all(a + n <= b for (a, n), (b, _) in zip(held, held[1:], strict=False))
        assert not held or held[-1][0] + held[-1][1] <= cap
    assert (where >= 0).all() if sizes else len(where) == 0
    assert all(kinds[where[i]] >= s for i, s in enumerate(sizes) if s)


def test_little_is_left_over():
    sizes = np.random.default_rng(1).integers(20, 900, 20_000)
    where, _, kinds = pack_sizes(sizes, (512, 2048))
    assert sizes.sum() / sum(kinds) > 0.97
    assert min(kinds) == 512 and max(kinds) == 2048


def test_steps_balance():
    rng = np.random.default_rng(2)
    costs, kinds = rng.random(800), np.repeat([1, 2], 400)
    steps = step_groups(costs, kinds, 8)
    sums = np.bincount(steps, costs)
    assert np.bincount(steps).max() == 8 and sums.max() / sums.min() < 1.3
    assert all(len(set(kinds[steps == s])) == 1 for s in range(steps.max() + 1))


@pytest.mark.parametrize("shard", [20_000, 50])
def test_pack(spark, shard):
    rng = np.random.default_rng(3)
    rows = [(int(i % 90), int(n)) for i, n in enumerate(rng.integers(0, 300, 500))] + [(1000, 1000), (1001, None), (1002, -5), (None, 70)] + [(7, 10)] * 300
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumnRenamed("n", "size")
    out = pack(df, "doc_id", "size", (64, 256), shard).toPandas()
    assert out.n_tokens.sum() == sum(max(n or 0, 0) for _, n in rows)
    assert (out.groupby("container_id").n_tokens.sum() <= out.groupby("container_id").capacity.first()).all()
    big = out[out.doc_id == 1000]
    assert sorted(big.n_tokens) == [232, 256, 256, 256] and sorted(big.piece_no) == [1, 2, 3, 4]
    assert len(out) == len(rows) + 3 + sum(n is not None and 256 < n <= 512 for _, n in rows)


def test_pack_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, size long"), "doc_id", "size").count() == 0
