import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from massloom.operators.multi_values import CODE_DELIMITERS, NAME_DELIMITERS, _matched_brackets, listed_values, runs, split_values, tokenize, values


def test_values():
    assert values("A|B", CODE_DELIMITERS) == ["A", "B"]
    assert values(' A ; "B" ;; C|', CODE_DELIMITERS) == ["A", "B", "C"]
    assert values('"a|b"|c', NAME_DELIMITERS) == ["a|b", "c"]
    assert values('"99""-cap x"|y', NAME_DELIMITERS) == ['99"-cap x', "y"]
    assert values('99"-cap x|y', NAME_DELIMITERS) == ['99"-cap x', "y"]
    assert values("f (a/b)|g [c;d]", NAME_DELIMITERS) == ["f (a/b)", "g [c;d]"]
    assert values("f (a|b", NAME_DELIMITERS) == ["f (a", "b"]
    assert values('"open|b', NAME_DELIMITERS) == ['"open', "b"]
    assert values("A, B|C", NAME_DELIMITERS, {"A, B"}, 1) == ["A, B", "C"]
    assert values("A, B, C", NAME_DELIMITERS, {"A, B", "B, C"}, 1) == ["A, B", "C"]
    assert values("A, B, C", NAME_DELIMITERS, {"A, B", "A, B, C"}, 2) == ["A, B, C"]
    assert values("", NAME_DELIMITERS) == values(" ||; ", NAME_DELIMITERS) == []
    assert runs("A, B|C", NAME_DELIMITERS, 1) == ["A, B", "B|C"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab"|;( ', max_size=6), min_size=1, max_size=5))
def test_quoted_values_round_trip(parts):
    kept = [p.strip() for p in parts if p.strip()]
    cell = "|".join('"' + p.replace('"', '""') + '"' for p in parts)
    assert values(cell, NAME_DELIMITERS) == kept


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab"|;()[ ,\\', max_size=30))
def test_tokens_cover_the_cell(text):
    pieces = tokenize(text, NAME_DELIMITERS)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b[0] == a[1] + 1 and text[a[1]] in NAME_DELIMITERS for a, b in zip(pieces, pieces[1:], strict=False))


def test_split_values(spark):
    proteins = spark.createDataFrame([("P1", "Kinase 4, long form", "G1", "S1", "Homo, x"), ("P2", "Tail A|B 7", None, None, "Mus"), ("P3", "Kinase 4", "G2", None, None)], "accession string, protein_name string, gene_name string, gene_synonym string, organism_name string")
    listed = listed_values(proteins)
    rows = [(1, "P1|P2", "Kinase 4, long form|Tail A|B 7", None), (2, "P1", "Kinase 4, long form", "x"), (3, None, "", " "), (4, "P1|P1", "Kinase 4;Kinase 4", None), (4, "P1|P1", "Kinase 4;Kinase 4", None), (None, "P1,P2", None, None)]
    df = spark.createDataFrame(rows, "psm_id long, accession string, protein_name string, field_name string")
    out = split_values(df, "psm_id", {"accession": CODE_DELIMITERS, "protein_name": NAME_DELIMITERS}, listed).collect()
    found = sorted((r.psm_id or 0, r.field_name, r.value_no, r.item_text) for r in out)
    twice = [(4, f, n, v) for f, v in (("accession", "P1"), ("protein_name", "Kinase 4")) for n in (1, 2)]
    assert found == sorted([(1, "accession", 1, "P1"), (1, "accession", 2, "P2"), (1, "protein_name", 1, "Kinase 4, long form"), (1, "protein_name", 2, "Tail A|B 7"), (0, "accession", 1, "P1"), (0, "accession", 2, "P2"), *twice, *twice])


def test_split_values_empty_and_long(spark):
    listed = spark.createDataFrame([], "field_name string, value string")
    empty = spark.createDataFrame([], "psm_id long, accession string")
    assert split_values(empty, "psm_id", {"accession": CODE_DELIMITERS}, listed).count() == 0
    cell = "|".join(f"P{i}" for i in range(20_000)) + "(" * 5000
    df = spark.createDataFrame([(1, cell)], "psm_id long, accession string")
    assert split_values(df, "psm_id", {"accession": CODE_DELIMITERS}, listed).count() == 20_000


def test_order_of_delimiters_does_not_matter():
    rng = random.Random(3)
    for _ in range(200):
        names = [rng.choice("ABCD") + str(rng.randrange(9)) for _ in range(rng.randrange(2, 6))]
        cell = names[0] + "".join(rng.choice(["|", "; ", " / ", ",", "\t", "||"]) + n for n in names[1:])
        assert values(cell, CODE_DELIMITERS) == names


@pytest.mark.parametrize("cell", ["(" * 100_000 + "]" * 100_000, "([{" * 40_000 + ")" * 40_000, ',"""' * 40_000, ',"a"b' * 40_000, "((" * 50_000])
def test_hostile_cells_take_linear_time(cell):
    began = time.process_time()
    tokenize(cell, "|;,/")
    assert time.process_time() - began < 1.5


def test_brackets_of_other_kinds_within_a_pair():
    assert _matched_brackets("([)]") == {0, 2}
    assert _matched_brackets("(a]b)") == {0, 4}
    assert _matched_brackets("{[(]}") == {0, 1, 3, 4}
