"""Peptide sequences with modifications in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A modification in brackets; its name may hold brackets of its own, two levels deep.
_MOD = r"\[((?:[^\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*)\]"
#: What stands before a modification since the one before it.
_BEFORE = r"([^\[\]]*)" + _MOD
#: Fixed value: modifications of this type are part of the residue's mass and aren't listed.
FIXED_TYPE = "Common Fixed:"


def modifications(sequence: Column, with_fixed: bool = False) -> Column:
    """(residue, name) of each modification of a sequence of one hypothesis, residues from 1; one before the first residue has 0.

    Fixed modifications are left out unless asked for. Null and bare sequences give null and an empty array.
    """
    before, names = F.regexp_extract_all(sequence, F.lit(_BEFORE), 1), F.regexp_extract_all(sequence, F.lit(_BEFORE), 2)
    residues = lambda i: F.length(F.regexp_replace(F.array_join(F.slice(before, 1, i + 1), ""), "[^A-Z]", ""))
    found = F.transform(names, lambda m, i: F.struct(residues(i).alias("residue"), m.alias("name")))
    return found if with_fixed else F.filter(found, lambda m: ~m["name"].startswith(FIXED_TYPE))


def bare_sequence(sequence: Column) -> Column:
    """A sequence without its modifications."""
    return F.regexp_replace(sequence, _MOD, "")
