"""Rows of delimited text that fail to parse, apart from those that load.

Lines are parsed once and written with a row number. Structure (quoting, cell count) is checked on the line alone. Each distinct value
of a column is cast and checked once: the invalid ones form a dictionary with reasons that is joined back. What is right most of the time,
such as a hot `1`, is in no dictionary. A small dictionary is broadcast after a check of its size; else the probing side is salted so that
a value may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.text import bound, is_blank, strip
from massloom.session import materialize

#: A tab inside quotes and the escape itself, while a line is split at its other tabs.
_ESCAPE = "\x01"
#: A dictionary of invalid values of at most so many characters, and rows of 100 each, is broadcast.
BROADCAST_CHARS = 16 << 20
#: Copies of a larger dictionary, so that rows with one hot value are spread over as many tasks.
SALTS = 16


@dataclass(frozen=True)
class CellRule:
    """A column of the file: the reason given when a cell is invalid, the check on the unquoted text, and the typed value."""

    name: str
    reason: str
    invalid: Callable[[Column], Column]
    typed: Callable[[Column], Column]


def _whole_number(col: Column) -> Column:
    digits = F.regexp_extract(col, r"^ *+\+?0*+([1-9][0-9]{0,9}) *+\z", 1)
    return F.when(digits != "", digits.cast("bigint"))


def positive_int(name: str) -> CellRule:
    """ASCII digits for 1 to 2147483647; a plus sign, leading zeros and surrounding spaces are allowed."""
    most = 2**31 - 1
    return CellRule(name, name.lower(), lambda c: ~F.coalesce(_whole_number(c) <= most, F.lit(False)), lambda c: _whole_number(c).cast("int"))


#: The columns of ExperimentalDesign.tsv.
DESIGN_RULES = (
    CellRule(
        "FileName", "file_name",
        lambda c: strip(c).rlike(r"[/\\]") | ~strip(c).rlike(r"(?i)\.(?:raw|mzml|mgf|d)\z"),
        strip,
    ),
    CellRule(
        "Condition", "condition",
        lambda c: is_blank(c) | c.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFFFD]"),
        lambda c: c,
    ),
    positive_int("Biorep"), positive_int("Fraction"), positive_int("Techrep"),
)


def _cells(line: Column) -> Column:
    """The unquoted cells of a line, null if its quoting is wrong."""
    return bound(F.split(line, '"', -1), lambda parts: bound(F.size(parts) - 1, lambda last: _cells_of(parts, last)))


def _cells_of(parts: Column, last: Column) -> Column:
    """`parts` of a line cut at its quotes, `last` being the number of quotes: the parts at odd places are inside quotes if every quote encloses a whole cell."""

    def fits(p: Column, i: Column) -> Column:
        begins = (i == 0) | p.startswith("\t")
        ends = (i == last) | p.endswith("\t")
        return (i % 2 == 1) | (p == "") | (begins & ends)

    def text(p: Column, i: Column) -> Column:
        kept = F.replace(p, F.lit(_ESCAPE), F.lit(_ESCAPE + "a"))
        doubled = (p == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, F.replace(kept, F.lit("\t"), F.lit(_ESCAPE + "b"))).when(doubled, F.lit('"')).otherwise(kept)

    ok = (last == 0) | ((last % 2 == 0) & F.forall(F.transform(parts, fits), lambda x: x))
    cut = F.split(F.array_join(F.transform(parts, text), ""), "\t", -1)
    cells = F.transform(cut, lambda c: F.replace(F.replace(c, F.lit(_ESCAPE + "b"), F.lit("\t")), F.lit(_ESCAPE + "a"), F.lit(_ESCAPE)))
    return F.when(ok, cells)


def parse_lines(lines: DataFrame, key: str, text: str, rules: tuple[CellRule, ...] = DESIGN_RULES) -> DataFrame:
    """`key`, `line`, `cells` and `structure` (`quoting`, `column_count` or null) of each line; null text counts as an empty line.

    Only the two named columns are read, so other columns may have any names. One carriage return at the end belongs to the line end.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    cut = lines.select(F.col(key).alias("key"), F.when(raw.endswith("\r"), F.expr(f"left(coalesce(`{text}`, ''), length(`{text}`) - 1)")).otherwise(raw).alias("line"))
    cut = cut.withColumn("cells", _cells(F.col("line")))
    structure = F.when(F.col("cells").isNull(), "quoting").when(F.size("cells") != len(rules), "column_count")
    return cut.select("key", "line", "cells", structure.alias("structure"))


def invalid_values(parsed: DataFrame, rules: tuple[CellRule, ...] = DESIGN_RULES) -> DataFrame:
    """The dictionary: `place`, `value` and `reason` of each distinct value that its column doesn't allow."""
    distinct = parsed.filter("structure IS NULL").select(F.posexplode("cells").alias("place", "value")).distinct()
    reason = F.coalesce(*[F.when((F.col("place") == i) & r.invalid(F.col("value")), F.lit(r.reason)) for i, r in enumerate(rules)])
    return distinct.select("place", "value", reason.alias("reason")).filter("reason IS NOT NULL")


def _checked(lines: DataFrame, key: str, text: str, rules: tuple[CellRule, ...]) -> tuple[DataFrame, DataFrame]:
    """(the parsed lines with a row number, (row, reason) of those with an invalid value)."""
    parsed = materialize(parse_lines(lines, key, text, rules).withColumn("row", F.monotonically_increasing_id()), "parsed")
    bad = materialize(invalid_values(parsed, rules), "invalid")
    chars = bad.agg(F.coalesce(F.sum(F.length("value") + 100), F.lit(0))).first()[0]
    cells = parsed.filter("structure IS NULL").select("row", F.posexplode("cells").alias("place", "value"))
    if chars <= BROADCAST_CHARS:
        hits = cells.join(F.broadcast(bad), ["place", "value"])
    else:
        salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = cells.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["salt", "place", "value"])
    return parsed, hits.groupBy("row").agg(F.min(F.struct("place", "reason")).alias("first")).select("row", F.col("first.reason").alias("reason"))


def bad_rows(lines: DataFrame, key: str, text: str, rules: tuple[CellRule, ...] = DESIGN_RULES) -> DataFrame:
    """(`key`, line, reason) of each line that fails; the first reason in the order quoting, column_count, then the columns'.

    Repeated lines come out as often as they occur; a null key is a key. An empty table gives no rows.
    """
    parsed, by_value = _checked(lines, key, text, rules)
    by_structure = parsed.filter("structure IS NOT NULL").select("key", "line", F.col("structure").alias("reason"))
    found = by_structure.unionByName(parsed.join(by_value, "row").select("key", "line", "reason"))
    return found.withColumnRenamed("key", key)


def good_rows(lines: DataFrame, key: str, text: str, rules: tuple[CellRule, ...] = DESIGN_RULES) -> DataFrame:
    """The other lines as typed columns beside `key`."""
    parsed, by_value = _checked(lines, key, text, rules)
    kept = parsed.filter("structure IS NULL").join(by_value, "row", "left_anti")
    return kept.select(F.col("key").alias(key), *[r.typed(F.col("cells")[i]).alias(r.name) for i, r in enumerate(rules)])
