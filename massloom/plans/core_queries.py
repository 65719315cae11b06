"""Queries p1_ and p4_, on rows that fail to parse and on packed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators.bad_rows import bad_rows, good_rows
from massloom.operators.multi_values import MATCH_FIELDS, listed_values, split_values
from massloom.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "design_lines").filter("line_no > 1")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows(_records(spark, sf_dir), "line_id", "raw_line").select("line_id", "reason")


def p1_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = good_rows(_records(spark, sf_dir), "line_id", "raw_line")
    return good.select("line_id", F.col("FileName").alias("file_name"), F.col("Condition").alias("condition"), F.col("Biorep").alias("biorep"), F.col("Fraction").alias("fraction"), F.col("Techrep").alias("techrep"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = listed_values(table(spark, sf_dir, "proteins"), table(spark, sf_dir, "contaminants"))
    return split_values(table(spark, sf_dir, "psms"), "psm_id", MATCH_FIELDS, listed)


_CELL = r'("(?:[^"]|"")*"|[^"\t]*)'
_LINE = rf"""
lines AS (
  SELECT line_id, CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE coalesce(raw_line, '') END AS line
  FROM design_lines WHERE line_no > 1),
cut AS (
  SELECT *, regexp_full_match(line, '{_CELL}(\t{_CELL})*') AS quoting,
    regexp_full_match(line, '{_CELL}(\t{_CELL}){{4}}') AS five,
    {", ".join(f"regexp_extract(line, '^{_CELL}" + f"\\t{_CELL}" * 4 + f"$', {i}) AS r{i}" for i in range(1, 6))}
  FROM lines),
cells AS (
  SELECT *, {", ".join(f"CASE WHEN starts_with(r{i}, '\"') THEN replace(r{i}[2:-2], '\"\"', '\"') ELSE r{i} END AS c{i}" for i in range(1, 6))}
  FROM cut),
marked AS (
  SELECT *, CASE
    WHEN NOT quoting THEN 'quoting' WHEN NOT five THEN 'column_count'
    WHEN regexp_matches(trim(c1, W), '[/\\]') OR NOT regexp_matches(trim(c1, W), '(?i)\.(raw|mzml|mgf|d)$') THEN 'file_name'
    WHEN trim(c2, W) = '' OR regexp_matches(c2, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{FFFD}}]') THEN 'condition'
    {" ".join(f"WHEN NOT regexp_full_match(c{i}, ' *[+]?0*[1-9][0-9]{{0,9}} *') OR coalesce(try_cast(trim(c{i}) AS BIGINT), 0) NOT BETWEEN 1 AND 2147483647 THEN '{n}'" for i, n in ((3, "biorep"), (4, "fraction"), (5, "techrep")))}
    END AS reason
  FROM cells)
""".replace("W)", "' ' || chr(9) || chr(10) || chr(13) || chr(160))")

QUERIES = {"p1_found": p1_found, "p1_valid": p1_valid, "p4_found": p4_found}
SQL = {
    "p1_found": f"WITH {_LINE} SELECT line_id, reason FROM marked WHERE reason IS NOT NULL",
    "p1_valid": f"WITH {_LINE} SELECT line_id, trim(c1, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS file_name, c2 AS condition, CAST(trim(c3) AS INTEGER) AS biorep, CAST(trim(c4) AS INTEGER) AS fraction, CAST(trim(c5) AS INTEGER) AS techrep FROM marked WHERE reason IS NULL",
}
