"""Queries of the operators of this subpackage over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massloom.functions.text import WHITE, strip
from massloom.llm.components import connected_groups
from massloom.llm.packing import pack
from massloom.llm.percentiles import day_sketches, merged, percentiles, readable_number
from massloom.llm.reading_level import reading_levels
from massloom.llm.sql import SQL
from massloom.llm.survivors import descending, survivors
from massloom.llm.term_counts import count_terms, separators
from massloom.llm.tokens import count_tokens, encode_texts
from massloom.llm.top_n import kept_layout, skipped_row_groups, top_n
from massloom.session import materialize, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = kept_layout(table(spark, sf_dir, "psms"), "psm_id", "base_sequence", "score")
    return top_n(spark, path, 3).select(F.col("key").alias("psm_id"), "place_no")


def p3_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p3_found reads of its layout, all files together."""
    path = kept_layout(table(spark, sf_dir, "psms"), "psm_id", "base_sequence", "score")
    return skipped_row_groups(spark, path, 3).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_row_groups", "n_read", "n_skipped")])


def file_key(path: Column) -> Column:
    """The bare lower-case file name of a path, whether quoted, a URL, of either slash, escaped, relative or padded.

    File names are unique without regard to case, so folders, which are mounted under several names, don't count.
    """
    bare = F.btrim(strip(path), F.lit('"' + WHITE))
    decoded = F.when(bare.rlike("(?i)^file:"), F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))).otherwise(bare)
    return F.lower(strip(F.substring_index(F.replace(decoded, F.lit("\\"), F.lit("/")), "/", -1)))


def _filed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "spectra_files").select("file_id", F.lower("file_name").alias("file_key"))
    matches = table(spark, sf_dir, "spectral_matches").filter("scan_number IS NOT NULL").withColumn("file_key", file_key(F.col("full_file_path")))
    return matches.join(files, "file_key")


#: The fields of a surviving match record.
MATCH_FIELDS = ("base_sequence", "full_sequence", "precursor_charge", "accession")


def _trust() -> list[Column]:
    filled = [F.when(F.length(strip(F.col(f).cast("string"))) > 0, 1).otherwise(0) for f in MATCH_FIELDS]
    return [descending(F.col("score")), -sum(filled[1:], filled[0]), descending(F.unix_micros(F.col("searched_at").cast("timestamp")))]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = survivors(_filed_matches(spark, sf_dir), ["file_id", "scan_number"], "match_id", _trust(), {f: (f,) for f in MATCH_FIELDS})
    return out.select("file_id", "scan_number", F.col("bundle_name").alias("field_name"), F.col("record_id").alias("match_id"))


def p5_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences from one record, with a charge and an accession that some record of the group has together with the full sequence."""
    bundles = {"sequence": ("base_sequence", "full_sequence"), "charge": ("precursor_charge",), "protein": ("accession",)}
    out = survivors(_filed_matches(spark, sf_dir), ["file_id", "scan_number"], "match_id", _trust(), bundles, [("full_sequence", "precursor_charge"), ("base_sequence", "accession")])
    return out.select("file_id", "scan_number", "bundle_name", F.col("record_id").alias("match_id"))


#: Separators of the terms of each field.
TERM_FIELDS = {"full_sequence": separators("|", False), "identified_sequence_variations": separators("|,;", True)}


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_terms(table(spark, sf_dir, "psms"), TERM_FIELDS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_terms(spark, sf_dir).filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "shared_pairs").select(strip(F.col("accession_a")).alias("a"), strip(F.col("accession_b")).alias("b"))
    listed = table(spark, sf_dir, "proteins").select(F.col("accession").alias("target")).distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).filter("node IS NOT NULL").distinct()
    nodes = materialize(ends.withColumn("target", F.regexp_replace("node", "^DECOY_", "")).join(listed, "target", "left_semi").select("node"), "nodes")
    known = pairs.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi")
    out = connected_groups(nodes, known, "node", "a", "b")
    return out.select(F.col("node").alias("accession"), F.col("group_id").alias("group_accession"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens")


def p9_one_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", capacities=(4096,))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the containers of each capacity is used."""
    containers = p9_containers(spark, sf_dir).groupBy("capacity", "container_id").agg(F.sum("n_tokens").alias("used"))
    return containers.groupBy("capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.round(F.sum("used") / F.sum("capacity"), 4).alias("share_used"))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p9_containers: every document's tokens once, no container over its capacity or with two pieces on one place, none split that fits."""
    sizes = materialize(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    packed = materialize(pack(sizes, "doc_id", "n_tokens"), "packed")
    whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("n_pieces")).join(sizes, "doc_id", "full_outer")
    documents = whole.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.when(F.col("placed").eqNullSafe(F.col("n_tokens")), 0).otherwise(1)).alias("n_wrong_size"), F.sum(F.when((F.col("n_pieces") > 1) & (F.col("n_tokens") <= 8192), 1).otherwise(0)).alias("n_needless_splits"))
    before = F.max(F.col("start") + F.col("n_tokens")).over(Window.partitionBy("container_id").orderBy("start", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    places = packed.filter("n_tokens > 0").select("capacity", "start", "n_tokens", F.coalesce(before, F.lit(0)).alias("before"))
    clashes = places.agg(F.sum(F.when(F.col("start") < F.col("before"), 1).otherwise(0)).alias("n_clashes"), F.sum(F.when(F.col("start") + F.col("n_tokens") > F.col("capacity"), 1).otherwise(0)).alias("n_over_capacity"))
    steps = packed.groupBy("step_group").agg(F.countDistinct("capacity").alias("kinds"), F.countDistinct("container_id").alias("n")).agg(F.sum(F.when((F.col("kinds") > 1) | (F.col("n") > 8), 1).otherwise(0)).alias("n_wrong_steps"))
    one = F.lit(1).alias("one")
    return documents.select("*", one).join(clashes.select("*", one), "one").join(steps.select("*", one), "one").drop("one")


def p2_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file how many of the seven percentiles of sketches with buffers of 32 values, which collapse often, are within their stated error."""
    rows = _ppm(spark, sf_dir).filter("ppm IS NOT NULL AND NOT isnan(ppm) AND abs(ppm) < double('infinity')")
    found = percentiles(merged(day_sketches(rows, ["full_file_path", "export_day"], "ppm", 32), ["full_file_path"], 32), ["full_file_path"], SHARES, 32)
    asked = found.select("full_file_path", "n_values", "rank_error", F.inline(F.array(*[F.struct(F.lit(x).alias("share"), F.ceil(F.lit(x) * F.col("n_values")).alias("wanted"), F.col(f"p{round(100 * x):02d}").alias("v")) for x in SHARES])))
    ranks = rows.join(asked, rows["full_file_path"].eqNullSafe(asked["full_file_path"])).groupBy(asked["full_file_path"], "n_values", "rank_error", "share", "wanted", "v").agg(F.sum(F.when(F.col("ppm") < F.col("v"), 1).otherwise(0)).alias("below"), F.sum(F.when(F.col("ppm") <= F.col("v"), 1).otherwise(0)).alias("upto"))
    off = F.greatest(F.col("below") + 1 - F.greatest("wanted", F.lit(1)), F.greatest("wanted", F.lit(1)) - F.col("upto"), F.lit(0))
    return ranks.groupBy("full_file_path", "n_values").agg(F.sum(F.when(off <= F.col("rank_error"), 1).otherwise(0)).alias("n_within"))


def _ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "psms").select("full_file_path", F.to_date("exported_at").alias("export_day"), readable_number(F.col("mass_diff_ppm")).alias("ppm"))


#: The quantiles that the percentile queries give.
SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file over all days, from the sketches of its days."""
    days = day_sketches(_ppm(spark, sf_dir), ["full_file_path", "export_day"], "ppm")
    return percentiles(merged(days, ["full_file_path"]), ["full_file_path"], SHARES)


def p2_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each export day over all files, from the sketches of files and days."""
    days = day_sketches(_ppm(spark, sf_dir), ["full_file_path", "export_day"], "ppm")
    return percentiles(merged(days, ["export_day"]), ["export_day"], SHARES).withColumn("export_day", F.col("export_day").cast("string"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"), "doc_id", "text", "reading_level")


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_days, p2_rank_check, p3_found, p3_skipped, p5_found, p5_bundles, p6_terms, p6_found, p7_found, p8_ids, p9_containers, p9_one_capacity, p9_fill, p9_invariants, p10_found)}
__all__ = ["QUERIES", "SQL"]
