"""Queries on range, nearest, index and merging joins, named after the operators of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.masses import PROTON, RESIDUES, overlap_ratio, to_mass
from massloom.functions.text import accessions
from massloom.operators import joins
from massloom.session import table


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their observed and theoretical mass."""
    mass = F.expr("try_cast(trim(peptide_monoisotopic_mass) AS double)")
    rows = table(spark, sf_dir, "psms").select("psm_id", "precursor_charge", "precursor_mz", mass.alias("mass"))
    return rows.withColumn("observed", to_mass(F.col("precursor_mz"), F.col("precursor_charge"))).filter("mass IS NOT NULL AND NOT isnan(mass) AND observed IS NOT NULL AND NOT isnan(observed)")


_MASSES = f"""o AS (SELECT psm_id, try_cast(trim(peptide_monoisotopic_mass) AS DOUBLE) AS mass, precursor_mz * abs(precursor_charge) - precursor_charge * {PROTON!r} AS observed FROM psms),
  masses AS (SELECT * FROM o WHERE mass IS NOT NULL AND NOT isnan(mass) AND observed IS NOT NULL AND NOT isnan(observed))"""


def band_join_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theory to observed, 200 ppm around each part's price."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * (1 - 200e-6)).alias("lo"), (F.col("p_retailprice") * (1 + 200e-6)).alias("hi"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return joins.band_join(parts, lines, "lo", "hi", "l_extendedprice", 1e-3, scale=F.log).select("p_partkey", "l_orderkey", "l_linenumber")


def band_join_notches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed to theory with the shift of each notch taken off; the theories are the masses of all matches."""
    notches = F.inline(F.array(*[F.struct(F.lit(n).alias("notch"), F.lit(s).alias("shift")) for n, s in ((0, 0.0), (1, 1.00335), (2, 2.0067))]))
    masses = _observed(spark, sf_dir)
    observed = masses.select("psm_id", "observed", notches).withColumn("lo", (F.col("observed") - F.col("shift")) * (1 - 1e-6)).withColumn("hi", (F.col("observed") - F.col("shift")) * (1 + 1e-6))
    theory = masses.select(F.col("mass").alias("theory")).distinct()
    return joins.band_join(observed, theory, "lo", "hi", "theory", 4e-6, scale=F.log).groupBy("psm_id", "notch").agg(F.count(F.lit(1)).alias("n_theories"))


def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier's lines the one whose price is nearest to 30 times the price of each of its parts, and whether it is near enough."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_retailprice") * 30).alias("theory"))
    theory = lines.select("l_suppkey", "l_partkey").distinct().join(parts, "l_partkey")
    out = joins.nearest_join(theory, lines.select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "theory", "l_extendedprice")
    near = F.col("nearest.value")
    return out.select("l_suppkey", "l_partkey", near.alias("nearest_price"), near.between(F.col("theory") * 0.9995, F.col("theory") * 1.0005).alias("is_match"))


def complementary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest line price to what a supplier's dearest line leaves over."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice")
    totals = lines.groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("total"))
    theory = lines.groupBy("l_suppkey", "l_partkey").agg(F.min("l_extendedprice").alias("fragment")).join(totals, "l_suppkey").withColumn("theory", F.col("total") - F.col("fragment"))
    out = joins.nearest_join(theory, lines, ["l_suppkey"], "theory", "l_extendedprice")
    return out.select("l_suppkey", "l_partkey", F.col("nearest.value").alias("complement"))


def all_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the supplier within 100 ppm of 30 times the part's price, each quantity once."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_retailprice") * 30 * (1 - 1e-4)).alias("lo"), (F.col("p_retailprice") * 30 * (1 + 1e-4)).alias("hi"))
    theory = lines.select("l_suppkey", F.col("l_partkey").alias("part")).distinct().join(parts, "part")
    return joins.band_join(theory, lines.select("l_suppkey", "l_extendedprice", "l_quantity"), "lo", "hi", "l_extendedprice", 1e-3, ["l_suppkey"], F.log).select("l_suppkey", "part", "l_quantity").distinct()


def index_count_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and suppliers with at least four hits in price bins, the price window of the order as the precursor window."""
    lines = table(spark, sf_dir, "lineitem")
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"))
    priced = lines.select("l_orderkey", "l_suppkey", "l_partkey").join(prices, "l_partkey")
    near = priced.select("l_orderkey", "price", (F.col("price") - 0.01).alias("lo"), (F.col("price") + 0.01).alias("hi")).distinct()
    fragments = joins.fragment_bins(near, "lo", "hi", 100.0).select("l_orderkey", F.col("price").alias("observed"), "bin").distinct()
    index = priced.select("l_suppkey", F.col("price").alias("indexed"), F.rint(F.col("price") * 100).cast("bigint").alias("bin")).distinct()
    return joins.index_count_join(fragments, index, "l_orderkey", "l_suppkey", 4, F.abs(F.col("observed") - F.col("indexed")) <= 0.01)


def binned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and residue pairs in the same low-resolution bin."""
    pairs = spark.createDataFrame([(a + b, x + y) for a, x in RESIDUES.items() for b, y in RESIDUES.items() if a <= b], "pair string, pair_mass double")
    binned = pairs.withColumn("bin", F.rint(F.col("pair_mass") / 1.0005079).cast("bigint"))
    rows = table(spark, sf_dir, "psms").filter("score IS NOT NULL AND NOT isnan(score)").select("psm_id", F.rint(F.col("score") * 10 / 1.0005079).cast("bigint").alias("bin"))
    return rows.join(F.broadcast(binned), "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("psm_id").alias("n_psms"))


def pair_mass_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first part leaves of a line's price is looked up among all parts; (line, first, second, n_pairs) by distinct prices, first <= second, with the pairs of parts that have them."""
    price = F.round("p_retailprice", 2)
    parts = table(spark, sf_dir, "part").groupBy(price.alias("mass")).agg(F.count(F.lit(1)).alias("n")).filter("mass IS NOT NULL")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    first, second = parts.select(F.col("mass").alias("first"), "n"), parts.select(F.col("mass").alias("second"), F.col("n").alias("n2"))
    # The lower of two prices is at most half the sum and at least what the dearest part leaves; the exact bounds follow.
    targets = lines.select("l_extendedprice").distinct().join(F.broadcast(parts.agg(F.max("mass").alias("most"))))
    wanted = targets.select("l_extendedprice", (F.col("l_extendedprice") - F.col("most") - 0.1).alias("lo"), (F.col("l_extendedprice") / 2 + 0.1).alias("hi"))
    need = joins.band_join(wanted, first, "lo", "hi", "first", 50.0).select("l_extendedprice", "first", "n", (F.col("l_extendedprice") - F.col("first") - 0.05).alias("lo"), (F.col("l_extendedprice") - F.col("first") + 0.05).alias("hi"))
    found = joins.band_join(need, second, "lo", "hi", "second", 0.2).filter("first <= second")
    n_pairs = F.when(F.col("first") == F.col("second"), F.expr("n * (n + 1) DIV 2")).otherwise(F.col("n") * F.col("n2"))
    return lines.join(found.select("l_extendedprice", "first", "second", n_pairs.alias("n_pairs")), "l_extendedprice").select("l_orderkey", "l_linenumber", "first", "second", "n_pairs")


def priority_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first case that holds of each line."""
    q = F.col("l_quantity")
    case = joins.first_case([("single", q <= 5), ("dead_end_tris", q % 7 == 0), ("dead_end_h2o", q % 5 == 0), ("loop", F.col("l_discount") >= 0.08), ("cross", q > 20)])
    return table(spark, sf_dir, "lineitem").groupBy(case.alias("cross_type")).agg(F.count(F.lit(1)).alias("n"))


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "psms").filter("scan_number IS NOT NULL").select("psm_id", "full_file_path", "scan_number", "precursor_scan_number", "scan_retention_time")


def child_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later scans of the same file with the same precursor scan."""
    a = _scans(spark, sf_dir).filter("precursor_scan_number IS NOT NULL")
    b = a.select("full_file_path", "precursor_scan_number", F.col("scan_number").alias("child_scan"))
    return a.join(b, ["full_file_path", "precursor_scan_number"]).filter("child_scan > scan_number").select("psm_id", "child_scan").distinct()


def child_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that are no child of another."""
    a = _scans(spark, sf_dir)
    first = a.filter("precursor_scan_number IS NOT NULL").groupBy("full_file_path", "precursor_scan_number").agg(F.min("scan_number").alias("parent"))
    children = a.join(first, ["full_file_path", "precursor_scan_number"]).filter("scan_number > parent").select("psm_id")
    return a.join(children, "psm_id", "left_anti").select("psm_id")


def precursor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retention time of the precursor scan, the scan's own where it isn't there."""
    a = _scans(spark, sf_dir)
    known = a.groupBy("full_file_path", F.col("scan_number").alias("precursor_scan_number")).agg(F.min("scan_retention_time").alias("precursor_time"))
    return a.join(known, ["full_file_path", "precursor_scan_number"], "left").select("psm_id", F.coalesce("precursor_time", "scan_retention_time").alias("time_used"))


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "spectral_matches").filter("full_sequence IS NOT NULL AND precursor_charge IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return rows.groupBy("full_sequence", "precursor_charge").agg(F.max("score").alias("library_score"), F.count(F.lit(1)).alias("n_ions"), F.min("base_sequence").alias("base_sequence"))


def library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By full sequence and charge, else by base sequence and charge."""
    rows = table(spark, sf_dir, "psms").select("psm_id", "full_sequence", "base_sequence", "precursor_charge")
    out = joins.with_fallback(rows, _library(spark, sf_dir), ["full_sequence", "precursor_charge"], ["base_sequence", "precursor_charge"], "library_score")
    return out.select("psm_id", "library_score", "is_fallback")


def library_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    found = table(spark, sf_dir, "psms").filter("full_sequence IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").groupBy("full_sequence", "precursor_charge").agg(F.max("score").alias("score"))
    return joins.library_merge(_library(spark, sf_dir), found, ["full_sequence", "precursor_charge"], "n_ions", "score")


def shift_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass shifts within 0.02 of a residue's mass, added or removed."""
    named = [(f"Add {a}", m) for a, m in RESIDUES.items()] + [(f"Remove {a}", -m) for a, m in RESIDUES.items()]
    reference = spark.createDataFrame([(n, m - 0.02, m + 0.02) for n, m in named], "shift_name string, lo double, hi double")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 200 - 150).alias("shift"))
    return joins.band_join(reference, rows, "lo", "hi", "shift", 1.0).groupBy("shift_name").agg(F.count(F.lit(1)).alias("n"))


def modification_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts made by one modification or by two, the third branch's second mass looked up."""
    mods = spark.createDataFrame([("Oxidation", 15.994915), ("Methylation", 14.01565), ("Acetylation", 42.010565), ("Phosphorylation", 79.966331), ("Carbamylation", 43.005814), ("None", 0.0)], "mod string, mass double")
    shifts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("shift"))
    return joins.pairs_to_sum(mods, shifts, "mass", "mod", "shift", 0.002).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))


def time_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of one file whose apex times, rounded to 2 places, are within 0.5; of two, the lower charge is the precursor, the higher one the fragment."""
    rows = table(spark, sf_dir, "psms").filter("scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time)")
    apex = rows.select("psm_id", "full_file_path", "precursor_charge", F.round("scan_retention_time", 2).alias("apex"))
    a = apex.select("full_file_path", F.col("psm_id").alias("precursor_id"), F.col("precursor_charge").alias("lower"), (F.col("apex") - 0.5).alias("lo"), (F.col("apex") + 0.5).alias("hi"))
    b = apex.select("full_file_path", F.col("psm_id").alias("fragment_id"), F.col("precursor_charge").alias("higher"), "apex")
    return joins.band_join(a, b, "lo", "hi", "apex", 1.0, ["full_file_path"]).filter("lower < higher").select("precursor_id", "fragment_id")


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the spans of the customers' order dates overlap within a nation and segment, each pair of customers once.

    Equal spans are joined once with their number, and the pairs are summed up where they are formed.
    """
    keys = ["c_nationkey", "c_mktsegment"]
    days = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01"))
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(days).alias("a"), F.max(days).alias("b"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), *keys)
    first = spans.join(who, "o_custkey").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    second = first.select(*keys, F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    same = (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))
    pairs = first.join(second, keys).filter("a < a2 OR a = a2 AND b <= b2").withColumn("w", F.when(same, F.expr("n * (n - 1) DIV 2")).otherwise(F.col("n") * F.col("n2"))).filter("w > 0")
    overlap = overlap_ratio(F.col("a"), F.col("b"), F.col("a2"), F.col("b2"))
    return pairs.groupBy(*keys).agg(F.sum("w").alias("n_pairs"), F.round(F.sum(overlap * F.col("w")) / F.sum("w"), 6).alias("mean_overlap"))


def decoy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and decoy matches of each accession, paired by the accession without its prefix."""
    one = table(spark, sf_dir, "psms").select(F.explode(accessions("accession")).alias("accession"))
    base = F.regexp_replace("accession", "^DECOY_", "")
    return one.groupBy(base.alias("base_accession")).agg(F.sum(F.when(F.col("accession").startswith("DECOY_"), 0).otherwise(1)).alias("n_target"), F.sum(F.when(F.col("accession").startswith("DECOY_"), 1).otherwise(0)).alias("n_decoy"))


def shared_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches whose base sequence a search task's record has too."""
    rows = table(spark, sf_dir, "psms").select("psm_id", "base_sequence")
    return rows.join(table(spark, sf_dir, "spectral_matches").select("base_sequence"), "base_sequence", "left_semi").select("psm_id")


def reporter_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each spectrum the highest peak around each of eight reporters, 0 if none is positive; peaks are used once."""
    spectrum = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("peaks"))
    channels = [F.round(F.greatest(F.array_max(F.slice("peaks", 8 * k + 3, 3)), F.lit(0.0)), 6).alias(f"reporter_{k + 1}") for k in range(8)]
    return spectrum.select("vec_id", *channels)


def coisolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The precursors that share a scan."""
    rows = table(spark, sf_dir, "psms").filter("scan_number IS NOT NULL AND precursor_mz IS NOT NULL")
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("psm_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("full_file_path", "scan_number").agg(F.count(F.lit(1)).alias("n"), ids.alias("psm_ids")).filter("n > 1")


def _walk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01"))
    per_day = table(spark, sf_dir, "orders").groupBy("o_orderpriority", days.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.join(per_day.groupBy("o_orderpriority").agg(F.max_by("day", F.struct("n", "day")).alias("start")), "o_orderpriority")


def outward_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the busiest day of each priority outwards while a day has orders."""
    out = joins.outward_walk(_walk_rows(spark, sf_dir).withColumn("found", F.col("n") >= 2), ["o_orderpriority"], "start", "day", "found")
    return out.groupBy("o_orderpriority").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n_orders"))


def mass_acceptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5a, F5b, F5d, F5e and F6: how many matches each mass-difference acceptor takes."""
    from massloom.operators.filters import accepted, parse_acceptor

    rows = _observed(spark, sf_dir)
    texts = ("OneMM dot 5 ppm 0,1.0029", "ThreeMM dot 5 ppm 0,1.0029,2.0052,3.0077", "Win interval [-0.01,0.01];[0.99,1.02]", "Da daltonsAroundZero 0.005", "Ppm ppmAroundZero 2", "Any OpenSearch")
    sums = [F.sum(F.when(accepted(parse_acceptor(t), F.col("observed"), F.col("mass")).isNotNull(), 1).otherwise(0)).alias(t.split()[0].lower()) for t in texts]
    return rows.agg(*sums)


_LIB = "lib AS (SELECT full_sequence, precursor_charge, max(score) AS library_score, count(*) AS n_ions, min(base_sequence) AS base_sequence FROM spectral_matches WHERE full_sequence IS NOT NULL AND precursor_charge IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)"
_NEAREST = """SELECT {out} FROM (SELECT t.*, lo.v AS below, hi.v AS above FROM t ASOF LEFT JOIN v lo ON t.l_suppkey = lo.l_suppkey AND t.theory >= lo.v ASOF LEFT JOIN v hi ON t.l_suppkey = hi.l_suppkey AND t.theory <= hi.v)"""
_PICK = "CASE WHEN below IS NULL OR theory - below > above - theory THEN above ELSE below END"
_RES = ", ".join(f"('{a}', {m!r})" for a, m in RESIDUES.items())

QUERIES = {f.__name__: f for f in (band_join_ppm, band_join_notches, nearest_match, complementary_match, all_in_range, index_count_join, binned_join, pair_mass_join, priority_cases, child_scans, child_anti_join, precursor_lookup, library_lookup, library_merge, shift_lookup, modification_candidates, time_band_join, overlap_join, decoy_pairs, shared_sequences, reporter_ions, coisolated, outward_walk, mass_acceptors)}
SQL = {
    "band_join_ppm": "SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON l_extendedprice BETWEEN p_retailprice * (1 - 200e-6) AND p_retailprice * (1 + 200e-6)",
    "band_join_notches": f"WITH {_MASSES}, th AS (SELECT DISTINCT mass AS theory FROM masses), nt(notch, shift) AS (VALUES (0, 0.0::DOUBLE), (1, 1.00335::DOUBLE), (2, 2.0067::DOUBLE)), ob AS (SELECT psm_id, notch, (observed - shift) * (1 - 1e-6) AS lo, (observed - shift) * (1 + 1e-6) AS hi FROM masses, nt) SELECT psm_id, notch, count(*) AS n_theories FROM ob JOIN th ON theory BETWEEN lo AND hi GROUP BY ALL",
    "nearest_match": "WITH t AS (SELECT DISTINCT l_suppkey, l_partkey, p_retailprice * 30 AS theory FROM lineitem JOIN part ON p_partkey = l_partkey), v AS (SELECT DISTINCT l_suppkey, l_extendedprice AS v FROM lineitem) " + _NEAREST.format(out=f"l_suppkey, l_partkey, {_PICK} AS nearest_price, ({_PICK}) BETWEEN theory * 0.9995 AND theory * 1.0005 AS is_match"),
    "complementary_match": "WITH m AS (SELECT l_suppkey, max(l_extendedprice) AS total FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey, l_partkey, any_value(total) - min(l_extendedprice) AS theory FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1, 2), v AS (SELECT DISTINCT l_suppkey, l_extendedprice AS v FROM lineitem) " + _NEAREST.format(out=f"l_suppkey, l_partkey, {_PICK} AS complement"),
    "all_in_range": "WITH t AS (SELECT DISTINCT l_suppkey, l_partkey AS part, p_retailprice * 30 * (1 - 1e-4) AS lo, p_retailprice * 30 * (1 + 1e-4) AS hi FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT DISTINCT t.l_suppkey, part, l_quantity FROM t JOIN lineitem l ON l.l_suppkey = t.l_suppkey AND l_extendedprice BETWEEN lo AND hi",
    "index_count_join": "WITH p AS (SELECT l_orderkey, l_suppkey, p_retailprice AS price FROM lineitem JOIN part ON p_partkey = l_partkey), f AS (SELECT DISTINCT l_orderkey, price AS observed, unnest(generate_series(CAST(floor((price - 0.01::DOUBLE) * 100) AS BIGINT), CAST(ceil((price + 0.01::DOUBLE) * 100) AS BIGINT))) AS bin FROM p), i AS (SELECT DISTINCT l_suppkey, price AS indexed, CAST(round_even(price * 100, 0) AS BIGINT) AS bin FROM p) SELECT l_orderkey, l_suppkey, count(*) AS n_hits FROM f JOIN i USING (bin) WHERE abs(observed - indexed) <= 0.01 GROUP BY ALL HAVING count(*) >= 4",
    "binned_join": f"WITH r(a, m) AS (VALUES {_RES}), b AS (SELECT CAST(round_even((x.m + y.m) / 1.0005079::DOUBLE, 0) AS BIGINT) AS bin FROM r x JOIN r y ON x.a <= y.a), s AS (SELECT psm_id, CAST(round_even(score * 10 / 1.0005079::DOUBLE, 0) AS BIGINT) AS bin FROM psms WHERE score IS NOT NULL AND NOT isnan(score)) SELECT bin, count(*) AS n_hits, count(DISTINCT psm_id) AS n_psms FROM s JOIN b USING (bin) GROUP BY ALL",
    "pair_mass_join": "WITH m AS (SELECT round(p_retailprice, 2) AS mass, count(*) AS n FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1), s AS (SELECT a.mass AS first, b.mass AS second, a.mass + b.mass AS total, CASE WHEN a.mass = b.mass THEN a.n * (a.n + 1) // 2 ELSE a.n * b.n END AS n_pairs FROM m a JOIN m b ON a.mass <= b.mass), x AS (SELECT DISTINCT l_extendedprice AS x FROM lineitem), f AS (SELECT * FROM x JOIN s ON total BETWEEN x - 0.06 AND x + 0.06) SELECT l_orderkey, l_linenumber, first, second, n_pairs FROM lineitem JOIN f ON l_extendedprice = x WHERE second BETWEEN x - first - 0.05 AND x - first + 0.05",
    "priority_cases": "SELECT CASE WHEN l_quantity <= 5 THEN 'single' WHEN l_quantity % 7 = 0 THEN 'dead_end_tris' WHEN l_quantity % 5 = 0 THEN 'dead_end_h2o' WHEN l_discount >= 0.08 THEN 'loop' WHEN l_quantity > 20 THEN 'cross' END AS cross_type, count(*) AS n FROM lineitem GROUP BY 1",
    "child_scans": "SELECT DISTINCT a.psm_id, b.scan_number AS child_scan FROM psms a JOIN psms b ON a.full_file_path = b.full_file_path AND a.precursor_scan_number = b.precursor_scan_number AND b.scan_number > a.scan_number",
    "child_anti_join": "WITH f AS (SELECT full_file_path AS p, precursor_scan_number AS q, min(scan_number) AS parent FROM psms WHERE scan_number IS NOT NULL GROUP BY 1, 2) SELECT psm_id FROM psms WHERE scan_number IS NOT NULL AND NOT EXISTS (FROM f WHERE p = full_file_path AND q = precursor_scan_number AND scan_number > parent)",
    "precursor_lookup": "SELECT psm_id, coalesce(t, scan_retention_time) AS time_used FROM psms LEFT JOIN (SELECT full_file_path AS p, scan_number AS s, min(scan_retention_time) AS t FROM psms GROUP BY 1, 2) ON p = full_file_path AND s = precursor_scan_number WHERE scan_number IS NOT NULL",
    "library_lookup": f"WITH {_LIB}, fb AS (SELECT base_sequence, precursor_charge, min(library_score) AS f FROM lib GROUP BY 1, 2) SELECT psm_id, coalesce(library_score, f) AS library_score, library_score IS NULL AND f IS NOT NULL AS is_fallback FROM psms LEFT JOIN lib ON lib.full_sequence = psms.full_sequence AND lib.precursor_charge = psms.precursor_charge LEFT JOIN fb ON fb.base_sequence = psms.base_sequence AND fb.precursor_charge = psms.precursor_charge",
    "library_merge": f"WITH {_LIB}, fo AS (SELECT full_sequence, precursor_charge, max(score) AS score FROM psms WHERE full_sequence IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2) SELECT full_sequence, precursor_charge, CASE WHEN score IS NULL OR n_ions > floor(score) THEN 'library' ELSE 'match' END AS taken_from FROM lib FULL JOIN fo USING (full_sequence, precursor_charge)",
    "shift_lookup": f"WITH r(a, m) AS (VALUES {_RES}), s AS (SELECT 'Add ' || a AS shift_name, m - 0.02 AS lo, m + 0.02 AS hi FROM r UNION ALL SELECT 'Remove ' || a, -m - 0.02, -m + 0.02 FROM r) SELECT shift_name, count(*) AS n FROM s JOIN lineitem ON l_extendedprice / 200 - 150 BETWEEN lo AND hi GROUP BY 1",
    "modification_candidates": "WITH m(mod, mass) AS (VALUES ('Oxidation', 15.994915::DOUBLE), ('Methylation', 14.01565), ('Acetylation', 42.010565), ('Phosphorylation', 79.966331), ('Carbamylation', 43.005814), ('None', 0.0)), s AS (SELECT a.mod AS first, b.mod AS second, a.mass AS ma, b.mass AS mb FROM m a JOIN m b ON a.mod <= b.mod) SELECT first, second, count(*) AS n FROM lineitem JOIN s ON mb BETWEEN l_extendedprice / 1000 - ma - 0.002 AND l_extendedprice / 1000 - ma + 0.002 GROUP BY 1, 2",
    "time_band_join": "WITH x AS (SELECT psm_id, full_file_path, precursor_charge, round(scan_retention_time, 2) AS apex FROM psms WHERE scan_retention_time IS NOT NULL AND NOT isnan(scan_retention_time)) SELECT a.psm_id AS precursor_id, b.psm_id AS fragment_id FROM x a JOIN x b ON a.full_file_path = b.full_file_path AND a.precursor_charge < b.precursor_charge AND b.apex BETWEEN a.apex - 0.5 AND a.apex + 0.5",
    "overlap_join": "WITH s AS (SELECT o_custkey AS k, date_diff('day', DATE '1990-01-01', CAST(min(o_orderdate) AS DATE)) AS a, date_diff('day', DATE '1990-01-01', CAST(max(o_orderdate) AS DATE)) AS b, any_value(c_nationkey) AS c_nationkey, any_value(c_mktsegment) AS c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), p AS (SELECT c_nationkey, c_mktsegment, least(x.b, y.b) - greatest(x.a, y.a) AS common, greatest(x.b, y.b) - least(x.a, y.a) AS span FROM s x JOIN s y USING (c_nationkey, c_mktsegment) WHERE x.k < y.k) SELECT c_nationkey, c_mktsegment, count(*) AS n_pairs, round(avg(CASE WHEN common <= 0 OR span <= 0 THEN 0.0::DOUBLE ELSE common / span END), 6) AS mean_overlap FROM p GROUP BY 1, 2",
    "decoy_pairs": "WITH a AS (SELECT unnest(list_distinct(regexp_extract_all(accession, '[A-Za-z0-9_-]+'))) AS accession FROM psms) SELECT regexp_replace(accession, '^DECOY_', '') AS base_accession, CAST(sum((NOT starts_with(accession, 'DECOY_'))::INT) AS BIGINT) AS n_target, CAST(sum(starts_with(accession, 'DECOY_')::INT) AS BIGINT) AS n_decoy FROM a GROUP BY 1",
    "shared_sequences": "SELECT psm_id FROM psms WHERE base_sequence IN (SELECT base_sequence FROM spectral_matches WHERE base_sequence IS NOT NULL)",
    "reporter_ions": "SELECT vec_id, " + ", ".join(f"round(greatest(list_max(list_transform(embedding[{8 * k + 3}:{8 * k + 5}], lambda x: CAST(x AS DOUBLE))), 0.0), 6) AS reporter_{k + 1}" for k in range(8)) + " FROM embeddings",
    "coisolated": "SELECT full_file_path, scan_number, count(*) AS n, array_to_string(list_sort(list(DISTINCT psm_id)), ',') AS psm_ids FROM psms WHERE scan_number IS NOT NULL AND precursor_mz IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "outward_walk": "WITH p AS (SELECT o_orderpriority, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT o_orderpriority, arg_max(day, n * 100000 + day) AS start FROM p GROUP BY 1), i AS (SELECT o_orderpriority, day, n, start, day - row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) AS isl FROM p JOIN s USING (o_orderpriority) WHERE n >= 2), k AS (SELECT *, bool_or(day BETWEEN start - 1 AND start + 1) OVER (PARTITION BY o_orderpriority, isl) AS near FROM i) SELECT o_orderpriority, min(day) AS first_day, max(day) AS last_day, CAST(sum(n) AS BIGINT) AS n_orders FROM k WHERE near GROUP BY 1",
    "mass_acceptors": f"""WITH {_MASSES} SELECT CAST(sum((abs(observed - mass) <= mass * 5e-6 OR abs(observed - mass - 1.0029) <= (mass + 1.0029) * 5e-6)::INT) AS BIGINT) AS onemm,
        CAST(sum((abs(observed - mass) <= mass * 5e-6 OR abs(observed - mass - 1.0029) <= (mass + 1.0029) * 5e-6 OR abs(observed - mass - 2.0052) <= (mass + 2.0052) * 5e-6 OR abs(observed - mass - 3.0077) <= (mass + 3.0077) * 5e-6)::INT) AS BIGINT) AS threemm,
        CAST(sum((observed - mass BETWEEN -0.01 AND 0.01 OR observed - mass BETWEEN 0.99 AND 1.02)::INT) AS BIGINT) AS win, CAST(sum((abs(observed - mass) < 0.005)::INT) AS BIGINT) AS da, CAST(sum((abs((observed - mass) / mass * 1e6) < 2)::INT) AS BIGINT) AS ppm, count(*) AS "any" FROM masses""",
}
