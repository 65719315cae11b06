"""Readers of the field's file formats as DataFrames (S1-S16). Texts are split into records by Spark and parsed by built-in functions."""

from __future__ import annotations

import base64
import os
import tomllib
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions.text import bound
from massloom.operators.bad_rows import DESIGN_RULES, bad_rows, good_rows

#: The accepted endings.
SPECTRA = (".raw", ".mzml", ".mgf", ".msalign", ".tdf", ".tdf_bin", ".d")
DATABASES = (".fasta", ".fa", ".xml", ".msp")


def kind_of(path: str) -> str:
    """`spectra` or `database` by a file's ending, compression aside (S1); other files raise ValueError."""
    bare = path.lower().removesuffix(".gz").rstrip("/")
    for kind, endings in (("spectra", SPECTRA), ("database", DATABASES)):
        if bare.endswith(endings):
            return kind
    raise ValueError(f"not a file of spectra or a database: {path!r}")


def spectra_in(folders: Sequence[str]) -> list[str]:
    """The spectra files in folders and their subfolders (S14); a `.d` folder is a file."""
    found = []
    for folder in folders:
        for here, folders_here, files in os.walk(folder):
            d = [x for x in folders_here if x.lower().endswith(".d")]
            found += [os.path.join(here, x) for x in [*d, *files] if x.lower().endswith(SPECTRA)]
            folders_here[:] = [x for x in folders_here if x not in d]
    return sorted(found)


def _field(col: str, pattern: str) -> Column:
    found = F.regexp_extract(col, pattern, 1)
    return F.when(found != "", found)


def read_fasta(spark: SparkSession, paths: str | Sequence[str], contaminants: bool = False) -> DataFrame:
    """(accession, full_name, organism, gene, base_sequence, is_contaminant), proteins or RNA (S4, S5); entries without a sequence are kept for counting."""
    records = spark.read.option("lineSep", "\n>").text(paths)
    lines = F.split(F.regexp_replace("value", "^>", ""), r"\r?\n", 2)
    cut = records.select(F.trim(lines[0]).alias("header"), F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"[\s*]", "")).alias("base_sequence")).filter("header <> ''")
    accession = F.coalesce(_field("header", r"^[^|\s]*\|([^|\s]+)\|"), _field("header", r"^(\S+)"))
    return cut.select(accession.alias("accession"), _field("header", r"^\S+\s+(.*?)(?:\s+O[SX]=|$)").alias("full_name"), _field("header", r"OS=(.*?)(?:\s+[A-Z]{2}=|$)").alias("organism"), _field("header", r"GN=(\S+)").alias("gene"), "base_sequence", F.lit(contaminants).alias("is_contaminant"))


def with_sequence(databases: Sequence[DataFrame]) -> tuple[DataFrame, int]:
    """All databases as one without empty sequences, and how many of those there were."""
    every = databases[0]
    for d in databases[1:]:
        every = every.unionByName(d)
    return every.filter(F.length("base_sequence") > 0), every.filter(F.coalesce(F.length("base_sequence"), F.lit(0)) == 0).count()


def database_counts(databases: Sequence[DataFrame], decoy: str = "DECOY_") -> DataFrame:
    """(is_contaminant, n_targets, n_decoys, n_empty) of all databases together (S6), by one scan."""
    every = databases[0]
    for d in databases[1:]:
        every = every.unionByName(d)
    empty = F.coalesce(F.length("base_sequence"), F.lit(0)) == 0
    is_decoy = F.col("accession").startswith(decoy)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return every.groupBy("is_contaminant").agg(count(~empty & ~is_decoy).alias("n_targets"), count(~empty & is_decoy).alias("n_decoys"), count(empty).alias("n_empty"))


def filtered_spectra(spectra: DataFrame, keys: Sequence[str], per_window: int = 200, window: float | None = None, least_ratio: float = 0.01, low_cid: bool = False) -> DataFrame:
    """Spectra (`keys`, mz, intensity) with their highest peaks only (S2, F13): of each window up to `per_window`, of `least_ratio` of the base peak at least.

    Spectra of low-energy CID stay as they are. A spectrum stays where its arrays are, so nothing is shuffled; null and empty ones stay.
    """
    if low_cid:
        return spectra
    pairs = F.arrays_zip(F.col("mz").alias("mz"), F.col("intensity").alias("intensity"))
    base = F.array_max("intensity") * least_ratio
    strong = F.filter(pairs, lambda p: p["intensity"] >= base)
    ranked = F.array_sort(F.transform(strong, lambda p: F.struct((F.floor(p["mz"] / window) if window else F.lit(0).cast("bigint")).alias("w"), (-p["intensity"]).alias("i"), p["mz"].alias("mz"))))
    # In the order of windows and intensity a peak's place within its window is its distance from the window's first one.
    kept = bound(ranked, lambda r: bound(F.transform(r, lambda x: x["w"]), lambda w: F.filter(r, lambda x, i: i + 1 - F.array_position(w, x["w"]) < per_window)))
    by_mz = F.array_sort(F.transform(kept, lambda x: F.struct(x["mz"].alias("mz"), (-x["i"]).alias("intensity"))))
    has = F.size("mz") > 0
    return spectra.withColumn("kept__", F.when(has, by_mz)).withColumn("mz", F.when(has, F.transform("kept__", lambda p: p["mz"])).otherwise(F.col("mz"))).withColumn("intensity", F.when(has, F.transform("kept__", lambda p: p["intensity"])).otherwise(F.col("intensity"))).drop("kept__")


def read_protein_xml(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(accession, full_name, gene, organism, base_sequence, features) of the entries of a protein XML file.

    Files are cut at the ends of entries, so a part of a document, which has no root of its own, gives all its entries too.
    """
    feature = T.StructType([T.StructField(n, T.StringType()) for n in ("_type", "_description", "original", "variation")] + [T.StructField("location", T.StructType([T.StructField(n, T.StructType([T.StructField("_position", T.IntegerType())])) for n in ("position", "begin", "end")]))])
    text = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_type", T.StringType())])
    schema = T.StructType([
        T.StructField("accession", T.ArrayType(T.StringType())), T.StructField("name", T.StringType()),
        T.StructField("gene", T.ArrayType(T.StructType([T.StructField("name", T.ArrayType(text))]))),
        T.StructField("organism", T.StructType([T.StructField("name", T.ArrayType(text))])),
        T.StructField("feature", T.ArrayType(feature)), T.StructField("sequence", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_length", T.IntegerType())])),
    ])
    # Entries don't nest: the last start before an end is that entry's.
    entry = spark.read.option("lineSep", "</entry>").text(paths).select(F.regexp_extract("value", r"(?s).*(<entry[\s>].*)", 1).alias("entry")).filter("entry <> ''")
    rows = entry.select(F.from_xml(F.concat("entry", F.lit("</entry>")), schema).alias("e")).select("e.*")
    spans = F.transform(F.coalesce("feature", F.array().cast(T.ArrayType(feature))), lambda f: F.struct(f["_type"].alias("type"), f["_description"].alias("description"), f["original"].alias("original"), f["variation"].alias("variation"), F.coalesce(f["location"]["position"]["_position"], f["location"]["begin"]["_position"]).alias("begin"), F.coalesce(f["location"]["position"]["_position"], f["location"]["end"]["_position"]).alias("end")))
    return rows.select(F.col("accession")[0].alias("accession"), F.col("name").alias("full_name"), F.col("gene")[0]["name"][0]["_VALUE"].alias("gene"), F.col("organism.name")[0]["_VALUE"].alias("organism"), F.regexp_replace("sequence._VALUE", r"\s", "").alias("base_sequence"), spans.alias("features"))


def _numbers(lines: Column, place: int) -> Column:
    return F.transform(lines, lambda x: F.split(x, r"[\s]+")[place].try_cast("double"))


def read_mgf(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, title, precursor_mz, precursor_intensity, charge, retention_time, mz, intensity) of each spectrum (S2); times are minutes."""
    records = spark.read.option("lineSep", "END IONS").text(paths).select("value", F.col("_metadata.file_path").alias("file")).filter(F.contains("value", F.lit("BEGIN IONS")))
    lines = F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x))
    cut = records.withColumn("peaks", F.filter(lines, lambda x: x.rlike(r"^[0-9.]+\s+[0-9.eE+-]+")))
    mass = _field("value", r"PEPMASS=([0-9.eE+-]+)").try_cast("double")
    return cut.select(
        "file", _field("value", r"TITLE=([^\r\n]*)").alias("title"), mass.alias("precursor_mz"), _field("value", r"PEPMASS=\S+[ \t]+([0-9.eE+-]+)").try_cast("double").alias("precursor_intensity"),
        (_field("value", r"CHARGE=(\d+)").try_cast("int") * F.when(F.col("value").rlike(r"CHARGE=\d+-"), -1).otherwise(1)).alias("charge"), (_field("value", r"RTINSECONDS=([0-9.]+)").try_cast("double") / 60).alias("retention_time"),
        _numbers(F.col("peaks"), 0).alias("mz"), _numbers(F.col("peaks"), 1).alias("intensity"),
    )


def decode_array(text: str | None, wide: bool, packed: bool) -> np.ndarray:
    """The numbers of a binary array of an mzML file."""
    raw = base64.b64decode(text or "")
    if packed and raw:
        raw = zlib.decompress(raw)
    return np.frombuffer(raw, "<f8" if wide else "<f4").astype(float)


def read_mzml(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, scan_id, ms_level, retention_time, precursor_mz, charge, isolation_mz, mz, intensity) of each spectrum."""
    cv = T.ArrayType(T.StructType([T.StructField("_accession", T.StringType()), T.StructField("_value", T.StringType()), T.StructField("_unitName", T.StringType())]))
    params = [T.StructField("cvParam", cv)]
    ion = T.StructType([T.StructField("selectedIon", T.ArrayType(T.StructType(params)))])
    precursor = T.StructType([T.StructField("precursor", T.ArrayType(T.StructType([T.StructField("_spectrumRef", T.StringType()), T.StructField("isolationWindow", T.StructType(params)), T.StructField("selectedIonList", ion)])))])
    schema = T.StructType([
        T.StructField("_id", T.StringType()), T.StructField("_index", T.LongType()), *params,
        T.StructField("scanList", T.StructType([T.StructField("scan", T.ArrayType(T.StructType(params)))])), T.StructField("precursorList", precursor),
        T.StructField("binaryDataArrayList", T.StructType([T.StructField("binaryDataArray", T.ArrayType(T.StructType([*params, T.StructField("binary", T.StringType())])))])),
    ])
    rows = spark.read.format("xml").option("rowTag", "spectrum").schema(schema).load(paths).withColumn("file", F.col("_metadata.file_path"))

    def value(params: Column, accession: str) -> Column:
        return F.try_element_at(F.filter(params, lambda p: p["_accession"] == accession), F.lit(1))["_value"]

    def has(params: Column, accession: str) -> Column:
        return F.exists(params, lambda p: p["_accession"] == accession)

    def array_of(accession: str) -> Column:
        return F.try_element_at(F.filter("binaryDataArrayList.binaryDataArray", lambda a: has(a["cvParam"], accession)), F.lit(1))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def decoded(text: pd.Series, wide: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series([decode_array(*x) for x in zip(text, wide.fillna(False), packed.fillna(False), strict=True)])

    def numbers(accession: str) -> Column:
        a = array_of(accession)
        return decoded(a["binary"], has(a["cvParam"], "MS:1000523"), has(a["cvParam"], "MS:1000574"))

    scan = F.col("scanList.scan")[0]["cvParam"]
    time = F.try_element_at(F.filter(scan, lambda p: p["_accession"] == "MS:1000016"), F.lit(1))
    minutes = time["_value"].try_cast("double") / F.when(time["_unitName"] == "second", 60.0).otherwise(1.0)
    first = F.col("precursorList.precursor")[0]
    selected = first["selectedIonList"]["selectedIon"][0]["cvParam"]
    return rows.select("file", F.col("_id").alias("scan_id"), value(F.col("cvParam"), "MS:1000511").try_cast("int").alias("ms_level"), minutes.alias("retention_time"), value(selected, "MS:1000744").try_cast("double").alias("precursor_mz"), value(selected, "MS:1000041").try_cast("int").alias("charge"), value(first["isolationWindow"]["cvParam"], "MS:1000827").try_cast("double").alias("isolation_mz"), numbers("MS:1000514").alias("mz"), numbers("MS:1000515").alias("intensity"))


def read_msp(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(sequence, charge, mw, retention_time, mz, intensity, ions) of each library spectrum."""
    records = spark.read.option("lineSep", "\nName: ").text(paths).filter(F.contains("value", F.lit("Num peaks")))
    lines = F.split(F.regexp_replace("value", r"^(?:\x{FEFF})?Name: ", ""), r"\r?\n")
    peaks = F.filter(lines, lambda x: x.rlike(r"^[0-9.]+\s+[0-9.eE+-]+"))
    name = F.trim(lines[0])
    return records.select(F.regexp_extract(name, r"^(.*)/(-?\d+)$", 1).alias("sequence"), F.regexp_extract(name, r"^(.*)/(-?\d+)$", 2).try_cast("int").alias("charge"), _field("value", r"MW:\s*([0-9.]+)").try_cast("double").alias("mw"), _field("value", r"(?:iRT|RetentionTime)=([0-9.-]+)").try_cast("double").alias("retention_time"), _numbers(peaks, 0).alias("mz"), _numbers(peaks, 1).alias("intensity"), F.transform(peaks, lambda x: F.regexp_extract(x, r'"([^"/]+)', 1)).alias("ions"))


def read_modifications(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(modification_id, target, position, mod_type, formula) of each record and each of its targets."""
    records = spark.read.option("lineSep", "\n//").text(paths).filter(F.col("value").rlike(r"(?m)^\s*ID\s+\S"))
    get = lambda tag: F.trim(_field("value", rf"(?m)^\s*{tag}\s+([^\r\n]*)"))
    return records.select(get("ID").alias("modification_id"), F.explode_outer(F.split(get("TG"), r"\s+or\s+")).alias("target"), get("PP").alias("position"), get("MT").alias("mod_type"), get("CF").alias("formula"))


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, sep: str = "\t") -> DataFrame:
    """A text table with a header: crosslinkers (S9), proteases (S16), matches."""
    reader = spark.read.option("sep", sep).option("header", True).option("quote", "")
    return (reader.schema(schema) if schema else reader).csv(paths)


def read_matches(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A written table of matches with typed columns (S15); cells of several values stay text and are null as numbers."""
    rows = read_table(spark, paths)
    kinds = {"Scan Number": "int", "Precursor Charge": "int", "Precursor Scan Number": "int", "Scan Retention Time": "double", "Total Ion Current": "double", "Precursor MZ": "double", "Precursor Mass": "double", "Score": "double", "Delta Score": "double", "QValue": "double", "QValue Notch": "double", "PEP": "double", "PEP_QValue": "double"}
    return rows.withColumns({c: F.expr(f"try_cast(trim(`{c}`) AS {k})") for c, k in kinds.items() if c in rows.columns})


def read_combos(spark: SparkSession, paths: str | Sequence[str], masses: DataFrame | None = None, mass: str = "mass", tolerance: float = 0.001) -> DataFrame:
    """(first, second): pairs of masses, if `masses` is given those near one of its masses on both sides."""
    parts = F.split(F.trim(F.regexp_replace("value", "^\\x{FEFF}", "")), r"\s+")
    pairs = spark.read.text(paths).filter(F.col("value").rlike(r"\d")).select(parts[0].try_cast("double").alias("first"), parts[1].try_cast("double").alias("second"))
    if masses is None:
        return pairs
    # Masses within the tolerance are in the same bin or the next one.
    bin_of = lambda c: F.floor(c / tolerance)
    known = masses.select(F.col(mass).alias("mass__")).distinct().withColumn("bin__", F.explode(F.array(*[bin_of(F.col("mass__")) + k for k in (-1, 0, 1)])))
    for side in ("first", "second"):
        pairs = pairs.join(known, (bin_of(F.col(side)) == F.col("bin__")) & (F.abs(F.col(side) - F.col("mass__")) < tolerance), "left_semi")
    return pairs


#: A record: quoted cells, in which line breaks are text, and the rest of the line. A quote that no cell's end closes is an ordinary character here.
_RECORD = r'(?:(?<![^\t\n])"(?:[^"]++|"")*+"(?=[\t\r\n]|\z)|"|[^"\n]++)*+(?:\n|\z)'


def read_design(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of an ExperimentalDesign.tsv: typed rows, and the records that fail with their reasons.

    A record may hold line breaks inside quotes; an empty one is an error of its own.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract_all("value", F.lit(_RECORD), 0).alias("records"))
    # The break at the end of the last record begins no other.
    kept = F.when(F.element_at("records", -1) == "", F.slice("records", 1, F.size("records") - 1)).otherwise(F.col("records"))
    lines = whole.select(F.posexplode(kept).alias("line_no", "record")).filter("line_no > 0").select("line_no", F.regexp_replace("record", r"\n\z", "").alias("raw_line"))
    return good_rows(lines, "line_no", "raw_line", DESIGN_RULES), bad_rows(lines, "line_no", "raw_line", DESIGN_RULES)


def design_errors(design: DataFrame, files: DataFrame, file: str = "FileName") -> DataFrame:
    """(error, detail): files without a row, repeated places and gaps in the numbers of replicates and fractions (S11); extra rows are no error."""
    missing = files.join(design, file, "left_anti").select(F.lit("missing_file").alias("error"), F.col(file).alias("detail"))
    used = design.join(files, file, "left_semi")
    place = F.concat_ws("/", "Condition", *[F.col(c).cast("string") for c in ("Biorep", "Fraction", "Techrep")])
    twice = used.groupBy(place.alias("detail")).count().filter("count > 1").select(F.lit("repeated_place").alias("error"), "detail")
    out = missing.unionByName(twice)
    for level, within in (("Biorep", ["Condition"]), ("Fraction", ["Condition", "Biorep"]), ("Techrep", ["Condition", "Biorep", "Fraction"])):
        gaps = used.groupBy(*within).agg(F.max(level).alias("most"), F.countDistinct(level).alias("n")).filter("most <> n")
        out = out.unionByName(gaps.select(F.lit(f"gap_in_{level.lower()}").alias("error"), F.concat_ws("/", *[F.col(c).cast("string") for c in within]).alias("detail")))
    return out


def read_config(path: str, override: str | None = None) -> dict:
    """A task's TOML settings, those of a file beside it taking precedence section by section."""
    with open(path, "rb") as f:
        settings = tomllib.load(f)
    if override and os.path.exists(override):
        with open(override, "rb") as f:
            for k, v in tomllib.load(f).items():
                settings.setdefault("CommonParameters", {})[k] = v
    return settings


def parse_tolerance(text: str) -> tuple[float, bool]:
    """(value, whether in ppm) of `±5.0000 PPM` or `±0.3500 Absolute`."""
    value, unit = text.replace("±", "").split()
    if unit.lower() not in ("ppm", "absolute"):
        raise ValueError(f"not a tolerance: {text!r}")
    return float(value), unit.lower() == "ppm"
