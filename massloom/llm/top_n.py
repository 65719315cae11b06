"""Top N rows of every group by statistics-guided skipping.

The rows are laid out once, clustered by group and sorted by score within it (`cluster_rows`). A range partitioning on group and
score together puts a hot group in as many files as it needs. Reading (`top_n`) takes each file's row groups in descending maximum score
and skips those strictly below the N-th score that every group in them already has: within a file by what was read, between files by
the row groups' statistics. Only groups at the edges of a file can lie in several files, and only their rows are merged by a shuffle.
`kept_layout` writes the layout of the same files once a process, so later calls, for whatever N, only read what the statistics leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from massloom.functions.text import is_blank
from massloom.session import new_path, path_exists

#: Rows of a row group of the clustered table: few, since a row group is what is read or skipped.
ROW_GROUP_ROWS = 4096
#: Hadoop settings that the row groups' readers need on object stores, by the name that pyarrow gives them.
_S3_SETTINGS = {"fs.s3a.access.key": "access_key", "fs.s3a.secret.key": "secret_key", "fs.s3a.session.token": "session_token", "fs.s3a.endpoint": "endpoint_override", "fs.s3a.endpoint.region": "region"}
_LAYOUTS: dict[tuple, str] = {}


def cluster_rows(rows: DataFrame, key: str, group: str, score: str) -> str:
    """Write (`key`, `group_value`, `score`) clustered for `top_n`; returns the path.

    Rows whose group is null or blank or whose score is null or NaN take no part. Only the three named columns are read.
    """
    keep = rows.select(F.col(key).alias("key"), F.col(group).alias("group_value"), F.col(score).cast("double").alias("score"))
    keep = keep.filter(~is_blank(F.col("group_value")) & F.col("score").isNotNull() & ~F.isnan("score"))
    order = [F.asc("group_value"), F.desc("score"), F.asc_nulls_last("key")]
    path = new_path(rows.sparkSession, "clustered")
    keep.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(path)
    return path


def kept_layout(rows: DataFrame, key: str, group: str, score: str) -> str:
    """`cluster_rows` of rows read from files, written once a process for the same files as they are now (path, length, time).

    Rows that come from no files are written each time. The table goes when the process ends.
    """
    files = sorted(rows.inputFiles())
    if not files:
        return cluster_rows(rows, key, group, score)
    spark = rows.sparkSession
    listed = spark.read.format("binaryFile").load(files).select("path", "modificationTime", "length")
    state = listed.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
    plan = rows._jdf.queryExecution().analyzed().canonicalized().hashCode()
    at = (spark.sparkContext.applicationId, key, group, score, plan, *state)
    if at not in _LAYOUTS or not path_exists(spark, _LAYOUTS[at]):
        _LAYOUTS[at] = cluster_rows(rows, key, group, score)
    return _LAYOUTS[at]


def _settings(spark: SparkSession) -> dict[str, str]:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    return {name: value for setting, name in _S3_SETTINGS.items() if (value := hadoop.get(setting))}


def _open(path: str, settings: dict[str, str]) -> pq.ParquetFile:
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    if scheme in ("s3", "s3a", "s3n"):
        system, where = fs.S3FileSystem(**settings), rest
    else:
        system, where = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(where))


def _edges(f: pq.ParquetFile) -> tuple[str, str]:
    """The first and the last group of a file, which is sorted by group."""
    last = f.metadata.num_row_groups - 1
    a, b = (f.metadata.row_group(i).column(1).statistics for i in (0, last))
    first = a.min if a is not None and a.has_min_max else f.read_row_group(0, ["group_value"])[0][0].as_py()
    return first, b.max if b is not None and b.has_min_max else f.read_row_group(last, ["group_value"])[0][-1].as_py()


def _statistics(batches: Iterator[pa.RecordBatch], settings: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """A row for each row group: its file, place, rows, greatest and least score, and its group where it holds only one."""
    for b in batches:
        for path in b.column(0).to_pylist():
            f = _open(path, settings)
            rows = []
            for i in range(f.metadata.num_row_groups):
                g = f.metadata.row_group(i)
                s, v = g.column(1).statistics, g.column(2).statistics
                one = s.min if s is not None and s.has_min_max and s.min == s.max else None
                known = v is not None and v.has_min_max
                rows.append((path, i, g.num_rows, v.max if known else float("inf"), v.min if known else float("-inf"), one))
            names = ("file", "place", "n", "most", "least", "only")
            types = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _first_of_runs(groups: pa.Array, n: int) -> np.ndarray:
    """Places of the first n rows of each run of equal groups."""
    codes = groups.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return np.flatnonzero(np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)])) < n)


def _read(f: pq.ParquetFile, row_groups: list[dict], n: int, edge: bool, read: set[int]) -> Iterator[pa.Table]:
    """The top n of the groups that lie within the file or, with `edge`, candidates of those at its edges; the places read go to `read`."""
    first, last = _edges(f)
    nth: dict[str, list[float]] = {}
    taken: dict[int, pa.Table] = {}
    final = f.metadata.num_row_groups - 1
    for r in sorted(row_groups, key=lambda r: (-r["most"], r["place"])):
        only = r["only"]
        if only is not None:
            if (only in (first, last)) != edge:
                continue
            # Of several groups in a row group, some begin and end there and have no N-th score yet: those are always read.
            if len(best := nth.get(only, ())) == n and r["most"] < best[-1]:
                continue
        elif edge and r["place"] not in (0, final) and not {first, last} & _ends(f, r["place"]):
            continue
        read.add(r["place"])
        rows = f.read_row_group(r["place"]).combine_chunks()
        groups = rows["group_value"].chunk(0) if rows.num_rows else pa.array([], pa.string())
        rows = rows.take(pa.array(_first_of_runs(groups, n)))
        inner = np.array([g not in (first, last) for g in rows["group_value"].to_pylist()], bool)
        rows = rows.filter(pa.array(~inner if edge else inner))
        taken[r["place"]] = rows
        for g in {only} if only is not None else _outer(rows):
            scores = [s for s, k in zip(rows["score"].to_pylist(), rows["group_value"].to_pylist(), strict=True) if k == g]
            nth[g] = sorted([*nth.get(g, ()), *scores], reverse=True)[:n]
    if taken:
        # The file is sorted, so its order is the order of the places.
        rows = pa.concat_tables([taken[i] for i in sorted(taken)]).combine_chunks()
        if rows.num_rows:
            yield rows.take(pa.array(_first_of_runs(rows["group_value"].chunk(0), n)))


def _ends(f: pq.ParquetFile, place: int) -> set[str]:
    s = f.metadata.row_group(place).column(1).statistics
    return {s.min, s.max} if s is not None and s.has_min_max else set(_edges(f))


def _outer(rows: pa.Table) -> set[str]:
    g = rows["group_value"]
    return {g[0].as_py(), g[-1].as_py()} if len(g) else set()


def _work(spark: SparkSession, laid: DataFrame, files: list[str], n: int) -> DataFrame:
    """(file, n_row_groups, row_groups): of each file the row groups that the statistics of all files leave to be read."""
    settings = _settings(spark)
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files))
    stats = names.mapInArrow(lambda batches: _statistics(batches, settings), "file string, place int, n bigint, most double, least double, only string")
    # Rows of one group that all reach a score bound its N-th score from below, in whatever file it lies.
    bounds = stats.filter(F.col("only").isNotNull() & (F.col("n") >= n)).groupBy("only").agg(F.max("least").alias("bound"))
    marked = stats.join(bounds, "only", "left").withColumn("left", F.col("bound").isNull() | (F.col("most") >= F.col("bound")))
    return marked.groupBy("file").agg(F.count(F.lit(1)).alias("n_row_groups"), F.collect_list(F.when(F.col("left"), F.struct("place", "most", "only"))).alias("row_groups")).repartition(len(files))


def skipped_row_groups(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(file, n_row_groups, n_read, n_skipped): what `top_n` reads of each file and what it skips. An empty table gives no rows."""
    laid = spark.read.parquet(path)
    files, settings = laid.inputFiles(), _settings(spark)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                read: set[int] = set()
                f = _open(r["file"], settings)
                for edge in (False, True):
                    for _ in _read(f, r["row_groups"], n, edge, read):
                        pass
                columns = [[r["file"]], [r["n_row_groups"]], [len(read)], [r["n_row_groups"] - len(read)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "n_row_groups", "n_read", "n_skipped"])

    shape = "file string, n_row_groups bigint, n_read bigint, n_skipped bigint"
    return _work(spark, laid, files, n).mapInArrow(report, shape) if files else spark.createDataFrame([], shape)


def top_n(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(key, group_value, score, place_no): the n rows of each group of a clustered table with the highest score, ties by key ascending.

    Nothing is cut at a tie: places are total. An empty table gives no rows.
    """
    laid = spark.read.parquet(path)
    files = laid.inputFiles()
    schema = f"key {laid.schema['key'].dataType.simpleString()}, group_value string, score double"
    arrow = to_arrow_schema(laid.schema)
    if not files:
        return laid.limit(0).withColumn("place_no", F.lit(0))
    work, settings = _work(spark, laid, files, n), _settings(spark)

    def reader(edge: bool):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    for t in _read(_open(r["file"], settings), r["row_groups"], n, edge, set()):
                        yield from t.cast(arrow).to_batches()

        return read

    def ranked(edge: bool) -> DataFrame:
        return work.mapInArrow(reader(edge), schema)

    w = Window.partitionBy("group_value").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    # A group within a file is complete: its rows need no shuffle, only their place, which a window over the file's own order gives.
    inner = work.mapInArrow(_with_places(reader(False)), schema + ", place_no int")
    edges = ranked(True).withColumn("place_no", F.row_number().over(w)).filter(F.col("place_no") <= n)
    return inner.unionByName(edges)


def _with_places(read):
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in read(batches):
            codes = b.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)])) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place.astype("int32"))], ["key", "group_value", "score", "place_no"])

    return out
