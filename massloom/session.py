"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: list[str] = []
_SCOPES: list[list[str]] = []


def build_session(app: str = "massloom", master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local work and tests; on a cluster the submitter's own settings are used."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table of that name; columns are pruned by the plan, not here."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset and the executors run in this process, a local one.

    On a cluster a folder of this machine isn't shared, so the setting must be there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        if not _OWN_FOLDERS:
            _OWN_FOLDERS.append(tempfile.mkdtemp(prefix="massloom-"))
            atexit.register(shutil.rmtree, _OWN_FOLDERS[0], ignore_errors=True)
        at = f"file://{_OWN_FOLDERS[0]}"
    if "://" not in at and not at.startswith("file:"):
        # Named in full, so that it can be deleted without a session too.
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)).toString()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used. It belongs to the innermost `released` block, else to the process, and is deleted at its end."""
    path = f"{shared_folder(spark)}/massloom-{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    else:
        atexit.register(delete_path, spark, path)
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside the block are deleted at its end; the result has to be written inside too.

    For callers that live long, such as streams: a DataFrame is lazy, so an operator can't know when its tables aren't needed any more.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written table; where the session has ended, local files still go."""
    if path.startswith("file:"):
        here = local_path(path)
        if os.path.isfile(here):
            os.remove(here)
        else:
            shutil.rmtree(here, ignore_errors=True)
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:
        # At exit the context may be gone; the table is named, so that it can be deleted by hand.
        print(f"massloom: {path} is left: {type(e).__name__}", file=sys.stderr)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def local_path(path: str) -> str:
    """file:/a, file:///a or /a as /a."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def write_table(df: DataFrame, name: str) -> str:
    """Write to the shared folder; returns the path. The written table survives the loss of executors and cuts the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def send_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file to the shared folder and have it sent to every executor, also to later ones; returns its name for SparkFiles.get."""
    path = new_path(spark, name)
    if path.startswith("file:") or path.startswith("/"):
        os.makedirs(os.path.dirname(local_path(path)), exist_ok=True)
        with open(local_path(path), "wb") as f:
            f.write(data)
    else:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
        out.write(data)
        out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(write_table(df, name))


def cpu_count() -> int:
    return int(os.environ.get("BENCH_CPUS") or os.cpu_count() or 8)
