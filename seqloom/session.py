"""Session settings and the few helpers that touch the cluster's configuration."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "seqloom", **conf: str) -> SparkSession:
    """A session for tests, benches and notebooks. On a cluster bring your own session; no operator needs these settings.

    Keyword names use ``__`` for dots: ``build_session(spark__driver__memory="8g")``.
    """
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_written: dict[str, SparkSession] = {}
_folders: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: what ``spark.checkpoint.dir`` names, or what the context's checkpoint folder is set to.

    Only a local master, whose executors are the driver, may do without: it gets a temporary folder. Elsewhere the executors would
    each write to a disk of their own, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    there = sc._jsc.sc().getCheckpointDir()
    if not there.isEmpty():
        return there.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
    return _folders.setdefault(id(sc), tempfile.mkdtemp(prefix="seqloom-checkpoint-"))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone
        return


def _forget() -> None:
    """Removes at the driver's end what cut_lineage() wrote and nothing released, as far as it can still be reached."""
    for path, spark in _written.items():
        _delete(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder (see shared_folder), and read from there.

    It outlives lost executors as a checkpoint does, but is computed once where checkpoint() computes twice, and later
    reads take only the columns they need.
    """
    spark = df.sparkSession
    path = own_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqloom_path = path
    return out


def own_folder(spark: SparkSession) -> str:
    """The path of a new folder in the shared one, for files that a run writes and reads again. It is removed at the driver's end."""
    path = f"{shared_folder(spark)}/seqloom-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_forget)
    _written[path] = spark
    return path


def release(*tables: DataFrame) -> None:
    """Deletes tables of cut_lineage() from which nothing will be computed any more: what came of them has been written itself."""
    for t in tables:
        path = getattr(t, "_seqloom_path", None)
        if path and path in _written:
            _delete(_written.pop(path), path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spreads a small scan over all cores before work that is heavy for its size; a scan of many partitions stays as it is, without a shuffle.

    Anything but a projection or filter of a scan stays as it is too: to learn its partitions would run it.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if node.children().size():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() > cores:
        return df
    return df.repartition(cores)
