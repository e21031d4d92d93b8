"""Session factory and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "qirtas", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution; `conf` keys use `_` for `.`-free options, values win over defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once a session, so that they need no path to it."""
    context = spark.sparkContext
    if getattr(context, "_qirtas_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="qirtas-code-")) / "qirtas_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for path in sorted(root.rglob("*.py")):
            target.write(path, path.relative_to(root.parent))
    path = list(sys.path)
    context.addPyFile(str(archive))
    sys.path[:] = path  # the driver keeps its own copy
    context._qirtas_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`; a local one is set only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="qirtas-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_written: dict[str, list[str]] = {}


def drop_materialised(spark: SparkSession) -> int:
    """Delete what this session wrote by `materialise`; DataFrames that read it can't be used any more."""
    return _drop(spark, _written.pop(spark.sparkContext.applicationId, []))


@contextmanager
def scratch(spark: SparkSession):
    """Delete at the end what was written by `materialise` inside; results must have been read or written by then."""
    before = len(_written.setdefault(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        paths = _written.get(spark.sparkContext.applicationId, [])
        _drop(spark, paths[before:])
        del paths[before:]


def _drop(spark: SparkSession, paths: list[str]) -> int:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        folder = hadoop.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
