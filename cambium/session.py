"""Sessions, the shared scratch folder, and cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "cambium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for; `conf` overrides any of them (dots as double underscores)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers: its sources are sent to the executors once per context, unless
    PYTHONPATH leads workers to them anyway."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(sc, "_cambium_shipped", False) or root in {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}:
        return
    archive = Path(tempfile.mkdtemp(prefix="cambium-")) / "cambium.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "cambium").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))  # the driver serves it to every executor, late ones too
    sc._cambium_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session. Only where that is unset on a single machine
    (tests) a local folder is made and remembered in the setting; a cluster without the setting is refused, as each
    executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cambium-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_scopes: list[list[str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in a folder of the application's own that goes when the application ends, or
    earlier with the `scope` it was made in."""
    own = f"{shared_folder(spark)}/cambium-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_cambium_scratch", None) != own:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
        spark.sparkContext._cambium_scratch = own
    path = f"{own}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at its end; for services, whose answers are collected inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """`df` written once to the shared folder and read back: its lineage ends there, and a lost executor costs
    only a re-read. The path is kept in `df.cut_path` for `drop`."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def drop(*frames: DataFrame) -> None:
    """Deletes what `cut` wrote for these frames, once nothing lazy needs them any more."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            delete(df.sparkSession, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
