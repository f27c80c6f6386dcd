"""A small JSON file on shared storage that names the current version of something, replaced by one rename."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return bool(fs.exists(p))


class Pointer:
    """Readers see the state before a swap or after it, never a mixture; a writer that dies leaves the old one."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "CURRENT.json"):
        self.spark, self.folder, self.path = spark, folder.rstrip("/"), f"{folder.rstrip('/')}/{name}"

    def read(self) -> dict[str, Any] | None:
        p, fs = file_system(self.spark, self.path)
        if not fs.exists(p):
            return None
        source = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def swap(self, state: dict[str, Any]) -> None:
        fresh, fs = file_system(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        fs.mkdirs(fresh.getParent())
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        target, _ = file_system(self.spark, self.path)
        jvm = self.spark.sparkContext._jvm
        options = jvm.org.apache.hadoop.fs.Options.Rename
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri())
        args = self.spark.sparkContext._gateway.new_array(options, 1)
        args[0] = options.OVERWRITE
        context.rename(fs.makeQualified(fresh), fs.makeQualified(target), args)
