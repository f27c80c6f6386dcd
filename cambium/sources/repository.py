"""Source files of a repository on disk or object storage, as a table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators.spans import LANGUAGES

# Folders that hold no source of the repository's own, and the size beyond which a file is none.
IGNORED_FOLDERS = (".git", "node_modules", ".venv", "venv", "dist", "build", "out", "coverage", ".next", ".cache", "vendor", "target", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "public", "assets")
MAX_BYTES = 2_000_000
PRIORITY = ("typescript", "python", "go", "rust", "java")


def language(path: Column) -> Column:
    """The language of a path by its extension; null for others, declaration files and go tests."""
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    out = F.lit(None).cast("string")
    for name in PRIORITY:
        out = F.when(ext.isin(*[e for e, n in LANGUAGES.items() if n == name]), name).otherwise(out)
    return F.when(path.endswith(".d.ts") | path.endswith("_test.go"), None).otherwise(out)


def _links(root: str) -> list[str]:
    """Relative paths of symbolic links below a local root; they could lead out of the repository."""
    out = []
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in IGNORED_FOLDERS and not f.startswith(".")]
        out += [os.path.relpath(p, root) for n in [*folders, *names] if os.path.islink(p := os.path.join(folder, n))]
    return out


def _empty(root: str) -> list[str]:
    """Relative paths of empty files below a local root; the reader leaves files without bytes out."""
    out = []
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in IGNORED_FOLDERS and not f.startswith(".")]
        out += [os.path.relpath(p, root) for n in names if n.rpartition(".")[2] in LANGUAGES and not os.path.islink(p := os.path.join(folder, n)) and not os.path.getsize(p)]
    return out


def list_sources(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """`repo, path, language, sha256, line_count, text`, one row a source file: known extensions, at most MAX_BYTES, not in
    ignored or dot folders, no links. Contents are read on the executors; only names are filtered before."""
    base = root.rstrip("/")
    local = base if base.startswith("/") else base.removeprefix("file://") if base.startswith("file:///") else None
    ext = "|".join(LANGUAGES)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ext.replace("|", ",") + "}").load(base)
    full = os.path.realpath(local) if local else base
    path = F.regexp_replace("path", "^.*?" + _quoted(full.lstrip("/")) + "/", "")
    rows = rows.select(path.alias("path"), "length", "content").where(F.col("length") <= MAX_BYTES)
    if local and (names := _empty(local)):
        rows = rows.unionByName(spark.createDataFrame([(n, 0, bytearray()) for n in names], "path string, length bigint, content binary"))
    inside = F.split(F.col("path"), "/")
    bad = F.exists(F.slice(inside, F.lit(1), F.size(inside) - 1), lambda s: s.isin(*IGNORED_FOLDERS) | s.startswith("."))
    rows = rows.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~bad)
    for link in _links(local) if local else []:
        rows = rows.where((F.col("path") != link) & ~F.col("path").startswith(link + "/"))
    text = F.decode("content", F.lit("UTF-8")) if spark.conf.get("spark.sql.ansi.enabled", "true") == "false" else F.expr("coalesce(try_validate_utf8(cast(content as string)), make_valid_utf8(cast(content as string)))")
    return rows.select(F.lit(repo).alias("repo"), "path", "language", F.sha2("content", 256).alias("sha256"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("line_count"), text.alias("text"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
