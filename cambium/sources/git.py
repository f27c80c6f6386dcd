"""Facts from git: changed files and the history of lines. Driver-side, bounded by their limits."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

SEPARATOR = "\x1f"
FACTS = "commit string, author string, date string, subject string"


def _git(repo: str, *args: str, timeout: int = 30) -> list[str]:
    if not has_history(repo):
        return []
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.SubprocessError):
        return []
    return done.stdout.splitlines() if done.returncode == 0 else []


def has_history(repo: str) -> bool:
    return os.path.isdir(os.path.join(repo, ".git"))


def changed_files(repo: str, untracked: bool = True) -> list[str]:
    """Paths that differ from the last commit, sorted: both ends of a renaming, and new files if `untracked`."""
    out, entries = set(), iter("\n".join(_git(repo, "status", "--porcelain=v1", "-z", f"--untracked-files={'all' if untracked else 'no'}")).split("\0"))
    for entry in entries:
        if len(entry) > 3:
            out.add(entry[3:])
            if entry[0] in "RC":
                out.add(next(entries, ""))
    return sorted(out - {""})


def changed(spark: SparkSession, repo: str, name: str, paths: list[str] | None = None) -> DataFrame:
    """`repo, path, gone` of the changed (or the given) files."""
    rows = [(name, p, not os.path.isfile(os.path.join(repo, p))) for p in (paths or changed_files(repo))]
    return spark.createDataFrame(rows, "repo string, path string, gone boolean")


def history(spark: SparkSession, repo: str, path: str, first: int, last: int, limit: int = 12) -> DataFrame:
    """Commits that touched a range of lines, latest first; empty without a repository."""
    lines = _git(repo, "log", "-L", f"{first},{last}:{path}", f"--format=%H{SEPARATOR}%an{SEPARATOR}%ad{SEPARATOR}%s", "--date=short", "-n", str(limit))
    rows = [tuple(p[:4]) for line in lines if len(p := line.split(SEPARATOR)) >= 4]
    return spark.createDataFrame(rows, FACTS)
