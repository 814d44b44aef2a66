"""The commit log as a table."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "pos long, sha string, date string, author string, subject string, files array<string>"


def head_commit(git_dir: str | Path) -> str:
    got = subprocess.run(["git", "-C", str(git_dir), "rev-parse", "HEAD"], capture_output=True, text=True)
    return got.stdout.strip() if got.returncode == 0 else ""


def parse_log(text: str) -> list[tuple]:
    """Records of `\\x1e sha \\x1f date \\x1f author \\x1f subject` and a file on each further line."""
    out = []
    for pos, record in enumerate(text.split("\x1e")[1:]):
        head, _, files = record.partition("\n")
        sha, date, author, subject = head.split("\x1f", 3)
        out.append((pos, sha, date, author, subject, [f.strip() for f in files.split("\n") if f.strip()]))
    return out


def read_log(spark: SparkSession, git_dir: str | Path, paths: list[str]) -> DataFrame | None:
    """Commits in log order that touch paths; None where there is no repository. The path filter is git's own."""
    cmd = ["git", "-C", str(git_dir), "log", "--name-only", "--no-renames", "--date=short", "--format=%x1e%H%x1f%ad%x1f%an%x1f%s", "--", *paths]
    got = subprocess.run(cmd, capture_output=True, text=True, errors="replace")
    if got.returncode:
        return None
    return spark.createDataFrame(parse_log(got.stdout), SCHEMA)
