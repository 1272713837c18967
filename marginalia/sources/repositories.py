"""Git repositories: tracked files, changes since a commit, and history, by plain git on the driver.

A repository lies in one folder of one machine, so its listing is read there and handed to
Spark as rows; texts and diffs are handled by the executors.
"""

from __future__ import annotations

import os
import posixpath
import subprocess
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .code import language_of

# Tracked files that aren't indexed.
LOCK_FILES = (".DS_Store", ".terraform.lock.hcl", "go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "uv.lock")
BUILD_FOLDERS = (".idea", ".vscode", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", "dist", "build", ".egg-info", "vendor", ".terraform", "cdk.out")


def git(repo: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", repo, *arguments], check=True, capture_output=True, text=True, errors="replace").stdout


def discover(paths: Iterable[str]) -> list[str]:
    """Repositories at or below the paths, each once; what lies inside one isn't entered."""
    found: dict[str, None] = {}
    for root in paths:
        for folder, folders, _ in os.walk(os.path.expanduser(root)):
            if os.path.isdir(os.path.join(folder, ".git")):
                found[os.path.realpath(folder)] = None
                folders.clear()
            folders[:] = sorted(f for f in folders if not f.startswith("."))
    return list(found)


def wanted(path: str, exclude: Iterable[str] = ()) -> bool:
    parts = path.split("/")
    return language_of(path) is not None and posixpath.basename(path) not in LOCK_FILES and not set(parts) & {*BUILD_FOLDERS, *(e.strip() for e in exclude)}


def tracked(spark: SparkSession, repo: str, exclude: Iterable[str] = ()) -> DataFrame:
    rows = [(p,) for p in git(repo, "ls-files", "-z").split("\0") if p and wanted(p, exclude)]
    return spark.createDataFrame(rows, "file_path string")


def changed(spark: SparkSession, repo: str, since: str) -> DataFrame:
    rows = [(p,) for p in git(repo, "diff", "--name-only", "-z", f"{since}..HEAD").split("\0") if p]
    return spark.createDataFrame(rows, "file_path string")


def split_changes(changes: DataFrame, tracked_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to index again, and what is gone."""
    return changes.join(tracked_files, "file_path", "left_semi"), changes.join(tracked_files, "file_path", "left_anti")


def commits(spark: SparkSession, repo: str, months: int = 6, since: str = "") -> DataFrame:
    """History without merges; the oldest first."""
    log = git(repo, "log", "--no-merges", "--reverse", f"--since={months} months ago", "--pretty=format:%H|%an|%ae|%aI|%s", *([f"{since}..HEAD"] if since else []))
    return parsed_log(spark.createDataFrame([(repo, line) for line in log.splitlines()], "repo string, line string"))


def parsed_log(lines: DataFrame) -> DataFrame:
    """``repo, line`` to commits; a line of fewer than five parts is none."""
    parts = lines.select("repo", F.split("line", r"\|", 5).alias("p")).where(F.size("p") == 5)
    names = ("sha", "author_name", "author_email", "author_date", "subject")
    return parts.select("repo", *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(names)])


def commit_path(repo: Column, sha: Column) -> Column:
    """The path under which a commit is a source."""
    return F.concat(F.lit("git://"), repo, F.lit("#"), sha)


def new_commits(commits: DataFrame, sources: DataFrame) -> DataFrame:
    """Commits (repo, sha) that aren't sources yet."""
    known = sources.select(F.col("source_path").alias("__path"))
    return commits.join(known, commit_path(F.col("repo"), F.col("sha")) == F.col("__path"), "left_anti")


def file_changes(spark: SparkSession, repo: str, shas: Iterable[str]) -> DataFrame:
    rows = [(repo, sha, line) for sha in shas for line in git(repo, "show", "--numstat", "--format=", sha).splitlines() if line]
    return parsed_numstat(spark.createDataFrame(rows, "repo string, sha string, line string"))


def parsed_numstat(lines: DataFrame) -> DataFrame:
    """``repo, sha, line`` to changes; bars in place of numbers mark a binary file."""
    parts = lines.withColumn("p", F.split("line", "\t", 3)).where(F.size("p") == 3)

    def number(k: int) -> Column:
        return F.coalesce(F.get("p", F.lit(k)).try_cast("long"), F.lit(0))

    binary = (F.get("p", F.lit(0)) == "-") & (F.get("p", F.lit(1)) == "-")
    return parts.select("repo", "sha", number(0).alias("additions"), number(1).alias("deletions"), binary.alias("is_binary"), F.get("p", F.lit(2)).alias("file_path"))


def diff_of(repo: str, sha: str, path: str) -> str:
    return git(repo, "show", "--format=", sha, "--", path)


def head(repo: str) -> str:
    return git(repo, "rev-parse", "HEAD").strip()


def known_commit(repo: str, sha: str) -> bool:
    """A watermark that the repository has lost means starting over."""
    return subprocess.run(["git", "-C", repo, "cat-file", "-e", f"{sha}^{{commit}}"], capture_output=True).returncode == 0


def advanced(watermarks: dict[str, str], key: str, sha: str, errors: int, finished: bool) -> dict[str, str]:
    """The next watermarks: only a run without errors that came to its end moves one."""
    return {**watermarks, key: sha} if finished and not errors else watermarks
