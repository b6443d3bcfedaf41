"""Source trees, git state and plain text as DataFrames."""

from __future__ import annotations

import json
import os
import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.paths import glob_to_regex, language_of

# Paths never read as source.
IGNORE_GLOBS = (
    "node_modules/**", ".git/**", "__pycache__/**", "*.pyc", ".venv/**",
    "venv/**", "dist/**", "build/**", ".next/**", "target/**", "*.min.js",
    "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "*.db",
    "*.sqlite", "*.db-journal", "*.db-wal",
)
_SAFE_REF = re.compile(r"[A-Za-z0-9_./~^@{}\-]+")
_GIT_SECONDS = 30


def usable(files: DataFrame, ignore: tuple[str, ...] = IGNORE_GLOBS) -> DataFrame:
    """Rows (file_path, content) that are text of a known language and not ignored."""
    pattern = "|".join(glob_to_regex(g) for g in ignore)
    return (
        files.withColumn("language", language_of(F.col("file_path")))
        .where(F.col("language").isNotNull() & ~F.col("file_path").rlike(pattern))
        .where(~F.contains(F.decode("content", "ISO-8859-1"), F.lit("\x00")))
    )


def read_tree(spark: SparkSession, root: str, ignore: tuple[str, ...] = IGNORE_GLOBS) -> DataFrame:
    """Every usable file below a root: file_path, content, language, file_hash, text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    clean = F.regexp_replace("path", "^file:/*", "/")
    rel = F.when(clean.startswith(prefix), F.substring(clean, len(prefix) + 1, 1 << 30)).otherwise(clean)
    return (
        usable(raw.select(rel.alias("file_path"), "content"), ignore)
        .withColumn("file_hash", F.sha2("content", 256))
        .withColumn("text", F.decode("content", "UTF-8"))
    )


def _git(repo: str, *args: str) -> str | None:
    try:
        done = subprocess.run(
            ["git", *args], cwd=repo, capture_output=True, text=True, timeout=_GIT_SECONDS, check=False
        )
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def _paths(spark: SparkSession, text: str | None) -> DataFrame:
    names = sorted({line.strip() for line in (text or "").splitlines() if line.strip()})
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def tracked_files(spark: SparkSession, repo: str) -> DataFrame:
    return _paths(spark, _git(repo, "ls-files"))


def safe_ref(ref: str) -> bool:
    return bool(_SAFE_REF.fullmatch(ref)) and not ref.startswith("-")


def changed_files(spark: SparkSession, repo: str, base: str = "HEAD~1") -> DataFrame:
    """Names changed since a ref; the staged diff when the ref is unknown."""
    if not safe_ref(base):
        return _paths(spark, "")
    out = _git(repo, "diff", "--name-only", base, "--")
    return _paths(spark, out if out is not None else _git(repo, "diff", "--name-only", "--cached"))


def staged_and_unstaged(spark: SparkSession, repo: str) -> DataFrame:
    """Paths of the short status; a rename counts as its new name."""
    names = []
    for line in (_git(repo, "status", "--porcelain") or "").splitlines():
        if len(line) > 3:
            names.append(line[3:].split(" -> ")[-1])
    return _paths(spark, "\n".join(names))


def diff_text(spark: SparkSession, repo: str, base: str = "HEAD~1") -> DataFrame:
    text = _git(repo, "diff", "--unified=0", base, "--") if safe_ref(base) else None
    return spark.createDataFrame([("diff", text or "")], "diff_id string, text string")


def git_state(spark: SparkSession, repo: str) -> DataFrame:
    one = lambda *a: (_git(repo, *a) or "").strip()
    row = (one("rev-parse", "--abbrev-ref", "HEAD"), one("rev-parse", "HEAD"), bool(one("status", "--porcelain")))
    return spark.createDataFrame([row], "branch string, head string, dirty boolean")


def repo_root(start: str) -> str:
    """Nearest ancestor with a ``.git`` entry, else the start itself."""
    here = os.path.abspath(start)
    while True:
        if os.path.exists(os.path.join(here, ".git")):
            return here
        parent = os.path.dirname(here)
        if parent == here:
            return os.path.abspath(start)
        here = parent


def files_to_parse(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Current files (file_path, file_hash) whose content is not stored under that hash."""
    return current.join(stored.select("file_path", "file_hash"), ["file_path", "file_hash"], "left_anti")


def stale_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored paths that no longer exist."""
    return stored.select("file_path").distinct().join(current.select("file_path"), "file_path", "left_anti")


def repositories(spark: SparkSession, registry_json: DataFrame) -> DataFrame:
    """Registry texts ``{"repos": [{path, alias}]}`` to one row per path, first entry wins."""
    schema = "repos array<struct<path:string,alias:string>>"
    rows = registry_json.select(F.posexplode(F.from_json("text", schema)["repos"]).alias("pos", "r"))
    return rows.groupBy(F.col("r.path").alias("path")).agg(F.min_by("r.alias", "pos").alias("alias"))


def resolve_repository(repos: DataFrame, wanted: str) -> DataFrame:
    """By alias, then by path."""
    rank = F.when(F.col("alias") == wanted, 1).when(F.col("path") == wanted, 2)
    return repos.withColumn("rank", rank).where(F.col("rank").isNotNull()).orderBy("rank", "path").limit(1)


def evaluation_configs(texts: DataFrame) -> dict[str, DataFrame]:
    """Per-repository evaluation settings (JSON texts) as commits, entries and queries."""
    schema = (
        "name string, url string, commit string, language string, size_category string, "
        "test_commits array<struct<sha:string,description:string,changed_files:int>>, "
        "entry_points array<string>, search_queries array<struct<query:string,expected:string>>"
    )
    rows = texts.select(F.from_json("text", schema).alias("c")).select("c.*")
    return {
        "repos": rows.select("name", "url", "commit", "language", "size_category"),
        "commits": rows.select("name", F.explode("test_commits").alias("t")).select("name", "t.*"),
        "entry_points": rows.select("name", F.explode("entry_points").alias("expected")),
        "queries": rows.select("name", F.explode("search_queries").alias("q")).select("name", "q.*"),
    }


def _yaml_batch(column: pd.Series) -> pd.Series:
    import yaml

    return column.map(lambda t: json.dumps(yaml.safe_load(t), default=str))


def yaml_to_json(texts: DataFrame) -> DataFrame:
    """YAML texts as JSON texts; needs a YAML reader on the executors."""
    return texts.withColumn("text", F.pandas_udf(_yaml_batch, "string")("text"))
