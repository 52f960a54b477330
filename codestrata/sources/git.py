"""Git as a source: changed files, references and remote repositories. Commands run on the driver, their output becomes tables."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else None


def is_repository(root: str) -> bool:
    return (_git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def head(root: str) -> str | None:
    out = _git(root, "rev-parse", "--short", "HEAD")
    return out.strip() if out else None


def default_branch(root: str) -> str | None:
    """The branch that the remote's head names, else ``main`` or ``master`` where it exists."""
    out = _git(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD")
    if out:
        return out.strip().removeprefix("origin/")
    return next((b for b in ("main", "master") if _git(root, "rev-parse", "--verify", "--quiet", b)), None)


def resolve_ref(root: str, ref: str) -> str:
    """The remote's branch of that name where it exists."""
    return f"origin/{ref}" if _git(root, "rev-parse", "--verify", "--quiet", f"origin/{ref}") else ref


def diff_stats(numstat: DataFrame, statuses: DataFrame) -> DataFrame:
    """(path, status, additions, deletions) from the lines of ``--numstat`` and ``--name-status``; missing numbers are 0."""
    parts = F.split("value", "\t")
    letter = F.substring(parts[0], 1, 1)
    status = F.when(letter == "A", "Added").when(letter == "D", "Deleted").when(letter == "R", "Renamed").otherwise("Modified")
    paths = statuses.where(F.size(parts) >= 2).select(F.element_at(parts, -1).alias("path"), status.alias("status"))
    numbers = numstat.where(F.size(parts) >= 3).select(
        F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "").alias("path"),
        parts[0].try_cast("bigint").alias("additions"), parts[1].try_cast("bigint").alias("deletions"),
    )
    return paths.join(numbers, "path", "left").fillna(0, ["additions", "deletions"]).select("path", "status", "additions", "deletions")


def diff_files(spark: SparkSession, root: str, base: str) -> DataFrame | None:
    """The files that differ between a base and the head; None outside a repository."""
    span = f"{resolve_ref(root, base)}...HEAD"
    numstat, statuses = _git(root, "diff", "--numstat", span), _git(root, "diff", "--name-status", span)
    if numstat is None or statuses is None:
        return None
    tables = [spark.createDataFrame([(x,) for x in t.splitlines()], "value string") for t in (numstat, statuses)]
    return diff_stats(*tables)


def restrict_to(files: DataFrame, diff: DataFrame) -> DataFrame:
    """The files whose path is in a diff."""
    return files.join(diff.select(F.col("path").alias("relative_path")).distinct(), "relative_path", "left_semi")


def is_remote_url(text: str) -> bool:
    return bool(re.match(r"(?:https?|git|ssh)://|git@|github\.com/|gitlab\.com/|bitbucket\.org/", text))


def normalize_url(text: str) -> str:
    """With a scheme, and ``.git`` at the end once."""
    url = text if re.match(r"\w+://|git@", text) else f"https://{text}"
    return url if url.endswith(".git") else f"{url.rstrip('/')}.git"


def clone(url: str, parent: str | None = None) -> str:
    """A shallow clone in a new folder below ``parent``, which on a cluster is one that all executors share; its path."""
    folder = tempfile.mkdtemp(prefix="clone-", dir=parent)
    done = subprocess.run(["git", "clone", "--depth", "1", normalize_url(url), folder], capture_output=True, text=True, check=False)
    if done.returncode:
        remove_clone(folder)
        raise RuntimeError(done.stderr.strip())
    return folder


def remove_clone(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)


__all__ = ["clone", "default_branch", "diff_files", "diff_stats", "head", "is_remote_url", "is_repository", "normalize_url", "remove_clone", "resolve_ref", "restrict_to"]
