"""Lists of repositories, and repositories at a Git revision by the git program of the driver's machine."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXCLUDED_DIRECTORIES
from ..operators.diffs import changed_lines, patch_headers, strict_spans
from .corpus import MOST_BYTES, MOST_FILES, Corpus

OBJECT_ID = re.compile(r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$")
#: Fixed settings under which patches come out the same whatever the user's are.
GIT = ("-c", "core.quotePath=false", "-c", "diff.renames=true", "-c", "diff.noprefix=false", "-c", "diff.mnemonicPrefix=false", "-c", "core.fsmonitor=false", "-c", "diff.external=")
DIFF = (
    "--no-color", "--no-ext-diff", "--no-textconv", "--find-renames=50%", "-l20000", "--src-prefix=a/", "--dst-prefix=b/",
    "--ignore-submodules=dirty", "--diff-algorithm=myers", "--no-indent-heuristic", "--full-index", "--inter-hunk-context=0",
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of a list with a name and a URL a line; # begins a comment. Wrong lines and repeated names are an error when
    the rows are read."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    parts = lines.select("line", F.split("line", r"\s+").alias("p"))
    name = F.get("p", 0)
    good = (F.size("p") == 2) & name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~name.isin(".", "..")
    checked = F.when(good, name).otherwise(F.raise_error(F.concat(F.lit("expected a repository name and URL: "), F.col("line"))))
    rows = parts.select(checked.alias("name"), F.get("p", 1).alias("url"))
    once = rows.groupBy("name").agg(F.count("*").alias("n"), F.first("url").alias("url"))
    return once.select(F.when(F.col("n") == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("repeated repository name "), F.col("name")))).alias("name"), "url")


def safe_url(url: str) -> bool:
    """A local path, or an https URL of github.com without user, query or fragment."""
    return url.startswith("/") or bool(re.fullmatch(r"https://github\.com/[\w.-]+/[\w.-]+", url))


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a list with a path a line, in order."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' AND NOT startswith(path, '#')").distinct().orderBy("path")


def discovered(root: str) -> list[str]:
    """Directories below root that hold a .git."""
    found = []
    for folder, directories, files in os.walk(root):
        if ".git" in directories or ".git" in files:
            found.append(folder)
        directories[:] = sorted(d for d in directories if d not in EXCLUDED_DIRECTORIES)
    return sorted(found)


def git(root: str, *arguments: str, given: bytes | None = None, good: tuple[int, ...] = (0,)) -> bytes:
    done = subprocess.run(["git", *GIT, "-C", root, *arguments], input=given, capture_output=True, check=False, env=os.environ | {"GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"})
    if done.returncode not in good:
        raise ValueError(f"git {arguments[0]}: {done.stderr.decode(errors='replace')[-500:]}")
    return done.stdout


def blobs(root: str, revision: str, wanted: set[str] | None = None) -> list[tuple[str, str]]:
    """(path, content) of the regular files of a revision's tree, those wanted or all, by one process. Beyond the budgets of
    a corpus it's a ValueError, as all of it comes to the driver."""
    found = []
    for entry in git(root, "ls-tree", "-r", "-z", "--long", revision).split(b"\0"):
        head, _, name = entry.partition(b"\t")
        mode, *rest = head.split() or [b""]
        path = name.decode("utf-8", "replace")
        if mode in (b"100644", b"100755") and (wanted is None or path in wanted):
            found.append((path, rest[1], int(rest[2])))
    if len(found) > MOST_FILES or sum(n for *_, n in found) > MOST_BYTES:
        raise ValueError(f"{revision} has {len(found)} files of {sum(n for *_, n in found)} bytes; {MOST_FILES} and {MOST_BYTES} are allowed")
    out, at = git(root, "cat-file", "--batch", given=b"".join(oid + b"\n" for _, oid, _ in found)), 0
    rows = []
    for path, _, size in found:  # a line of id, type and size before each, a newline behind it
        at = out.index(b"\n", at) + 1
        rows.append((path, out[at : at + size].decode("utf-8", "replace")))
        at += size + 1
    return rows


def commit_of(root: str, revision: str) -> str:
    if revision.startswith("-") or any(c in revision for c in "\0\r\n") or not revision:
        raise ValueError(f"unsafe revision {revision!r}")
    found = git(root, "rev-parse", "--verify", "--end-of-options", revision + "^{commit}").decode().strip()
    if not OBJECT_ID.match(found):
        raise ValueError(f"{revision!r} is no commit")
    return found


def is_base_commit(root: str, commit: str) -> bool:
    """Whether a full object id is HEAD or an ancestor of it."""
    if not OBJECT_ID.match(commit) or commit_of(root, commit) != commit:
        return False
    return subprocess.run(["git", *GIT, "-C", root, "merge-base", "--is-ancestor", commit, "HEAD"], capture_output=True, check=False).returncode == 0


class Changes:
    """What changed between a base and HEAD, or, without a base, between HEAD and the work tree with its new files."""

    def __init__(self, spark: SparkSession, root: str, base: str = ""):
        self.spark, self.root = spark, os.path.realpath(root)
        self.base = commit_of(self.root, base) if base else ""
        self.head = commit_of(self.root, "HEAD")
        self.subject = git(self.root, "show", "-s", "--format=%s", self.head).decode(errors="replace").strip()

    def _names(self, *arguments: str) -> set[str]:
        return {x.decode("utf-8", "replace") for x in git(self.root, *arguments).split(b"\0") if x}

    @property
    def untracked(self) -> set[str]:
        return self._names("ls-files", "--others", "--exclude-standard", "-z") if not self.base else set()

    def paths(self) -> list[str]:
        if self.base:
            return sorted(self._names("diff", "--name-only", "-z", *DIFF, f"{self.base}...{self.head}"))
        return sorted(self._names("diff", "--name-only", "-z", *DIFF) | self._names("diff", "--cached", "--name-only", "-z", *DIFF) | self.untracked)

    def files(self) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in self.paths()], "path string")

    def patch(self, context: int = 3) -> str:
        sides = [[f"{self.base}...{self.head}"]] if self.base else [["--cached"], []]
        parts = [git(self.root, "diff", f"-U{context}", *DIFF, *side) for side in sides]
        # new files have no other side: a difference is all that the command finds, and says so by 1
        parts += [git(self.root, "diff", "--no-index", f"-U{context}", *DIFF, "--", os.devnull, path, good=(0, 1)) for path in sorted(self.untracked)]
        return b"".join(parts).decode("utf-8", "replace")

    def corpus(self, whole: bool = False) -> Corpus:
        """The new side: the tree of HEAD if there is a base, its changed files or with ``whole`` all, else the work tree."""
        if not self.base:
            return Corpus.from_directory(self.spark, self.root)
        return Corpus(self.spark.createDataFrame(blobs(self.root, self.head, None if whole else set(self.paths())), "path string, content string"))

    def lines(self, corpus: Corpus) -> DataFrame:
        """(path, line_no) changed on the new side; all lines of new files."""
        from ..operators.search import lines_of

        side = [f"{self.base}...{self.head}"] if self.base else ["HEAD"]
        text = git(self.root, "diff", "-U0", *DIFF, *side).decode("utf-8", "replace")
        headers = patch_headers(self.spark.createDataFrame([(text,)], "patch string"))
        totals = lines_of(corpus.files).groupBy("path").agg(F.max("total").alias("total"))
        strict_spans(headers)
        found = changed_lines(headers.join(totals, "path"))
        new = sorted(self.untracked)
        if new:
            found = found.unionByName(lines_of(corpus.files.where(F.col("path").isin(*new))).select("path", "line_no")).distinct()
        return found


