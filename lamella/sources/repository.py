"""A git repository's history and changes as rows.

Git runs on the driver, beside the repository, and its outputs become tables; one
``cat-file`` process reads all contents that a call needs.  For many repositories
or very long histories write the tables once and work on those.

Defined cases: a repository without commits has an empty log; files that aren't
UTF-8 have null contents; line ends of any kind become line feeds; renames are
those git finds at half the lines; unknown references raise ``ValueError``.
"""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lamella.sources import git_text

CHANGE = "file_path string, status string, old_file_path string, before_content string, after_content string"
COMMIT = "sha string, short_sha string, author string, committed_at long, message string, is_merge boolean"
_FORMAT = "%H%x00%h%x00%an%x00%ct%x00%P%x00%s%x01"


def _text(raw: bytes | None) -> str | None:
    try:
        return None if raw is None or b"\0" in raw else raw.decode().replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


class Repository:
    def __init__(self, spark: SparkSession, path: str, own_folder: str | None = None) -> None:
        """``own_folder`` names a folder whose files are never reported."""
        self.spark, self.path, self.own = spark, path, own_folder

    def _git(self, *args: str, ok: tuple[int, ...] = (0,)) -> bytes:
        done = subprocess.run(["git", "-C", self.path, *args], capture_output=True)
        if done.returncode not in ok:
            raise ValueError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
        return done.stdout

    def resolve(self, ref: str) -> str:
        return self._git("rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()

    def merge_base(self, a: str, b: str) -> str:
        return self._git("merge-base", a, b).decode().strip()

    def _blobs(self, names: list[str]) -> list[bytes | None]:
        """Contents of objects such as ``HEAD:a.txt`` or ``:a.txt``."""
        if not names:
            return []
        done = subprocess.run(["git", "-C", self.path, "cat-file", "--batch"], input="\n".join(names).encode() + b"\n", capture_output=True)
        out, at, data = [], 0, done.stdout
        for _ in names:
            end = data.index(b"\n", at)
            head = data[at:end]
            if head.endswith(b"missing"):
                out.append(None)
                at = end + 1
                continue
            size = int(head.rsplit(b" ", 1)[1])
            out.append(data[end + 1 : end + 1 + size])
            at = end + 2 + size
        return out

    def _changes(self, args: list[str], before: str, after: str | None) -> DataFrame:
        """Rows of ``git diff``; ``before`` and ``after`` are prefixes of object names, ``after`` null for the files as they are."""
        found = git_text.name_status(self._git("diff", "--name-status", "-z", "-M", *args).decode(errors="surrogateescape"))
        found = [x for x in found if not (self.own and x[0].startswith(self.own.rstrip("/") + "/"))]
        olds = self._blobs([f"{before}:{old or path}" for path, _, old in found])
        if after is None:
            files = [Path(self.path, path) for path, _, _ in found]
            news = [f.read_bytes() if f.is_file() else None for f in files]
        else:
            news = self._blobs([f"{after}:{path}" for path, _, _ in found])
        rows = [(path, status, old, None if status == "added" else _text(a), None if status == "deleted" else _text(b)) for (path, status, old), a, b in zip(found, olds, news)]
        return self.spark.createDataFrame(rows, CHANGE)

    def working_tree(self) -> DataFrame:
        """What differs from the last commit, staged or not; files that git doesn't know are left out."""
        return self._changes(["HEAD"], "HEAD", None)

    def staged(self, base: str = "HEAD") -> DataFrame:
        return self._changes(["--cached", base], base, "")

    def commit(self, sha: str) -> DataFrame:
        """A commit against its first parent; the first commit against nothing."""
        sha = self.resolve(sha)
        parents = self._git("rev-list", "--parents", "-n", "1", sha).decode().split()[1:]
        base = parents[0] if parents else self._git("hash-object", "-t", "tree", "/dev/null").decode().strip()
        return self._changes([base, sha], base, sha)

    def between(self, a: str, b: str) -> DataFrame:
        return self._changes([a, b], a, b)

    def since(self, ref: str) -> DataFrame:
        """A reference against the files as they are."""
        return self._changes([ref], ref, None)

    def _commits(self, *args: str) -> DataFrame:
        raw = self._git("log", f"--format={_FORMAT}", *args, ok=(0, 128)).decode(errors="replace")
        rows = []
        for one in raw.split("\x01"):
            f = one.lstrip("\n").split("\0")
            if len(f) == 6:
                rows.append((f[0], f[1], f[2], int(f[3]), f[5], " " in f[4]))
        return self.spark.createDataFrame(rows, COMMIT)

    def log(self, limit: int = 0) -> DataFrame:
        """Newest first; 0 means all."""
        return self._commits(*([f"-n{limit}"] if limit else []))

    def file_history(self, path: str, follow: bool = False) -> DataFrame:
        """Commits in which a file differs from the first parent's; ``follow`` goes back through renames."""
        return self._commits(*(["--follow"] if follow else ["--diff-merges=first-parent"]), "--", path)

    def changed_paths(self, sha: str) -> list[str]:
        return sorted(r["file_path"] for r in self.commit(sha).select("file_path").collect())

    def show(self, ref: str, path: str) -> str | None:
        """A file's text at a reference, null where it isn't there; an empty reference is the index."""
        return _text(self._blobs([f"{ref}:{path}"])[0])

    def blame(self, path: str, ref: str | None = None) -> DataFrame:
        """``file_path, line_number, commit_sha, author, author_time, summary``; uncommitted lines have no commit."""
        rows = git_text.blame_porcelain(self._git("blame", "--line-porcelain", *([ref] if ref else []), "--", path).decode(errors="replace"))
        return self.spark.createDataFrame([(path, *r) for r in rows], "file_path string, line_number long, commit_sha string, author string, author_time long, summary string")

    def clean(self) -> bool:
        return not self._git("status", "--porcelain", "--untracked-files=no").strip()

    def epoch(self) -> tuple[str, bool]:
        """The last commit and whether the files are as in it: what a saved graph is stamped with."""
        return self.resolve("HEAD"), self.clean()
