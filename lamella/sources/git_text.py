"""Parsers of git's text outputs into rows, applied with ``mapInPandas`` where tables of texts are large."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_CHANGE = T.StructType([T.StructField(n, T.StringType()) for n in ("filePath", "status", "oldFilePath", "beforeContent", "afterContent")])
STATUSES = ("added", "modified", "deleted", "renamed")
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "added", "T": "modified"}


def file_changes_json(rows: DataFrame, column: str) -> DataFrame:
    """A JSON array of file changes a row.

    Malformed JSON, unknown keys, a missing path and an unknown status fail the
    job; a null text gives no rows.
    """
    names = [f.name for f in FILE_CHANGE]
    one = F.explode(F.from_json(F.col(column), "array<map<string,string>>", {"mode": "FAILFAST"})).alias("m")
    m = F.col("m")
    odd = F.array_except(F.map_keys(m), F.array(*map(F.lit, names)))
    fault = F.when(F.size(odd) > 0, F.concat(F.lit("unknown field "), F.array_join(odd, ", "))).when(m["filePath"].isNull(), F.lit("no filePath")).when(~F.coalesce(m["status"], F.lit("")).isin(*STATUSES), F.concat(F.lit("unknown status "), F.coalesce(m["status"], F.lit("null"))))
    path = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(m["filePath"])
    return rows.select(one).select(path.alias("file_path"), m["status"].alias("status"), m["oldFilePath"].alias("old_file_path"), m["beforeContent"].alias("before_content"), m["afterContent"].alias("after_content"))


def name_status(text: str) -> list[tuple[str, str, str | None]]:
    """``git diff --name-status -z``: (path, status, old path)."""
    fields, out = iter(text.split("\0")), []
    for code in fields:
        if not code:
            continue
        first = next(fields, "")
        if code[0] in "RC":
            out.append((next(fields, ""), STATUS[code[0]], first if code[0] == "R" else None))
        else:
            out.append((first, STATUS.get(code[0], "modified"), None))
    return out


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _path(token: str, side: str) -> str | None:
    token = token.rstrip("\t")
    if token.startswith('"') and token.endswith('"'):
        raw = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else {b"n": b"\n", b"t": b"\t"}.get(m[1], m[1]), token[1:-1].encode())
        token = raw.decode("utf-8", "replace")
    if token == "/dev/null":
        return None
    return token.removeprefix(f"{side}/")


NO_NEWLINE = "\\ No newline at end of file"


def patch(text: str) -> list[dict]:
    """A unified diff's files with both sides rebuilt from their hunks; binary files have no content.

    Each side ends with a line feed unless the diff says otherwise.  Text that
    is no diff, hunks shorter than they say and lines of no known kind inside a
    hunk raise ``ValueError``; an empty text has no files.
    """
    out: list[dict] = []
    now: dict | None = None
    left = [0, 0]
    last = ""

    def opened(**more) -> dict:
        out.append({"old": None, "path": None, "status": "modified", "before": [], "after": [], "bare": set(), "binary": False, "hunks": 0} | more)
        return out[-1]

    for line in text.split("\n"):
        if now and (left[0] > 0 or left[1] > 0):
            mark, body = line[:1], line[1:]
            if line == NO_NEWLINE:
                now["bare"] |= {"before", "after"} if last == " " else {"before"} if last == "-" else {"after"}
                continue
            if mark not in (" ", "-", "+", ""):
                raise ValueError(f"line of no known kind in a hunk: {line[:80]!r}")
            if mark != "+":
                now["before"].append(body)
                left[0] -= 1
            if mark != "-":
                now["after"].append(body)
                left[1] -= 1
            if min(left) < 0:
                raise ValueError("a hunk is longer than it says")
            last = mark or " "
        elif line == NO_NEWLINE and now:
            now["bare"] |= {"before", "after"} if last == " " else {"before"} if last == "-" else {"after"}
        elif line.startswith("diff --git "):
            m = re.match(r"diff --git (\"a/.*?\"|a/.*?) (\"b/.*\"|b/.*)$", line)
            now = opened(old=_path(m[1], "a") if m else None, path=_path(m[2], "b") if m else None)
        elif line.startswith("--- ") and (now is None or now["hunks"]):
            now = opened(old=_path(line[4:], "a"))
            if now["old"] is None:
                now["status"] = "added"
        elif now is None:
            continue
        elif line.startswith("--- "):
            now["old"] = _path(line[4:], "a")
            if now["old"] is None:
                now["status"] = "added"
        elif line.startswith("+++ "):
            path = _path(line[4:], "b")
            now["path"] = now["old"] if path is None else path
            if path is None:
                now["status"] = "deleted"
        elif line.startswith("new file mode"):
            now["status"] = "added"
        elif line.startswith("deleted file mode"):
            now["status"] = "deleted"
        elif line.startswith("rename from "):
            now["status"], now["old"] = "renamed", _path(line[12:], "")
        elif line.startswith("copy from "):
            now["status"] = "added"
        elif line.startswith(("rename to ", "copy to ")):
            now["path"] = _path(line.partition(" to ")[2], "")
        elif line.startswith(("Binary files ", "GIT binary patch")):
            now["binary"] = True
        elif m := _HUNK.match(line):
            left = [int(m[2] or 1), int(m[4] or 1)]
            now["hunks"] += 1
        elif line.startswith("@@"):
            raise ValueError(f"bad hunk header: {line[:80]!r}")
    if left[0] > 0 or left[1] > 0:
        raise ValueError("a hunk is cut off")
    if text.strip() and not out:
        raise ValueError("no diff")
    rows = []
    for f in out:
        side = lambda name, absent: None if f["binary"] or f["status"] == absent else "\n".join(f[name]) + ("" if name in f["bare"] or not f[name] else "\n")
        rows.append({"file_path": f["path"] or f["old"], "status": f["status"], "old_file_path": f["old"] if f["status"] == "renamed" else None, "before_content": side("before", "added"), "after_content": side("after", "deleted")})
    return rows


def _parsed(rows: DataFrame, column: str, keep: list[str], schema: str, parse) -> DataFrame:
    """``parse`` over a column of texts, each of its rows beside the columns ``keep``."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*own, *r) for *own, t in pdf.itertuples(index=False) for r in parse(t or "")]
            yield pd.DataFrame(out, columns=[*keep, *names], dtype=object)

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*keep, column).mapInPandas(work, kinds + schema)


def patches(rows: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """:func:`patch` over a column of patch texts, beside the columns ``keep``; a null text has no files."""
    schema = "file_path string, status string, old_file_path string, before_content string, after_content string"
    return _parsed(rows, column, keep or [], schema, lambda t: [tuple(r.values()) for r in patch(t)])


def name_statuses(rows: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """:func:`name_status` over a column of texts."""
    return _parsed(rows, column, keep or [], "file_path string, status string, old_file_path string", name_status)


def blames(rows: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """:func:`blame_porcelain` over a column of texts."""
    return _parsed(rows, column, keep or [], "line_number long, commit_sha string, author string, author_time long, summary string", blame_porcelain)


def blame_porcelain(text: str) -> list[tuple[int, str | None, str, int | None, str]]:
    """``git blame --line-porcelain``: (line, sha or null where uncommitted, author, time, summary)."""
    out, now = [], {}
    for line in text.split("\n"):
        m = re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line)
        if m:
            now = {"sha": None if set(m[1]) == {"0"} else m[1], "line": int(m[2])}
        elif line.startswith("\t"):
            out.append((now["line"], now["sha"], now.get("author", ""), now.get("time") if now["sha"] else None, now.get("summary", "")))
        else:
            name, _, value = line.partition(" ")
            if name in ("author", "summary"):
                now[name] = value
            elif name == "author-time":
                now["time"] = int(value)
    return out
