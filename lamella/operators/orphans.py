"""Changes in lines that lie outside every entity.

Each file's free lines form segments on either side; equal segments anchor the
two lists (a longest common subsequence), and between anchors segments pair one
to one where there are equally many, else they are deletions and additions.

Defined cases: null texts have no lines, null span lists cover none; segments of
blank lines alone equal nothing and give no change; repeated files are compared
each; a file's segments are compared in its own row, in memory that grows with
the product of the two sides' counts; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file_path string, entity_id string, change_type string, start_line long, end_line long, old_start_line long, old_end_line long, before_content string, after_content string"


def segments(text: str | None, spans) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the runs of lines that no span covers."""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    covered = {n for s in (spans if spans is not None else []) for n in range(s["start_line"], s["end_line"] + 1)}
    out: list[list] = []
    for n, line in enumerate(lines, 1):
        if n in covered:
            continue
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
            out[-1][2].append(line)
        else:
            out.append([n, n, [line]])
    return [(a, b, "\n".join(x)) for a, b, x in out]


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; blank texts equal nothing."""
    same = np.array([[x == y and bool(x.strip()) for y in b] for x in a], dtype=bool).reshape(len(a), len(b))
    longest = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            longest[i, j] = longest[i + 1, j + 1] + 1 if same[i, j] else max(longest[i + 1, j], longest[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if same[i, j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif longest[i + 1, j] >= longest[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def paired(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for x, y in [*anchors(a, b), (len(a), len(b))]:
        if x - i == y - j:
            out += zip(range(i, x), range(j, y))
        else:
            out += [(n, None) for n in range(i, x)] + [(None, n) for n in range(j, y)]
        i, j = x + 1, y + 1
    return out


def file_changes(path: str, before: str | None, after: str | None, before_spans, after_spans) -> list[tuple]:
    b, a = segments(before, before_spans), segments(after, after_spans)
    out = []
    for i, j in paired([x[2] for x in b], [x[2] for x in a]):
        old = b[i] if i is not None else None
        new = a[j] if j is not None else None
        old_text = old[2] if old and old[2].strip() else None
        new_text = new[2] if new and new[2].strip() else None
        if old_text == new_text:
            continue
        kind = "added" if old_text is None else "deleted" if new_text is None else "modified"
        at = old if kind == "deleted" else new or old
        where = f"{'oldL' if kind == 'deleted' else 'L'}{at[0]}-{at[1]}"
        out.append((path, f"{path}::orphan::{kind}@{where}", kind, at[0], at[1], old and old[0], old and old[1], old_text, new_text))
    return out


def orphan_changes(files: DataFrame) -> DataFrame:
    """Change rows of ``files`` (``file_path, before_content, after_content, before_spans, after_spans``)."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for t in pdf.itertuples(index=False) for r in file_changes(*t)]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.astype({c: "Int64" for c in names if c.endswith("_line")})

    return files.select("file_path", "before_content", "after_content", "before_spans", "after_spans").mapInPandas(work, SCHEMA)
