"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "…"


def lines(c: Column) -> Column:
    """Lines without their ends; a final empty line doesn't count."""
    parts = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words(c: Column) -> Column:
    """White-space separated words, repeats kept."""
    return F.array_remove(F.split(c, r"[ \t\n\r\x0b\x0c]+"), "")


def token_estimate(c: Column) -> Column:
    """The larger of 13 tenths of the words and a quarter of the characters, whole numbers."""
    return F.greatest(F.floor(F.size(words(c)) * 13 / 10), F.floor(F.length(c) / 4)).cast("long")


def signature(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def similarity(a: Column, b: Column, least_ratio: float = 0.6) -> Column:
    """Jaccard of the distinct words; 0 where the word counts' ratio is below ``least_ratio`` or both are empty."""
    wa, wb = words(a), words(b)
    na, nb = F.size(wa), F.size(wb)
    union = F.size(F.array_union(wa, wb))
    ratio = F.least(na, nb) / F.greatest(na, nb, F.lit(1))
    return F.when((ratio < least_ratio) | (union == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(wa, wb)) / F.greatest(union, F.lit(1)))


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), 0)


def has_word(c: Column, word: Column) -> Column:
    """Whether ``word`` stands in ``c`` next to no letter, digit or underscore."""
    return F.array_contains(identifiers(c), word)


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit(MARK))).otherwise(c)


def day(seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd`` (session time zone UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def remote_url(c: Column) -> Column:
    """ssh, git and https remotes in one form: host/path, lower case host, no user or ``.git``."""
    c = F.regexp_replace(F.trim(c), r"^(?:ssh|git|https?)://", "")
    c = F.regexp_replace(c, r"^[^@/]+@", "")
    c = F.regexp_replace(c, r"^([^/:]+):(?!\d+/)", "$1/")
    c = F.regexp_replace(c, r"(\.git)?/*$", "")
    return F.concat(F.lower(F.substring_index(c, "/", 1)), F.substr(c, F.length(F.substring_index(c, "/", 1)) + 1))


def structural_text(c: Column) -> Column:
    """Text with runs of white space made one space: equal for changes of layout only."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def entity_id(path: Column, kind: Column, name: Column, parent: Column | None = None) -> Column:
    own = F.concat_ws("::", path, kind, name)
    return own if parent is None else F.when(parent.isNotNull(), F.concat_ws("::", parent, name)).otherwise(own)


def confidence(together: Column, a: Column, b: Column) -> Column:
    return together / F.greatest(F.lit(1), F.least(a, b))
