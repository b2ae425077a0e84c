"""Predicates over paths, names and entity kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Files, folders and suffixes that scans leave out.
EXCLUDED_FILES = ("cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "gemfile.lock", "pipfile.lock", "poetry.lock", "composer.lock", "go.sum", "flake.lock")
EXCLUDED_DIRS = ("__generated__", "_generated", "generated", "fixtures", "fixture", "benchmarks", "vendor", "node_modules", "test-harness", ".next", ".turbo", ".cache", "coverage")
EXCLUDED_ROOT_DIRS = ("out", "dist", "build", "target")
EXCLUDED_SUFFIXES = (
    ".min.js", ".min.css", ".generated.ts", ".generated.tsx", ".generated.js", ".generated.jsx", ".generated.mts", ".generated.cts", ".generated.mjs", ".generated.cjs", ".generated.d.ts",
    ".gen.ts", ".gen.tsx", ".gen.js", ".gen.jsx", ".gen.mts", ".gen.cts", ".gen.mjs", ".gen.cjs", ".gen.d.ts",
    ".module.css.d.ts", ".module.scss.d.ts", ".module.sass.d.ts", ".module.less.d.ts", ".svg.d.ts", ".png.d.ts", ".jpg.d.ts", ".jpeg.d.ts", ".webp.d.ts", ".gif.d.ts", ".avif.d.ts", ".ico.d.ts",
)
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".tiff", ".tif", ".bmp", ".heic", ".heif", ".avif", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp3", ".mp4", ".mov", ".avi", ".webm", ".ogg", ".wav", ".flac", ".m4a", ".m4v", ".mkv",
    ".zip", ".tar", ".tar.gz", ".tgz", ".bz2", ".gz", ".xz", ".7z", ".rar", ".so", ".dylib", ".dll", ".a", ".lib", ".o", ".obj", ".class", ".jar", ".pyc", ".pyo", ".pdb", ".exe", ".app", ".apk", ".ipa", ".aar",
    ".swiftmodule", ".swiftdoc", ".swiftsourceinfo", ".wasm", ".car", ".icns", ".riv", ".pdf", ".nib", ".storyboardc", ".db", ".sqlite", ".sqlite3", ".realm", ".profdata",
)
BINARY_DIR_SUFFIXES = (".framework", ".xcframework", ".dsym", ".app")
# What makes a path a test path.
TEST_TOKENS = ("test", "tests", "spec", "specs")
TEST_DIRS = ("e2e", "cypress", "playwright", "testing", "fixtures", "fixture", "benchmarks", "benchmark", "__tests__", "__mocks__")
TEST_FILE_PARTS = ("_test.", ".test.", "_spec.", ".spec.")
# Entity kinds that history counts as code.
CODE_KINDS = ("function", "method", "constructor", "init", "init_declaration", "class", "struct", "enum", "trait", "impl", "interface", "protocol", "protocol_declaration", "extension", "object_declaration", "companion_object", "module", "namespace", "component", "macro_definition", "type", "type_alias")


def one_of(suffixes) -> str:
    return "(?:" + "|".join(map(re.escape, suffixes)) + ")$"


def _parts(path: Column) -> Column:
    return F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")


def default_excluded(path: Column) -> Column:
    """Whether a scan leaves the path out by default."""
    parts, low = _parts(path), F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return (
        F.element_at(parts, -1).isin(*EXCLUDED_FILES)
        | F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED_DIRS)))
        | ((F.size(parts) > 1) & F.element_at(parts, 1).isin(*EXCLUDED_ROOT_DIRS))
        | low.rlike(one_of(EXCLUDED_SUFFIXES))
        | low.contains("_next/static/chunks")
    )


def probably_binary(path: Column) -> Column:
    parts, low = _parts(path), F.lower(path)
    return low.rlike(one_of(BINARY_SUFFIXES)) | F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.rlike(one_of(BINARY_DIR_SUFFIXES)))


def test_path(path: Column, custom: tuple[str, ...] = ()) -> Column:
    low = F.lower(path)
    parts = F.array_remove(F.split(low, "/"), "")
    name = F.substring_index(low, "/", -1)
    by_name = F.lit(False)
    for p in TEST_FILE_PARTS:
        by_name = by_name | name.contains(p)
    tokens = F.flatten(F.transform(parts, lambda x: F.split(x, "[-_.]")))
    return by_name | F.arrays_overlap(parts, F.array(*[F.lit(x.lower()) for x in (*TEST_DIRS, *custom)])) | F.arrays_overlap(tokens, F.array(*map(F.lit, TEST_TOKENS)))


def code_kind(kind: Column) -> Column:
    return kind.isin(*CODE_KINDS)


def glob_regex(spec: str) -> str:
    """A path glob (``*``, ``?``, ``**``, classes) as a regular expression for ``rlike``; a plain path also matches what lies below it."""
    out, i = [], 0
    while i < len(spec):
        c = spec[i]
        if spec.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if spec.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and (end := spec.find("]", i + 2)) > 0:
            body = spec[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end + 1
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    tail = "" if re.search(r"[*?\[]", spec) else "(?:/.*)?"
    return "^" + "".join(out).rstrip("/") + tail + "$"
