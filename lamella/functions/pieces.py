"""More scalar functions and predicates as Column expressions.

Null inputs give null unless a function says otherwise; texts of any length are
worked on in their row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamella.functions import text as T


def short_hash(c: Column, length: int = 8) -> Column:
    return F.substring(F.md5(c), 1, length)


def structural_hash(c: Column) -> Column:
    """Hash of a text without ``//`` and ``#`` comment lines and layout; a shebang counts; comments alone hash the empty text."""
    ls = F.transform(F.split(c, "\n"), lambda x, i: F.when((i == 0) & x.startswith("#!"), x).otherwise(F.regexp_replace(x, r"^\s*(?://|#).*$", "")))
    return F.md5(T.structural_text(F.array_join(ls, " ")))


def head(c: Column, most_tokens: int) -> Column:
    """Leading whole lines with a mark of how many follow, within ``most_tokens``; null where not one line fits or all do.

    The token estimate of a beginning never falls as lines are added, so the
    lines are added up one by one until one is too many.
    """
    ls = F.split(c, "\n")
    n = F.size(ls)
    mark = lambda left: F.concat(F.lit("\n… truncated: "), left.cast("string"), F.lit(" more lines"))
    empty = F.struct(F.lit("").alias("t"), F.lit(0).alias("k"), F.lit(False).alias("full"))

    def step(acc, x):
        more = F.when(acc["k"] == 0, x).otherwise(F.concat(acc["t"], F.lit("\n"), x))
        fits = ~acc["full"] & (T.token_estimate(F.concat(more, mark(n - acc["k"] - 1))) <= most_tokens)
        return F.struct(F.when(fits, more).otherwise(acc["t"]).alias("t"), F.when(fits, acc["k"] + 1).otherwise(acc["k"]).alias("k"), (acc["full"] | ~fits).alias("full"))

    out = F.aggregate(ls, empty, step)
    return F.when((out["k"] > 0) & (out["k"] < n), F.concat(out["t"], mark(n - out["k"])))


def dot_chains(c: Column) -> Column:
    """Structs (object, member) of ``a.b`` in order."""
    found = F.regexp_extract_all(c, F.lit(r"\b[A-Za-z_]\w*\.[A-Za-z_]\w*"), 0)
    return F.transform(found, lambda x: F.struct(F.substring_index(x, ".", 1).alias("object"), F.substring_index(x, ".", -1).alias("member")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def byte_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal from KB on."""
    step = lambda k, unit: F.concat(F.format_string("%.1f", F.bround(n / 1024.0**k, 1)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, step(1, "KB")).when(n < 1024**3, step(2, "MB")).otherwise(step(3, "GB"))


def line_of_char(c: Column, offset: Column) -> Column:
    """The line, from 1, of a code point's place, from 0."""
    before = F.substr(c, F.lit(1), offset.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_starts(c: Column) -> Column:
    """The places of all lines' first code points, from 0."""
    sizes = F.transform(F.split(c, "\n"), lambda x: F.length(x) + 1)
    return F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, v: a + v))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading words, separators kept, two lines share."""
    x, y = F.split(a, r"(?<=\s)|(?=\s)"), F.split(b, r"(?<=\s)|(?=\s)")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def inline_diff(a: Column, b: Column) -> tuple[Column, Column]:
    """Both lines with the words between their common beginning and end in brackets."""
    parts = lambda c: F.split(c, r"(?<=\s)|(?=\s)")
    x, y = parts(a), parts(b)
    lead = common_prefix(a, b)
    back = F.zip_with(F.reverse(x), F.reverse(y), lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(back, False)
    tail = F.least(F.when(first == 0, F.size(back)).otherwise(first - 1).cast("int"), F.least(F.size(x), F.size(y)) - lead)

    def shown(w):
        middle = F.array_join(F.slice(w, lead + 1, F.size(w) - lead - tail), "")
        return F.concat(F.array_join(F.slice(w, F.lit(1), lead), ""), F.when(middle != "", F.concat(F.lit("["), middle, F.lit("]"))).otherwise(""), F.array_join(F.slice(w, F.size(w) - tail + 1, tail), ""))

    return shown(x), shown(y)


def qualified(c: Column) -> tuple[Column, Column]:
    """Parent and name of ``Parent::name`` or ``Parent.name``; a bare name has no parent."""
    mark = F.when(c.contains("::"), "::").otherwise(".")
    at = F.when(c.contains("::"), F.length(c) - F.instr(F.reverse(c), "::")).otherwise(F.length(c) - F.instr(F.reverse(c), ".") + 1)
    has = c.contains("::") | c.contains(".")
    return F.when(has, F.substr(c, F.lit(1), at - 1)), F.when(has, F.substr(c, at + F.length(mark))).otherwise(c)


def normalised_path(c: Column) -> Column:
    """Slashes forward, ``.`` and empty parts gone, ``..`` resolved."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))), "/")


def extension_rank(path: Column, order: list[str]) -> Column:
    """A path's place in ``order`` of suffixes, those without one last."""
    rank = F.lit(len(order))
    for i, x in reversed(list(enumerate(order))):
        rank = F.when(path.endswith(x), i).otherwise(rank)
    return rank


def free_lines(start: Column, end: Column, spans: Column) -> Column:
    """The lines of a range that none of ``spans`` (structs ``start_line, end_line``) holds, as an array."""
    return F.filter(F.sequence(start, end), lambda n: ~F.exists(spans, lambda s: (n >= s["start_line"]) & (n <= s["end_line"])))


def merged_ranges(spans: Column) -> Column:
    """Ranges (structs ``a, b``) in order, those that touch or overlap made one."""
    last = lambda acc: F.element_at(acc, -1)

    def step(acc, s):
        joins = (F.size(acc) > 0) & (s["a"] <= last(acc)["b"])
        one = F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one))).otherwise(F.concat(acc, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<a:bigint,b:bigint>>"), step)


# Predicates ---------------------------------------------------------------------

# Files that manage a project's packages.
MANIFESTS = ("cargo.toml", "package.json", "pyproject.toml", "go.mod", "tsconfig.json", ".gitattributes", ".gitignore")
# Words of prompts that are never taken for names.
STOP_WORDS = ("this", "that", "with", "from", "what", "when", "where", "which", "function", "class", "method", "file", "code", "test", "tests")


def binary_content(c: Column) -> Column:
    """Whether bytes hold a NUL or aren't UTF-8."""
    return F.contains(F.hex(c), F.lit("00")) & F.exists(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0))), lambda i: F.substring(F.hex(c), i * 2 + 1, F.lit(2)) == "00") | ~F.is_valid_utf8(c.cast("string"))


def undiffable(status: Column, before: Column, after: Column) -> Column:
    """Whether a change lacks the contents that its status needs."""
    return F.when(status == "added", after.isNull()).when(status == "deleted", before.isNull()).otherwise(before.isNull() | after.isNull())


def stub_signature(content: Column) -> Column:
    """Whether the first line says nothing of its own: empty, an attribute, decorator or comment."""
    line = F.trim(T.signature(F.coalesce(content, F.lit(""))))
    return (line == "") | line.startswith("#[") | line.startswith("@") | line.startswith("//") | line.startswith("/*")


def packer_test(name: Column, path: Column, content: Column) -> Column:
    """The context packer's own idea of a test."""
    head_ = F.ltrim(F.coalesce(content, F.lit("")))
    file = F.substring_index(path, "/", -1)
    marks = F.lit(False)
    for x in ("#[test]", "#[tokio::test]", "#[cfg(test)]"):
        marks = marks | head_.startswith(x)
    for x in ("_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "_test.py"):
        marks = marks | path.endswith(x)
    return name.startswith("test_") | (name == "tests") | marks | path.contains("/tests/") | file.startswith("test_")


def manifest_file(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1)).isin(*MANIFESTS)


def noise_path(path: Column, excluded: Column) -> Column:
    """Whether a watcher passes over the path: inside ``.git``, or excluded."""
    return path.rlike(r"(^|/)\.git(/|$)") | excluded


#: A name that may refer to an entity: two characters, three where the first is a small letter.
REFERENCE_WORD = r"^(?:[a-z]\w{2,}|[A-Z_]\w+)$"

#: Names that are nearly always locals and are never taken for references.
COMMON_LOCALS = (
    "result", "results", "data", "config", "value", "values", "item", "items", "input",
    "output", "args", "opts", "name", "path", "file", "line", "count", "index", "temp", "prev",
    "next", "curr", "current", "node", "left", "right", "root", "head", "tail", "body", "text",
    "content", "source", "target", "entry", "error", "errors", "message", "response",
    "request", "context", "state", "props", "event", "handler", "callback", "options",
    "params", "query", "list", "base", "info", "meta", "kind", "mode", "flag", "size",
    "length", "width", "height", "start", "stop", "begin", "done", "found", "status", "code",
)


def reference_word(c: Column, common: tuple[str, ...] = COMMON_LOCALS) -> Column:
    return c.rlike(REFERENCE_WORD) & ~c.isin(*common)


def prompt_names(c: Column, most: int = 2) -> Column:
    """Up to ``most`` names that a prompt mentions: in backticks, qualified, with underscores or inner capitals, of four characters at least."""
    found = lambda rule, g=1: F.regexp_extract_all(c, F.lit(rule), g)
    every = F.concat(found(r"`([A-Za-z_]\w*)`"), found(r"\b(?:\w+(?:::|\.))+([A-Za-z_]\w*)"), found(r"\b([a-z]\w*_\w+)\b"), found(r"\b([A-Za-z]*[a-z][A-Z]\w*)\b"))
    kept = F.filter(F.array_distinct(every), lambda x: (F.length(x) >= 4) & ~F.lower(x).isin(*STOP_WORDS))
    return F.slice(kept, 1, most)


#: Interpreters by the begin of their names, and editors' names of languages, with the suffix whose parser fits.
SHEBANGS = (("python", ".py"), ("node", ".js"), ("deno", ".ts"), ("ruby", ".rb"), ("bash", ".sh"), ("sh", ".sh"), ("zsh", ".sh"))
MODES = {"python": ".py", "javascript": ".js", "typescript": ".ts", "ruby": ".rb", "sh": ".sh", "bash": ".sh", "go": ".go", "rust": ".rs", "java": ".java", "yaml": ".yaml", "json": ".json", "toml": ".toml", "markdown": ".md"}
_TELLING = ((".py", r"(?m)^(?:def \w+\(.*\).*:|import \w+$|from \w+ import )"), (".go", r"(?m)^(?:package \w+$|func )"), (".rs", r"(?m)^(?:fn |use \w+::|impl )"), (".js", r"(?m)^(?:const \w+ = |function \w+\(|module\.exports)"), (".java", r"(?m)^(?:public class |import java\.)"), (".json", r"\A\s*[\[{]\s*[\"\[{]"))


def language_of_content(c: Column) -> Column:
    """The suffix whose parser fits a whole text: by its first line's interpreter, an editor's mode line, or the most of telling declarations, two at least; else null."""
    text = F.coalesce(c, F.lit(""))
    shebang = r"^#!\s*(\S+)(?:[ \t]+(\S+))?"
    first, second = F.regexp_extract(text, shebang, 1), F.regexp_extract(text, shebang, 2)
    tool = F.substring_index(F.when(first.endswith("/env") & (second != ""), second).otherwise(first), "/", -1)
    by_tool = F.coalesce(*[F.when(tool.startswith(name), suffix) for name, suffix in SHEBANGS])
    mode = F.lower(F.regexp_extract(text, r"(?:vim?|ex):.*?\b(?:ft|filetype|syntax)=(\w+)", 1))
    by_mode = F.coalesce(*[F.when(mode == name, suffix) for name, suffix in MODES.items()])
    scores = [(suffix, F.regexp_count(text, F.lit(rule))) for suffix, rule in _TELLING]
    best = F.greatest(*[n for _, n in scores])
    told = F.coalesce(*[F.when((n == best) & (n >= (1 if suffix == ".json" else 2)), suffix) for suffix, n in scores])
    return F.coalesce(by_tool, F.when(mode != "", by_mode).otherwise(told))


def display_language(suffix: Column) -> Column:
    """A suffix's language as shown to readers; unknown ones as they are."""
    names = {"py": "Python", "ts": "TypeScript", "tsx": "TSX", "js": "JavaScript", "rs": "Rust", "go": "Go", "rb": "Ruby", "java": "Java", "md": "Markdown", "json": "JSON", "yaml": "YAML", "toml": "TOML", "html": "HTML", "c": "C", "cpp": "C++"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), suffix), suffix)
