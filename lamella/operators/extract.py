"""Entities of structured files: one file in, its entities out.

Parsers take a path and a text and give entities in the file's order; a registry
maps suffixes to parsers, the longest suffix first, and text of an unknown kind
falls back to chunks of twenty lines.  Data formats and Python are parsed
exactly.  Languages with braces or indented blocks go by declaration patterns
over text whose comments and strings are blanked; that finds declarations and
their blocks but is no grammar.

Defined cases: null texts count as empty and have no entities; text that a
format's own parser rejects has none either; line ends of any kind count as one
line feed; a file is parsed whole in its row; repeated files are parsed each;
ids that a file uses twice get ``@L<line>`` and ``#<ordinal>`` in code, markup and
Markdown, and stay as they are in CSV, JSON, YAML and TOML; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import tomllib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.pieces import MODES

SCHEMA = "id string, file_path string, entity_type string, name string, parent_id string, content string, content_hash string, structural_hash string, start_line long, end_line long, metadata map<string,string>"
CHUNK = 20


@dataclass
class Entity:
    entity_type: str
    name: str
    start_line: int
    end_line: int
    content: str
    parent: Entity | None = None
    id: str = ""
    structural: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)


Parser = Callable[[str, str], list[Entity]]
_parsers: dict[str, tuple[Parser, bool]] = {}


def register(parser: Parser, *suffixes: str, repair: bool = True) -> Parser:
    """Use ``parser`` for paths that end with one of ``suffixes``; ``repair`` makes its ids unique in a file."""
    for s in suffixes:
        _parsers[s.lower()] = parser, repair
    return parser


def parser_of(path: str, custom: dict[str, str] | None = None) -> tuple[Parser, bool]:
    """The parser of the longest dotted suffix; ``custom`` maps further suffixes to known ones."""
    name = path.rsplit("/", 1)[-1].lower()
    for i in [i for i, c in enumerate(name) if c == "."]:
        s = name[i:]
        s = (custom or {}).get(s, s)
        if s in _parsers:
            return _parsers[s]
    return chunks, True


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def lines_of(text: str) -> list[str]:
    out = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return out[:-1] if out[-1] == "" else out


def body(ls: list[str], start: int, end: int) -> str:
    return "\n".join(ls[start - 1 : end])


def trimmed(ls: list[str], start: int, end: int) -> int:
    """The last line up to ``end`` that isn't blank."""
    while end > start and not ls[end - 1].strip():
        end -= 1
    return end


# Text and data -----------------------------------------------------------------


def chunks(path: str, text: str) -> list[Entity]:
    ls = lines_of(text)
    out = []
    for a in range(1, len(ls) + 1, CHUNK):
        b = min(a + CHUNK - 1, len(ls))
        out.append(Entity("chunk", f"lines {a}-{b}", a, b, body(ls, a, b)))
    return out


def cells(line: str, mark: str) -> list[str]:
    """One record: quoted cells may hold the separator, a doubled quote is a quote, blanks around cells go."""
    out, cell, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                cell += '"'
                i += 1
            else:
                quoted = not quoted
        elif c == mark and not quoted:
            out.append(cell.strip())
            cell = ""
        else:
            cell += c
        i += 1
    return [*out, cell.strip()]


def table_rows(path: str, text: str) -> list[Entity]:
    """Rows under a header; a row's line is its place among the lines that aren't blank."""
    mark = "\t" if path.lower().endswith(".tsv") else ","
    ls = [x for x in lines_of(text) if x.strip()]
    if not ls:
        return []
    head, out = cells(ls[0], mark), []
    for n, line in enumerate(ls[1:], 2):
        own = cells(line, mark)
        meta = {h: own[i] for i, h in enumerate(head) if i < len(own)}
        out.append(Entity("row", f"row[{own[0] or f'row_{n - 1}'}]", n, n, line, structural=digest("\0".join(own)), metadata=meta))
    return out


_SCALAR = re.compile(r'"(?:[^"\\]|\\.)*"|[^\s,\]}\[{:"]+', re.S)


def json_members(path: str, text: str) -> list[Entity]:
    """Members of objects at any depth, by RFC 6901 pointer; arrays are entered at the root only."""
    try:
        json.loads(text)
    except ValueError:
        return []
    pos, out = 0, []
    line_at = lambda p: text.count("\n", 0, p) + 1

    def blank(p: int) -> int:
        while p < len(text) and text[p] in " \t\r\n":
            p += 1
        return p

    def end_of(p: int) -> int:
        if text[p] not in "[{":
            return _SCALAR.match(text, p).end()
        depth = 0
        while True:
            if text[p] == '"':
                p = _SCALAR.match(text, p).end()
                continue
            depth += (text[p] in "[{") - (text[p] in "]}")
            p += 1
            if not depth:
                return p

    pos = blank(0)
    if text[pos] not in "[{":
        return [Entity("chunk", "document", line_at(pos), line_at(end_of(pos) - 1), text[pos : end_of(pos)])]
    work = [(pos, "", None)]
    while work:
        p, pointer, parent = work.pop()
        array, p, k, inner = text[p] == "[", blank(p + 1), 0, []
        while text[p] not in "]}":
            if array:
                name, at = str(k), p
            else:
                e = end_of(p)
                name, at = json.loads(text[p:e]), p
                p = blank(blank(e) + 1)
            e = end_of(p)
            value = text[p:e]
            mark = f"{pointer}/{name.replace('~', '~0').replace('/', '~1')}"
            kind = "object" if value[0] == "{" else "element" if array else "property"
            own = Entity(kind, name, line_at(at), line_at(e - 1), text[at:e], parent, f"{path}::{mark}", digest(value))
            inner.append((own, p if value[0] == "{" else None, mark))
            p, k = blank(e), k + 1
            if text[p] == ",":
                p = blank(p + 1)
        for own, at, mark in inner:
            out.append((mark, own))
            if at is not None:
                work.append((at, mark, own))
    order = {id(own): (own.start_line, i) for i, (_, own) in enumerate(out)}
    return sorted((own for _, own in out), key=lambda x: order[id(x)])


_YAML = re.compile(r"""^(?:"([^"]+)"|'([^']+)'|([^\s#'"\-\[{&*!|>%@`][^:#]*?))\s*:(?:\s|$)(.*)$""")


def yaml_keys(path: str, text: str) -> list[Entity]:
    """Keys at the first column with what follows up to the next one; what comes before them is a preamble."""
    ls = lines_of(text)
    found = [(i, next(x for x in m.groups()[:3] if x), m[4].strip()) for i, line in enumerate(ls, 1) if (m := _YAML.match(line))]
    if not found:
        return [Entity("chunk", "(document)", 1, trimmed(ls, 1, len(ls)), body(ls, 1, trimmed(ls, 1, len(ls))))] if any(x.strip() for x in ls) else []
    out = []
    first = found[0][0]
    if any(x.strip() and x.strip() not in ("---", "...") for x in ls[: first - 1]):
        end = trimmed(ls, 1, first - 1)
        out.append(Entity("chunk", "(preamble)", 1, end, body(ls, 1, end)))
    for (a, name, rest), after in zip(found, [*[x[0] for x in found[1:]], len(ls) + 1]):
        end = trimmed(ls, a, after - 1)
        block = any(x[:1] in (" ", "\t", "-") and x.strip() for x in ls[a:end])
        kind = "section" if block and rest[:1] not in ("|", ">") or rest[:1] in ("{", "[") else "property"
        own = body(ls, a, end)
        value = "\n".join([rest, *[x.strip() for x in ls[a:end] if x.strip() and not x.strip().startswith("#")]])
        out.append(Entity(kind, name.strip(), a, end, own, structural=digest(value)))
    return out


_TOML_HEAD = re.compile(r"^\s*\[(\[)?\s*([^\[\]]+?)\s*\]\]?\s*(?:#.*)?$")
_TOML_KEY = re.compile(r"""^\s*((?:[A-Za-z0-9_\-]+|"[^"]*"|'[^']*')(?:\s*\.\s*(?:[A-Za-z0-9_\-]+|"[^"]*"|'[^']*'))*)\s*=""")


def toml_keys(path: str, text: str) -> list[Entity]:
    """Root keys, sections and elements of arrays of tables (``name/0``, ``name/1``), hashed by their parsed value."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    ls, out, seen = lines_of(text), [], Counter()

    def value_at(dotted: str, n: int | None = None):
        v = data
        for part in re.findall(r"""[A-Za-z0-9_\-]+|"[^"]*"|'[^']*'""", dotted):
            v = v[-1] if isinstance(v, list) else v
            v = v[part.strip("\"'")]
        return v[n] if n is not None else v

    spots = [(i, m) for i, x in enumerate(ls, 1) if (m := _TOML_HEAD.match(x))]
    until = spots[0][0] - 1 if spots else len(ls)
    i = 1
    while i <= until:
        m = _TOML_KEY.match(ls[i - 1])
        if not m:
            i += 1
            continue
        end = i
        while end < until:  # a value may go on: the key's text up to here must parse
            try:
                tomllib.loads(body(ls, i, end))
                break
            except tomllib.TOMLDecodeError:
                end += 1
        out.append(Entity("property", m[1], i, end, body(ls, i, end), structural=digest(json.dumps(value_at(m[1]), sort_keys=True, default=str))))
        i = end + 1
    for (a, m), after in zip(spots, [*[x[0] for x in spots[1:]], len(ls) + 1]):
        end = trimmed(ls, a, after - 1)
        n = None
        name = m[2]
        if m[1]:
            n = seen[m[2]]
            seen[m[2]] += 1
            name = f"{m[2]}/{n}"
        try:
            value = value_at(m[2], n)
        except (KeyError, IndexError, TypeError):
            value = body(ls, a, end)
        out.append(Entity("section", name, a, end, body(ls, a, end), structural=digest(json.dumps(value, sort_keys=True, default=str))))
    return out


# Markup ------------------------------------------------------------------------


def _levels(found: list[tuple[int, int, str, str]], ls: list[str], preamble: str | None) -> list[Entity]:
    """Sections from (line, level, kind, title), each up to the next of its level or above, below the nearest one of a lower level."""
    out: list[Entity] = []
    if preamble and (first := found[0][0] if found else len(ls) + 1) > 1 and any(x.strip() for x in ls[: first - 1]):
        end = trimmed(ls, 1, first - 1)
        out.append(Entity(preamble, "(preamble)", 1, end, body(ls, 1, end)))
    stack: list[tuple[int, Entity]] = []
    for i, (line, level, kind, title) in enumerate(found):
        after = next((x[0] for x in found[i + 1 :] if x[1] <= level), len(ls) + 1)
        while stack and stack[-1][0] >= level:
            stack.pop()
        end = trimmed(ls, line, after - 1)
        own = Entity(kind, title, line, end, body(ls, line, end), stack[-1][1] if stack else None)
        stack.append((level, own))
        out.append(own)
    return out


def markdown(path: str, text: str) -> list[Entity]:
    """ATX headings outside fenced code, with a preamble."""
    ls, found, fence = lines_of(text), [], None
    for i, x in enumerate(ls, 1):
        if m := re.match(r"^\s{0,3}(```+|~~~+)", x):
            fence = None if fence and m[1].startswith(fence) else fence or m[1]
        elif not fence and (m := re.match(r"^(#{1,6})\s+(.+?)\s*#*\s*$", x)):
            found.append((i, len(m[1]), "heading", m[2]))
    return _levels(found, ls, "preamble")


#: Sectioning commands by level, and environments that count.
TEX_LEVELS = {"part": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
TEX_ENVIRONMENTS = ("figure", "table", "equation", "align", "theorem", "lemma", "proof", "definition", "corollary", "proposition", "example", "algorithm", "lstlisting", "abstract")


def latex(path: str, text: str) -> list[Entity]:
    ls = lines_of(text)
    plain = [re.sub(r"(?<!\\)%.*", "", x) for x in ls]
    command = re.compile(r"\\(" + "|".join(TEX_LEVELS) + r")\*?\{([^}]*)\}")
    found = [(i, TEX_LEVELS[m[1]], m[1], m[2]) for i, x in enumerate(plain, 1) if (m := command.search(x))]
    start = next((i for i, x in enumerate(plain, 1) if r"\begin{document}" in x), 0)
    out = _levels(found, ls, None)
    if start > 1 and any(x.strip() for x in ls[: start - 1]):
        out.insert(0, Entity("preamble", "(preamble)", 1, trimmed(ls, 1, start - 1), body(ls, 1, trimmed(ls, 1, start - 1))))
    within = lambda n: max((s for s in out if s.entity_type in TEX_LEVELS and s.start_line <= n <= s.end_line), key=lambda s: s.start_line, default=None)
    open_, more, count = [], [], Counter()
    for i, x in enumerate(plain, 1):
        for m in re.finditer(r"\\(begin|end)\{(\w+)\*?\}", x):
            if m[2] not in TEX_ENVIRONMENTS:
                continue
            if m[1] == "begin":
                open_.append((m[2], i))
            elif open_ and open_[-1][0] == m[2]:
                kind, a = open_.pop()
                count[kind] += 1
                own = body(ls, a, i)
                label = re.search(r"\\label\{([^}]*)\}", own)
                more.append(Entity(kind, label[1] if label else f"{kind}_{count[kind]}", a, i, own, within(a)))
        if m := re.match(r"\s*\\(?:re)?newcommand\*?\{?\\(\w+)\}?", x):
            more.append(Entity("command", m[1], i, i, ls[i - 1]))
    return sorted([*out, *more], key=lambda x: (x.start_line, -x.end_line))


_BLOCK = re.compile(r"^<(template|script|style|[a-z][\w-]*)\b([^>]*)>", re.M)


def sfc(path: str, text: str) -> list[Entity]:
    """Top-level blocks; scripts' declarations below them, at the file's lines."""
    ls, out, at = lines_of(text), [], 0
    text = "\n".join(ls)
    count = Counter()
    while m := _BLOCK.search(text, at):
        close, depth, p = re.compile(rf"<(/)?{m[1]}\b[^>]*?(/)?>"), 1, m.end()
        while depth and (t := close.search(text, p)):
            depth += -1 if t[1] else 0 if t[2] else 1
            p = t.end()
        end = p if not depth else len(text)
        a, b = text.count("\n", 0, m.start()) + 1, text.count("\n", 0, end) + 1
        count[m[1]] += 1
        name = m[1] + (" setup" if "setup" in m[2] else " module" if "module" in m[2] else "")
        own = Entity("sfc_block", name, a, b, text[m.start() : end])
        out.append(own)
        if m[1] == "script":
            inner = text[m.end() : text.rfind("</", m.end(), end)]
            shift = text.count("\n", 0, m.end())
            for e in _code("ts" if "ts" in m[2] else "js")(path, inner):
                e.start_line, e.end_line = e.start_line + shift, e.end_line + shift
                e.parent = e.parent or own
                out.append(e)
        at = end
    return out


_SVELTE = re.compile(r"\{([#/])(if|each|await|key|snippet)\b\s*([^}]*)\}")


def svelte(path: str, text: str) -> list[Entity]:
    """Scripts, styles and their declarations, snippets and control blocks with their nesting."""
    scripts = [e for e in sfc(path, text) if e.parent is not None or e.name.split()[0] in ("script", "style")]
    for e in scripts:
        if e.entity_type == "sfc_block":
            e.entity_type = {"script": "svelte_instance_script", "script module": "svelte_module_script", "style": "style"}.get(e.name, "svelte_instance_script")
    ls = lines_of(text)
    plain, open_, out = "\n".join(ls), [], []
    for m in _SVELTE.finditer(plain):
        line = plain.count("\n", 0, m.start()) + 1
        if m[1] == "#":
            title = re.match(r"\w+", m[3])[0] if m[2] == "snippet" and re.match(r"\w+", m[3]) else f"{m[2]} {m[3].strip()}".strip()
            own = Entity(f"svelte_{m[2]}", title, line, line, "", open_[-1] if open_ else None)
            open_.append(own)
            out.append(own)
        elif open_ and open_[-1].entity_type == f"svelte_{m[2]}":
            own = open_.pop()
            own.end_line = line
    for own in out:
        own.content = body(ls, own.start_line, own.end_line)
    return sorted([*scripts, *out], key=lambda x: (x.start_line, -x.end_line))


_ERB = re.compile(r"<%(#|==|=|-)?(.*?)-?%>", re.S)


def erb(path: str, text: str) -> list[Entity]:
    """The template, and its blocks, expressions and code tags, nested by ``do`` or ``if`` and ``end``."""
    ls = lines_of(text)
    plain = "\n".join(ls)
    if not plain.strip():
        return []
    top = Entity("template", path.rsplit("/", 1)[-1].split(".")[0], 1, len(ls), plain)
    out, open_, count = [top], [top], Counter()
    for m in _ERB.finditer(plain):
        a, b = plain.count("\n", 0, m.start()) + 1, plain.count("\n", 0, m.end()) + 1
        code = m[2].strip()
        if m[1] == "#" or not code:
            continue
        if code == "end":
            if len(open_) > 1:
                own = open_.pop()
                own.end_line = b
                own.content = body(ls, own.start_line, b)
            continue
        if re.match(r"(else|elsif|when|rescue|ensure)\b", code):
            continue
        block = bool(re.match(r"(if|unless|case|while|until|for|begin)\b", code) or re.search(r"\bdo(\s*\|[^|]*\|)?$", code))
        kind = "block" if block else "expression" if m[1] in ("=", "==") else "code"
        title = re.sub(r"\s+", " ", code)[:60]
        count[kind, title] += 1
        own = Entity(f"erb_{kind}", title if count[kind, title] == 1 else f"{title} {count[kind, title]}", a, b, m[0], open_[-1])
        out.append(own)
        if block:
            open_.append(own)
    return out


# Code --------------------------------------------------------------------------


def python(path: str, text: str) -> list[Entity]:
    """Functions, classes and methods by Python's own parser, decorators included; structure is the tree without names' places or docstrings."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    ls, out = lines_of(text), []

    def structure(node) -> str:
        plain = [x for x in node.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str))]
        return digest(ast.dump(ast.Module([*plain], [])) + (ast.dump(node.args) if hasattr(node, "args") else "") + "".join(ast.dump(d) for d in node.decorator_list))

    def visit(nodes, parent: Entity | None) -> None:
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                a = min([n.lineno, *[d.lineno for d in n.decorator_list]])
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if parent is not None and parent.entity_type == "class" else "function"
                own = Entity(kind, n.name, a, n.end_lineno, body(ls, a, n.end_lineno), parent, structural=structure(n))
                out.append(own)
                if kind == "class":
                    visit(n.body, own)
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(n, part, []), parent)

    visit(tree.body, None)
    return out


_SLASH = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'", re.S)
_HASH = re.compile(r"#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


def blanked(text: str, kind: str = "slash") -> str:
    """``text`` with comments and strings as blanks, as long as before and with its line feeds."""
    rule = {"slash": _SLASH, "rust": _RUST, "hash": _HASH}[kind]
    return rule.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_JS = (
    ("class", r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(\w+)"),
    ("interface", r"^[ \t]*(?:export\s+)?interface\s+(\w+)"),
    ("enum", r"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
    ("type", r"^[ \t]*(?:export\s+)?type\s+(\w+)[^=\n]*="),
    ("namespace", r"^[ \t]*(?:export\s+)?(?:namespace|module)\s+(\w+)"),
    ("function", r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("variable", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)"),
    ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*([A-Za-z_$#]\w*)\s*\([^;{}]*\)\s*(?::[^;{}]+)?\{"),
)
_RULES: dict[str, tuple[str, tuple]] = {
    "js": ("slash", _JS),
    "ts": ("slash", _JS),
    "go": ("slash", (("method", r"^func\s*\(\s*\w*\s*\*?\w+[^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("type", r"^type\s+(\w+)"))),
    "rs": ("rust", (("impl", r"^[ \t]*impl(?:<[^>]*>)?\s+((?:[\w:<>', ]+\s+for\s+)?[\w:]+)"), ("trait", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("struct", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("module", r"^[ \t]*(?:pub\s+)?mod\s+(\w+)"), ("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)"))),
    "java": ("slash", (("class", r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed|partial|internal|data|open)\s+)*(?:class|record|object)\s+(\w+)"), ("interface", r"^[ \t]*(?:(?:public|private|protected|sealed)\s+)*(?:interface|protocol|trait)\s+(\w+)"), ("struct", r"^[ \t]*(?:(?:public|private|internal)\s+)*struct\s+(\w+)"), ("enum", r"^[ \t]*(?:(?:public|private|protected)\s+)*enum\s+(?:class\s+)?(\w+)"), ("extension", r"^[ \t]*extension\s+(\w+)"), ("function", r"^[ \t]*(?:(?:public|private|protected|static|final|override|open|suspend|inline|mutating|def)\s+)*(?:fun|func|def|function)\s+(\w+)"), ("method", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|override|virtual|async|synchronized|internal)\s+)*(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?]+\s+(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w,\s.]+)?\{"))),
    "c": ("slash", (("struct", r"^[ \t]*(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("class", r"^[ \t]*class\s+(\w+)[^;{]*\{"), ("enum", r"^[ \t]*(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)\s*\{"), ("namespace", r"^[ \t]*namespace\s+(\w+)"), ("function", r"^(?!\s*(?:if|for|while|switch|return|else)\b)[\w:*&<>,\s]+?[\s*&]([\w:~]+)\s*\([^;{}]*\)\s*(?:const\s*)?\{"))),
    "sh": ("hash", (("function", r"^[ \t]*(?:function\s+)?([\w-]+)\s*\(\)\s*\{"),)),
}
_RUBY = re.compile(r"^([ \t]*)(class|module|def)\s+((?:self\.)?[\w:?!]+)", re.M)
_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "constructor_", "do", "else", "with"}


def _block_end(plain: str, at: int) -> int:
    """Where the declaration at ``at`` ends: the brace that closes its first one, or its line where a ``;`` or line feed comes first."""
    depth, p, round_ = 0, at, 0
    while p < len(plain):
        c = plain[p]
        if c in "([":
            round_ += 1
        elif c in ")]":
            round_ -= 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                rest = plain.find("\n", p)
                return p + 1 if rest < 0 or plain[p + 1 : rest].strip(" \t;,)") else rest
        elif c == ";" and not depth and not round_:
            return p + 1
        elif c == "\n" and not depth and round_ <= 0 and not re.match(r"\s*(?:\{|where\b|throws\b|extends\b|implements\b|:|[?.|&+=]|=>)", plain[p:]) and not re.search(r"(?:[=,|&+(]|=>|->)\s*$", plain[at:p]):
            return p
        p += 1
    return len(plain)


def _code(language: str) -> Parser:
    kind, rules = _RULES[language]
    compiled = [(k, re.compile(r, re.M)) for k, r in rules]

    def parse(path: str, text: str) -> list[Entity]:
        text = "\n".join(lines_of(text))
        plain, ls = blanked(text, kind), lines_of(text)
        found: dict[int, Entity] = {}
        for k, rule in compiled:
            for m in rule.finditer(plain):
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                if at in found or m[1] in _WORDS:
                    continue
                end = _block_end(plain, at)
                a, b = plain.count("\n", 0, at) + 1, plain.count("\n", 0, max(at, end - 1)) + 1
                meta = {}
                if language == "go" and k == "method":
                    meta = {"receiver": re.match(r"func\s*\(\s*\w*\s*\*?(\w+)", plain[at:])[1]}
                found[at] = Entity(k, m[1], a, b, body(ls, a, b), metadata=meta)
        if language in ("js", "ts"):
            for m in re.finditer(r"^[ \t]*export\s*\{([^}]*)\}\s*from\b", plain, re.M):
                n = plain.count("\n", 0, m.start()) + 1
                for j, one in enumerate(x.strip() for x in m[1].split(",") if x.strip()):
                    found[m.start() + j / 1e6] = Entity("export", re.split(r"\s+as\s+", one)[-1], n, n, ls[n - 1], metadata={"source": re.split(r"\s+as\s+", one)[0]})
            for m in re.finditer(r"^([ \t]*)(describe|it|test)\s*\(\s*(['\"`])(.*?)\3", text, re.M):
                at = m.start(2)
                end = _block_end(plain, at)
                a, b = text.count("\n", 0, at) + 1, text.count("\n", 0, max(at, end - 1)) + 1
                found[at] = Entity("test_suite" if m[2] == "describe" else "test", m[4], a, b, body(ls, a, b))
        out = [found[k] for k in sorted(found)]
        kept: list[Entity] = []
        for e in out:
            holders = [x for x in kept if x.start_line <= e.start_line and e.end_line <= x.end_line and x is not e and (x.start_line, x.end_line) != (e.start_line, e.end_line)]
            e.parent = max(holders, key=lambda x: x.start_line, default=None)
            if e.parent is not None and e.entity_type in ("function", "variable") and e.parent.entity_type in ("function", "method"):
                continue  # locals stay part of their function
            if e.entity_type == "method" and language != "go" and (e.parent is None or e.parent.entity_type not in ("class", "interface", "enum", "struct", "extension", "impl", "trait", "variable")):
                continue
            if e.entity_type == "function" and e.parent is not None and e.parent.entity_type in ("impl", "trait", "class", "struct", "interface", "extension", "enum"):
                e.entity_type = "method"
            kept.append(e)
        for e in kept:
            e.structural = digest(re.sub(r"\s+", " ", _code_text(e.content, kind)).strip())
        return kept

    return parse


def _code_text(content: str, kind: str) -> str:
    """``content`` without comments; strings stay."""
    rule = {"slash": _SLASH, "rust": _RUST, "hash": _HASH}[kind]
    return rule.sub(lambda m: m[0] if m[0][0] in "\"'`" else " ", content)


def uncommented(text: str) -> str:
    """A script's text without comments; strings stay."""
    return _code_text(text, "slash")


def ruby(path: str, text: str) -> list[Entity]:
    """Classes, modules and methods up to the ``end`` at their own indent."""
    text = "\n".join(lines_of(text))
    ls, out = lines_of(text), []
    for m in _RUBY.finditer(blanked(text, "hash")):
        a = text.count("\n", 0, m.start()) + 1
        close = re.compile(rf"^{re.escape(m[1])}end\b")
        b = next((i for i in range(a + 1, len(ls) + 1) if close.match(ls[i - 1])), a)
        out.append(Entity({"def": "method"}.get(m[2], m[2]), m[3], a, b, body(ls, a, b)))
    for e in out:
        e.parent = max((x for x in out if x is not e and x.start_line < e.start_line and e.end_line <= x.end_line), key=lambda x: x.start_line, default=None)
        e.structural = digest(re.sub(r"\s+", " ", _code_text(e.content, "hash")).strip())
    return out


register(table_rows, ".csv", ".tsv", repair=False)
register(json_members, ".json", repair=False)
register(yaml_keys, ".yaml", ".yml", repair=False)
register(toml_keys, ".toml", repair=False)
register(markdown, ".md", ".mdx", ".markdown")
register(latex, ".tex")
register(sfc, ".vue")
register(svelte, ".svelte")
register(erb, ".erb", ".html.erb")
register(python, ".py", ".pyi")
register(ruby, ".rb")
register(_code("js"), ".js", ".jsx", ".mjs", ".cjs", ".svelte.js")
register(_code("ts"), ".ts", ".tsx", ".mts", ".cts", ".svelte.ts")
register(_code("go"), ".go")
register(_code("rs"), ".rs")
register(_code("java"), ".java", ".kt", ".cs", ".swift", ".scala", ".php", ".dart")
register(_code("c"), ".c", ".h", ".cpp", ".cc", ".hpp")
register(_code("sh"), ".sh", ".bash")


# Identity ----------------------------------------------------------------------


def identified(path: str, entities: list[Entity], repair: bool = True) -> list[Entity]:
    """Ids by path, kind and name, or parent and name; repeated ones get their line, then an ordinal, and children follow their own parent."""
    used: Counter = Counter()
    plain: dict[int, str] = {}

    def name_of(e: Entity, ids: dict[int, str]) -> str:
        return e.id or (f"{ids[id(e.parent)]}::{e.name}" if e.parent is not None and id(e.parent) in ids else f"{path}::{e.entity_type}::{e.name}")

    for e in entities:
        plain[id(e)] = name_of(e, plain)
        used[plain[id(e)]] += 1
    final: dict[int, str] = {}
    again: Counter = Counter()
    for e in entities:
        own = name_of(e, final)
        if repair and used[plain[id(e)]] > 1:
            own = f"{own}@L{e.start_line}"
            again[own] += 1
            if again[own] > 1:
                own = f"{own}#{again[own]}"
        final[id(e)] = own
    for e in entities:
        e.id = final[id(e)]
    return entities


def entities_of(path: str, text: str | None, custom: dict[str, str] | None = None) -> list[Entity]:
    if not text:
        return []
    parse, repair = parser_of(path, custom)
    return identified(path, parse(path, text), repair)


def entity_rows(path: str, entities: list[Entity], brief: bool = False) -> Iterator[tuple]:
    """``entities`` as rows of :data:`SCHEMA`."""
    for e in entities:
        whole = (None, None, None) if brief else (e.content, digest(e.content), e.structural)
        yield e.id, path, e.entity_type, e.name, e.parent.id if e.parent is not None else None, *whole, e.start_line, e.end_line, {k: v for k, v in e.metadata.items()}


def extracted(files: DataFrame, path: str = "file_path", content: str = "content", custom: dict[str, str] | None = None, brief: bool = False) -> DataFrame:
    """The entities of ``files``; ``brief`` leaves contents and hashes out (null)."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, t in pdf.itertuples(index=False) for r in entity_rows(p, entities_of(p, t, custom), brief)], columns=names, dtype=object).astype({"start_line": "int64", "end_line": "int64"})

    return files.select(F.col(f"`{path}`").cast("string").alias("p"), F.col(f"`{content}`").alias("t")).mapInPandas(work, SCHEMA)


def with_receivers(entities: DataFrame) -> DataFrame:
    """Go methods as children of their receiver's type in the same folder, the first by (file, line), with ids to match."""
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    types = entities.filter(F.col("entity_type").isin("struct", "interface", "type") & F.col("file_path").endswith(".go"))
    first = types.groupBy(folder(F.col("file_path")).alias("_folder"), F.col("name").alias("_type")).agg(F.min_by("id", F.struct("file_path", "start_line", "id")).alias("_owner"))
    e = entities.withColumns({"_folder": folder(F.col("file_path")), "_type": F.when((F.col("entity_type") == "method") & F.col("file_path").endswith(".go"), F.col("metadata")["receiver"])})
    e = e.join(first, ["_folder", "_type"], "left")
    found = F.col("_owner").isNotNull()
    return e.withColumn("id", F.when(found, F.concat_ws("::", "_owner", "name")).otherwise(F.col("id"))).withColumn("parent_id", F.coalesce("_owner", "parent_id")).select(*entities.columns)


def applied(edits: list[tuple[int, int, str]], lines: list[str]) -> str:
    """``lines`` with (first line, last line, text) put in; of edits that overlap the first, or longer one, counts."""
    out, at = [], 1
    for a, b, text in sorted(edits, key=lambda x: (x[0], -x[1])):
        if a < at:
            continue
        out += lines[at - 1 : a - 1] + text.split("\n")
        at = b + 1
    return "\n".join([*out, *lines[at - 1 :]])


# Languages ---------------------------------------------------------------------

def custom_suffixes(text: str) -> dict[str, str]:
    """Lines ``.ext = .known`` or attributes ``*.ext linguist-language=Name`` as a map of suffixes."""
    out = {}
    for line in lines_of(text):
        if m := re.match(r"\s*(\.[\w.]+)\s*=\s*(\.?[\w.]+)\s*$", line):
            out[m[1].lower()] = m[2].lower() if m[2].startswith(".") else MODES.get(m[2].lower(), m[2].lower())
        elif (m := re.match(r"\s*\*(\.[\w.]+)\s.*linguist-language=(\w+)", line)) and m[2].lower() in MODES:
            out[m[1].lower()] = MODES[m[2].lower()]
    return out
