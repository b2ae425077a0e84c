"""Dependency graphs from the text of files: references, imports, resolution, and the graph's upkeep.

A file gives its entities, its references (names in an entity's own lines,
comments, strings and children left out) and its imports in one pass each;
everything that looks across files is a join.  A reference is resolved by the
first rule that knows it: a member of its own class, an imported module's
symbol, a member of the type that its variable or attribute was constructed from
or annotated with, an imported name, a symbol of its file or, in Go, of its package, a method of a name
that one class alone has.  Its local names hide all of these.

Defined cases: null texts have no entities; names that several symbols of a file
bear mean the first by line; unresolved names give no edge; a variable or
attribute that is bound to several types has none; an entity never
points at itself, its parent or its children by bare name; repeated edges keep the
one of the first rule and then of the first type (calls, imports, others); empty
inputs give an empty graph; further columns are ignored.
"""

from __future__ import annotations

import keyword
import posixpath
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import pieces
from lamella.functions import predicates as P
from lamella.operators import exports, extract, scopes
from lamella.operators import graph as G
from lamella.storage import cut, dealt, near

_KEYWORDS = {*keyword.kwlist, "self", "this", "cls", "let", "const", "var", "function", "new", "return", "typeof", "void", "null", "undefined", "true", "false", "func", "package", "struct", "interface", "type", "impl", "trait", "enum", "pub", "mut", "use", "mod", "crate", "match", "switch", "case", "throw", "public", "private", "protected", "static", "final", "extends", "implements", "string", "int", "bool", "end", "module", "require", "export", "default", "instanceof"}
_NAME = re.compile(r"(?:\b(\w+)\s*(?:\.|::|->)\s*)?\b([A-Za-z_]\w*)\b(\s*\()?")
_LOCALS = re.compile(r"(?:\b(?:let|const|var|for|mut)\s+(?:mut\s+)?|^\s*)([A-Za-z_]\w*)\s*(?::\s*[\w\[\], <>.]+)?\s*(?::?=(?!=)|\bin\b|\bof\b)", re.M)
_IMPORT_LINE = re.compile(r"\s*(?:import|from|use|require|include|#include|using)\b")
_REFERENCE = re.compile(pieces.REFERENCE_WORD)
_COMMON = frozenset(pieces.COMMON_LOCALS)
_HASHED = (".py", ".pyi", ".rb", ".sh", ".bash", ".yaml", ".yml", ".toml")
#: Suffixes tried for an import without one, in order.
TRIED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")

REFERENCE = "from_entity string, file_path string, owner string, qualifier string, token string, ref_type string, type_name string"
_BOUND = re.compile(r"(?:\b(self|this)\s*\.\s*)?\b([A-Za-z_]\w*)\s*(?::\s*([A-Z]\w*)\s*)?(?::?=\s*(?:new\s+|await\s+|&)*([A-Z]\w*)\s*(?:::new\s*)?[({]|(?=[,)]))")
IMPORT = "file_path string, local string, candidates array<string>, name string"


def reference_word(token: str) -> bool:
    return bool(_REFERENCE.match(token)) and token not in _KEYWORDS and token not in _COMMON


def local_names(plain: str, header: str) -> set[str]:
    """Parameters, and names that are assigned or looped over."""
    out = set(_LOCALS.findall(plain))
    if m := re.search(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", header):
        out |= {w for part in m[1].split(",") if (w := next(iter(re.findall(r"[A-Za-z_]\w*", part.split("=")[0])), None))}
    return out


def bound_types(plain: str) -> dict[str, str]:
    """Names, attributes with ``self.``, and the one type each is constructed from or annotated with."""
    found: dict[str, set[str]] = {}
    for m in _BOUND.finditer(plain):
        if kind := m[4] or m[3]:
            found.setdefault(("self." if m[1] else "") + m[2], set()).add(kind)
    return {name: kinds.pop() for name, kinds in found.items() if len(kinds) == 1}


def references_of(path: str, text: str, entities: list[extract.Entity] | None = None) -> list[tuple]:
    """(entity, file, its class or parent, qualifier, name, reference type, type of the qualifier) of each reference once."""
    entities = [e for e in (extract.entities_of(path, text) if entities is None else entities) if e.entity_type not in ("chunk", "export", "sfc_block")]
    kind = "hash" if path.endswith(_HASHED) else "rust" if path.endswith(".rs") else "slash"
    lines = extract.blanked("\n".join(extract.lines_of(text)), kind).split("\n")
    owner: list = [None] * (len(lines) + 1)
    for e in sorted(entities, key=lambda e: (e.start_line, -e.end_line)):
        for n in range(e.start_line, min(e.end_line, len(lines)) + 1):
            owner[n] = e
    own: dict[int, list[str]] = {}
    by_id = {id(e): e for e in entities}
    for n, e in enumerate(owner):
        if e is not None:
            own.setdefault(id(e), []).append(lines[n - 1])
    parent_of = lambda e: e.parent.id if e.parent is not None else None
    attributes: dict[str | None, dict[str, set[str]]] = {}
    for key, ls in own.items():
        for name, bound in bound_types("\n".join(ls)).items():
            if name.startswith("self."):
                holder = by_id[key].id if by_id[key].entity_type == "class" else parent_of(by_id[key])
                attributes.setdefault(holder, {}).setdefault(name[5:], set()).add(bound)
    out: dict[tuple, None] = {}
    for key, ls in own.items():
        e = by_id[key]
        hidden = (local_names("\n".join(ls[1:]) if len(ls) > 1 else "", ls[0]) | {e.name}) if e.entity_type in ("function", "method", "variable", "test") else {e.name}
        types = bound_types("\n".join(ls))
        for line in ls:
            imports = bool(_IMPORT_LINE.match(line))
            last: str | None = None
            for m in _NAME.finditer(line):
                q, token, call = m[1], m[2], m[3]
                bound = types.get(q) if q else None
                if q is None and line[: m.start()].rstrip().endswith((".", "->")):  # goes on from the name before it
                    q = last
                    known = attributes.get(parent_of(e), {}).get(q or "", set())
                    bound = next(iter(known)) if len(known) == 1 else None
                    if bound is None:
                        last = token
                        continue
                last = token
                if not reference_word(token) or (q is None and token in hidden):
                    continue
                out[e.id, path, parent_of(e), q, token, "calls" if call else "imports" if imports else "typeref", bound] = None
                if q and q not in hidden and reference_word(q):
                    out[e.id, path, parent_of(e), None, q, "typeref", None] = None
    return list(out)


def _relative(path: str, module: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), module))


def _script_targets(path: str, module: str) -> list[str]:
    if not module.startswith("."):
        return []
    at = _relative(path, module)
    return [at, *[at + x for x in TRIED], *[f"{at}/index{x}" for x in TRIED]]


_STATEMENT = re.compile(r"\b(import|export)\b[ \t]*(?:type[ \t]+)?((?:[\w$* \t]|,\s*|\{[^}]*\})*?)\s*\bfrom\s*['\"]([^'\"]+)['\"]")


def script_imports(path: str, text: str) -> list[tuple]:
    """(local, candidate files, name) of import, re-export and require statements; a null name means the module.

    A default import asks for ``default``, and after that for the symbol of its local name.
    """
    out = []
    for m in _STATEMENT.finditer(text):
        what, where = m[2].strip(), _script_targets(path, m[3])
        if b := re.search(r"\{([^}]*)\}", what):
            for one in filter(str.strip, b[1].split(",")):
                name, local = exports.renamed(one)
                out.append((local, where, name))
        if s := re.search(r"\*\s+as\s+([\w$]+)", what):
            out.append((s[1], where, None))
        if m[1] == "import" and (d := re.match(r"([\w$]+)\s*(?:,|$)", what)):
            out += [(d[1], where, "default"), (d[1], where, d[1])]
    for m in re.finditer(r"(?:const|let|var)\s+(\w+|\{[^}]*\})\s*=\s*require\(['\"]([^'\"]+)['\"]\)", text):
        where = _script_targets(path, m[2])
        if m[1][0] == "{":
            out += [((x.partition(":")[2] or x).strip(), where, x.partition(":")[0].strip()) for x in m[1][1:-1].split(",") if x.strip()]
        else:
            out.append((m[1], where, None))
    return out


def python_imports(path: str, text: str) -> list[tuple]:
    out = []

    def at(module: str) -> str:
        dots = len(module) - len(module.lstrip("."))
        rest = module.lstrip(".").replace(".", "/")
        if not dots:
            return rest
        base = posixpath.dirname(path)
        for _ in range(dots - 1):
            base = posixpath.dirname(base)
        return posixpath.join(base, rest) if rest else base

    files = lambda stem: [f"{stem}.py", f"{stem}/__init__.py"]
    for m in re.finditer(r"^[ \t]*from\s+([.\w]+)\s+import\s+(\([^)]*\)|[^\n#]+)", text, re.M):
        for one in (x.strip() for x in m[2].strip("()").replace("\n", " ").split(",") if x.strip()):
            name, _, local = one.partition(" as ")
            name, local = name.strip(), (local or name).strip()
            out.append((local, files(at(m[1])), name))
            out.append((local, files(posixpath.join(at(m[1]), name)), None))
    for m in re.finditer(r"^[ \t]*import\s+([^\n#]+)", text, re.M):
        for one in (x.strip() for x in m[1].split(",") if x.strip()):
            name, _, local = one.partition(" as ")
            out.append(((local or name.rsplit(".", 1)[-1]).strip(), files(at(name.strip())), None))
    return out


def rust_imports(path: str, text: str) -> list[tuple]:
    root = path.split("src/")[0] + "src" if "src/" in path else posixpath.dirname(path)
    out = []
    for m in re.finditer(r"^\s*(?:pub\s+)?use\s+(crate|super|self)::([^;]+);", text, re.M):
        base = root if m[1] == "crate" else posixpath.dirname(path)
        head, _, group = m[2].partition("{")
        names = [x.strip() for x in group.rstrip("} \n").split(",")] if group else [""]
        for n in names:
            whole = (head + n).replace(" as ", "\0").strip()
            whole, _, local = whole.partition("\0")
            parts = [p for p in whole.split("::") if p]
            if parts:
                stem = posixpath.join(base, *parts[:-1])
                out.append(((local or parts[-1]).strip(), [f"{stem}.rs", f"{stem}/mod.rs"], parts[-1]))
    return out


def go_imports(path: str, text: str) -> list[tuple]:
    """Imported packages under their alias, or the path's last part but for a version; candidates are the folders that end the import's path."""
    out = []
    for block in re.findall(r"^import\s*(\([^)]*\)|[^\n(]+)", text, re.M):
        for m in re.finditer(r"(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\"", block):
            parts = m[2].strip("/").split("/")
            named = parts[:-1] if len(parts) > 1 and re.fullmatch(r"v\d+", parts[-1]) else parts
            if m[1] not in ("_", "."):
                out.append((m[1] or named[-1], ["/".join(parts[i:]) + "/" for i in range(len(parts))], None))
    return out


#: Import scanners by suffix; add to it for other languages.
SCANNERS: dict[str, Callable[[str, str], list[tuple]]] = {".go": go_imports, ".py": python_imports, ".pyi": python_imports, ".rs": rust_imports, **{x: script_imports for x in (*TRIED, ".mts", ".cts", ".vue", ".svelte")}}


def _per_file(files: DataFrame, schema: str, rows: Callable[[str, str], list[tuple]]) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, t in pdf.itertuples(index=False) if t for r in rows(p, t)], columns=names, dtype=object)

    return files.select("file_path", "content").mapInPandas(work, schema)


def references(files: DataFrame) -> DataFrame:
    return _per_file(files, REFERENCE, references_of)


def imports_of(path: str, text: str) -> list[tuple]:
    suffix = posixpath.splitext(path)[1]
    return [(path, *row) for row in SCANNERS[suffix](path, text) if row[1]] if suffix in SCANNERS else []


def exports_of(path: str, text: str) -> list[tuple]:
    if SCANNERS.get(posixpath.splitext(path)[1]) is not script_imports:
        return []
    return [(path, *row) for row in exports.script_exports(path, extract.uncommented(text), _script_targets)]


def import_rows(files: DataFrame) -> DataFrame:
    """``file_path, local, candidates, name`` of every import."""
    return _per_file(files, IMPORT, imports_of)


def export_rows(files: DataFrame) -> DataFrame:
    """The export statements of script files."""
    return _per_file(files, exports.STATEMENT, exports_of)


def import_table(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``file_path, local, target, name``: imported names and the first of their candidate files that exists."""
    return exports.existing(import_rows(files), files if known is None else known, "file_path", "local", "name").select("file_path", "local", "target", "name")


def file_imports(files: DataFrame) -> DataFrame:
    """``importing_file, imported_file``, each once."""
    return import_table(files).select(F.col("file_path").alias("importing_file"), F.col("target").alias("imported_file")).filter("importing_file <> imported_file").distinct()


def symbols_of(nodes: DataFrame) -> DataFrame:
    """``file_path, name, target, target_parent``: what a name means in its file, top-level symbols and first lines first."""
    symbols = nodes.filter("entity_type not in ('chunk', 'export')")
    first = F.struct(F.col("parent_id").isNotNull(), "start_line", "id")
    return symbols.groupBy("file_path", "name").agg(F.min_by(F.struct("id", "parent_id"), first).alias("x")).select("file_path", "name", F.col("x.id").alias("target"), F.col("x.parent_id").alias("target_parent"))


def resolved(refs: DataFrame, nodes: DataFrame, imports: DataFrame, offered: DataFrame | None = None) -> DataFrame:
    """Edges of ``refs``; each rule is an equi join, the first that knows a reference counts.

    ``offered`` says what a file's exported name means (:func:`exports.offered`);
    without it only a file's own symbols can be imported from it.  An
    imported name that its file hands on gives two edges, one to the entity behind it
    and one to the export.
    """
    at = F.struct("start_line", "id")
    symbols = nodes.filter("entity_type not in ('chunk', 'export')").select("id", "file_path", "name", "parent_id", "start_line")
    in_file = cut(symbols_of(nodes), "symbols")
    members = symbols.filter("parent_id is not null").groupBy(F.col("parent_id").alias("owner"), F.col("name").alias("token")).agg(F.min_by("id", at).alias("target"))
    sole = symbols.filter("parent_id is not null").groupBy(F.col("name").alias("token")).agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    far = (in_file if offered is None else offered).select(F.col("file_path").alias("to_file"), F.col("name").alias("to_name"), "target")
    imp = imports.select("file_path", "local", F.col("target").alias("to_file"), F.col("name").alias("imported"))
    own = refs.filter("qualifier in ('self', 'this', 'cls')").join(members, ["owner", "token"]).withColumn("rule", F.lit(0))
    spaces = imp.filter("imported is null").select("file_path", F.col("local").alias("qualifier"), "to_file")
    in_module = refs.join(spaces, ["file_path", "qualifier"])
    by_module = in_module.join(far.withColumnRenamed("to_name", "token"), ["to_file", "token"]).withColumn("rule", F.lit(1))
    names = imp.filter("imported is not null").select("file_path", F.col("local").alias("token"), "to_file", F.col("imported").alias("to_name"))
    meant = names.join(far, ["to_file", "to_name"]).groupBy("file_path", "token").agg(F.min_by("target", F.struct(F.col("to_name") != "default", "target")).alias("target"))
    meant = cut(meant, "meant")
    here_types = in_file.select("file_path", F.col("name").alias("type_name"), F.col("target").alias("type_id"), F.lit(0).alias("via"))
    far_types = meant.select("file_path", F.col("token").alias("type_name"), F.col("target").alias("type_id"), F.lit(1).alias("via"))
    type_ids = here_types.union(far_types).groupBy("file_path", "type_name").agg(F.min_by("type_id", F.struct("via", "type_id")).alias("type_id"))
    of_type = members.select(F.col("owner").alias("type_id"), "token", "target")
    by_type = refs.filter("type_name is not null").join(type_ids, ["file_path", "type_name"]).join(of_type, ["type_id", "token"]).withColumn("rule", F.lit(2))
    by_name = refs.filter("qualifier is null").join(meant, ["file_path", "token"]).withColumn("rule", F.lit(3))
    here = refs.filter("qualifier is null").join(in_file.withColumnRenamed("name", "token"), ["file_path", "token"])
    here = here.filter(~F.col("target").eqNullSafe(F.col("owner")) & ~F.col("target_parent").eqNullSafe(F.col("from_entity"))).withColumn("rule", F.lit(4))
    beside = refs.filter("qualifier is null and file_path like '%.go'").withColumn("to_file", F.concat(F.lit("package:"), folder_of(F.col("file_path"))))
    beside = beside.join(in_file.select("file_path", F.col("name").alias("token")), ["file_path", "token"], "left_anti")
    beside = beside.join(far.withColumnRenamed("to_name", "token"), ["to_file", "token"]).filter(~F.col("target").eqNullSafe(F.col("owner"))).withColumn("rule", F.lit(4))
    methods = refs.filter("qualifier is not null and qualifier not in ('self', 'this', 'cls') and ref_type = 'calls' and file_path rlike '[.](py|rb)$'")
    known = imp.select("file_path", F.col("local").alias("qualifier")).distinct()
    unique = methods.join(known, ["file_path", "qualifier"], "left_anti").join(sole, "token").withColumn("rule", F.lit(5))
    handed = nodes.filter("entity_type = 'export'").groupBy(F.col("file_path").alias("to_file"), F.col("name").alias("to_name")).agg(F.min("id").alias("target"))
    handed_names = refs.filter("qualifier is null").join(names, ["file_path", "token"]).join(handed, ["to_file", "to_name"])
    handed_spaces = in_module.join(handed.withColumnRenamed("to_name", "token"), ["to_file", "token"])
    parts = [own, by_module, by_type, by_name, here, beside, unique, *[x.withColumns({"ref_type": F.lit("imports"), "rule": F.lit(6)}) for x in (handed_names, handed_spaces)]]
    found = None
    for part in parts:
        part = part.select("from_entity", F.col("target").alias("to_entity"), "ref_type", "rule")
        found = part if found is None else found.union(part)
    found = found.filter("from_entity <> to_entity").withColumn("seq", G.rank(F.col("ref_type")))
    return G.deduplicated(found, "rule", "seq")


def export_edges(nodes: DataFrame, step: DataFrame, offered: DataFrame) -> DataFrame:
    """Edges from re-export entities to what they hand on: the next file's export of that name, else the entity behind it."""
    e = nodes.filter("entity_type = 'export'").select(F.col("id").alias("from_entity"), "file_path", "name")
    own = e.join(step.select("file_path", "name", "to_file", "to_name"), ["file_path", "name"])
    handed = e.groupBy(F.col("file_path").alias("to_file"), F.col("name").alias("to_name")).agg(F.min("from_entity").alias("next"))
    ends = offered.select("file_path", "name", "target")
    j = own.join(handed, ["to_file", "to_name"], "left").join(ends, ["file_path", "name"], "left").withColumn("to_entity", F.coalesce("next", "target"))
    return j.filter("to_entity is not null and to_entity <> from_entity").groupBy("from_entity").agg(F.min("to_entity").alias("to_entity")).withColumn("ref_type", F.lit("imports"))


#: The tables that a project's graph is linked from; each is a file's own and found by reading that file alone.
FACTS = ("files", "nodes", "references", "imports", "exports")
#: Buckets of the reference table, by token.
BUCKETS = 64


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


#: What a file gives by itself: a table's columns, and its rows from path, text and entities.
_TABLES: dict[str, tuple[str, Callable[[str, str, list[extract.Entity]], Iterable[tuple]]]] = {
    "nodes": (extract.SCHEMA, lambda p, t, e: extract.entity_rows(p, e)),
    "references": (REFERENCE, references_of),
    "imports": (IMPORT, lambda p, t, e: imports_of(p, t)),
    "exports": (exports.STATEMENT, lambda p, t, e: exports_of(p, t)),
    "scopes": (scopes.FACT, scopes.facts_of),
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
#: Files whose rows a task holds at a time.
FILES_HELD = 1000


def facts(files: DataFrame, *tables: str) -> dict[str, DataFrame]:
    """What each file says: entities, references by token bucket, imports and exports; or those of ``tables`` (and ``scopes``) alone.

    Files are dealt over all tasks by their path, then read in one pass for all tables, whose rows are kept:
    whatever looks at them later reads no file again.
    """
    tables = tables or FACTS[1:]
    files = cut(files.select("file_path", "content"), "texts")
    columns = {t: dict(c.split(" ") for c in _TABLES[t][0].split(", ")) for t in tables}
    kinds: dict[str, str] = {}
    for one in columns.values():
        kinds |= one

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_HELD):
                found: dict[str, list[tuple]] = {t: [] for t in tables}
                for p, text in zip(*[c.to_pylist() for c in batch.slice(at, FILES_HELD).columns]):
                    if text:
                        entities = extract.entities_of(p, text)
                        for t, rows in found.items():
                            rows += _TABLES[t][1](p, text, entities)
                for t, rows in found.items():
                    if rows:
                        own = dict(zip(columns[t], zip(*rows)))
                        own = {c: [list(m.items()) for m in x] if kinds[c].startswith("map") else x for c, x in own.items()}
                        out = [pa.array(own[c], _ARROW[k]) if c in own else pa.nulls(len(rows), _ARROW[k]) for c, k in kinds.items()]
                        yield pa.RecordBatch.from_arrays([*out, pa.array([t] * len(rows))], [*kinds, "fact_table"])

    rows = dealt(files, "file_path").mapInArrow(work, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", fact_table string")
    if "references" in tables:
        rows = rows.withColumn("bucket", bucket_of(F.col("token"))).select(*kinds, "bucket", "fact_table")
        columns["references"]["bucket"] = "int"
    rows = cut(rows, "facts", "fact_table")
    return {"files": files.select("file_path")} | {t: rows.filter(F.col("fact_table") == t).select(*columns[t]) for t in tables}


def folder_of(path: Column) -> Column:
    """A file's folder with its last slash; empty for files that have none."""
    return F.regexp_replace(path, "[^/]*$", "")


def packages(nodes: DataFrame) -> DataFrame:
    """``file_path, name, target`` of Go packages as if their folders were files: what others can name under the folder, all names under ``package:`` and it."""
    go = nodes.filter("file_path like '%.go' and parent_id is null and entity_type not in ('chunk', 'export')")
    first = go.groupBy(folder_of(F.col("file_path")).alias("at"), "name").agg(F.min_by("id", F.struct("file_path", "start_line", "id")).alias("target"))
    shared = first.filter("at <> '' and name rlike '^[A-Z]'").select(F.col("at").alias("file_path"), "name", "target")
    return shared.union(first.select(F.concat(F.lit("package:"), "at"), "name", "target"))


def linking(known: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is looked up across files: ``imports`` with the files they mean, ``step`` and ``offered`` for exported names."""
    folders = known["files"].filter("file_path like '%/%.go'").select(folder_of(F.col("file_path")).alias("file_path"))
    places = known["files"].select("file_path").union(folders)
    imports = cut(exports.existing(known["imports"], places, "file_path", "local", "name").select("file_path", "local", "target", "name"), "imports")
    symbols = cut(symbols_of(known["nodes"]), "symbols")
    step = exports.pointers(known["exports"], symbols, imports, known["files"])
    return {"imports": imports, "step": step, "offered": cut(exports.offered(step, symbols).union(packages(known["nodes"])), "offered")}


def linked(known: dict[str, DataFrame], links: dict[str, DataFrame], only: DataFrame | None = None) -> DataFrame:
    """The edges of all files, or of those in ``only`` (``file_path``), each with the ``file_path`` of its source."""
    nodes, refs, exporting = known["nodes"], known["references"], known["nodes"]
    if only is not None:
        refs = refs.join(near(only), "file_path", "left_semi")
    sources = nodes.select(F.col("id").alias("from_entity"), "file_path")
    edges = resolved(cut(refs, "references"), nodes, links["imports"], links["offered"]).unionByName(export_edges(exporting, links["step"], links["offered"]))
    edges = edges.join(sources.dropDuplicates(["from_entity"]), "from_entity")
    return edges if only is None else edges.join(near(only), "file_path", "left_semi")


def graph(files: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``files`` (``file_path, content``); ``only`` (``id``) leaves the edges of other sources out."""
    known = facts(files)
    if only is not None:
        known["references"] = known["references"].join(only.select(F.col("id").alias("from_entity")), "from_entity", "left_semi")
    edges = linked(known, linking(known))
    if only is not None:
        edges = edges.join(only.select(F.col("id").alias("from_entity")), "from_entity", "left_semi")
    return known["nodes"], cut(edges.select(*G.EDGE), "edges")


def combined_facts(known: dict[str, DataFrame], new: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``known`` without the files of ``gone``, and ``new``."""
    left = near(gone)
    return {t: known[t].join(left, "file_path", "left_anti").unionByName(new[t]) for t in FACTS}


def differing(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Rows that one of two tables has more often, each once."""
    both = a.select(*columns, F.lit(1).alias("_n")).union(b.select(*columns, F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").drop("_n")


def frontier(known: dict[str, DataFrame], after: dict[str, DataFrame], links: dict[str, DataFrame], now: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """``file_path`` of all files whose edges may differ after a change: one rule for every kind of edge.

    An edge follows from its file's own facts and from what these are looked up in.
    So a file is read again if it changed, if an import of it means another file
    than before, if it imports from or hands on names of a file whose exported names mean
    something else, or if it holds a name whose entities changed anywhere.
    The last is looked up in the token buckets of those names alone.
    """
    left = near(gone)
    old, new = (cut(x["nodes"].join(left, "file_path", "left_semi"), "nodes") for x in (known, after))
    names = cut(differing(old, new, "name", "id", "file_path", "entity_type", "parent_id", "start_line").select("name").distinct(), "names")
    buckets = [r[0] for r in names.select(bucket_of(F.col("name"))).distinct().collect()]
    mention = after["references"].filter(F.col("bucket").isin(buckets)).join(near(names.select(F.col("name").alias("token"))), "token", "left_semi").select("file_path")
    moved = differing(links["imports"], now["imports"], "file_path", "local", "target", "name").select("file_path")
    meaning = cut(differing(links["offered"], now["offered"], "file_path", "name", "target").union(differing(links["step"], now["step"], "file_path", "name", "to_file")).select("file_path").distinct(), "meaning")
    close = near(meaning)
    to = lambda d, c: d.join(close.withColumnRenamed("file_path", c), c, "left_semi").select("file_path")
    own_exports = differing(old.filter("entity_type = 'export'"), new.filter("entity_type = 'export'"), "id", "file_path", "name").select("file_path").distinct()
    handing = now["imports"].join(near(own_exports.select(F.col("file_path").alias("target"))), "target", "left_semi").select("file_path")
    passing = now["step"].join(near(own_exports.select(F.col("file_path").alias("to_file"))), "to_file", "left_semi").select("file_path")
    return gone.union(mention).union(moved).union(meaning).union(to(now["imports"], "target")).union(to(now["step"], "to_file")).union(handing).union(passing).distinct()


def relinked(known: dict[str, DataFrame], links: dict[str, DataFrame], edges: DataFrame, new: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """Facts, links and edges after the files of ``gone`` were replaced by those of ``new``; equal to linking all facts anew."""
    after = combined_facts(known, new, gone)
    after |= {t: cut(after[t], t) for t in ("nodes", "references", "exports")}
    now = linking(after)
    dirty = cut(frontier(known, after, links, now, gone), "dirty")
    return after, now, cut(edges.join(near(dirty), "file_path", "left_anti").unionByName(linked(after, now, dirty)), "edges")


def _gone(changed: DataFrame, deleted: DataFrame | None) -> DataFrame:
    gone = changed.select("file_path") if deleted is None else changed.select("file_path").union(deleted.select("file_path"))
    return cut(gone.distinct(), "stale")


def refreshed(files: DataFrame, changed: DataFrame, nodes: DataFrame, edges: DataFrame, deleted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph after ``changed`` files (and without ``deleted`` ones), from the former one.

    The result is that of a full build.  Only the new files are read for entities' tables, and only
    edges of the :func:`frontier` are resolved again; names, imports and exports of the others are scanned, which
    :func:`rebuilt` and :class:`lamella.project.Project` keep instead.
    """
    known = facts(files, *FACTS[2:]) | {"nodes": cut(nodes, "nodes")}
    with_file = edges.select(*G.EDGE).join(nodes.select(F.col("id").alias("from_entity"), "file_path").dropDuplicates(["from_entity"]), "from_entity")
    after, _, out = relinked(known, linking(known), with_file, facts(changed.select("file_path", "content")), _gone(changed, deleted))
    return after["nodes"], out.select(*G.EDGE)


def rebuilt(files: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`refreshed` of the graph of ``files``, whose facts and links are kept between the two: no file is read twice."""
    known = facts(files)
    links = linking(known)
    after, _, out = relinked(known, links, cut(linked(known, links), "edges"), facts(changed.select("file_path", "content")), _gone(changed, deleted))
    return after["nodes"], out.select(*G.EDGE)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("entity_count")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count")))


def is_test() -> Column:
    """Whether a node is a test: by its name, or by a test path together with a test's marks in its content."""
    name = F.col("name")
    named = name.startswith("test_") | name.startswith("Test") | name.endswith("_test") | name.endswith("Test") | F.col("entity_type").isin("test", "test_suite")
    marked = F.coalesce(F.col("content"), F.lit("")).rlike(r"\bassert|\bexpect\(|#\[test\]|@Test\b|\bt\.Run\(|\bit\(")
    return named | (P.test_path(F.col("file_path")) & marked)


def impact(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 2, most: int = 10_000) -> dict[str, DataFrame]:
    """Direct ``deps`` and ``dependents``, the transitive ``impact`` with depth and test mark, and its ``tests``, from one traversal."""
    if depth < 0:
        raise ValueError("depth must not be negative; 0 means no limit")
    start = edges.sparkSession.range(1).select(F.lit(node).alias("id"))
    reach = G.reach(edges, start, depth=depth, most=most)
    hit = reach.join(nodes, "id").withColumn("is_test", is_test())
    return {"deps": G.neighbours(edges, nodes, node), "dependents": G.neighbours(edges, nodes, node, reverse=True), "impact": hit, "tests": hit.filter("is_test")}


def tests_of(nodes: DataFrame, edges: DataFrame, node: str, most: int = 10_000) -> DataFrame:
    """The tests that reach ``node``; where the graph knows none, those whose text holds its name as a word."""
    start = edges.sparkSession.range(1).select(F.lit(node).alias("id"))
    found = cut(G.reach(edges, start, most=most).join(nodes, "id").filter(is_test()).select("id"), "tests")
    if not found.isEmpty():
        return found
    name = nodes.filter(F.col("id") == node).select(F.col("name").alias("_name")).limit(1)
    hit = nodes.filter(is_test() & (F.col("id") != node)).crossJoin(F.broadcast(name))
    return hit.filter(F.array_contains(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"[A-Za-z_]\w*"), 0), F.col("_name"))).select("id")


def tests_of_many(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, id``: the tests that reach each of ``starts`` (``id``), from one traversal; what to run after a whole diff."""
    tests = nodes.filter(is_test()).select("id").distinct()
    return G.reach_many(edges, starts).join(tests, "id", "left_semi").select("start", "id")


def relations(changed: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """``entity_id, direction, id, in_diff``: of each changed entity (``entity_id``) the first callers and callees by id."""
    from pyspark.sql import Window as W

    ids = changed.select("entity_id").distinct()
    out = None
    for direction, own, far in (("caller", "to_entity", "from_entity"), ("callee", "from_entity", "to_entity")):
        one = edges.select(F.col(own).alias("entity_id"), F.col(far).alias("id")).distinct().join(ids, "entity_id", "left_semi")
        one = one.withColumn("k", F.row_number().over(W.partitionBy("entity_id").orderBy("id"))).filter(F.col("k") <= most)
        one = one.select("entity_id", F.lit(direction).alias("direction"), "id")
        out = one if out is None else out.union(one)
    flagged = ids.select(F.col("entity_id").alias("id"), F.lit(True).alias("in_diff"))
    return out.join(flagged, "id", "left").select("entity_id", "direction", "id", F.coalesce("in_diff", F.lit(False)).alias("in_diff"))


def combined(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """All rows of ``after``, and those of ``before`` whose key it lacks."""
    return after.unionByName(before.join(after.select(key), key, "left_anti"))


def k_hops(nodes: DataFrame, edges: DataFrame, node: str, hops: int = 8, budget: int | None = None, most: int = 20_000) -> DataFrame:
    """Nodes within ``hops`` steps of ``node`` in any direction, the node itself at depth 0.

    With ``budget`` the walk ends once the contents met hold twice as many
    tokens (256 at least); over ``most`` nodes raise an error.
    """
    from lamella.functions import text as T

    both = edges.select("from_entity", "to_entity").union(edges.select(F.col("to_entity"), F.col("from_entity")))
    seen = cut(edges.sparkSession.range(1).select(F.lit(node).alias("id"), F.lit(0).alias("depth")), "hops")
    front, step = seen, 0
    while step < hops:
        step += 1
        new = both.join(near(front.select(F.col("id").alias("from_entity"))), "from_entity").select(F.col("to_entity").alias("id")).distinct()
        front = cut(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(step)), "hops")
        if front.isEmpty():
            break
        seen = seen.union(front)
        if seen.count() > most:
            raise ValueError(f"over {most} nodes within {step} steps")
        if budget is not None:
            held = seen.join(nodes, "id").agg(F.sum(T.token_estimate(F.coalesce("content", F.lit(""))))).first()[0] or 0
            if held >= max(256, 2 * budget):
                break
    return seen.join(nodes, "id")
