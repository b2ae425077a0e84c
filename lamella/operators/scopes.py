"""Names in nested scopes, and types that flow through a project: what a call means where names alone don't tell.

A Python file gives facts in one pass: its scopes, the names that each binds, the
calls, and who is copied to whom.  A scope's code lists the scopes around it, so a use
of a name meets all scopes that could bind it in one equi join on (file, scope, name) and takes
the innermost.  Everything else is joins over these facts:

* a name means a local, a definition, or through an import what another file offers;
* a variable has the type of what it was made or annotated with; types flow along copies,
  returns and arguments, by position or name, into parameters and attributes; a call of a
  method leads to the receiver's class, and its result has what that method returns.

Types flow in rounds of a semi-naive fixed point: a round looks at facts that are new alone, by joins or, for
files that few others are connected with by imports, inside a task.  A
place that meets two types is ambiguous and decides no call; two suffice to know it, so a place holds
two at most.

Defined cases: scopes of classes are seen from themselves alone, as in Python; names
that no scope binds, or that are bound to several things in one scope, mean the last
definition, else the import, else a local; files that don't parse and null texts have no facts; calls of unknown or
ambiguous receivers give no edge; recursion ends, as no fact comes twice; empty inputs give no rows;
further columns are ignored.
"""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators import extract
from lamella.storage import cut, dealt, near

FACT = "file_path string, fact string, scope string, name string, base string, extra string, place int"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Facts(ast.NodeVisitor):
    """Facts of one file, as rows of :data:`FACT` without the path.

    ``scope``  scope's code, kind, the entity it belongs to
    ``bind``   a name that a scope binds: ``base`` is param, local, import or the entity's id, ``place`` a parameter's position
    ``copy``   ``name`` takes what ``base`` has; both are names of the scope
    ``type``   ``name`` is annotated with the type ``base``
    ``call``   ``name`` takes the result of calling ``extra``, of ``base`` if that isn't null
    ``arg``    the call into ``name`` passes ``base`` at ``place`` or as ``extra``
    ``get``    ``name`` takes the attribute ``extra`` of ``base``; ``put`` sets it
    """

    def __init__(self, entities: dict[tuple[str, int], str]) -> None:
        self.rows: list[tuple] = []
        self.entities = entities
        self.scope, self.kind, self.n, self.made = "", "module", 0, 0
        self.add("scope", "module")

    def add(self, fact: str, name: str | None, base: str | None = None, extra: str | None = None, place: int | None = None) -> None:
        self.rows.append((fact, self.scope, name, base, extra, place))

    def temporary(self) -> str:
        self.made += 1
        return f"${self.made}"

    def within(self, kind: str, entity: str | None):
        self.n += 1
        before = self.scope, self.kind
        self.scope, self.kind = f"{self.scope}/{self.n}", kind
        self.add("scope", kind, entity)
        return before

    def leave(self, before) -> None:
        self.scope, self.kind = before

    def entity(self, node) -> str | None:
        lines = [node.lineno, *[d.lineno for d in node.decorator_list]]
        return next((self.entities[node.name, n] for n in lines if (node.name, n) in self.entities), None)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        own = self.entity(node)
        self.add("bind", node.name, own or "local")
        for x in [*node.decorator_list, *node.bases]:
            self.value(x)
        before = self.within("class", own)
        for x in node.body:
            self.visit(x)
        self.leave(before)

    def visit_FunctionDef(self, node) -> None:
        own, method = self.entity(node), self.kind == "class"
        self.add("bind", node.name, own or "local")
        for x in [*node.decorator_list, *node.args.defaults, *filter(None, node.args.kw_defaults)]:
            self.value(x)
        static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list)
        before = self.within("method" if method and not static else "function", own)
        names = [*node.args.posonlyargs, *node.args.args]
        for k, a in enumerate(names):
            self.add("bind", a.arg, "param", None, k - (method and not static))
        for a in [*node.args.kwonlyargs, *filter(None, [node.args.vararg, node.args.kwarg])]:
            self.add("bind", a.arg, "param")
        for a in [*names, *node.args.kwonlyargs]:
            if t := _type_name(a.annotation):
                self.add("type", a.arg, t)
        if t := _type_name(node.returns):
            self.add("type", "$return", t)
        self.add("bind", "$return", "local")
        for x in node.body:
            self.visit(x)
        self.leave(before)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node: ast.Lambda) -> None:
        before = self.within("function", None)
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            self.add("bind", a.arg, "param")
        self.value(node.body)
        self.leave(before)

    def comprehension(self, node) -> None:
        before = self.within("function", None)
        for g in node.generators:
            self.value(g.iter)
            self.target(g.target, None)
            for x in g.ifs:
                self.value(x)
        for x in ([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]):
            self.value(x)
        self.leave(before)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("bind", (a.asname or a.name.rsplit(".", 1)[-1]), "import")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("bind", a.asname or a.name, "import")

    def visit_Return(self, node: ast.Return) -> None:
        if node.value is not None:
            if got := self.value(node.value):
                self.add("copy", "$return", got)

    def visit_Assign(self, node: ast.Assign) -> None:
        got = self.value(node.value)
        for t in node.targets:
            self.target(t, got)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        got = self.value(node.value) if node.value is not None else None
        self.target(node.target, got)
        if isinstance(node.target, ast.Name) and (t := _type_name(node.annotation)):
            self.add("type", node.target.id, t)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self.target(node.target, self.value(node.value))

    def visit_For(self, node: ast.For) -> None:
        self.value(node.iter)
        self.target(node.target, None)
        for x in [*node.body, *node.orelse]:
            self.visit(x)

    def visit_With(self, node) -> None:
        for item in node.items:
            got = self.value(item.context_expr)
            if item.optional_vars is not None:
                self.target(item.optional_vars, got)
        for x in node.body:
            self.visit(x)

    visit_AsyncFor, visit_AsyncWith = visit_For, visit_With

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if node.name:
            self.add("bind", node.name, "local")
        self.generic_visit(node)

    def target(self, t, got: str | None) -> None:
        if isinstance(t, ast.Name):
            self.add("bind", t.id, "local")
            if got:
                self.add("copy", t.id, got)
        elif isinstance(t, ast.Attribute):
            base = self.value(t.value)
            if base and got:
                self.add("put", got, base, t.attr)
        elif isinstance(t, (ast.Tuple, ast.List)):
            for x in t.elts:
                self.target(x, None)
        elif isinstance(t, ast.Starred):
            self.target(t.value, None)
        else:
            self.generic_visit(t)

    def value(self, x) -> str | None:
        """The name that holds an expression's value, a new one where it has none of its own."""
        if isinstance(x, ast.Name):
            return x.id
        if isinstance(x, ast.Await):
            return self.value(x.value)
        if isinstance(x, ast.Attribute):
            base = self.value(x.value)
            if base is None:
                return None
            out = self.temporary()
            self.add("bind", out, "local")
            self.add("get", out, base, x.attr)
            return out
        if isinstance(x, ast.Call):
            out = self.temporary()
            self.add("bind", out, "local")
            if isinstance(x.func, ast.Name):
                self.add("call", out, None, x.func.id)
            elif isinstance(x.func, ast.Attribute):
                base = self.value(x.func.value)
                if base is not None:
                    self.add("call", out, base, x.func.attr)
            else:
                self.value(x.func)
            for k, a in enumerate(x.args):
                if (got := self.value(a)) and not any(isinstance(y, ast.Starred) for y in x.args[: k + 1]):
                    self.add("arg", out, got, None, k)
            for a in x.keywords:
                if (got := self.value(a.value)) and a.arg:
                    self.add("arg", out, got, a.arg)
            return out
        if isinstance(x, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            self.comprehension(x)
            return None
        if isinstance(x, ast.AST):
            for y in ast.iter_child_nodes(x):
                self.visit(y) if isinstance(x, (ast.Lambda, ast.NamedExpr)) else self.value(y)
        return None

    def visit_Expr(self, node: ast.Expr) -> None:
        self.value(node.value)

    def generic_visit(self, node) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.expr):
                self.value(x)
            else:
                self.visit(x)


def _type_name(x) -> str | None:
    if isinstance(x, ast.Constant) and isinstance(x.value, str):
        return x.value if x.value.isidentifier() else None
    return x.id if isinstance(x, ast.Name) else None


def facts_of(path: str, text: str, entities: list[extract.Entity] | None = None) -> list[tuple]:
    """The file's facts; ``entities`` are those of the text, where they are known."""
    if not path.endswith((".py", ".pyi")):
        return []
    try:
        tree = ast.parse("\n".join(extract.lines_of(text)) + "\n")
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = {(e.name, e.start_line): e.id for e in (extract.entities_of(path, text) if entities is None else entities)}
    v = _Facts(found)
    for x in tree.body:
        v.visit(x)
    return [(path, *row) for row in v.rows]


def scope_facts(files: DataFrame) -> DataFrame:
    """The facts of all Python files (``file_path, content``)."""
    names = [c.split(" ")[0] for c in FACT.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, t in pdf.itertuples(index=False) if t for r in facts_of(p, t)]
            yield pd.DataFrame(rows, columns=names, dtype=object).astype({"place": "Int32"})

    return dealt(cut(files.select("file_path", "content"), "texts"), "file_path").mapInPandas(work, FACT)


def around(scope: Column) -> Column:
    """A scope's code and those of all scopes around it, each with its depth; the module's is empty."""
    parts = F.split(scope, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("at"), k.alias("depth")))


def innermost(uses: DataFrame, bindings: DataFrame, classes: DataFrame) -> DataFrame:
    """``uses`` (``file_path, scope, name``) with ``at``, the innermost scope that binds the name.

    ``bindings`` has ``file_path, scope, name``, ``classes`` the (``file_path,
    scope``) that only their own level sees.
    """
    one = uses.select("file_path", "scope", "name").distinct()
    tried = one.withColumn("x", F.explode(around(F.col("scope")))).select("file_path", "scope", "name", "x.*")
    hidden = classes.select("file_path", F.col("scope").alias("at"), F.lit(True).alias("hidden"))
    tried = tried.join(hidden, ["file_path", "at"], "left").filter("hidden is null or at = scope").drop("hidden")
    bound = bindings.select("file_path", F.col("scope").alias("at"), "name").distinct()
    best = tried.join(bound, ["file_path", "at", "name"]).groupBy("file_path", "scope", "name").agg(F.max_by("at", "depth").alias("at"))
    return uses.join(best, ["file_path", "scope", "name"])


def node_of(file: Column, scope: Column, name: Column) -> Column:
    return F.concat(file, F.lit("#"), scope, F.lit("#"), name)


def attribute_of(owner: Column, name: Column) -> Column:
    return F.concat(owner, F.lit("."), name)


def type_graph(facts: DataFrame, nodes: DataFrame, imports: DataFrame, offered: DataFrame) -> dict[str, DataFrame]:
    """What the fixed point runs on, all names resolved.

    ``known`` (``node, type``), ``flows`` (``node, to``), ``sites`` (``site, node,
    method`` of method calls), ``gets`` (``site, node, attr``), ``puts`` (``node,
    attr, source``), ``direct`` (``site, target`` of calls by name), ``args``
    (``site, place, keyword, node``), ``params`` (``function, place, name, to``),
    ``returns`` (``function, node``), ``owners`` (``file_path, scope, entity``); each has the
    ``file_path`` whose facts say it.
    """
    facts = cut(facts, "facts")
    of = lambda fact: facts.filter(F.col("fact") == fact)
    scopes = of("scope").select("file_path", "scope", F.col("name").alias("kind"), F.col("base").alias("entity"))
    binds = of("bind").select("file_path", "scope", "name", F.col("base").alias("what"), "place")
    classes = scopes.filter("kind = 'class'")

    def at(d: DataFrame, column: str, out: str) -> DataFrame:
        """``d`` with the node ``out`` of the name in ``column``."""
        uses = d.select("file_path", "scope", F.col(column).alias("name")).filter("name is not null").distinct()
        found = innermost(uses, binds, classes).select("file_path", "scope", F.col("name").alias(column), node_of(F.col("file_path"), F.col("at"), F.col("name")).alias(out))
        return d.join(found, ["file_path", "scope", column])

    meant = binds.withColumn("node", node_of(F.col("file_path"), F.col("scope"), F.col("name")))
    here = meant.filter("what not in ('param', 'local', 'import')").groupBy("node").agg(F.max("what").alias("entity"))
    far = imports.filter("name is not null").select("file_path", "local", F.col("target").alias("to_file"), F.col("name").alias("to_name"))
    far = far.join(offered.select(F.col("file_path").alias("to_file"), F.col("name").alias("to_name"), "target"), ["to_file", "to_name"]).groupBy("file_path", F.col("local").alias("name")).agg(F.min("target").alias("entity"))
    imported = meant.filter("what = 'import'").join(far, ["file_path", "name"]).groupBy("node").agg(F.min("entity").alias("entity")).join(here, "node", "left_anti")
    entity = cut(here.union(imported), "named")
    kinds = nodes.select(F.col("id").alias("entity"), "entity_type")
    entity = cut(entity.join(kinds, "entity"), "named")
    class_of = entity.filter("entity_type = 'class'").select("node", F.col("entity").alias("type"))
    owners = scopes.filter("kind in ('function', 'method', 'class') and entity is not null")

    calls = of("call").select("file_path", "scope", F.col("name").alias("site_name"), "base", F.col("extra").alias("callee"))
    site = lambda d: d.withColumn("site", node_of(F.col("file_path"), F.col("scope"), F.col("site_name")))
    by_name = site(at(calls.filter("base is null"), "callee", "node")).join(entity, "node").select("site", "file_path", "scope", F.col("entity").alias("target"), "entity_type")
    spaces = imports.filter("name is null").select("file_path", F.col("local").alias("base"), F.col("target").alias("to_file"))
    offers = offered.select(F.col("file_path").alias("to_file"), F.col("name").alias("callee"), F.col("target").alias("entity"))
    methods = calls.filter("base is not null")
    by_module = site(methods).join(spaces, ["file_path", "base"]).join(offers, ["to_file", "callee"]).join(kinds, "entity").select("site", "file_path", "scope", F.col("entity").alias("target"), "entity_type")
    direct = cut(by_name.union(by_module).distinct(), "direct")
    sites = cut(site(at(methods, "base", "node")).select("site", "file_path", "scope", "node", F.col("callee").alias("method")), "sites")

    copies = at(at(of("copy").select("file_path", "scope", F.col("base").alias("source"), F.col("name").alias("into")), "source", "node"), "into", "to").select("file_path", "node", "to")
    fields = binds.filter("what = 'local'").join(classes.filter("entity is not null").select("file_path", "scope", "entity"), ["file_path", "scope"])
    fields = fields.select("file_path", node_of(F.col("file_path"), F.col("scope"), F.col("name")).alias("node"), attribute_of(F.col("entity"), F.col("name")).alias("to")).distinct()
    annotated = at(at(of("type").select("file_path", "scope", "name", F.col("base").alias("type_name")), "type_name", "class_node"), "name", "node").select("file_path", "node", "class_node")
    annotated = annotated.join(class_of.withColumnRenamed("node", "class_node"), "class_node").select("file_path", "node", "type")
    made = direct.filter("entity_type = 'class'").select("file_path", F.col("site").alias("node"), F.col("target").alias("type"))
    receivers = binds.filter("what = 'param' and place = -1").join(scopes.filter("kind = 'method'").select("file_path", "scope"), ["file_path", "scope"])
    outer = scopes.filter("kind = 'class' and entity is not null").select("file_path", F.col("scope").alias("outer"), F.col("entity").alias("type"))
    receivers = receivers.withColumn("outer", F.regexp_replace("scope", "/[^/]*$", "")).join(outer, ["file_path", "outer"]).select("file_path", node_of(F.col("file_path"), F.col("scope"), F.col("name")).alias("node"), "type")
    known = cut(annotated.union(made).union(receivers).distinct(), "known")

    params = binds.filter("what = 'param' and (place is null or place >= 0)").join(scopes.filter("entity is not null").select("file_path", "scope", "entity"), ["file_path", "scope"])
    params = params.select("file_path", F.col("entity").alias("function"), "place", "name", node_of(F.col("file_path"), F.col("scope"), F.col("name")).alias("to"))
    args = of("arg").select("file_path", "scope", F.col("name").alias("site_name"), F.col("base").alias("source"), F.col("extra").alias("keyword"), "place")
    args = cut(site(at(args, "source", "node")).select("file_path", "site", "place", "keyword", "node"), "args")
    returns = owners.filter("kind <> 'class'").select("file_path", F.col("entity").alias("function"), node_of(F.col("file_path"), F.col("scope"), F.lit("$return")).alias("node"))
    gets = site(at(of("get").select("file_path", "scope", F.col("name").alias("site_name"), "base", F.col("extra").alias("attr")), "base", "node")).select("file_path", "site", "node", "attr")
    puts = at(at(of("put").select("file_path", "scope", F.col("name").alias("source"), "base", F.col("extra").alias("attr")), "base", "node"), "source", "from").select("file_path", "node", "attr", F.col("from").alias("source"))
    return {"known": known, "flows": cut(copies.union(fields), "flows"), "sites": sites, "gets": cut(gets, "gets"), "puts": cut(puts, "puts"), "direct": direct, "args": args, "params": cut(params, "params"), "returns": cut(returns, "returns"), "owners": owners.select("file_path", "scope", "entity")}


def members_of(nodes: DataFrame) -> DataFrame:
    """``type, method, file_path, target``: what a class has by a name."""
    kept = F.min_by(F.struct("id", "file_path"), "id").alias("x")
    return nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("type"), F.col("name").alias("method")).agg(kept).select("type", "method", "x.file_path", F.col("x.id").alias("target"))


def typed(graph: dict[str, DataFrame], nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, type`` of every place that types reach, two a place at most, and ``site, type, target`` of every method call met."""
    members, g = cut(members_of(nodes), "members"), graph

    def passed(calls: DataFrame) -> DataFrame:
        """``node, to`` between the arguments and parameters, and the returns and results, of ``site, function`` rows."""
        into = calls.join(g["args"], "site").join(g["params"].withColumnRenamed("place", "at"), "function")
        into = into.filter("place = at or keyword = name").select("node", "to")
        return into.union(calls.join(g["returns"], "function").select("node", F.col("site").alias("to")))

    named = g["direct"]
    makers = named.filter("entity_type = 'class'").join(members.filter("method = '__init__'").select(F.col("type").alias("target"), F.col("target").alias("function")), "target").select("site", "function")
    by_name = named.filter("entity_type <> 'class'").select("site", F.col("target").alias("function"))
    into = makers.join(g["args"], "site").join(g["params"].withColumnRenamed("place", "at"), "function").filter("place = at or keyword = name").select("node", "to")
    flows = cut(g["flows"].select("node", "to").union(passed(by_name)).union(into).distinct(), "flows")
    facts, fresh = _fewest(None, g["known"])
    called = None
    while not fresh.isEmpty():
        # New types at receivers bring new calls, attributes read and attributes set.
        met = fresh.join(g["sites"].select("site", "node", "method"), "node").join(members.drop("file_path"), ["type", "method"]).select("site", "type", "target").distinct()
        met = cut(met if called is None else met.join(called, ["site", "type", "target"], "left_anti"), "met")
        called = met if called is None else called.union(met)
        read = fresh.join(g["gets"], "node").select(attribute_of(F.col("type"), F.col("attr")).alias("node"), F.col("site").alias("to"))
        write = fresh.join(g["puts"], "node").select(F.col("source").alias("node"), attribute_of(F.col("type"), F.col("attr")).alias("to"))
        opened = passed(met.select("site", F.col("target").alias("function"))).union(read).union(write).distinct()
        opened = cut(opened.join(flows, ["node", "to"], "left_anti"), "opened")
        moved = fresh.join(flows, "node").select(F.col("to").alias("node"), "type").union(facts.join(opened, "node").select(F.col("to").alias("node"), "type"))
        flows = flows.union(opened)
        facts, fresh = _fewest(facts, moved)
    return facts, called if called is not None else g["sites"].limit(0).select("site", F.lit("").alias("type"), F.lit("").alias("target"))


def _fewest(facts: DataFrame | None, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All facts with ``moved``, two types a node at most, and the ones of these that are new."""
    new = moved.select("node", "type", F.lit(True).alias("new"))
    both = new if facts is None else new.union(facts.select("node", "type", F.lit(False).alias("new")))
    # A node that has two keeps them; of others the least and the greatest new one count.
    own = F.collect_set(F.when(~F.col("new"), F.col("type")))
    some = F.when(F.col("new"), F.col("type"))
    kept = both.groupBy("node").agg(own.alias("own"), F.min(some).alias("least"), F.max(some).alias("most"))
    fresh = F.array_except(F.array_distinct(F.array_compact(F.array("least", "most"))), "own")
    fresh = F.slice(fresh, 1, F.greatest(F.lit(0), 2 - F.size("own")))
    row = lambda new: lambda t: F.struct(t.alias("type"), F.lit(new).alias("new"))
    out = cut(kept.select("node", F.inline(F.concat(F.transform("own", row(False)), F.transform(fresh, row(True))))), "types")
    return out.select("node", "type"), cut(out.filter("new").select("node", "type"), "fresh")


#: Facts of files that import each other up to which one task follows their types, and about how many it holds at once.
GROUP_ROWS, HELD_FACTS = 20_000, 200_000


def groups(imports: DataFrame) -> DataFrame:
    """``file_path, group``: files that imports connect, by the least path among them; files without imports are left out.

    In a round a file takes the least label next to it, hands that on to the file that its
    former label names, and follows its new label one step, which halves ways.
    """
    one = imports.select("file_path", F.col("target").alias("other")).filter("file_path <> other").distinct()
    edges = cut(one.union(one.select(F.col("other"), F.col("file_path"))), "links")
    labels = edges.select("file_path", F.col("file_path").alias("label")).distinct()
    while True:
        beside = edges.join(labels.select(F.col("file_path").alias("other"), F.col("label").alias("near")), "other").groupBy("file_path").agg(F.min("near").alias("near"))
        least = cut(labels.join(beside, "file_path").select("file_path", "label", F.least("label", "near").alias("least")), "labels")
        told = least.groupBy(F.col("label").alias("file_path")).agg(F.min("least").alias("told"))
        known = cut(least.join(told, "file_path", "left").select("file_path", "label", F.least("least", F.coalesce("told", "least")).alias("next")), "labels")
        ahead = known.select(F.col("file_path").alias("next"), F.col("next").alias("then"))
        grown = cut(known.join(ahead, "next").select("file_path", F.col("label").alias("was"), F.col("then").alias("label")), "labels")
        labels = grown.select("file_path", "label")
        if grown.filter("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "group")


#: Columns of the fixed point's tables that :func:`followed` takes, after the kind and the file.
_ROWS = {"known": ("node", "type"), "flows": ("node", "to"), "sites": ("site", "node", "method", "scope"), "gets": ("site", "node", "attr"), "puts": ("node", "attr", "source"), "direct": ("site", "target", "entity_type"), "args": ("site", "node", "keyword"), "params": ("function", "to", "name"), "returns": ("function", "node"), "members": ("type", "method", "target")}


def followed(rows: Iterable[tuple]) -> list[tuple[str, str, str]]:
    """``file_path, scope, target`` of the method calls that types decide, by the rounds of :func:`typed`; rows are (kind, file, four of :data:`_ROWS`, place)."""
    by: dict[str, dict[str, list]] = {k: defaultdict(list) for k in _ROWS}
    members: dict[tuple, str] = {}
    for kind, file, a, b, c, d, place in rows:
        if kind == "members":
            members[a, b] = c
        elif kind in ("sites", "gets"):  # by the node whose types they wait for
            by[kind][b].append((a, c, d, file))
        else:
            by[kind][a].append((b, c, place))

    def passed(site: str, function: str, results: bool = True) -> Iterator[tuple[str, str]]:
        for node, keyword, at in by["args"][site]:
            for to, name, place in by["params"][function]:
                if (place is not None and place == at) or (keyword is not None and keyword == name):
                    yield node, to
        if results:
            for node, _, _ in by["returns"][function]:
                yield node, site

    flows = {(node, to) for node, outs in by["flows"].items() for to, _, _ in outs}
    for site, found in list(by["direct"].items()):
        for target, kind, _ in found:
            if kind != "class":
                flows.update(passed(site, target))
            elif (target, "__init__") in members:
                flows.update(passed(site, members[target, "__init__"], False))
    after: dict[str, set[str]] = defaultdict(set)
    for node, to in flows:
        after[node].add(to)
    facts: dict[str, list[str]] = defaultdict(list)
    called: set[tuple[str, str]] = set()

    def fewest(moved: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
        new: dict[str, set[str]] = defaultdict(set)
        for node, kind in moved:
            new[node].add(kind)
        out = []
        for node, kinds in new.items():
            for kind in dict.fromkeys((min(kinds), max(kinds))):
                if len(facts[node]) < 2 and kind not in facts[node]:
                    facts[node].append(kind)
                    out.append((node, kind))
        return out

    fresh = fewest((node, kind) for node, found in by["known"].items() for kind, _, _ in found)
    while fresh:
        opened: set[tuple[str, str]] = set()
        for node, kind in fresh:
            for site, method, _, _ in by["sites"][node]:
                if (kind, method) in members and (site, kind) not in called:
                    called.add((site, kind))
                    opened.update(passed(site, members[kind, method]))
            opened.update((f"{kind}.{attr}", site) for site, attr, _, _ in by["gets"][node])
            opened.update((source, f"{kind}.{attr}") for attr, source, _ in by["puts"][node])
        moved = [(to, kind) for node, kind in fresh for to in after[node]]
        for node, to in opened:
            if to not in after[node]:
                moved += [(to, kind) for kind in facts[node]]
        for node, to in opened:
            after[node].add(to)
        fresh = fewest(moved)
    return [(file, scope, members[facts[node][0], method]) for node, found in by["sites"].items() if len(facts[node]) == 1 for _, method, scope, file in found if (facts[node][0], method) in members]


def decided(graph: dict[str, DataFrame], nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """``file_path, scope, target`` of the method calls that types decide.

    Types flow between files that imports connect.  Such a group of at most :data:`GROUP_ROWS` facts is
    followed in a task, many groups to a task; larger ones by the joins of :func:`typed`.
    """
    tables = {t: graph[t] if t != "members" else members_of(nodes) for t in _ROWS}
    rows = None
    for t, d in tables.items():
        own = [F.col(c) for c in _ROWS[t]] + [F.lit(None).cast("string")] * (4 - len(_ROWS[t]))
        one = d.select(F.lit(t), "file_path", *own, F.col("place") if "place" in d.columns else F.lit(None).cast("int")).toDF("kind", "file_path", "a", "b", "c", "d", "place")
        rows = one if rows is None else rows.union(one)
    rows = rows.join(groups(imports), "file_path", "left").withColumn("group", F.coalesce("group", "file_path"))
    rows = cut(rows, "typed")
    large = cut(rows.groupBy("group").count().filter(F.col("count") > GROUP_ROWS).select("group"), "large")
    some = not large.isEmpty()
    small = rows.join(near(large), "group", "left_anti") if some else rows
    buckets = max(1, rows.count() // HELD_FACTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def work(t: pa.Table) -> pa.Table:
        found = followed(zip(*[t.column(c).to_pylist() for c in ("kind", "file_path", "a", "b", "c", "d", "place")]))
        return pa.table([pa.array([r[i] for r in found], pa.string()) for i in range(3)], ["file_path", "scope", "target"])

    out = small.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets))).groupBy("bucket").applyInArrow(work, "file_path string, scope string, target string")
    if not some:
        return out
    files = cut(rows.join(near(large), "group", "left_semi").select("file_path").distinct(), "large")
    own = {t: d.join(near(files), "file_path", "left_semi") for t, d in graph.items()}
    types, met = typed(own, nodes)
    sure = types.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("type")).filter("n = 1").select("node", "type")
    return out.union(own["sites"].join(sure, "node").join(met, ["site", "type"]).select("file_path", "scope", "target"))


def calls(files: DataFrame, nodes: DataFrame, imports: DataFrame, offered: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``from_entity, to_entity`` of all calls in Python files that scopes, imports and types decide; ``facts`` are the files' :func:`scope_facts`, where they are known."""
    graph = type_graph(scope_facts(files) if facts is None else facts, nodes, imports, offered)
    rows = decided(graph, nodes, imports).union(graph["direct"].select("file_path", "scope", "target")).distinct()
    owners = graph["owners"].select("file_path", F.col("scope").alias("at"), "entity")
    tried = rows.withColumn("x", F.explode(around(F.col("scope")))).select("file_path", "scope", "target", "x.*").join(owners, ["file_path", "at"])
    edges = tried.groupBy("file_path", "scope", "target").agg(F.max_by("entity", "depth").alias("from_entity"))
    return edges.select("from_entity", F.col("target").alias("to_entity")).filter("from_entity <> to_entity").distinct()


