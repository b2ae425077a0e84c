"""Nested scopes and types that flow through calls, arguments and attributes."""

from lamella.operators import graph_build, scopes


def calls(spark, files):
    d = spark.createDataFrame(sorted(files.items()), "file_path string, content string")
    known = graph_build.facts(d)
    links = graph_build.linking(known)
    return {tuple(r) for r in scopes.calls(d, known["nodes"], links["imports"], links["offered"]).collect()}


TWO = "class A:\n  def save(self):\n    return 1\n\nclass B:\n  def save(self):\n    return 2\n  def other(self):\n    return A()\n"


def test_shadowing_at_three_depths(spark):
    files = {
        "m.py": "def f():\n  return 1\n\ndef g():\n  def f():\n    return 2\n  def h(f):\n    return f()\n  return f() + h(1)\n\ndef k():\n  return f()\n\nclass C:\n  def f(self):\n    return 3\n  def run(self):\n    return f()\n\ndef late():\n  return [f() for f in [1]] + [f()]\n",
    }
    got = calls(spark, files)
    assert ("m.py::function::k", "m.py::function::f") in got
    assert ("m.py::class::C::run", "m.py::function::f") in got and ("m.py::class::C::run", "m.py::class::C::f") not in got
    assert ("m.py::function::g", "m.py::function::f") not in got
    assert ("m.py::function::late", "m.py::function::f") in got


def test_types_across_files_and_two_calls_deep(spark):
    files = {
        "s.py": TWO,
        "f.py": "from s import A, B\n\ndef make():\n  return A()\n\ndef wrapped():\n  x = make()\n  return x\n\ndef either(flag):\n  if flag:\n    return A()\n  return B()\n",
        "u.py": "from f import wrapped, either\nimport f as lib\nfrom s import B\n\ndef one():\n  x = wrapped()\n  return x.save()\n\ndef two():\n  return lib.wrapped().save()\n\ndef three(flag):\n  return either(flag).save()\n\ndef four():\n  return B().other().save()\n\ndef five(b: B):\n  y = b\n  return y.save()\n",
    }
    got = {e for e in calls(spark, files) if e[1].endswith("save")}
    assert got == {("u.py::function::one", "s.py::class::A::save"), ("u.py::function::two", "s.py::class::A::save"), ("u.py::function::four", "s.py::class::A::save"), ("u.py::function::five", "s.py::class::B::save")}


def test_constructor_parameters(spark):
    files = {
        "s.py": TWO,
        "job.py": "class Job:\n  def __init__(self, store, name=None, spare=None):\n    self.store = store\n    self.spare = spare\n  def run(self):\n    return self.store.save()\n  def again(self):\n    return self.spare.save()\n\nclass Kept:\n  own = None\n  def set(self, x):\n    self.own = x\n  def go(self):\n    self.own.save()\n",
        "main.py": "from job import Job, Kept\nfrom s import A, B\n\ndef start():\n  j = Job(A(), spare=B())\n  k = Kept()\n  k.set(j.store)\n  return j.run()\n",
    }
    got = calls(spark, files)
    assert {("job.py::class::Job::run", "s.py::class::A::save"), ("job.py::class::Job::again", "s.py::class::B::save"), ("job.py::class::Kept::go", "s.py::class::A::save"), ("main.py::function::start", "job.py::class::Job::run"), ("main.py::function::start", "job.py::class::Kept::set")} <= got
    files["more.py"] = "from job import Job\nfrom s import B\n\ndef also():\n  return Job(B())\n"
    after = calls(spark, files)
    assert not any(a == "job.py::class::Job::run" for a, _ in after)


def test_defined_cases(spark):
    assert calls(spark, {"bad.py": "def (", "r.py": "def f(x):\n  return f(f(x)).g()\n\ndef a():\n  return b()\n\ndef b():\n  return a()\n", "t.txt": "x"}) == {("r.py::function::a", "r.py::function::b"), ("r.py::function::b", "r.py::function::a")}
    d = spark.createDataFrame([("n.py", None)], "file_path string, content string")
    assert scopes.scope_facts(d).count() == 0


def test_typed_graph_has_both_kinds_of_edges(spark):
    from lamella import api

    files = spark.createDataFrame([("s.py", TWO), ("u.py", "from s import A\n\ndef make():\n  return A()\n\ndef run():\n  x = make()\n  return x.save()\n")], "file_path string, content string")
    plain, typed = ({tuple(r) for r in api.build_graph(files, types=t)[1].collect()} for t in (False, True))
    # Names of one letter are no reference words; scopes know them.
    assert typed - plain == {("u.py::function::run", "s.py::class::A::save", "calls"), ("u.py::function::make", "s.py::class::A", "calls"), ("s.py::class::B::other", "s.py::class::A", "calls")} and plain < typed


def test_groups_of_files_in_a_task_and_by_joins(spark, monkeypatch):
    parts = {
        "s.py": TWO,
        "f.py": "from s import A, B\n\ndef make(flag):\n  if flag:\n    return A()\n  return B()\n\ndef one():\n  x = A()\n  return x\n",
        "job.py": "class Job:\n  def __init__(self, store, spare=None):\n    self.store = store\n    self.spare = spare\n  def run(self):\n    return self.store.save()\n  def again(self):\n    return self.spare.save()\n",
        "u.py": "from f import make, one\nfrom job import Job\nfrom s import B\n\ndef start():\n  j = Job(one(), spare=B())\n  j.run()\n  return make(1).save()\n\ndef both():\n  return B().other().save()\n",
        "w.py": "def g():\n  return 1\n\ndef outer():\n  return g()\n",
    }
    files = {f"p{i}/{p}": t.replace("from ", f"from p{i}.") for i in range(3) for p, t in parts.items()}
    rounds = []
    monkeypatch.setattr(scopes, "typed", lambda g, n, was=scopes.typed: rounds.append(1) or was(g, n))
    alone = calls(spark, files)
    assert not rounds and ("p1/job.py::class::Job::again", "p1/s.py::class::B::save") in alone and ("p1/u.py::function::start", "p1/s.py::class::A::save") not in alone
    monkeypatch.setattr(scopes, "GROUP_ROWS", 20)
    assert calls(spark, files) == alone and rounds
    links = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(9)] + [("x", "a"), ("x", "x")], "file_path string, target string")
    assert {tuple(r) for r in scopes.groups(links).collect()} == {(f"f{i}", "f0") for i in range(10)} | {("x", "a"), ("a", "a")}
