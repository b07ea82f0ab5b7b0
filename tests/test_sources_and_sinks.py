"""Extraction, models, analyses, results."""

import json

import pytest

from loxis import analyses
from loxis.operators import relational
from loxis.session import query_datalog, query_ql
from loxis.sinks import results
from loxis.sources import extract_c, extract_python  # noqa: F401  register their languages
from loxis.sources.database import Database
from loxis.sources.extract import count_lines, extract, facts_of, scheme_of, source_roots, split_facts
from loxis.sources.models import AccessPath, AccessPathError, ModelError, Step, add_models, parse_access_path, parse_models


def rows(df):
    return sorted(map(tuple, df.collect()))


def call_facts(db, calls, functions, assigns=(), addresses=()):
    """Facts of calls by name: (caller, callee), and of `v = w` or `v = &w` in a function."""
    ids = {n: k for k, n in enumerate(functions, 1)}
    exprs, parents, text, enclosing, k = [], [], [], [], 100
    for caller, callee in calls:
        exprs += [(k, 74, 0), (k + 1, 84, 0)]
        parents.append((k + 1, 0, k))
        text.append((k + 1, callee))
        enclosing += [(k, ids[caller]), (k + 1, ids[caller])]
        k += 10
    for f, to, source in assigns:
        exprs += [(k, 52, 0), (k + 1, 84, 0), (k + 2, 84, 0)]
        parents += [(k + 1, 0, k), (k + 2, 1, k)]
        text += [(k + 1, to), (k + 2, source)]
        enclosing += [(x, ids[f]) for x in (k, k + 1, k + 2)]
        k += 10
    for f, to, source in addresses:
        exprs += [(k, 52, 0), (k + 1, 84, 0), (k + 2, 2, 0), (k + 3, 84, 0)]
        parents += [(k + 1, 0, k), (k + 2, 1, k), (k + 3, 0, k + 2)]
        text += [(k + 1, to), (k + 3, source)]
        enclosing += [(x, ids[f]) for x in (k, k + 1, k + 2, k + 3)]
        k += 10
    db.add_rows("functions", [(i, n, 1) for n, i in ids.items()], "id long, name string, kind long")
    db.add_rows("exprs", exprs, "id long, kind long, location long").add_rows("exprparents", parents, "e long, i long, p long")
    return db.add_rows("valuetext", text, "id long, t string").add_rows("enclosingfunction", enclosing, "c long, p long")


def named(db, program, relation, *places):
    """Rows of an analysis with the names of functions for their ids at these places."""
    name = dict(db.relation("functions").select("c0", "c1").collect())
    return sorted(tuple(name[x] if k in places else x for k, x in enumerate(r)) for r in rows(analyses.analyse(db, program, relation)))


def test_call_graph(spark):
    db = call_facts(Database(spark), [("main", "foo"), ("main", "bar"), ("foo", "bar"), ("foo", "baz"), ("bar", "baz")], ["baz", "bar", "foo", "main"])
    assert len(rows(analyses.analyse(db, analyses.CALL_GRAPH, "invokes"))) == 5 and len(rows(analyses.analyse(db, analyses.CALL_GRAPH, "depends"))) == 6
    assert named(db, analyses.CALL_GRAPH, "leaf", 0) == [("baz",)] and named(db, analyses.CALL_GRAPH, "entry", 0) == [("main",)]
    assert rows(analyses.bind_calls(db).relation("funbind")) == [(100, 3), (110, 2), (120, 2), (130, 1), (140, 1)]


def test_points_to(spark):
    copies = [("basic", "fp", "inc"), ("chain", "fp", "inc"), ("chain", "gp", "fp"), ("chain", "hp", "gp"), ("multi", "fp", "inc"), ("multi", "fp", "mul2")]
    db = call_facts(Database(spark), [], ["inc", "mul2", "neg", "basic", "chain", "multi", "address"], copies, [("address", "p", "inc"), ("address", "q", "x")])
    db.add_rows("localvariables", [(1000, "fp", "int")], "id long, n string, t string").add_rows("params", [(1, 0, "n", "int")], "f long, i long, n string, t string")
    got = set(named(db, analyses.POINTS_TO, "points", 0, 2))
    assert got == {("basic", "fp", "inc"), ("chain", "fp", "inc"), ("chain", "gp", "inc"), ("chain", "hp", "inc"), ("multi", "fp", "inc"), ("multi", "fp", "mul2"), ("address", "p", "inc")}


def test_data_flow_parameters_and_metrics(spark):
    db = call_facts(Database(spark), [("f", "g")], ["f", "g"], [("f", "b", "a"), ("f", "c", "b")])
    db.add_rows("localvariables", [(1000, "z", "int")], "id long, n string, t string").add_rows("params", [(1, 0, "a", "int"), (1, 1, "unused", "int")], "f long, i long, n string, t string").add_rows("stmts", [(5, 1, 0)])
    assert set(named(db, analyses.DATA_FLOW, "flow", 0)) == {("f", "a", "b"), ("f", "b", "c"), ("f", "a", "c")}
    assert named(db, analyses.UNUSED_PARAMETERS, "unused", 0) == [("f", "unused")]
    assert named(db, analyses.METRICS, "parameters", 0) == [("f", 2), ("g", 0)] and named(db, analyses.METRICS, "fan_in", 0) == [("f", 0), ("g", 1)]


TWO_FILES = {
    "one.c": "static int help(int n) { return n; } int first(int (*cb)(int)) { return cb(1) + help(2) + shared(3); } int go(void) { return first(help); }",
    "two.c": "static int help(int n, int spare) { int m = n; return m + 1; } int second(void) { return help(1, 2) + help(3, 4); } int shared(int k) { return printf(k); }",
}


def test_functions_of_equal_names_in_two_files(spark):
    """A call means the function of its own file; nothing of one flows into the other."""
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in TWO_FILES.items()], "path string, content binary")
    db = split_facts(spark, facts_of(files, "", ("c",)).persist(), scheme_of(("c",)))
    where = dict(rows(query_datalog(db, analyses.CALL_GRAPH + "q(f, p) :- functions(f, _, _), home(f, u), files(u, p).", "q")))
    name = {r[0]: f"{r[1]}@{where[r[0]]}" for r in db.relation("functions").collect()}
    told = lambda program, relation, *at: {tuple(name[x] if k in at else x for k, x in enumerate(r)) for r in rows(analyses.analyse(db, program, relation))}
    assert told(analyses.CALL_GRAPH, "invokes", 0, 1) == {("first@one.c", "help@one.c"), ("first@one.c", "shared@two.c"), ("go@one.c", "first@one.c"), ("second@two.c", "help@two.c")}
    assert told(analyses.CALL_GRAPH, "outside", 0) == {("first@one.c", "cb"), ("shared@two.c", "printf")}
    assert told(analyses.CALL_GRAPH, "leaf", 0) == {("help@one.c",), ("help@two.c",)}
    assert told(analyses.POINTS_TO, "points", 0, 2) == {("first@one.c", "cb", "help@one.c")}
    assert told(analyses.DATA_FLOW, "flow", 0) == {("help@two.c", "n", "m")}
    assert told(analyses.UNUSED_PARAMETERS, "unused", 0) == {("help@two.c", "spare")}
    assert {r[1] for r in told(analyses.METRICS, "fan_in", 0) if r[0].startswith("help")} == {1}
    assert len(rows(analyses.bind_calls(db).relation("funbind"))) == 5


def test_dangerous_calls(spark):
    db = call_facts(Database(spark), [("a", "gets"), ("b", "strcpy"), ("c", "puts")], ["a", "b", "c"])
    assert rows(query_ql(db, analyses.DANGEROUS)) == [("gets", "a"), ("strcpy", "b")]


def test_java_bindings(spark):
    db = Database(spark)
    db.add_rows("methods", [(1, "run", "()", "void", 50, 1), (2, "run", "(int)", "void", 51, 2)], "id long, n string, s string, t string, p long, src long").add_rows("constrs", [(3, "Dog", "()", "void", 50, 3)], "id long, n string, s string, t string, p long, src long")
    db.add_rows("exprs", [(10, 61, "void", 0, 0), (11, 52, "Dog", 0, 0), (12, 60, "int", 0, 0), (13, 60, "int", 0, 0)], "id long, k long, t string, p long, i long")
    db.add_rows("namestrings", [("run", "", 10), ("x", "", 12), ("y", "", 13)], "n string, v string, p long").add_rows("callableEnclosingExpr", [(12, 1), (13, 1)])
    db.add_rows("localvars", [(20, "x", "int", 1)], "id long, n string, t string, p long").add_rows("params", [(21, "int", 0, 1, 21)], "id long, t string, pos long, p long, s long").add_rows("paramName", [(21, "x")], "id long, n string").add_rows("fields", [(22, "y", "int", 50)], "id long, n string, t string, p long")
    analyses.bind_java(db)
    assert rows(db.relation("callableBinding")) == [(10, 1), (11, 3)] and rows(db.relation("variableBinding")) == [(12, 20), (13, 22)]


SOURCE = '''import os
from a.b import c as d, e   # a comment

@decorate(1)
class Dog(Animal):
    def bark(self, times: int = 2, *rest, loud=False, **more):
        x = times + 1
        return [y for y in rest if y] or os.path.join("a", x)

async def main():
    # another
    await Dog().bark(3)
'''


def test_python_facts(spark, tmp_path):
    (tmp_path / "src/p").mkdir(parents=True)
    (tmp_path / "src/p/dog.py").write_text(SOURCE)
    (tmp_path / "src/bad.py").write_text("def (:\n")
    (tmp_path / "src/x.c").write_text("int x; // one\n/* two\n three */ int y;\n\n")
    db = extract(spark, str(tmp_path / "src"), str(tmp_path / "out"), root=str(tmp_path / "src"))
    get = lambda name, *c: sorted(tuple(r[i] for i in c) for r in db.relation(name).collect())
    assert get("py_Functions", 1) == [("bark",), ("main",)] and get("py_Classes", 1) == [("Dog",)] and get("py_base_classes", 2) == [("Animal",)]
    assert get("py_parameters", 2, 1, 4) == [(0, "self", 0), (1, "times", 0), (2, "rest", 2), (3, "loud", 1), (4, "more", 3)]
    assert get("py_import_names", 2, 3) == [("c", "d"), ("e", ""), ("os", "")] and get("py_comments", 1) == [("# a comment",), ("# another",)]
    assert get("py_decorators", 3) == [("decorate(1)",)] and get("py_variables", 1) == [("x",), ("y",)] and len(get("py_function_is_async", 0)) == 1
    assert get("files", 1) == [("bad.py",), ("p/dog.py",), ("x.c",)] and (3, 2, 2) not in get("numlines", 1, 2, 3)
    assert get("numlines", 1, 2, 3) == [(1, 1, 0), (4, 2, 3), (12, 9, 2)]
    calls = """class Call extends @py_expr { Call() { py_exprs(this, 0, _, _) } string name() { exists(int f | py_exprs(f, _, this, 0) and py_expr_names(f, result)) } } from Call c select c.name()"""
    assert rows(query_ql(db, calls)) == [("Dog",), ("bark",), ("join",)]
    again = extract(spark, str(tmp_path / "src"), str(tmp_path / "out2"), root=str(tmp_path / "src"))
    assert rows(again.relation("py_exprs")) == rows(db.relation("py_exprs"))


def test_lines_and_roots(tmp_path):
    assert count_lines("a = 1\n# b\n\nc # d\n", "python") == (4, 2, 2) and count_lines("", "java") == (0, 0, 0)
    (tmp_path / "m/src/main/java").mkdir(parents=True)
    (tmp_path / "m/pom.xml").write_text("<project/>")
    assert source_roots(str(tmp_path)) == [str(tmp_path / "m/src/main/java")]
    (tmp_path / "m/src/own").mkdir()
    (tmp_path / "m/pom.xml").write_text("<project><build><sourceDirectory>src/own</sourceDirectory></build></project>")
    assert source_roots(str(tmp_path)) == [str(tmp_path / "m/src/own")]


MODELS = """
extensions:
  - addsTo: {pack: p, extensible: sourceModel}
    data:
      - ["zoo.gate", "Door", false, "letIn", "(Cart)", "", "ReturnValue", "visitor", "manual"]
  - addsTo: {pack: p, extensible: summaryModel}
    data:
      - ["zoo.food", "Bowl", true, "pour", "(Bowl,int)", "", "Argument[0]", "Argument[this].Element", "taint", "manual"]
  - addsTo: {pack: p, extensible: neutralModel}
    data:
      - ["zoo.food", "Bowl", "weigh", "()", "summary", "manual"]
  - addsTo: {pack: p, extensible: other}
    data: [[1, 2]]
"""


def test_models(spark):
    m = parse_models(MODELS)
    assert m.by_kind("sourceModel", "visitor")[0][5] == "ReturnValue" and m.unknown == {"other": [[1, 2]]} and m.by_callable("summaryModel", "zoo.food", "Bowl", "pour")
    db = add_models(Database(spark), m.merge(m))
    assert rows(query_ql(db, 'from string t, string n where summaryModel(_, t, true, n, _, _, _, "taint", _) select t, n')) == [("Bowl", "pour")]
    with pytest.raises(ModelError):
        parse_models("extensions: [{addsTo: {extensible: sinkModel}, data: [[1]]}]")


def test_access_paths():
    assert parse_access_path("Argument[this].SyntheticField[android.content.Intent.extras].MapValue") == AccessPath("Argument", ("this",), (Step("SyntheticField", "android.content.Intent.extras"), Step("MapValue")))
    assert parse_access_path("Argument[0..2]").argument == ("range", 0, 2) and parse_access_path("Argument[*@1]").argument == ("dereferenced element", 1) and parse_access_path("Argument[-1]").argument == ("index", -1)
    assert parse_access_path("ReturnValue[**].Field[*next]").steps == (Step("DerefField", "next"),) and parse_access_path("").root == "Empty"
    for bad in ("Nothing", "Argument", "Argument[x]", "ReturnValue.What", "Argument[0]Field[x]"):
        with pytest.raises(AccessPathError):
            parse_access_path(bad)


DOC = """/**
 * @name Dangerous call
 * @description Finds calls
 *              of old functions.
 * @kind problem
 * @id c/dangerous
 * @problem.severity error
 * @security-severity 9.3
 * @tags security
 *       external/cwe-676
 */
select 1"""


def test_results(spark):
    m = results.parse_metadata(DOC)
    assert (m.name, m.description, m.kind, m.severity, m.tags) == ("Dangerous call", "Finds calls of old functions.", "problem", "error", ["security", "external/cwe-676"])
    df = spark.createDataFrame([("file:///a.c:1:2:3:4", 'say "x", y', True)], "e string, m string, b boolean")
    assert results.to_csv(df) == 'e,m,b\nfile:///a.c:1:2:3:4,"say ""x"", y",true\n'
    got = json.loads(results.to_json(df, m))
    assert got["columns"][2] == {"name": "b", "type": "boolean"} and got["rows"][0][2] is True and got["metadata"]["id"] == "c/dangerous"
    run = json.loads(results.to_sarif(df, m))["runs"][0]
    assert run["results"][0]["level"] == "error" and run["results"][0]["locations"][0]["physicalLocation"]["region"]["endColumn"] == 4
    path = spark.createDataFrame([("e", "s", "t", "found")], "a string, b string, c string, d string")
    flow = json.loads(results.to_sarif(path, results.Metadata(kind="path-problem", severity="recommendation")))["runs"][0]["results"][0]
    assert flow["level"] == "note" and len(flow["codeFlows"][0]["threadFlows"][0]["locations"]) == 2 and flow["message"]["text"] == "found"
    assert "| e " in results.to_table(df)


def test_result_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b'), (2, "c,d")], "k long, s string")
    results.write_csv(df, str(tmp_path / "csv"))
    results.write_parquet(df, str(tmp_path / "set"))
    assert rows(spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')) == [("1", 'a"b'), ("2", "c,d")]
    assert rows(results.read_result(spark, str(tmp_path / "set"))) == rows(df)


def test_relational(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k long, s string"), spark.createDataFrame([(2, 5), (3, 6)], "k long, n long")
    assert rows(relational.equi_join(a, b, [("k", "k")])) == [(2, "y", 2, 5), (2, "z", 2, 5)] and rows(relational.project(a, "k")) == [(1,), (2,)]
    assert rows(relational.aggregate(a, ["k"], "count")) == [(1, 1), (2, 2)] and rows(relational.aggregate(b, [], "sum", "n")) == [(11,)]
    assert rows(relational.difference(a, a.where("k = 2"))) == [(1, "x")] and rows(relational.union(a, a)) == rows(a) and rows(relational.intersection(a, a.where("k = 1"))) == [(1, "x")]
    assert rows(relational.semi_join(a, b, ["k"])) == [(2, "y"), (2, "z")] and rows(relational.anti_join(a, b, ["k"])) == [(1, "x")] and rows(relational.count_rows(a)) == [(3,)]
    assert relational.rename(a, {"s": "t"}).columns == ["k", "t"] and rows(relational.select(a, a.k > 1)) == [(2, "y"), (2, "z")]


C_SOURCE = """#include <stdio.h>
/* a comment */
typedef struct node { int value; struct node *next; } node_t;
enum color { RED, GREEN = 5 };
static int limit = 10;
int inc(int x) { return x + 1; }
int mul2(int x) { return x * 2; }
int run(int (*f)(int), int v) { return f(v); }
void unused_param(int a, int b) { if (a > 0 && a != 3) { a++; } else while (a) a -= 1; }
int main(void) {
    int (*fp)(int) = inc;
    int (*gp)(int);
    node_t *n = 0, m;
    gp = fp;
    if (limit) fp = mul2;
    for (int i = 0; i < 3; i++) { printf("%d\\n", gp(i)); }
    int c = (int) m.value + n->value;
    switch (c) { case 1: break; default: c = c ? 1 : 2; }
    do { c--; } while (c > 0);
    return run(fp, c) + run(&inc, 2);
}
int broken(( ;
int after(void) { gets(0); return 0; }
"""


def test_c_facts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.c").write_text(C_SOURCE)
    db = extract(spark, str(tmp_path / "src"), str(tmp_path / "out"), root=str(tmp_path / "src"), languages=["c"])
    get = lambda name, *c: sorted(tuple(r[i] for i in c) for r in db.relation(name).collect())
    assert get("functions", 1) == [("after",), ("inc",), ("main",), ("mul2",), ("run",), ("unused_param",)]
    assert get("localvariables", 1) == [("c",), ("fp",), ("gp",), ("i",), ("m",), ("n",)] and get("globalvariables", 1, 2) == [("limit", "int")]
    assert get("fields", 1, 2) == [(0, "value"), (1, "next")] and get("enumconstants", 2, 3) == [(0, "RED"), (1, "GREEN")] and get("includes", 2) == [("stdio.h",)]
    assert get("params", 1, 2, 3) == [(0, "a", "int"), (0, "f", "int (*)()"), (0, "x", "int"), (0, "x", "int"), (1, "b", "int"), (1, "v", "int")]
    kinds = [k for (k,) in get("stmts", 1)]
    assert all(kinds.count(k) == n for k, n in ((2, 2), (3, 1), (6, 5), (8, 1), (9, 1), (10, 2), (11, 1), (28, 1)))
    assert len(get("iscall", 0)) == 6 and len(get("if_else", 0)) == 1 and len(get("comments", 1)) == 1
    assert named(db, analyses.UNUSED_PARAMETERS, "unused", 0) == [("unused_param", "b")]
    assert named(db, analyses.CALL_GRAPH, "invokes", 0, 1) == [("main", "run")] and named(db, analyses.CALL_GRAPH, "outside", 0) == [("after", "gets"), ("main", "gp"), ("main", "printf"), ("run", "f")]
    points = set(named(db, analyses.POINTS_TO, "points", 0, 2))
    assert {("main", "fp", "inc"), ("main", "fp", "mul2"), ("main", "gp", "inc"), ("main", "gp", "mul2"), ("run", "f", "inc"), ("run", "f", "mul2")} <= points
    assert rows(query_ql(db, analyses.DANGEROUS)) == [("gets", "after")]


def small_class(name="p/Dog", above="p/Animal", interface="p/Printable"):
    """A class file by hand: a field `int age`, a constructor and `String bark(int, long[])`."""
    import struct

    pool, texts = [], {}

    def text(t):
        if t not in texts:
            raw = t.encode()
            pool.append(b"\x01" + struct.pack(">H", len(raw)) + raw)
            texts[t] = len(pool)
        return texts[t]

    def klass(t):
        k = text(t)
        pool.append(b"\x07" + struct.pack(">H", k))
        return len(pool)

    own, up, face = klass(name), klass(above), klass(interface)
    member = lambda flags, n, d: struct.pack(">HHHH", flags, text(n), text(d), 0)
    fields = [member(0x0002, "age", "I")]
    methods = [member(0x0001, "<init>", "()V"), member(0x0009, "bark", "(I[J)Ljava/lang/String;"), member(0x1000, "hidden", "()V")]
    head = struct.pack(">IHH", 0xCAFEBABE, 0, 65) + struct.pack(">H", len(pool) + 1) + b"".join(pool)
    return head + struct.pack(">HHHHH", 0x0021, own, up, 1, face) + struct.pack(">H", 1) + b"".join(fields) + struct.pack(">H", 3) + b"".join(methods) + struct.pack(">H", 0)


def test_class_files(spark, tmp_path):
    import zipfile

    from loxis.sources.extract_classes import ClassFile, ClassFileError, extract_classes, types_of

    assert types_of("(I[[Ljava/util/Map$Entry;J)V") == ["int", "java.util.Map.Entry[][]", "long", "void"]
    with pytest.raises(ClassFileError):
        ClassFile(small_class()[:40])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/Dog.class").write_bytes(small_class())
    (tmp_path / "in/Bad.class").write_bytes(b"nothing")
    with zipfile.ZipFile(tmp_path / "in/more.jar", "w") as z:
        z.writestr("p/Puppy.class", small_class("p/Puppy", "p/Dog"))
    db = extract_classes(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    get = lambda name, *c: sorted(tuple(r[i] for i in c) for r in db.relation(name).collect())
    assert get("classes_or_interfaces", 1) == [("Dog",), ("Puppy",)] and get("packages", 1) == [("p",)]
    assert get("methods", 1, 2, 3) == [("bark", "bark(int, long[])", "java.lang.String")] * 2 and get("fields", 1, 2) == [("age", "int")] * 2 and get("constrs", 1) == [("Dog",), ("Puppy",)]
    program = 'class C extends @classorinterface { C() { classes_or_interfaces(this, _, _, _) } string name() { classes_or_interfaces(this, result, _, _) } C up() { extendsReftype(this, result) } predicate isStatic(string m) { exists(int x, int k | methods(x, m, _, _, this, _) and hasModifier(x, k) and modifiers(k, "static")) } } from C c, string m where c.isStatic(m) select c.up().name(), c.name(), m'
    assert rows(query_ql(db, program)) == [("Dog", "Puppy", "bark")]


def test_archives_of_a_jdk(spark, tmp_path, monkeypatch):
    import zipfile

    from loxis.sources import extract_classes as classes

    home = tmp_path / "jdk"
    (home / "jmods").mkdir(parents=True)
    for module in ("java.base", "java.logging", "java.sql", "java.xml", "java.desktop"):
        with zipfile.ZipFile(home / f"jmods/{module}.jmod", "w") as z:
            z.writestr("classes/p/Dog.class", small_class() if module == "java.base" else small_class(f"{module.replace('.', '/')}/Dog"))
    monkeypatch.setenv("JAVA_HOME", str(home))
    assert classes.java_home() == str(home)
    names = lambda **k: sorted(r[1] for r in classes.extract_jdk(spark, str(tmp_path / f"out{len(k)}"), **k).relation("packages").collect())
    assert names() == ["java.logging", "java.sql", "java.xml", "p"] and len(classes.jdk_archives(str(home), ["all"])) == 5
    assert names(modules=["java.desktop"]) == ["java.desktop"]
    with pytest.raises(FileNotFoundError, match="java.none"):
        classes.jdk_archives(str(home), ["java.none"])
    (tmp_path / "old/jre/lib").mkdir(parents=True)
    (tmp_path / "old/jre/lib/rt.jar").write_bytes(b"")
    assert classes.jdk_archives(str(tmp_path / "old")) == [str(tmp_path / "old/jre/lib/rt.jar")]


JAVA_SOURCE = '''package p.q;
import java.util.List;
interface Printable { String print(int n, String... rest) throws Exception; }
abstract class Animal<T extends Comparable<T>> implements Printable {
    private static final int MAX = 10;
    protected List<Map<String, T>> items = new ArrayList<>();
    Animal(int age) { super(); this.age = age; }
    int run(int x) {
        int y = MAX >> 2;
        for (String s : names) { System.out.println(s + y); }
        Runnable r = () -> { int z = y; bark(z); };
        if (x > y && !(x instanceof Object o)) return (int) y; else while (y < 3) y++;
        try { bark(x); } catch (IOException | RuntimeException e) { throw e; } finally { bark(1); }
        switch (y) { case 1: break; default: y = 5L > 3 ? 1 : 2; }
        return new Dog().run(items.get(0));
    }
    enum Color { RED, GREEN }
}
class Dog extends Animal<String> { Dog() { super(3); } void bark(int n) { } }
class Broken { int f( { } void after() { bark(2); } }
'''


JS_SOURCE = r"""
import def, { one as two, three } from './lib.js';
import * as all from "pkg";
// a comment
const x = 1, { a, b: [c, ...d], e = 5 } = load(`n${x + 1}t`), re = /a[/]b+/gi;
export default class Dog extends Animal {
  #age = 3;
  static make(n, m = 2) { return new Dog(n, ...m); }
  get age() { return this.#age; }
  async run(x) { for (const k of x) { await k?.go(x => x * 2); } }
}
export function walk(tree, fn) {
  if (!tree) return null; else fn(tree);
  for (let i = 0; i < 10; i++) { continue; }
  for (var q in tree) delete tree[q];
  switch (typeof tree) { case "a": break; default: throw new Error("x") }
  try { walk(tree.left, fn) } catch (err) { log(err) } finally { }
  do { x++ } while (x ** 2 > 3 || x === 4)
  const f = async function* named() { yield 1 }
  label: while (true) break label
  return tree.a ? { k: 1, x, m() { return 2 }, ...tree } : [1, , 2]
}
broken ( ;
after(1)
"""
TS_SOURCE = r"""
interface P<T> extends Q { a: T; m(): void }
enum Color { Red, Green }
type Alias = { a: number } | Map<string, P<number>>;
@Injectable() export class S<T> { private x: number = 1; constructor(private readonly y: Map<string, T[]>, z?: string) {} get<K extends T>(k: K): K[] | undefined { return (k as any)!.list<string>(k) as K[]; } }
const f = (a: number, b?: string): boolean => a < 3;
let g: (x: number) => void = (x) => { };
declare function ext(n: number): string;
export abstract class A { abstract go(): void; }
"""


def test_javascript_facts():
    from loxis.sources.extract_js import extract_js

    out = list(extract_js("a.js", JS_SOURCE))
    get = lambda name, *c: [tuple(r[i] for i in c) if len(c) > 1 else r[c[0]] for n, r in out if n == name]
    assert get("functions", 1) == ["make", "age", "run", "", "walk", "named", "m"] and get("classes", 1) == ["Dog"]
    assert get("imports", 2, 3) == [("def, one, three", "./lib.js"), ("* as all", "pkg")] and len(get("exports", 0)) == 2 and get("toplevels", 1) == [1]
    assert get("variables", 1) == ["x", "a", "c", "d", "e", "re", "Dog", "n", "m", "x", "k", "x", "walk", "tree", "fn", "i", "q", "err", "f"]
    kinds = get("stmts", 1)
    assert all(kinds.count(k) == n for k, n in ((3, 1), (8, 1), (19, 2), (11, 1), (13, 1), (14, 1), (15, 1), (21, 1), (4, 1), (29, 1), (30, 1)))
    assert {"after", "/a[/]b+/gi", "go"} <= set(get("literals", 0)) and get("comments", 3) == ["// a comment"]
    ids = [r[0] for n, r in out if n in ("stmts", "exprs", "functions", "classes", "properties", "scopes", "variables")]
    assert len(set(ids)) == len(ids) and {r[2] for n, r in out if n in ("stmts", "exprs")} <= {*ids, *get("toplevels", 0)}
    places = {r[0]: r[2:] for n, r in out if n == "locations_default"}
    where = dict(r for n, r in out if n == "hasLocation")
    name = {r[1]: r[0] for n, r in out if n == "functions"}
    assert places[where[name["walk"]]] == (12, 8, 22, 1)


def test_typescript_facts():
    from loxis.sources.extract_js import extract_js

    out = list(extract_js("a.ts", TS_SOURCE))
    get = lambda name, c: [r[c] for n, r in out if n == name]
    assert get("interfaces", 1) == ["P"] and get("enums", 1) == ["Color"] and get("type_aliases", 1) == ["Alias"] and get("decorators", 1) == ["Injectable"]
    assert get("functions", 1) == ["constructor", "get", "", "", "ext", "go"] and get("classes", 1) == ["S", "A"]
    assert get("type_annotations", 2) == ["Map<string, T[]>", "string", "K", "K[] | undefined", "number", "string", "boolean", "(x: number) => void", "number", "string", "void"]


GENERIC_SOURCE = """
package zoo;
@Deprecated @Kind(value = "pen") public class Pen<A extends Animal & Comparable<A>, B> {
    @Inject private final List<A> all = null;
    @Override public <K extends Number, V> Map<K, V> by(@NotNull final K key, V value) { return null; }
    <X> Pen(X x) { }
    record Tag(@Id int number, String text) { }
    enum Size { @Old SMALL, LARGE(2); Size(int n) { } }
}
interface Animal { }
"""


def test_generics_annotations_and_generated_members(spark):
    from loxis.sources import extract_java  # noqa: F401

    files = spark.createDataFrame([("Pen.java", bytearray(GENERIC_SOURCE.encode()))], "path string, content binary")
    db = split_facts(spark, facts_of(files, "", ("java",)).persist(), scheme_of(("java",)))
    found = lambda text: rows(query_datalog(db, text, "q"))
    assert found("q(c, v, p) :- typeVars(_, v, p, k), classes_or_interfaces(k, c, _, _).") == [("Pen", "A", 0), ("Pen", "B", 1)]
    assert found("q(m, v, t) :- typeVars(x, v, _, k), methods(k, m, _, _, _, _), typeBounds(_, t, _, x).") == [("by", "K", "Number")]
    assert found("q(v, t, p) :- typeVars(x, v, _, _), typeBounds(_, t, p, x).") == [("A", "Animal", 0), ("A", "Comparable", 1), ("K", "Number", 0)]
    assert found("q(c, a) :- annotations(_, k, a), classes_or_interfaces(k, c, _, _).") == [("Pen", "Deprecated"), ("Pen", "Kind")]
    assert found("q(f, a) :- annotations(_, k, a), fields(k, f, _, _).") == [("SMALL", "Old"), ("all", "Inject"), ("number", "Id")]
    assert found("q(n, a) :- annotations(_, k, a), paramName(k, n).") == [("key", "NotNull")] and found("q(m, a) :- annotations(_, k, a), methods(k, m, _, _, _, _).") == [("by", "Override")]
    assert found("q(s) :- constrs(k, _, s, _, _, _), not compiler_generated(k, _).") == [("Pen(X)",), ("Size(int)",)] and found("q(k) :- isDefConstr(k).") == []


def test_java_facts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.java").write_text(JAVA_SOURCE)
    from loxis.sources import extract_java  # noqa: F401

    db = extract(spark, str(tmp_path / "src"), str(tmp_path / "out"), root=str(tmp_path / "src"), languages=["java"])
    get = lambda name, *c: sorted(tuple(r[i] for i in c) for r in db.relation(name).collect())
    assert get("classes_or_interfaces", 1) == [("Animal",), ("Broken",), ("Color",), ("Dog",), ("Printable",)] and get("packages", 1) == [("p.q",)]
    assert get("methods", 1, 2, 3) == [("after", "after()", "void"), ("bark", "bark(int)", "void"), ("print", "print(int, String...)", "String"), ("run", "run(int)", "int"), ("valueOf", "valueOf(String)", "Color"), ("values", "values()", "Color[]")]
    assert get("constrs", 2, 3) == [("Animal(int)", "Animal"), ("Broken()", "Broken"), ("Color(String, int)", "Color"), ("Dog()", "Dog")]
    assert len(get("isDefConstr", 0)) == 1 and len(get("compiler_generated", 0)) == 4
    assert get("typeVars", 1, 2) == [("T", 0)] and get("typeBounds", 1, 2) == [("Comparable", 0)]
    assert get("fields", 1, 2) == [("GREEN", "Color"), ("MAX", "int"), ("RED", "Color"), ("items", "List")]
    assert get("localvars", 1, 2) == [("e", "IOException|RuntimeException"), ("o", "Object"), ("r", "Runnable"), ("s", "String"), ("y", "int"), ("z", "int")]
    analyses.bind_java(db)
    calls = "class Call extends @expr { Call() { exprs(this, 61, _, _, _) } string name() { namestrings(result, _, this) } } from Call c, int m, string n where callableBinding(c, m) and methods(m, n, _, _, _, _) select c.name(), n"
    assert rows(query_ql(db, calls)) == [("bark", "bark"), ("run", "run")]
    bound = "from int e, int v, string n where variableBinding(e, v) and namestrings(n, _, e) and (fields(v, n, _, _) or localvars(v, n, _, _) or paramName(v, n)) select n"
    assert rows(query_ql(db, bound)) == [("MAX",), ("age",), ("e",), ("items",), ("s",), ("x",), ("y",), ("z",)]
    up = "from string a, string b, int x, int y where extendsReftype(x, y) and classes_or_interfaces(x, a, _, _) and classes_or_interfaces(y, b, _, _) select a, b"
    assert rows(query_ql(db, up)) == [("Dog", "Animal")]
