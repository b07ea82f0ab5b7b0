"""Programs over small relations, with answers worked out by hand."""

import pytest

from loxis.lang.datalog import SyntaxProblem, parse_datalog
from loxis.lang.ql_syntax import QLError
from loxis.plans import engine as engine_module
from loxis.plans.compile import Compiler
from loxis.plans.engine import Engine
from loxis.plans.ir import StratificationError, UnboundVariable, atoms
from loxis.session import query_all_ql, query_datalog, query_ql
from loxis.sources.database import Database
from loxis.sources.dbscheme import SchemeError, parse_dbscheme

CHAIN = [(1, 2), (2, 3), (3, 4)]


@pytest.fixture
def db(spark):
    out = Database(spark).add_rows("edge", CHAIN).add_rows("val", [(1,), (5,), (10,), (20,)]).add_rows("r", [(1, 1), (1, 2), (2, 2)]).add_rows("pair", [(1, "b"), (1, "a"), (2, "z")], "k long, s string")
    out.add_rows("functions", [(1, "main", 1), (2, "helper", 1), (3, "unused", 1)], "id long, name string, kind long")
    out.add_rows("params", [(2, 0, "x", "int"), (2, 1, "y", "int")], "id long, i long, name string, type string")
    return out.add_rows("localvariables", [(10, "a", "int"), (11, "b", "int"), (12, "c", "int")], "id long, name string, type string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def datalog(db, text, out="q"):
    return rows(query_datalog(db, text, out))


CASES = {
    "closure": ("q(x,y) :- edge(x,y). q(x,z) :- q(x,y), edge(y,z).", [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]),
    "cycle": ("e(1,2). e(2,3). e(3,1). q(x,y) :- e(x,y). q(x,z) :- q(x,y), q(y,z).", [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]),
    "not reached": ("road(3,9). road(9,4). road(4,3). road(7,4). road(8,8). town(a) :- road(a,_). town(b) :- road(_,b). way(b) :- road(3,b). way(c) :- way(b), road(b,c). q(a) :- town(a), not way(a).", [(7,), (8,)]),
    "zero is kept": ("n(x) :- edge(x,_). n(y) :- edge(_,y). q(x,k) :- n(x), k = count { y : edge(x,y) }.", [(1, 1), (2, 1), (3, 1), (4, 0)]),
    "strict drops": ("n(x) :- edge(x,_). n(y) :- edge(_,y). q(x,k) :- n(x), k = strictcount { y : edge(x,y) }.", [(1, 1), (2, 1), (3, 1)]),
    "repeated variable": ("q(x) :- r(x,x).", [(1,), (2,)]),
    "wildcards": ("q(x) :- r(x,_).", [(1,), (2,)]),
    "division": ("q(x,d,m) :- val(x), d = x / 3, m = x % 3.", [(1, 0, 1), (5, 1, 2), (10, 3, 1), (20, 6, 2)]),
    "negative division truncates": ("v(-7). q(d,m) :- v(x), d = x / 2, m = x % 3.", [(-3, -1)]),
    "division by zero": ("q(d) :- val(x), d = x / 0.", []),
    "overflow": ("v(9223372036854775807). q(d) :- v(x), d = x + 1.", []),
    "cross": ("q(x,y) :- val(x), val(y), x + y = 15, x < y.", [(5, 10)]),
    "minus sign": ("q(z) :- val(x), z = x -1.", [(0,), (4,), (9,), (19,)]),
    "constant first": ("q(x) :- val(x), 7 > x.", [(1,), (5,)]),
    "undefined is empty": ("q(x) :- val(x), not nothing(x).", [(1,), (5,), (10,), (20,)]),
    "wrong arity matches nothing": ("q(x) :- val(x, _).", []),
    "facts join": ("e(1,2). e(2,3). q(x,z) :- e(x,y), e(y,z).", [(1, 3)]),
    "constants in the head": ('q(x, "old", 3) :- val(x), x > 10.', [(20, "old", 3)]),
    "concat": ('q(k,s) :- pair(k,_), s = concat { x, "+" : pair(k,x) }.', [(1, "a+b"), (2, "z")]),
    "rank": ("q(k,s) :- pair(k,_), s = rank[1] { x : pair(k,x) }.", [(1, "a"), (2, "z")]),
    "unique": ("q(k,s) :- pair(k,_), s = unique { x : pair(k,x) }.", [(2, "z")]),
    "min of nothing": ("q(x,m) :- val(x), m = min { y : edge(x,y) }.", [(1, 2)]),
    "sum over an empty relation": ("q(s) :- s = sum { x : val(x), x > 99 }.", [(0,)]),
    "mutual recursion": ("s(0,1). s(1,2). s(2,3). even(0). odd(y) :- even(x), s(x,y). even(y) :- odd(x), s(x,y). q(x) :- odd(x).", [(1,), (3,)]),
    "string escapes": ('v("a\\"b\\n"). q(x) :- v(x).', [('a"b\n',)]),
    "promotion": ("v(2.5). v(3.0). q(y) :- v(x), y = x * 2.", [(5.0,), (6.0,)]),
    "int meets float": ("v(1.0). v(2.0). q(x) :- val(x), v(x).", [(1,)]),
}


@pytest.mark.parametrize("name", CASES)
def test_datalog(db, name):
    text, want = CASES[name]
    assert datalog(db, text) == want


def test_rounds_halve_for_closures(spark):
    db = Database(spark).add_rows("edge", [(k, k + 1) for k in range(32)])
    engine = Engine(db)
    out = engine.run(parse_datalog("p(x,y) :- edge(x,y). p(x,z) :- p(x,y), edge(y,z)."), ["p"])["p"]
    assert out.count() == 32 * 33 // 2 and engine.rounds["p"] <= 7


def closure_of(edges):
    out = set(edges)
    while more := {(x, z) for x, y in out for v, z in edges if y == v and y is not None} - out:
        out |= more
    return out


CLOSURE = "p(x,y) :- edge(x,y). p(x,z) :- p(x,y), edge(y,z)."
TREE = [(k // 2, k) for k in range(2, 128)]


@pytest.mark.parametrize("edges", [TREE, [(b, a) for a, b in TREE], [(k, k + 1) for k in range(20)]], ids=["down", "up", "chain"])
def test_closures_derive_each_row_once(spark, monkeypatch, edges):
    """Where paths are single, rows that are derived before they are made distinct are no more than the closure has."""
    engine, derived = Engine(Database(spark).add_rows("edge", edges)), []
    rule = engine.compiler.rule
    monkeypatch.setattr(engine.compiler, "rule", lambda r: derived.append(rule(r)) or derived[-1])
    out = {tuple(r) for r in engine.run(parse_datalog(CLOSURE), ["p"])["p"].collect()}
    assert out == closure_of(edges) and sum(df.count() for df in derived) == len(out)


def test_closures_of_members_derive_each_row_once(spark, monkeypatch):
    derived, rule = [], Compiler.rule

    def kept(self, r):
        df = rule(self, r)
        if any(a.pred.startswith(engine_module.DELTA) for a, _ in atoms(r.body)):
            derived.append(df)
        return df

    monkeypatch.setattr(Compiler, "rule", kept)
    db = Database(spark).add_rows("node", [(k,) for k in range(1, 128)])
    text = "class Node extends int { Node() { node(this) } Node getParent() { result = this / 2 } } from Node n where n.getParent+() = 7 select n as k"
    assert rows(query_ql(db, text)) == [(k,) for k in range(14, 128) if (k >> k.bit_length() - 3) == 7]
    assert sum(df.count() for df in derived) == len(closure_of(TREE)) - len(TREE)


def test_rounds_have_tasks_by_their_rows(spark, monkeypatch):
    """Many rows make more partitions, while the round runs only."""
    monkeypatch.setattr(engine_module, "TASK_ROWS", 50)
    engine, seen = Engine(Database(spark).add_rows("edge", TREE)), []
    written = engine._written
    monkeypatch.setattr(engine, "_written", lambda *a: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or written(*a))
    own = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    out = engine.run(parse_datalog(CLOSURE), ["p"])["p"].collect()
    assert len(out) == len(closure_of(TREE)) and max(seen) >= len(out) // 50 > int(own[0])
    assert own == (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"))


def test_what_is_made_of_many_rows_is_dealt_too(spark, monkeypatch):
    """A join with many rows of a recursion is written in partitions by their number; few rows and mere filters stay lazy."""
    db, text = Database(spark).add_rows("edge", TREE), f"{CLOSURE} q(x,y) :- p(x,y), not edge(_,x). r(x,y) :- p(x,y), y > 9."
    for rows_, read in ((50, {"q"}), (engine_module.TASK_ROWS, set())):
        monkeypatch.setattr(engine_module, "TASK_ROWS", rows_)
        engine = Engine(db)
        out = engine.run(parse_datalog(text), ["q", "r"])
        assert {p for p in out if "AntiJoin" not in (plan := out[p]._jdf.queryExecution().toString()) and "LeftAnti" not in plan} - {"r"} == read
        assert rows(out["q"]) == sorted((x, y) for x, y in closure_of(TREE) if x == 1) and out["r"].count() == sum(y > 9 for _, y in closure_of(TREE))


@pytest.mark.parametrize("few", [0, 100_000])
def test_other_recursions_have_tasks_by_their_rows(spark, monkeypatch, few):
    monkeypatch.setattr(engine_module, "TASK_ROWS", 10)
    monkeypatch.setattr(engine_module, "FEW", few)
    engine, seen = Engine(Database(spark).add_rows("edge", TREE)), []
    written = engine._written
    monkeypatch.setattr(engine, "_written", lambda *a: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or written(*a))
    assert rows(engine.run(parse_datalog("q(1). q(y) :- q(x), edge(x, y)."), ["q"])["q"]) == [(k,) for k in range(1, 128)]
    assert engine.sizes["q"] == 127 and (few or max(seen) > int(spark.conf.get("spark.sql.shuffle.partitions")))


@pytest.mark.parametrize("step", ["p(x,y), edge(y,z)", "edge(x,y), p(y,z)", "p(x,y), p(y,z)"])
def test_closures_of_graphs(spark, step):
    """Loops, several paths of equal and of unequal length, and ends that are null."""
    edges = [(1, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 5), (5, 6), (6, 4), (7, 8), (1, None), (None, 3), (9, 9)]
    db = Database(spark).add("edge", spark.createDataFrame(edges, "a long, b long"))
    out = query_datalog(db, f"p(x,y) :- edge(x,y). p(x,z) :- {step}.", "p").collect()
    assert len(out) == len(set(out)) and {tuple(r) for r in out} == closure_of(edges)


def test_closures_that_begin_with_facts_too(spark):
    """Facts of p are beginnings only: p(5,0) does not lengthen another path."""
    db = Database(spark).add_rows("edge", [(1, 2), (2, 3)]).add_rows("p", [(0, 1), (5, 0)])
    assert datalog(db, CLOSURE, "p") == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (5, 0)]


def test_errors(db):
    with pytest.raises(StratificationError):
        datalog(db, "q(x) :- val(x), not p(x). p(x) :- val(x), not q(x).")
    with pytest.raises(StratificationError):
        datalog(db, "q(x, n) :- val(x), n = count { y : q(y, _) }.")
    with pytest.raises(UnboundVariable):
        datalog(db, "q(x, y) :- val(x), y > 3.")
    with pytest.raises(UnboundVariable):
        datalog(db, "q(x, y) :- val(x).")
    with pytest.raises(SyntaxProblem, match=r"2:9"):
        datalog(db, "p(1).\nq(x) :- , .")


LIB = """
class Routine extends int {
  string label;
  Routine() { functions(this, label, _) }
  string title() { result = label }
  int arity() { result = count(int k | params(this, k, _, _)) }
  string accepts() { exists(int k | params(this, k, result, _)) }
  predicate takesAny() { this.arity() > 0 }
  string text() { result = label + "/" + this.arity().toString() }
}
class Start extends Routine { Start() { functions(this, "main", _) } override string text() { result = "start " + super.text() } }
class Slot extends int { Slot() { localvariables(this, _, _) } string title() { localvariables(this, result, _) } }
class Item = Routine or Slot;
"""
QL = {
    "implies": ("from int x where val(x) and (x = 10 implies val(x)) select x", [(1,), (5,), (10,), (20,)]),
    "if": ("from int x, int l where val(x) and if x > 9 then l = 100 else l = 0 select x, l", [(1, 0), (5, 0), (10, 100), (20, 100)]),
    "negated comparison": ("from int x where val(x) and not x > 9 select x", [(1,), (5,)]),
    "set": ('import lib from Routine r where r.title() in ["main", "helper"] select r.title()', [("helper",), ("main",)]),
    "union class": ("import lib from Item e select e", [(1,), (2,), (3,), (10,), (11,), (12,)]),
    "members of a union": ("import lib from Item e where e > 9 select e.title()", [("a",), ("b",), ("c",)]),
    "overriding": ("import lib from Routine r select r.text()", [("helper/2",), ("start main/0",), ("unused/0",)]),
    "inherited": ("import lib from Start m select m.title(), m.arity()", [("main", 0)]),
    "without": ("import lib from Routine r where not r.takesAny() select r.title()", [("main",), ("unused",)]),
    "grouped by this": ("import lib from Routine r select r.title(), r.arity()", [("helper", 2), ("main", 0), ("unused", 0)]),
    "closure": ("from int a, int b where edge+(a, b) select a, b", [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]),
    "both closures": ("from int a where edge*(a, a) and not edge+(a, a) select a", [(1,), (2,), (3,)]),
    "vacuous forall": ("from int x where val(x) and forall(int y | edge(x, y) | y > 99) select x", [(5,), (10,), (20,)]),
    "forex": ("from int x where val(x) and forex(int y | edge(x, y) | y > 1) select x", [(1,)]),
    "range": ("from int x where x = [3 .. 5] select x", [(3,), (4,), (5,)]),
    "empty range": ("from int x where x = [5 .. 3] select x", []),
    "offsets": ('from int i where i = "banana".indexOf("an") select i', [(1,), (3,)]),
    "split": ('from string s where s = "a.b.c".splitAt(".") select s', [("a",), ("b",), ("c",)]),
    "split at": ('select "a.b.c".splitAt(".", 2) as s', [("c",)]),
    "matches with places": ('from string s, int i, int o where s = "a1b22".regexpFind("[0-9]+", i, o) select s, i, o', [("1", 0, 1), ("22", 1, 3)]),
    "one match": ('select "a1b22".regexpFind("[0-9]+", 1, _) as s', [("22",)]),
    "constants of columns": ("predicate p(int x, int k) { val(x) and k = 3 } from int x, int k where p(x, k) and x = 10 and k = 3 select x, k", [(10, 3)]),
    "equal variables": ("from int a, int b, int c where edge(a, b) and b = c and edge(c, _) select a, c", [(1, 2), (2, 3)]),
    "null is not true under negation": ("from int x where val(x) and not 10 / (x - 10) > 0 select x", [(1,), (5,), (10,)]),
    "capture": ('select "key=val".regexpCapture("(.*)=(.*)", 2) as s', [("val",)]),
    "no match": ('select "key".regexpCapture("(.*)=(.*)", 2) as s', []),
    "prefix beyond": ('select "ab".prefix(3) as s', []),
    "numbers": ('from int x where x = "42".toInt() or x = "no".toInt() select x', [(42,)]),
    "recursion with a function": ("int fact(int n) { n = 1 and result = 1 or result = fact(n - 1) * n and n in [2 .. 5] } from int n select n, fact(n)", [(1, 1), (2, 2), (3, 6), (4, 24), (5, 120)]),
    "aggregates": ("select count(int x | val(x)) as c, sum(int x | val(x) | x) as s, max(int x | val(x)) as m, avg(int x | val(x) | x) as a", [(4, 36, 20, 9.0)]),
    "any": ("from int x where x = any(int y | val(y) and y > 5 | y) select x", [(10,), (20,)]),
    "fields": ("class V extends int { int twice; V() { val(this) and twice = this * 2 } int get() { result = twice } } from V v where v.get() > 15 select v.get()", [(20,), (40,)]),
    "newtype": ("newtype T = A(int x) { val(x) and x > 5 } or B() predicate isB(T t) { t = B() } from int n where n = count(T t | not isB(t)) select n", [(2,)]),
    "module": ("module M { int twice(int x) { val(x) and result = 2 * x } } from int x where x = M::twice(10) select x", [(20,)]),
    "bindingset": ("bindingset[x] predicate even(int x) { x % 2 = 0 } from int x where val(x) and even(x) select x", [(10,), (20,)]),
    "cast": ("import lib from Routine r select r.(Start).title()", [("main",)]),
    "instanceof": ("import lib from Routine r where not r instanceof Start select r", [(2,), (3,)]),
    "module of a class and a predicate": ("signature class S; signature predicate link(int a, int b); module Walk<S T, link/2 step> { class Stop extends T { Stop() { step(_, this) } } predicate next(T a, T b) { step(a, b) } } predicate up(int a, int b) { edge(a, b) and a > 1 } from int a, int b where Walk<int, up/2>::next(a, b) or a = 0 and b instanceof Walk<int, edge/2>::Stop select a, b", [(0, 2), (0, 3), (0, 4), (2, 3), (3, 4)]),
    "module of a module": ("signature module G { class N; predicate to(N a, N b); default int weight(N a) { exists(a) and result = 1 } } module Small implements G { class N extends int { N() { val(this) } } predicate to(N a, N b) { a < b and b < 11 } } module Big implements G { class N = Small::N; predicate to(N a, N b) { Small::to(b, a) } int weight(N a) { result = a } } module Reach<G X> { predicate far(X::N a, X::N b) { X::to+(a, b) } int cost(X::N a, X::N b) { far(a, b) and result = X::weight(a) } } module R = Reach<Big>; from int a, int b, int c where c = Reach<Small>::cost(a, b) or c = R::cost(a, b) select a, b, c", [(1, 5, 1), (1, 10, 1), (5, 1, 5), (5, 10, 1), (10, 1, 10), (10, 5, 10)]),
    "modules in modules": ("signature class S; module A<S T> { module B<S U> { predicate both(T t, U u) { t = u } } } class Odd extends int { Odd() { val(this) and this % 2 = 1 } } class V extends int { V() { val(this) } } from int x where A<Odd>::B<V>::both(x, _) select x", [(1,), (5,)]),
    "an import of a module with arguments": ("signature predicate p(int x); module Twice<p/1 q> { int twice(int x) { q(x) and result = 2 * x } } import Twice<val/1> from int x where x = twice(_) select x", [(2,), (10,), (20,), (40,)]),
    "a comparison is no module": ("from int a, int b where edge(a, b) and a < b and b > 3 select a", [(3,)]),
    "URL as an argument": ('from string u, string v where toUrl("a.c", 1, 2, 3, 4, u) and v = toUrl("a.c", 1, 2, 3, 4) select u, v', [("file://a.c:1:2:3:4", "file://a.c:1:2:3:4")]),
    "alias": ("predicate e = edge2/2; predicate edge2(int a, int b) { edge(a, b) and a > 1 } from int a where e(a, _) select a", [(2,), (3,)]),
}


@pytest.mark.parametrize("name", QL)
def test_ql(db, name):
    text, want = QL[name]
    assert rows(query_ql(db, text, {"lib": LIB})) == want


@pytest.mark.parametrize(("text", "why"), [
    ("signature class S; module M<S T> { predicate p(T t) { t = 1 } } select count(int x | M<int, int>::p(x)) as n", "takes 1 arguments"),
    ("signature predicate s(int x); module M<s/1 p> { predicate q(int x) { p(x) } } select count(int x | M<edge/2>::q(x)) as n", "does not fit"),
    ("signature module G { predicate to(int a, int b); } module Bad implements G { } select 1 as n", "asks for"),
    ("signature class S; module M<S T> { predicate p(T t) { M<M<T>::C>::p(t) } class C extends T { C() { this > 0 } } } select count(int x | M<int>::p(x)) as n", "without an end"),
])
def test_modules_that_do_not_fit(db, text, why):
    with pytest.raises(QLError, match=why):
        query_ql(db, text)


def test_a_wrong_key_is_told(spark):
    rows_ = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, s string")
    assert Database(spark).add("r", rows_, key=["k", "s"]).checked().names() == ["r"]
    with pytest.raises(ValueError, match="columns k are no key"):
        Database(spark).add("r", rows_, key=["k"]).checked()


@pytest.mark.parametrize("few", [0, 100_000])
def test_steps_in_one_job_give_the_same_rows(spark, monkeypatch, few):
    """A chain longer than the steps, a cycle, and two predicates that need each other."""
    monkeypatch.setattr(engine_module, "FEW", few)
    db = Database(spark).add_rows("edge", [(k, k + 1) for k in range(1, 20)] + [(20, 15), (30, 31)])
    assert datalog(db, "q(1). q(y) :- q(x), edge(x, y).") == [(k,) for k in range(1, 21)]
    both = "even(1). odd(y) :- even(x), edge(x, y). even(y) :- odd(x), edge(x, y). "
    assert datalog(db, both + "q(x) :- even(x).") == [(k,) for k in range(1, 21, 2)]
    engine = Engine(db)
    engine.run(parse_datalog("q(1). q(y) :- q(x), edge(x, y)."), ["q"])
    assert engine.rounds["q"] == (4 if few else 20)


def test_select_order_and_labels(db):
    df = query_ql(db, 'from int x where val(x) select x as "n", -x as m order by m')
    assert df.columns == ["n", "m"] and [r.n for r in df.collect()] == [20, 10, 5, 1]


def test_every_select_and_query_predicate(db):
    found = query_all_ql(db, "query predicate big(int x) { val(x) and x > 9 } from int x where val(x) select x")
    assert sorted(d.count() for d in found.values()) == [2, 4]


def test_ql_errors(db):
    for text, what in (("from int x where vall(x) select x", "1:18: no predicate vall"), ("from Foo x select x", "no type Foo"), ("from int x where val(x) select y", "no variable y"), ("from int x where val(x) and x.foo() = 1 select x", "no built-in foo"), ("from int x where val(x, 1) select x", "1 columns"), ("select", "unexpected end|expected")):
        with pytest.raises(Exception, match=what):
            query_ql(db, text)


SCHEME = """
/* tables /* nested */ */
files(unique int id: @file, string name: string ref);
stmts(unique int id: @stmt, int kind: int ref);   // keyed
#keyset[a, b]
calls(int a: @stmt ref, int b: @file ref);
@element = @file | @stmt;
case @stmt.kind of 1 = @if | 2 = @loop;
"""


def test_schema(spark):
    s = parse_dbscheme(SCHEME)
    assert list(s.tables) == ["files", "stmts", "calls"] and s.tables["calls"].keysets == [["a", "b"]] and s.members("@element") == {"@element", "@file", "@stmt"}
    assert s.tables["files"].struct()["id"].metadata == {"entity": "@file", "unique": True}
    db = Database(spark, SCHEME).add_rows("files", [(1, "a.c")]).add_rows("stmts", [(10, 1), (11, 2)]).add_rows("calls", [(10, 1)])
    assert rows(query_ql(db, "from @element e select e")) == [(1,), (10,), (11,)]
    assert rows(query_ql(db, "class Loop extends @loop { } from Loop l select l")) == [(11,)]
    with pytest.raises(SchemeError, match="line 2"):
        parse_dbscheme("files(int id);\n files(")


def test_save_and_load(spark, tmp_path):
    db = Database(spark, SCHEME).add_rows("files", [(1, "a.c")]).add_rows("stmts", [(10, 1)])
    db.save(str(tmp_path / "db"))
    back = Database.load(spark, str(tmp_path / "db"))
    assert back.names() == ["files", "stmts"] and back.columns("files") == ["id", "name"] and rows(query_ql(back, "from @element e select e")) == [(1,), (10,)]


def test_keys_spare_the_distinct(spark):
    db = Database(spark).add("t", spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "k long, g long, s string"), key=["k"]).add("u", spark.createDataFrame([(7, "x"), (7, "x")], "g long, n string"))
    plan = lambda text: query_datalog(db, text, "q")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan("q(k) :- t(k, _, _), k > 0.") and "Aggregate" not in plan("q(k, s) :- t(k, g, _), t(k, _, s).")
    assert "Aggregate" not in plan("q(k, j) :- t(k, g, _), t(j, g, _), not u(k, _).")
    for text in ("q(g) :- t(_, g, _).", "q(k) :- t(k, g, _), u(g, _).", "q(g, n) :- u(g, n).", "q(k) :- t(k, g, _), t(_, g, _)."):
        assert "Aggregate" in plan(text)
        assert len(rows(query_datalog(db, text, "q"))) == len(set(rows(query_datalog(db, text, "q"))))


def test_plans(spark, db, tmp_path):
    """Filters and columns reach the scan; a negated atom is an anti join; nothing runs in Python."""
    spark.range(100).selectExpr("id", "id % 7 AS k", "'x' AS s").write.parquet(str(tmp_path / "t"))
    big = Database(spark).add("t", spark.read.parquet(str(tmp_path / "t"))).add_rows("u", [(1,)])
    df = query_datalog(big, "q(a) :- t(a, k, _), k = 3, not u(a).", "q")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,3)]" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan and "LeftAnti" in plan and "Python" not in plan
