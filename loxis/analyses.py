"""Analyses of program facts, as Datalog: call graph, data flow, points-to, unused parameters, metrics, bindings.

The relations are those of the C and Java fact schemas: expressions with their kinds and parents, names,
functions, parameters and local variables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .plans.engine import Engine
from .lang.datalog import parse_datalog
from .session import query_datalog
from .sources.database import Database

#: Kinds of C expressions.
ADDRESS_OF, ASSIGN, CALL, ACCESS = 2, 52, 74, 84

# Functions are known by their ids, variables by the id of their function and their name, as names may be those of
# functions of several files. means(f, t, g): in function f the name t stands for function g, one of the same file
# if there is one, and any of that name otherwise.
_USES = f"""
arm(p, k, e) :- exprparents(e, k, p).
use(e, f, t) :- enclosingfunction(e, f), exprs(e, {ACCESS}, _), valuetext(e, t).
home(x, u) :- element_location(x, l), locations_default(l, u, _, _, _, _).
beside(f, t, g) :- use(_, f, t), functions(g, t, _), home(f, u), home(g, u).
means(f, t, g) :- beside(f, t, g).
means(f, t, g) :- use(_, f, t), functions(g, t, _), not beside(f, t, _).
"""
_SITES = f"""
site(c, f, e) :- exprs(c, {CALL}, _), arm(c, 0, e), enclosingfunction(c, f).
"""
#: What is written to a variable: by its initialiser or an assignment.
_WRITES = f"""
write(f, t, e) :- localvariables(v, t, _), arm(v, 0, e), enclosingfunction(v, f).
write(f, t, e) :- use(l, f, t), arm(a, 0, l), exprs(a, {ASSIGN}, _), arm(a, 1, e).
"""

#: Over ids: which function invokes which, which names of no known function it calls, and what it depends on in the end.
CALL_GRAPH = f"""{_USES}{_SITES}
invokes(f, g) :- site(_, f, e), use(e, f, t), means(f, t, g).
outside(f, t) :- site(_, f, e), use(e, f, t), not means(f, t, _).
depends(f, g) :- invokes(f, g).
depends(f, h) :- invokes(f, g), depends(g, h).
leaf(f) :- functions(f, _, _), not invokes(f, _), not outside(f, _).
entry(f) :- invokes(f, _), not invokes(_, f).
"""

#: A variable flows to one when it is used anywhere in what is written to that, but as the function of a call.
DATA_FLOW = f"""{_USES}{_SITES}{_WRITES}
inside(e, e) :- write(_, _, e).
inside(e, y) :- inside(e, x), arm(x, _, y).
moves(f, s, t) :- write(f, t, e), inside(e, x), use(x, f, s), not site(_, f, x).
flow(f, s, t) :- moves(f, s, t).
flow(f, s, u) :- moves(f, s, t), flow(f, t, u).
"""

#: Inclusion-based: the functions that a variable may point to, by copies, arguments and calls through pointers.
POINTS_TO = f"""{_USES}{_SITES}{_WRITES}
denotes(e, f, g) :- use(e, f, t), means(f, t, g).
denotes(e, f, g) :- exprs(e, {ADDRESS_OF}, _), arm(e, 0, o), use(o, f, t), means(f, t, g).
points(f, v, g) :- write(f, v, e), denotes(e, f, g).
points(f, v, g) :- write(f, v, e), use(e, f, w), points(f, w, g).
target(c, f, g) :- site(c, f, e), denotes(e, f, g).
target(c, f, g) :- site(c, f, e), use(e, f, w), points(f, w, g).
given(g, p, f, a) :- target(c, f, g), params(g, i, p, _), k = i + 1, arm(c, k, a).
points(g, p, h) :- given(g, p, f, a), denotes(a, f, h).
points(g, p, h) :- given(g, p, f, a), use(a, f, w), points(f, w, h).
"""

UNUSED_PARAMETERS = f"""{_USES}
unused(f, p) :- params(f, _, p, _), not use(_, f, p).
"""

#: By function: the numbers of its parameters, statements and expressions, of the functions it invokes, and of those that invoke it.
METRICS = f"""{CALL_GRAPH}
own(x, f) :- enclosingfunction(x, f).
parameters(f, n) :- functions(f, _, _), n = count {{ i : params(f, i, _, _) }}.
statements(f, n) :- functions(f, _, _), n = count {{ x : own(x, f), stmts(x, _, _) }}.
expressions(f, n) :- functions(f, _, _), n = count {{ x : own(x, f), exprs(x, _, _) }}.
fan_out(f, n) :- functions(f, _, _), n = count {{ g : invokes(f, g) }}.
fan_in(f, n) :- functions(f, _, _), n = count {{ g : invokes(g, f) }}.
"""

#: A call is bound to the function that its name means, the one of least id where there are several.
CALL_BINDING = f"""{_USES}{_SITES}
bound(c, g) :- site(c, f, e), use(e, f, t), g = min {{ x : means(f, t, x) }}.
"""

#: Java calls by method name or constructed type, and variables by the innermost kind of declaration of the name.
JAVA_CALL_BINDING = """
method(n, m) :- methods(_, n, _, _, _, _), m = min { x : methods(x, n, _, _, _, _) }.
constructor(n, m) :- constrs(_, n, _, _, _, _), m = min { x : constrs(x, n, _, _, _, _) }.
bound(c, m) :- exprs(c, 61, _, _, _), namestrings(n, _, c), method(n, m).
bound(c, m) :- exprs(c, 52, n, _, _), constructor(n, m).
"""
JAVA_VARIABLE_BINDING = """
inside(e, c) :- callableEnclosingExpr(e, c).
use(e, n, c) :- exprs(e, 60, _, _, _), namestrings(n, _, e), inside(e, c).
local(n, c, v) :- localvars(_, n, _, c), v = max { x : localvars(x, n, _, c) }.
parameter(n, c, v) :- params(p, _, _, c, _), paramName(p, n), v = max { x : params(x, _, _, c, _), paramName(x, n) }.
owner(c, t) :- methods(c, _, _, _, t, _).
owner(c, t) :- constrs(c, _, _, _, t, _).
field(n, c, v) :- owner(c, t), fields(_, n, _, t), v = max { x : fields(x, n, _, t) }.
bound(e, v) :- use(e, n, c), local(n, c, v).
bound(e, v) :- use(e, n, c), parameter(n, c, v), not local(n, c, _).
bound(e, v) :- use(e, n, c), field(n, c, v), not local(n, c, _), not parameter(n, c, _).
"""

DANGEROUS = """
class Function extends int {
  Function() { functions(this, _, _) }
  string getName() { functions(this, result, _) }
}
class Call extends int {
  Call() { exprs(this, 74, _) }
  string getTarget() { exists(int v | exprparents(v, 0, this) and exprs(v, 84, _) and valuetext(v, result)) }
  Function getCaller() { enclosingfunction(this, result) }
}
from Call c
where c.getTarget() in ["gets", "strcpy", "strcat", "sprintf", "vsprintf", "scanf"]
select c.getTarget() as target, c.getCaller().getName() as caller
"""


def analyse(db: Database, program: str, output: str) -> DataFrame:
    """The rows of one predicate of an analysis."""
    return query_datalog(db, program, output)


def bind_calls(db: Database) -> Database:
    """Add funbind: calls of a name to the function of the name."""
    return db.add("funbind", Engine(db).run(parse_datalog(CALL_BINDING), ["bound"])["bound"].toDF("expr", "fun"), unique=True)


def bind_java(db: Database) -> Database:
    """Add callableBinding and variableBinding."""
    db.add("callableBinding", Engine(db).run(parse_datalog(JAVA_CALL_BINDING), ["bound"])["bound"].toDF("callerid", "callee"), unique=True)
    return db.add("variableBinding", Engine(db).run(parse_datalog(JAVA_VARIABLE_BINDING), ["bound"])["bound"].toDF("expr", "variable"), unique=True)
