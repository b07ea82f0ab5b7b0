"""Binding-passing compiler: a formula turns a DataFrame of bindings into one with more of them.

Columns are named for variables. Conjuncts run in an order found here, in which each has its variables bound;
everything else, the order and kind of joins above all, is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.builtins import MULTI, SCALAR, TESTS, found_at, int_div
from ..sources.database import Database
from .ir import (
    Aggregate,
    And,
    Atom,
    BinOp,
    Call,
    Compare,
    Const,
    Exists,
    Formula,
    If,
    LogicError,
    Multi,
    Not,
    OneOf,
    Or,
    Range,
    Rule,
    UnboundVariable,
    Var,
    expr_vars,
    free_vars,
)

NAMES = {"bigint": "long", "double": "double", "string": "string", "boolean": "boolean", "void": "void"}
#: Aggregates that have a value where there is nothing to aggregate.
TOTAL = {"count": 0, "sum": 0, "concat": ""}


class Bindings:
    """Rows of bound variables; no DataFrame stands for the one row without variables."""

    def __init__(self, df: DataFrame | None, names: frozenset[str] = frozenset()):
        self.df, self.names = df, names

    def types(self) -> dict[str, str]:
        return {n: NAMES.get(t, t) for n, t in self.df.dtypes} if self.df is not None else {}


def col(name: str) -> Column:
    return F.col(f"`{name}`")


class Compiler:
    def __init__(self, db: Database, lookup: Callable[[str], DataFrame | None]):
        self.db, self.spark, self.lookup = db, db.spark, lookup

    # Scalars

    def scalar(self, e, types: dict[str, str]) -> tuple[Column, str]:
        match e:
            case Var(name):
                if name not in types:
                    raise UnboundVariable(f"{name} is not bound")
                return col(name), types[name]
            case Const(bool() as v):
                return F.lit(v), "boolean"
            case Const(int() as v):
                return F.lit(v).cast("bigint"), "long"
            case Const(float() as v):
                return F.lit(v), "double"
            case Const(v):
                return F.lit(v), "string"
            case BinOp(op, left, right):
                return self.arithmetic(op, self.scalar(left, types), self.scalar(right, types))
            case Call(name, args):
                return self.call(name, [self.scalar(a, types) for a in args])
        raise LogicError(f"not an expression: {e!r}")

    @staticmethod
    def arithmetic(op: str, left: tuple[Column, str], right: tuple[Column, str]) -> tuple[Column, str]:
        (a, s), (b, t) = left, right
        if op == "+" and "string" in (s, t):
            return F.concat(a.cast("string"), b.cast("string")), "string"
        if not {s, t} <= {"long", "double", "void"}:
            raise LogicError(f"no {op} of {s} and {t}")
        if "double" in (s, t):
            a, b = a.cast("double"), b.cast("double")
            if op == "%":
                return F.when(b != 0, F.try_mod(a, b)), "double"
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, a / b)}[op](), "double"
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": int_div, "%": lambda x, y: F.when(y != 0, F.try_mod(x, y))}[op](a, b), "long"

    @staticmethod
    def _named(name: str, kinds: list[str], table: dict) -> str | None:
        for kind in ([kinds[0]] if kinds else []) + (["double"] if kinds and kinds[0] == "long" else []):
            if f"{kind}.{name}" in table:
                return f"{kind}.{name}"
        return name if name in table else None

    def call(self, name: str, args: list[tuple[Column, str]]) -> tuple[Column, str]:
        kinds = [t for _, t in args]
        found = self._named(name, kinds, SCALAR)
        if found is None:
            raise LogicError(f"no built-in {name} of {', '.join(kinds)}")
        kind, make = SCALAR[found]
        columns = [c.cast("double") if found.startswith("double.") and t == "long" else c for c, t in args]
        return make(*columns), kinds[0] if kind == "same" else kind

    @staticmethod
    def comparison(op: str, left: tuple[Column, str], right: tuple[Column, str]) -> Column:
        (a, s), (b, t) = left, right
        if s != t and {s, t} != {"long", "double"} and "void" not in (s, t):
            if op in ("=", "!="):
                return F.lit(op == "!=")
            raise LogicError(f"no comparison of {s} and {t}")
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    # Which variables a formula needs and binds

    def can_run(self, f: Formula, bound: frozenset[str]) -> frozenset[str] | None:
        """What is bound after f, or None if f must wait."""
        match f:
            case Atom(_, args):
                plain = {a.name for a in args if isinstance(a, Var) and a.name != "_"}
                inner = set().union(*(expr_vars(a) for a in args if not isinstance(a, Var))) if args else set()
                return bound | plain if inner <= bound | plain else None
            case Compare(op, a, b):
                need = expr_vars(a) | expr_vars(b)
                if need <= bound:
                    return bound
                if op == "=":
                    for x, y in ((a, b), (b, a)):
                        if isinstance(x, Var) and expr_vars(y) <= bound:
                            return bound | {x.name}
                return None
            case And(items):
                left = list(items)
                while left:
                    for x in left:
                        if (after := self.can_run(x, bound)) is not None:
                            bound = after
                            left.remove(x)
                            break
                    else:
                        return None
                return bound
            case Or(items):
                ends = [self.can_run(x, bound) for x in items]
                if any(e is None for e in ends):
                    return None
                return frozenset.intersection(*ends) if ends else bound
            case Exists(names, body):
                after = self.can_run(body, bound - set(names))
                return None if after is None else bound | (after - set(names))
            case Not(body):
                return bound if self.can_run(body, bound) is not None else None
            case If(c, t, e):
                return self.can_run(Or((And((c, t)), And((Not(c), e)))), bound)
            case Range(v, a, b):
                if not expr_vars(a) | expr_vars(b) <= bound:
                    return None
                return self._binds(v, bound)
            case OneOf(v, values):
                if not set().union(*map(expr_vars, values)) <= bound:
                    return None
                return self._binds(v, bound)
            case Multi("regexpFindAt", (s, p, *places), result):
                if not expr_vars(s) | expr_vars(p) <= bound:
                    return None
                for x in (*places, result):
                    bound = bound if bound is None else self._binds(x, bound)
                return bound
            case Multi(name, args, result):
                if not set().union(*map(expr_vars, args)) <= bound:
                    return None
                return bound if name in {t.split(".")[-1] for t in TESTS} and result is None else self._binds(result, bound)
            case Aggregate():
                if f.rank is not None and not isinstance(f.rank, Var) and not expr_vars(f.rank) <= bound:
                    return None
                after = self.can_run(f.body, bound - set(f.local))
                if after is None:
                    return None
                need = expr_vars(f.value) | expr_vars(f.separator)
                for e, _ in f.order:
                    need |= expr_vars(e)
                if not need <= after:
                    return None
                bound = bound | (free_vars(f.body) - set(f.local))
                if isinstance(f.rank, Var):
                    bound = bound | {f.rank.name}
                return self._binds(f.result, bound)
        raise LogicError(f"not a formula: {f!r}")

    @staticmethod
    def _binds(v, bound: frozenset[str]) -> frozenset[str] | None:
        if isinstance(v, Var):
            return bound | {v.name}
        return bound if expr_vars(v) <= bound else None

    def _closed(self, f: Formula, bound: frozenset[str], elsewhere: frozenset[str]) -> bool:
        """Whether f may run as a filter now: what it shares with the rest is bound."""
        return (free_vars(f) & elsewhere) <= bound

    def order(self, items: list[Formula], bound: frozenset[str], live: frozenset[str]) -> list[Formula]:
        """Filters as early as they can run, then joins on bound variables, then what generates."""
        out, left = [], list(items)
        while left:
            best, rank = None, (9, 0)
            for k, f in enumerate(left):
                elsewhere = live.union(*(free_vars(x) for x in left if x is not f))
                after = self.can_run(f, bound)
                if after is None:
                    continue
                if isinstance(f, (Not, Exists, If, Or, Aggregate)):
                    inner = [x for x in self._negations(f)]
                    if any(not self._closed(x, bound, elsewhere | bound) for x in inner):
                        continue
                new = after - bound
                shared = free_vars(f) & bound
                if not new:
                    r = 0 if isinstance(f, (Compare, Range, OneOf, Multi)) else 2
                elif isinstance(f, (Compare, OneOf, Multi, Range)):
                    r = 1 if shared else 7  # a constant joins nothing: better a filter on what binds the variable too
                elif isinstance(f, Aggregate):
                    r = 4 if free_vars(f.body) - set(f.local) <= bound else 6
                else:
                    r = 3 if shared or not bound else 5
                if (r, k) < rank:
                    best, rank = f, (r, k)
            if best is None:
                names = sorted(set().union(*map(free_vars, left)) - bound)
                raise UnboundVariable(f"no order binds {', '.join(names)}")
            out.append(best)
            left.remove(best)
            bound = self.can_run(best, bound)
        return out

    def _negations(self, f: Formula) -> list[Formula]:
        """The parts of f that only filter, whose outer variables must come from outside."""
        match f:
            case Not(body):
                return [body]
            case If(c, _, _):
                return [c]
            case And(items) | Or(items):
                return [y for x in items for y in self._negations(x)]
            case Exists(names, body):
                return [Exists(names, y) for y in self._negations(body)]
        return []

    # Formulas

    def condition(self, f: Formula, types: dict[str, str]) -> Column | None:
        """f as one Column, if it is made of comparisons of bound variables only."""
        match f:
            case Compare(op, a, b) if expr_vars(a) | expr_vars(b) <= types.keys():
                return self.comparison(op, self.scalar(a, types), self.scalar(b, types))
            case And(items) | Or(items):
                parts = [self.condition(x, types) for x in items]
                if any(p is None for p in parts):
                    return None
                both = isinstance(f, And)
                return reduce(lambda x, y: x & y if both else x | y, parts, F.lit(both))
            case Not(body):
                inner = self.condition(body, types)
                return None if inner is None else ~F.coalesce(inner, F.lit(False))
            case If(c, t, e):
                return self.condition(Or((And((c, t)), And((Not(c), e)))), types)
            case Range(v, a, b) if free_vars(f) <= types.keys():
                return self.condition(And((Compare(">=", v, a), Compare("<=", v, b))), types)
            case OneOf(v, values) if free_vars(f) <= types.keys():
                return self.condition(Or(tuple(Compare("=", v, x) for x in values)), types)
            case Multi(name, args, None) if free_vars(f) <= types.keys():
                return self._test(name, args, types)
        return None

    def _test(self, name: str, args: tuple, types: dict[str, str]) -> Column:
        own = [self.scalar(a, types) for a in args]
        found = self._named(name, [t for _, t in own], TESTS)
        if found is None:
            raise LogicError(f"no test {name}")
        return TESTS[found](*(c for c, _ in own))

    def run(self, f: Formula, b: Bindings, live: frozenset[str]) -> Bindings:
        """Bindings that satisfy f; live are the variables that are still needed."""
        if b.df is not None or not free_vars(f):
            if (cond := self.condition(f, b.types())) is not None:
                if isinstance(f, And) and not f.items:
                    return b
                return self._filtered(b, cond)
        match f:
            case Atom():
                return self._atom(f, b, live)
            case Compare():
                return self._compare(f, b)
            case And(items):
                return self._and(list(items), b, live)
            case Or(items):
                return self._or(items, b, live)
            case If(c, t, e):
                return self._or((And((c, t)), And((Not(c), e))), b, live)
            case Not(body):
                return self._anti(body, b)
            case Exists(names, body):
                return self._exists(names, body, b, live)
            case Range(v, low, high):
                return self._range(v, low, high, b)
            case OneOf(v, values):
                return self._spread(b, v, F.array(*(self.scalar(x, b.types())[0] for x in values)), self.scalar(values[0], b.types())[1])
            case Multi("regexpFindAt", (s, p, *places), result):
                types = b.types()
                out = Bindings(self._frame(b).select("*", F.explode(found_at(self.scalar(s, types)[0], self.scalar(p, types)[0])).alias("__found")), b.names)
                for x, part, kind in ((result, "v", "string"), (places[0], "n", "long"), (places[1], "at", "long")):
                    value = F.col("__found")[part]
                    if isinstance(x, Var) and x.name == "_":
                        continue
                    if isinstance(x, Var) and x.name not in out.names:
                        out = self._bind(out, x.name, value)
                    else:
                        out = self._filtered(out, self.comparison("=", (value, kind), self.scalar(x, out.types())))
                return Bindings(out.df.drop("__found"), out.names)
            case Multi(name, args, result):
                own = [self.scalar(a, b.types()) for a in args]
                found = self._named(name, [t for _, t in own], MULTI)
                if found is None:
                    raise LogicError(f"no built-in {name}")
                kind, make = MULTI[found]
                return self._spread(b, result, make(*(c for c, _ in own)), kind)
            case Aggregate():
                return self._aggregate(f, b)
        raise LogicError(f"not a formula: {f!r}")

    def _one_row(self) -> DataFrame:
        return self.spark.range(1).select()

    def _frame(self, b: Bindings) -> DataFrame:
        return self._one_row() if b.df is None else b.df

    def _filtered(self, b: Bindings, cond: Column) -> Bindings:
        return Bindings(self._frame(b).where(cond), b.names)

    def _bind(self, b: Bindings, name: str, value: Column) -> Bindings:
        df = self._frame(b)
        return Bindings(df.select("*", value.alias(name)).where(col(name).isNotNull()), b.names | {name})

    def _compare(self, f: Compare, b: Bindings) -> Bindings:
        for x, y in ((f.left, f.right), (f.right, f.left)):
            if isinstance(x, Var) and x.name not in b.names and expr_vars(y) <= b.names and f.op == "=":
                return self._bind(b, x.name, self.scalar(y, b.types())[0])
        raise UnboundVariable(f"{sorted(free_vars(f) - b.names)} in a comparison")

    def _range(self, v, low, high, b: Bindings) -> Bindings:
        x, y = (self.scalar(e, b.types())[0] for e in (low, high))
        return self._spread(b, v, F.when(x <= y, F.sequence(x, y)), "long")

    def _spread(self, b: Bindings, v, values: Column, kind: str) -> Bindings:
        """v takes each value of an array, or is compared with each."""
        if isinstance(v, Var) and v.name not in b.names:
            return Bindings(self._frame(b).select("*", F.explode(values).alias(v.name)).where(col(v.name).isNotNull()), b.names | {v.name})
        out = self._frame(b).select("*", F.explode(F.array_distinct(values)).alias("__each"))
        own, t = self.scalar(v, b.types())
        return Bindings(out.where(self.comparison("=", (own, t), (col("__each"), kind))).drop("__each"), b.names)

    def _atom_frame(self, f: Atom) -> tuple[DataFrame, list[tuple[str, object]]] | None:
        """The atom's relation with columns named for its variables; arguments that are compared later."""
        rel = self.lookup(f.pred)
        if rel is None or len(rel.columns) != len(f.args):
            return None
        first: dict[str, int] = {}
        later, where = [], []
        kinds = [NAMES.get(t, t) for _, t in rel.dtypes]
        for i, a in enumerate(f.args):
            c = F.col(f"c{i}")
            if isinstance(a, Var):
                if a.name == "_":
                    continue
                if a.name in first:
                    where.append(c.eqNullSafe(F.col(f"c{first[a.name]}")))
                else:
                    first[a.name] = i
            elif isinstance(a, Const):
                where.append(self.comparison("=", (c, kinds[i]), self.scalar(a, {})))
            else:
                first[f"__arg{i}"] = i
                later.append((f"__arg{i}", a))
        for w in where:
            rel = rel.where(w)
        return rel.select(*(F.col(f"c{i}").alias(n) for n, i in first.items())), later

    def _atom(self, f: Atom, b: Bindings, live: frozenset[str]) -> Bindings:
        found = self._atom_frame(f)
        names = [n for n in dict.fromkeys(a.name for a in f.args if isinstance(a, Var)) if n != "_"]
        if found is None:
            return Bindings(self._frame(b).where(F.lit(False)).select("*", *(F.lit(None).alias(n) for n in names if n not in b.names)), b.names | set(names))
        rel, later = found
        # An argument that is computed from bound variables is a column to join on.
        known = [(name, e) for name, e in later if b.df is not None and expr_vars(e) <= b.names]
        if known:
            types = b.types()
            b = Bindings(b.df.select("*", *(self.scalar(e, types)[0].alias(name) for name, e in known)), b.names | {name for name, _ in known})
            names += [name for name, _ in known]
            later = [x for x in later if x not in known]
            out = self._atom_joined(rel, later, names, b, live)
            return Bindings(out.df.drop(*(name for name, _ in known)), out.names - {name for name, _ in known})
        return self._atom_joined(rel, later, names, b, live)

    def _atom_joined(self, rel: DataFrame, later: list, names: list[str], b: Bindings, live: frozenset[str]) -> Bindings:
        shared = [n for n in names if n in b.names]
        new = [n for n in names if n not in b.names]
        own = set(new) & live
        if b.df is None:
            out = Bindings(rel if rel.columns else self._where_any(self._one_row(), rel), frozenset(names))
        elif not own and not later:
            if shared:
                left, right = self._aligned(b.df, rel.select(*shared), shared)
                out = Bindings(left.join(right, shared, "left_semi"), b.names)
            else:
                out = Bindings(self._where_any(b.df, rel), b.names)
            if new:
                return out
        elif shared:
            left, right = self._aligned(b.df, rel, shared)
            out = Bindings(left.join(right, shared), b.names | set(new))
        else:
            out = Bindings(b.df.crossJoin(rel), b.names | set(new))
        for name, e in later:
            value, kind = self.scalar(e, out.types())
            out = Bindings(out.df.where(self.comparison("=", (col(name), out.types()[name]), (value, kind))).drop(name), out.names)
        return out

    @staticmethod
    def _where_any(df: DataFrame, rel: DataFrame) -> DataFrame:
        return df.join(rel.select().limit(1), F.lit(True), "left_semi")

    @staticmethod
    def _aligned(a: DataFrame, b: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
        """Both sides with the same types of the names: whole numbers become floating where they meet them."""
        s, t = dict(a.dtypes), dict(b.dtypes)
        for n in names:
            if s[n] == t[n] or "void" in (s[n], t[n]):
                continue
            if {s[n], t[n]} == {"bigint", "double"}:
                a, b = (x.withColumn(n, col(n).cast("double")) for x in (a, b))
            else:
                raise LogicError(f"{n} is both {s[n]} and {t[n]}")
        return a, b

    def _and(self, items: list[Formula], b: Bindings, live: frozenset[str]) -> Bindings:
        flat: list[Formula] = []
        for x in items:
            flat += x.items if isinstance(x, And) else [x]
        flat = self._substituted(flat, b, live)
        todo = self.order(flat, b.names, live | b.names)
        for k, f in enumerate(todo):
            later = live.union(*map(free_vars, todo[k + 1 :])) if todo[k + 1 :] else live
            b = self.run(f, b, later)
            if b.df is not None and (gone := [n for n in b.names if n not in later]):
                b = Bindings(b.df.drop(*gone), b.names - set(gone)) if len(gone) < len(b.names) or later else b
        return b

    @staticmethod
    def _substituted(items: list[Formula], b: Bindings, live: frozenset[str]) -> list[Formula]:
        """`v = c` and `v = w` put into the other parts, so that they are filters and join keys there."""
        done: list[Formula] = []
        todo = [x for f in items for x in (f.items if isinstance(f, And) else [f])]
        while todo:
            f = todo.pop(0)
            if isinstance(f, Compare) and f.op == "=":
                for v, e in ((f.left, f.right), (f.right, f.left)):
                    if isinstance(v, Var) and v.name not in b.names and isinstance(e, (Var, Const)) and v != e and "_" not in (v.name, getattr(e, "name", "")):
                        done, todo = ([renamed(x, {v.name: e}) for x in part] for part in (done, todo))
                        if v.name in live:
                            done.append(f)
                        break
                else:
                    done.append(f)
                continue
            done.append(f)
        return done

    def _or(self, items: tuple, b: Bindings, live: frozenset[str]) -> Bindings:
        if not items:
            return Bindings(self._frame(b).where(F.lit(False)), b.names)
        ends = [self.run(x, b, live | b.names) for x in items]
        names = [n for n in sorted(frozenset.intersection(*(e.names for e in ends))) if n in live or n in b.names]
        for e in ends:
            if missing := (live & e.names) - set(names) - b.names:
                raise UnboundVariable(f"{', '.join(sorted(missing))} is bound in one branch only")
        if not names:
            held = reduce(DataFrame.union, [self._frame(e).select(F.lit(1).alias("__t")) for e in ends])
            return Bindings(self._where_any(self._one_row(), held))
        return Bindings(unioned([e.df.select(*map(col, names)) for e in ends]), frozenset(names))

    def _keys(self, b: Bindings, f: Formula) -> tuple[list[str], Bindings]:
        shared = sorted(free_vars(f) & b.names)
        return shared, Bindings(b.df.select(*map(col, shared)).distinct(), frozenset(shared)) if shared else Bindings(None)

    def _matching(self, f: Formula, b: Bindings) -> tuple[list[str], DataFrame]:
        """The values of the variables that f shares with b for which f holds."""
        shared = sorted(free_vars(f) & b.names)
        if isinstance(f, Atom) and shared and not any(isinstance(a, (BinOp, Call)) for a in f.args):
            found = self._atom_frame(f)  # the relation itself answers, without passing bindings
            if found is not None:
                return shared, found[0].select(*map(col, shared))
        shared, keys = self._keys(b, f)
        out = self.run(f, keys, frozenset(shared))
        return shared, self._frame(out).select(*map(col, shared)) if shared else self._frame(out)

    def _filtering_join(self, f: Formula, b: Bindings, how: str) -> Bindings:
        shared, held = self._matching(f, b)
        df = self._frame(b)
        if not shared:
            return Bindings(df.join(held.select().limit(1), F.lit(True), how), b.names)
        left, right = self._aligned(df, held, shared)
        return Bindings(left.join(right, shared, how), b.names)

    def _anti(self, f: Formula, b: Bindings) -> Bindings:
        if isinstance(f, Not):
            return self._exists((), f.body, b, b.names)
        if isinstance(f, Exists):
            f = f.body if not set(f.vars) & b.names else f
        return self._filtering_join(f, b, "left_anti")

    def _exists(self, names: tuple, body: Formula, b: Bindings, live: frozenset[str]) -> Bindings:
        hidden = set(names) & b.names
        if hidden:  # a quantified variable hides an outer one of the same name
            body = renamed(body, {n: f"{n}'" for n in hidden})
            names = tuple(f"{n}'" if n in hidden else n for n in names)
        new = ((free_vars(body) - set(names)) - b.names) & live
        if not new and b.df is not None:
            return self._filtering_join(body, b, "left_semi")
        out = self.run(body, b, live | b.names | new)
        keep = [n for n in sorted(out.names) if n not in names]
        return Bindings(out.df.select(*map(col, keep)).distinct(), frozenset(keep)) if keep else self._exists_closed(out)

    def _exists_closed(self, out: Bindings) -> Bindings:
        return Bindings(self._where_any(self._one_row(), self._frame(out)))

    def _aggregate(self, f: Aggregate, b: Bindings) -> Bindings:
        hidden = set(f.local) & b.names
        if hidden:
            raise LogicError(f"{', '.join(sorted(hidden))} is both local to an aggregate and bound outside it")
        parts = expr_vars(f.value).union(expr_vars(f.separator), *(expr_vars(e) for e, _ in f.order))
        inner = free_vars(f.body) | parts
        group = sorted(inner - set(f.local))
        shared = [n for n in group if n in b.names]
        keys = Bindings(b.df.select(*map(col, shared)).distinct(), frozenset(shared)) if shared else Bindings(None)
        body = f.body
        s = self.run(body, keys, frozenset(inner))
        types = s.types()
        df = self._frame(s)
        local = sorted(n for n in f.local if n in s.names)
        value = self.scalar(f.value, types)[0] if f.value is not None else (F.struct(*map(col, local)) if local else F.lit(1))
        kind = self.scalar(f.value, types)[1] if f.value is not None else "long"
        df = df.select(*map(col, group), value.alias("__v"), *(self.scalar(e, types)[0].alias(f"__o{i}") for i, (e, _) in enumerate(f.order)), *([self.scalar(f.separator, types)[0].alias("__s")] if f.kind.endswith("concat") else []))
        name = f.kind.removeprefix("strict")
        by = [col(g) for g in group]
        v = col("__v")
        if name == "rank":
            order = [col(f"__o{i}").asc() if up else col(f"__o{i}").desc() for i, (_, up) in enumerate(f.order)] or [v.asc()]
            out = df.distinct().withColumn("__r", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
            out = out.select(*by, v.alias("__a"), "__r")
        elif name == "any":
            out = df.select(*by, v.alias("__a")).distinct()
        elif name == "concat":
            order = [f"__o{i}" for i in range(len(f.order))]
            if order and not all(up for _, up in f.order):
                ranked = df.distinct().withColumn("__r", F.dense_rank().over(Window.partitionBy(*by).orderBy(*(col(o).asc() if up else col(o).desc() for o, (_, up) in zip(order, f.order)))))
                items = F.transform(F.array_sort(F.collect_set(F.struct("__r", v))), lambda x: x["__v"])
                out = ranked.groupBy(*by).agg(items.alias("__i"), F.min("__s").alias("__p"))
            else:
                items = F.transform(F.array_sort(F.collect_set(F.struct(*map(col, order), v))), lambda x: x["__v"])
                out = df.groupBy(*by).agg(items.alias("__i"), F.min("__s").alias("__p"))
            out = out.select(*by, F.call_function("array_join", F.transform("__i", lambda x: x.cast("string")), F.col("__p")).alias("__a"))
        else:
            one = {
                "count": lambda: F.count_distinct(v), "sum": lambda: F.sum_distinct(v), "min": lambda: F.min(v), "max": lambda: F.max(v), "avg": lambda: F.avg(v),
                "unique": lambda: F.when(F.count_distinct(v) == 1, F.min(v)),
            }[name]
            if name == "avg":
                df = df.select(*by, v).distinct()
            elif name == "sum" and kind == "long":
                df = df.select(*by, v).distinct()
                one = lambda: F.try_sum(v)
            out = df.groupBy(*by).agg(one().alias("__a"))
            if not group and name not in ("count", "sum"):
                out = out.where(col("__a").isNotNull())
            if not group and f.kind.startswith("strict"):
                out = df.select(F.lit(1).alias("__one")).limit(1).crossJoin(out).drop("__one")
        total = f.kind in TOTAL
        fill = F.lit(TOTAL[f.kind]).cast(out.schema["__a"].dataType) if total else None
        if not group and total:
            out = out.select(F.coalesce("__a", fill).alias("__a")) if name != "concat" else out
        extra = ["__r"] if name == "rank" else []
        if b.df is None:
            joined, names = out, frozenset(group)
        elif shared:
            left, right = self._aligned(b.df, out, shared)
            joined, names = left.join(right, shared, "left" if total and len(shared) == len(group) else "inner"), b.names | set(group)
            if total and len(shared) == len(group):
                joined = joined.withColumn("__a", F.coalesce("__a", fill))
        else:
            joined, names = b.df.crossJoin(out), b.names | set(group)
        joined = joined.where(col("__a").isNotNull())
        done = Bindings(joined, names)
        types = done.types()
        for source, target in (("__a", f.result), *((x, f.rank) for x in extra)):
            if isinstance(target, Var) and target.name not in done.names:
                done = Bindings(done.df.withColumnRenamed(source, target.name), done.names | {target.name})
            else:
                held = self.comparison("=", (col(source), types[source]), self.scalar(target, done.types()))
                done = Bindings(done.df.where(held).drop(source), done.names)
        return done

    # Rules

    def rule(self, r: Rule) -> DataFrame:
        """Rows of the head, c0, c1, ...; not yet distinct."""
        need = frozenset().union(*map(expr_vars, r.args)) if r.args else frozenset()
        b = self.run(r.body, Bindings(None), need)
        if missing := need - b.names:
            raise UnboundVariable(f"{', '.join(sorted(missing))} in the head of {r.pred}")
        types = b.types()
        columns = [self.scalar(a, types)[0].alias(f"c{i}") for i, a in enumerate(r.args)]
        df = self._frame(b).select(*columns) if columns else self._frame(b).select(F.lit(True).alias("c0")).limit(1)
        nullable = [f"c{i}" for i, a in enumerate(r.args) if not isinstance(a, (Var, Const))]
        return df.dropna(subset=nullable) if nullable else df


def unioned(parts: list[DataFrame]) -> DataFrame:
    """Union by place, with whole numbers next to floating ones made floating."""
    if len(parts) == 1:
        return parts[0]
    for i, name in enumerate(parts[0].columns):
        kinds = {p.dtypes[i][1] for p in parts} - {"void"}
        if kinds == {"bigint", "double"}:
            parts = [p.withColumn(p.columns[i], col(p.columns[i]).cast("double")) for p in parts]
        elif len(kinds) > 1:
            raise LogicError(f"column {name} is {' and '.join(sorted(kinds))} in different rules")
    return reduce(DataFrame.union, parts)


def renamed(f: Formula, names: dict) -> Formula:
    """f with free variables renamed, or replaced by what is equal to them."""

    def e(x):
        match x:
            case Var(n):
                to = names.get(n, n)
                return Var(to) if isinstance(to, str) else to
            case BinOp(op, a, b):
                return BinOp(op, e(a), e(b))
            case Call(n, args):
                return Call(n, tuple(map(e, args)))
        return x

    match f:
        case Atom(p, args):
            return Atom(p, tuple(map(e, args)))
        case Not(body):
            return Not(renamed(body, names))
        case And(items):
            return And(tuple(renamed(x, names) for x in items))
        case Or(items):
            return Or(tuple(renamed(x, names) for x in items))
        case Compare(op, a, b):
            return Compare(op, e(a), e(b))
        case Exists(own, body):
            return Exists(own, renamed(body, {k: v for k, v in names.items() if k not in own}))
        case If(c, t, o):
            return If(renamed(c, names), renamed(t, names), renamed(o, names))
        case Range(v, a, b):
            return Range(e(v), e(a), e(b))
        case OneOf(v, values):
            return OneOf(e(v), tuple(map(e, values)))
        case Multi(n, args, r):
            return Multi(n, tuple(map(e, args)), e(r))
        case Aggregate():
            inner = {k: v for k, v in names.items() if k not in f.local}

            def deep(x):
                nonlocal names
                old, names = names, inner
                out = e(x) if x is not None else None
                names = old
                return out

            return Aggregate(f.kind, e(f.result), f.local, renamed(f.body, inner), deep(f.value), tuple((deep(x), up) for x, up in f.order), deep(f.separator), e(f.rank) if f.rank is not None else None)
    raise LogicError(f"not a formula: {f!r}")
