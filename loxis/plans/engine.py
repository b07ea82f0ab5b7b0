"""Evaluation: one lazy DataFrame for each predicate without recursion, a fixpoint loop for each with."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.database import Database
from .compile import Compiler, col, unioned
from .ir import And, Atom, Compare, Const, Not, Program, Rule, Var, alternatives, atoms, expr_vars, rewrite
from .stratify import Stratum, stratify

DELTA = "Δ"
#: Steps of a linear recursion in one job, while no more rows than FEW are new.
STEPS, FEW = 6, 100_000
#: Rows that a task of a round is dealt: with more rows a round has more tasks, not larger ones.
TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one if that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loxis-")
    return found.rstrip("/")


class Engine:
    """Evaluates programs over a database.

    Rounds of a fixpoint are written to the folder in spark.checkpoint.dir, so that plans stay small and a lost
    executor costs no more than its tasks. Closures of a relation double their paths each round. Of a linear
    recursion with few new rows a round takes STEPS steps in one job. Shuffles of a round have a partition for
    each TASK_ROWS of its rows; so have those of a predicate that joins or unites so many, which is written then.
    """

    def __init__(self, db: Database):
        self.db, self.spark = db, db.spark
        self.derived: dict[str, DataFrame] = {}
        self.compiler = Compiler(db, self.lookup)
        self.rounds: dict[str, int] = {}
        #: Rows of recursive predicates, and of what is made of them alone the sum of theirs.
        self.sizes: dict[str, int] = {}
        self._folder: str | None = None

    def lookup(self, pred: str) -> DataFrame | None:
        return self.derived[pred] if pred in self.derived else self.db.relation(pred)

    def run(self, program: Program, outputs: list[str] | None = None) -> dict[str, DataFrame]:
        """Evaluate what the outputs need (all heads if none are named) and return them."""
        heads = {r.pred for r in program.rules}
        base = {h: df for h in heads if (df := self.db.relation(h)) is not None}  # facts may be added to a base relation
        for stratum in stratify(program, outputs):
            if stratum.recursive:
                self._fixpoint(stratum, base)
            else:
                name = stratum.preds[0]
                parts = [self.compiler.rule(r) for r in stratum.rules] + ([base[name]] if name in base else [])
                df = unioned(parts)
                self.sizes[name] = size = sum(self.sizes.get(a.pred, 0) for r in stratum.rules for a, _ in atoms(r.body))
                unique = len(parts) == 1 and self._is_unique(stratum.rules[0])
                self.derived[name] = df if unique else df.distinct()
                shuffled = not unique or sum(1 for _ in atoms(stratum.rules[0].body)) > 1
                if name in program.cached or shuffled and self._partitions(size):  # written once: nothing stays in executors' memory, nor is lost with them
                    with self._dealt(size):
                        _, self.derived[name], n = self._written(self.derived[name])
                    self.sizes[name] = n if size else 0
        return {p: self.derived[p] for p in (outputs if outputs is not None else heads) if p in self.derived}

    def _is_unique(self, r: Rule) -> bool:
        """Whether the head of a rule determines which row of each relation it came from, so no row comes twice."""
        items, waiting = [], [r.body]
        while waiting:
            f = waiting.pop()
            if isinstance(f, And):
                waiting += f.items
            else:
                items.append(f)
        if not all(isinstance(f, (Atom, Compare, Not)) for f in items):
            return False
        fixed = {a.name for a in r.args if isinstance(a, Var)}
        left = [f for f in items if isinstance(f, Atom)]
        if not left:
            return False
        while True:
            done = len(left), len(fixed)
            for f in list(left):
                known = [isinstance(a, Const) or isinstance(a, Var) and a.name in fixed for a in f.args]
                keys = self.db.keys(f.pred) if f.pred not in self.derived else [tuple(range(len(f.args)))]
                if any(all(k < len(known) and known[k] for k in key) for key in keys):
                    fixed |= {a.name for a in f.args if isinstance(a, Var)} - {"_"}
                    left.remove(f)
            for f in items:
                if isinstance(f, Compare) and f.op == "=":
                    for v, e in ((f.left, f.right), (f.right, f.left)):
                        if isinstance(v, Var) and expr_vars(e) <= fixed:
                            fixed.add(v.name)
            if not left or (len(left), len(fixed)) == done:
                return not left

    # Recursion

    def _path(self) -> str:
        if self._folder is None:
            self._folder = shared_folder(self.spark)
        return f"{self._folder}/round-{uuid.uuid4().hex}"

    def _written(self, df: DataFrame, *counted: Column) -> tuple:
        """A round is one job: its rows, and those that are to be counted, are counted as they are written."""
        path, seen = self._path(), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n0"), *(F.count_if(c).alias(f"n{k}") for k, c in enumerate(counted, 1))).write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path), *(seen.get[f"n{k}"] for k in range(len(counted) + 1))

    def _partitions(self, rows: float) -> int:
        """Partitions of a shuffle of so many rows; 0 for what few tasks do, which is left to the session."""
        n, own = math.ceil(rows / TASK_ROWS), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(n, own) if n > min(own, self.spark.sparkContext.defaultParallelism) else 0

    @contextmanager
    def _dealt(self, rows: float) -> Iterator[None]:
        """For jobs on so many rows: no more than TASK_ROWS of them a task, however few partitions the session has."""
        conf, n = self.spark.conf, self._partitions(rows)
        if not n:
            yield
            return
        own = {k: conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        try:
            for k, v in zip(own, (str(n), "false")):  # gathered by bytes, which are few a row, they would be large again
                conf.set(k, v)
            yield
        finally:
            for k, v in own.items():
                conf.set(k, v)

    def _fixpoint(self, stratum: Stratum, base: dict[str, DataFrame]) -> None:
        inside = set(stratum.preds)
        stratum = Stratum(stratum.preds, [w for r in stratum.rules for w in alternatives(r)], True)
        recursive = {p: [r for r in stratum.rules if r.pred == p and any(a.pred in inside for a, _ in atoms(r.body))] for p in stratum.preds}
        start = {p: [r for r in stratum.rules if r.pred == p and r not in recursive[p]] for p in stratum.preds}
        first = {p: [self.compiler.rule(r) for r in start[p]] + ([base[p]] if p in base else []) for p in stratum.preds}
        waiting = [p for p in stratum.preds if not first[p]]
        schemas = {p: unioned(first[p]).schema for p in stratum.preds if first[p]}
        while waiting:  # predicates without a rule of their own to start with take their types from the others
            for p in waiting:
                for r in recursive[p]:
                    if all(a.pred not in inside or a.pred in schemas for a, _ in atoms(r.body)):
                        for q, schema in schemas.items():
                            self.derived[q] = self.spark.createDataFrame([], schema)
                        schemas[p] = self.compiler.rule(r).schema
                        break
                if p in schemas:
                    waiting.remove(p)
                    break
            else:
                for p in waiting:  # nothing to start from: empty
                    self.derived[p] = self.spark.createDataFrame([], ", ".join(f"c{i} void" for i in range(len(recursive[p][0].args))))
                    schemas[p] = self.derived[p].schema
                waiting = []
        closure = not any(p in base for p in stratum.preds) and self._is_closure(stratum, recursive, start)
        files: dict[str, list[str]] = {p: [] for p in stratum.preds}
        delta: dict[str, DataFrame] = {}
        new = 0
        for p in stratum.preds:
            df = unioned(first[p]) if first[p] else self.spark.createDataFrame([], schemas[p])
            if len(first[p]) > 1 or not (start[p] and self._is_unique(start[p][0])):
                df = df.distinct()
            path, back, n = self._written(df)
            files[p].append(path)
            schemas[p] = back.schema
            new += n
            if n:
                delta[p] = back
        if closure:
            self._closure(stratum.preds[0], files[stratum.preds[0]], schemas[stratum.preds[0]], new)
            return
        # What the rounds read and do not change is written once, not derived again in each.
        for p in {a.pred for p in stratum.preds for r in recursive[p] for a, _ in atoms(r.body)} - inside:
            if p in self.derived:
                self.derived[p] = self._written(self.derived[p])[1]
        linear = len(stratum.preds) <= 2 and all(sum(a.pred in inside for a, _ in atoms(r.body)) == 1 for p in stratum.preds for r in recursive[p])
        rounds, total = 0, new
        while delta:
            rounds += 1
            for p in stratum.preds:
                self.derived[p] = self.spark.read.schema(schemas[p]).parquet(*files[p])
                self.derived[DELTA + p] = delta.get(p)
            found: dict[str, tuple[str, DataFrame]] = {}
            if linear and new <= FEW:
                with self._dealt(total):
                    delta, new, more = self._leap(stratum, recursive, schemas, delta, files)
                total += more
                continue
            before, new = new, 0
            for p in stratum.preds:
                parts = [self.compiler.rule(v) for r in recursive[p] for v in self._variants(r, inside, delta)]
                if not parts:
                    continue
                names = [f"c{i}" for i in range(len(schemas[p]))]
                rows = unioned(parts).select(*(F.col(n).cast(schemas[p][n].dataType) for n in names)).distinct()
                with self._dealt(total + before):
                    path, back, n = self._written(rows.join(self.derived[p], names, "left_anti"))
                new += n
                if n:
                    found[p] = (path, back)
            for p, (path, _) in found.items():
                files[p].append(path)
            total += new
            delta = {p: back for p, (_, back) in found.items()}
        for p in stratum.preds:
            self.derived[p] = self.spark.read.schema(schemas[p]).parquet(*files[p])
            self.derived.pop(DELTA + p, None)
            self.rounds[p], self.sizes[p] = rounds, total

    def _closure(self, t: str, files: list[str], schema: StructType, size: int) -> None:
        """The closure of the relation in files, of so many rows; what is found is added to files.

        Before a round, files hold the pairs whose shortest path has less than 2^k steps, and far those of exactly
        2^(k-1). Two of far make a pair of 2^k; such a pair and a shorter one, in the right order, any longer one. So
        a row is derived once for each such middle of its shortest paths, in a tree once, and not for every middle.
        """
        names, near, exact = schema.names, "\u2203" + t, DELTA + t
        x, y, z = Var("x"), Var("y"), Var("z")
        far = self.spark.read.schema(schema).parquet(*files)
        begins, ends, nulls = far.agg(*(F.approx_count_distinct(n) for n in names), F.count_if(F.col(names[0]).isNull() | F.col(names[1]).isNull())).first()

        def found(a: str, b: str, *known: DataFrame) -> DataFrame:
            rows = self.compiler.rule(Rule(t, (x, z), And((Atom(a, (x, y)), Atom(b, (y, z))))))
            rows = rows.select(*(F.col(n).cast(schema[n].dataType).alias(n) for n in names)).distinct()
            for old in known:
                rows = rows.join(old, reduce(Column.__and__, (rows[n].eqNullSafe(old[n]) for n in names)) if nulls else names, "left_anti")
            return rows

        total, edges, rounds = size, max(begins, ends), 0
        while size:
            rounds += 1
            self.derived[exact], self.derived[near] = far, self.spark.read.schema(schema).parquet(*files)
            with self._dealt(total + 2 * size):
                path, far, size = self._written(found(exact, exact, self.derived[near]))
            if size:
                self.derived[exact] = far
                # The side that is joined on its ends has the smaller groups where more rows share a beginning than an end.
                order = (near, exact) if begins < ends else (exact, near)
                with self._dealt(total + size + size * total / edges):
                    longer, _, n = self._written(found(*order, self.derived[near], far))
                files += [path, longer]
                total += size + n
        self.derived.pop(exact, None), self.derived.pop(near, None)
        self.derived[t] = self.spark.read.schema(schema).parquet(*files)
        self.rounds[t], self.sizes[t] = rounds, total

    def _leap(self, stratum: Stratum, rules: dict[str, list[Rule]], schemas: dict, delta: dict[str, DataFrame], files: dict[str, list[str]]) -> tuple[dict[str, DataFrame], int, int]:
        """STEPS steps from the new rows of the last round; what is new at the last step, its number, and that of all new rows.

        What a step derives is followed by the next one whether it was known or not, and stored with the first
        step that derived it, unless it was known before: so only rows of the last step are still to be followed.
        """
        inside, made = set(stratum.preds), {p: [] for p in stratum.preds}
        for step in range(1, STEPS + 1):
            for p in stratum.preds:
                self.derived[DELTA + p] = delta.get(p)
            found = {}
            for p in stratum.preds:
                parts = [self.compiler.rule(v) for r in rules[p] for v in self._variants(r, inside, delta)]
                if parts:
                    names = [f"c{i}" for i in range(len(schemas[p]))]
                    found[p] = unioned(parts).select(*(F.col(n).cast(schemas[p][n].dataType) for n in names)).distinct()
                    made[p].append(found[p].withColumn("step", F.lit(step)))
            delta = found
        out, last, total = {}, 0, 0
        for p, parts in made.items():
            if not parts:
                continue
            names = [f"c{i}" for i in range(len(schemas[p]))]
            first = unioned(parts).groupBy(*names).agg(F.min("step").alias("step"))
            path, back, rows, n = self._written(first.join(self.derived[p], names, "left_anti"), F.col("step") == STEPS)
            files[p].append(path)
            last += n
            total += rows
            if n:
                out[p] = back.where(F.col("step") == STEPS).select(*names)
        return out, last, total

    @staticmethod
    def _variants(r: Rule, inside: set[str], delta: dict[str, DataFrame]) -> list[Rule]:
        """Semi-naive: one copy of the rule for each recursive atom, which reads the last round's new rows."""
        places = [a.pred for a, _ in atoms(r.body) if a.pred in inside]
        out = []
        for k, pred in enumerate(places):
            if pred not in delta:
                continue
            seen = -1

            def change(a: Atom, k: int = k) -> Atom:
                nonlocal seen
                if a.pred in inside:
                    seen += 1
                    if seen == k:
                        return Atom(DELTA + a.pred, a.args)
                return a

            out.append(Rule(r.pred, r.args, rewrite(r.body, change)))
        return out

    @staticmethod
    def _is_closure(stratum: Stratum, recursive: dict[str, list[Rule]], start: dict[str, list[Rule]]) -> bool:
        """Whether it is t(x,z) :- t(x,y), e(y,z), with t begun by e alone; also the other way round, or with t twice."""
        if len(stratum.preds) != 1:
            return False
        t = stratum.preds[0]
        if len(recursive[t]) != 1 or len(start[t]) != 1:
            return False
        r, s = recursive[t][0], start[t][0]
        body = r.body.items if isinstance(r.body, And) else (r.body,)
        one = s.body.items[0] if isinstance(s.body, And) and len(s.body.items) == 1 else s.body
        if len(body) != 2 or not all(isinstance(f, Atom) and len(f.args) == 2 for f in body) or not isinstance(one, Atom) or one.args != s.args or len(r.args) != 2:
            return False
        if {f.pred for f in body} - {t, one.pred}:
            return False
        x, z = r.args
        for a, b in (body, body[::-1]):
            if a.args[0] == x and b.args[1] == z and a.args[1] == b.args[0] and len({x, z, a.args[1]}) == 3 and all(isinstance(v, Var) and v.name != "_" for v in (x, z, a.args[1])):
                return True
        return False


def column_order(df: DataFrame, order: list[tuple[int, bool]]) -> DataFrame:
    return df.orderBy(*(col(df.columns[i]).asc() if up else col(df.columns[i]).desc() for i, up in order)) if order else df
