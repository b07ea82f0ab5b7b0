"""Incremental maintenance of a monotone program over a stream of new facts.

Each micro-batch is the first delta of a semi-naive fixpoint: only rules that read a relation with new rows
run, over the new rows and what is stored. A program with negation or aggregates is refused, as new facts could
take rows back.

What a batch adds, base facts and all that follows, counts from one commit on: a small file in the folder that lists
the files of each relation and the last batch of each stream. A batch that fails leaves only files that no commit
names; when it comes again, it is worked on as a whole. A new session goes on from the last commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.compile import Compiler, unioned
from ..plans.ir import Atom, LogicError, Program, Rule, alternatives, atoms, rewrite
from ..sources.database import Database

DELTA = "Δ"
#: A relation of more files than this is written anew as one, so that reading it stays cheap.
MERGED_FROM = 16


def _monotone(program: Program) -> None:
    for r in program.rules:
        if any(not positive for _, positive in atoms(r.body)) or "Aggregate(" in repr(r.body) or "Not(" in repr(r.body):
            raise LogicError(f"{r.pred} is not monotone: it has a negation or an aggregate")


class Maintained:
    """The rows of a program's predicates, kept in a folder as facts arrive. One writer at a time."""

    def __init__(self, spark: SparkSession, program: Program, folder: str, schemas: dict[str, str]):
        """schemas: of every predicate, base and derived, as DDL with columns c0, c1, ..."""
        _monotone(program)
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self.rules = [w for r in program.rules for w in alternatives(r)]
        self.deltas: dict[str, DataFrame] = {}
        self.compiler = Compiler(Database(spark), self._lookup)
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._place = lambda name: hadoop.Path(f"{self.folder}/_commits/{name}")
        self._store_at = self._place("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.number, self.files, self.batches = self._last()

    # Commits

    def _last(self) -> tuple[int, dict[str, list[str]], dict[str, int]]:
        names = [f.getPath().getName() for f in self._store_at.listStatus(self._place(""))] if self._store_at.exists(self._place("")) else []
        done = sorted(n for n in names if n.isdigit())
        if not done:
            return 0, {p: [] for p in self.schemas}, {}
        told = json.loads(self.spark.read.text(f"{self.folder}/_commits/{done[-1]}", wholetext=True).first().value)
        return int(done[-1]), {p: told["files"].get(p, []) for p in self.schemas}, told["batches"]

    def _commit(self, batches: dict[str, int]) -> None:
        """Written aside and renamed, so that a commit is there as a whole or not at all."""
        aside, place = self._place(f".{uuid.uuid4().hex}"), self._place(f"{self.number + 1:012d}")
        out = self._store_at.create(aside)
        out.write(bytearray(json.dumps({"files": self.files, "batches": batches}).encode()))
        out.close()
        if self._store_at.exists(place) or not self._store_at.rename(aside, place):
            raise RuntimeError(f"{self.folder}: another writer made commit {self.number + 1}")
        self.number, self.batches = self.number + 1, batches

    # Relations

    def relation(self, pred: str) -> DataFrame:
        files = self.files[pred]
        return self.spark.read.schema(self.schemas[pred]).parquet(*(f"{self.folder}/{f}" for f in files)) if files else self.spark.createDataFrame([], self.schemas[pred])

    def _lookup(self, pred: str) -> DataFrame | None:
        if pred.startswith(DELTA):
            return self.deltas.get(pred[len(DELTA) :])
        return self.relation(pred) if pred in self.schemas else None

    def _write(self, pred: str, rows: DataFrame) -> str:
        name = f"{pred}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def _store(self, pred: str, rows: DataFrame) -> DataFrame | None:
        """Store rows that are new; None if none is."""
        name = self._write(pred, rows.distinct().join(self.relation(pred), rows.columns, "left_anti"))
        back = self.spark.read.schema(self.schemas[pred]).parquet(f"{self.folder}/{name}")
        if back.isEmpty():
            return None
        self.files[pred].append(name)
        return back

    def add(self, pred: str, facts: DataFrame, stream: str | None = None, batch: int = 0) -> int:
        """Add facts of a base relation and all that follows; returns the number of rounds.

        Of a stream, a batch whose number is not above that of the last one committed is passed over.
        """
        if stream is not None and batch <= self.batches.get(stream, -1):
            return 0
        before = {p: list(x) for p, x in self.files.items()}
        try:
            rounds = self._derive(pred, facts)
            for p, names in self.files.items():
                if len(names) > MERGED_FROM:
                    self.files[p] = [self._write(p, self.relation(p))]
            if self.files != before or stream is not None:
                self._commit(self.batches | ({} if stream is None else {stream: batch}))
            return rounds
        except BaseException:
            self.files = before
            raise
        finally:
            self.deltas = {}

    def _derive(self, pred: str, facts: DataFrame) -> int:
        names = [x.split()[0] for x in self.schemas[pred].split(", ")]
        new = self._store(pred, facts.toDF(*names))
        deltas, rounds = ({pred: new} if new is not None else {}), 0
        while deltas:
            rounds += 1
            self.deltas, found = deltas, {}
            for head in dict.fromkeys(r.pred for r in self.rules):
                parts = [self.compiler.rule(v) for r in self.rules if r.pred == head for v in self._variants(r, deltas)]
                if parts and (rows := self._store(head, unioned(parts))) is not None:
                    found[head] = rows
            deltas = found
        return rounds

    @staticmethod
    def _variants(r: Rule, deltas: dict[str, DataFrame]) -> list[Rule]:
        places = [a.pred for a, _ in atoms(r.body)]
        out = []
        for k, pred in enumerate(places):
            if pred in deltas:
                seen = iter(range(len(places)))
                out.append(Rule(r.pred, r.args, rewrite(r.body, lambda a: Atom(DELTA + a.pred, a.args) if next(seen) == k else a)))
        return out

    def follow(self, pred: str, stream: DataFrame, checkpoint: str, name: str | None = None):
        """Start a streaming query that adds each micro-batch, under the name of the relation unless another is given.

        A batch that comes again after its commit is passed over; one that failed before is added as a whole.
        """
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: self.add(pred, batch, name or pred, number) and None).start()
