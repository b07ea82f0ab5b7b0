"""The front door: run Datalog or QL text against a database and get DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .lang.datalog import parse_datalog
from .lang.ql import compile_ql
from .plans.engine import Engine, column_order
from .plans.ir import LogicError, Program
from .sources.database import Database


def relation_arity(db: Database):
    def arity(name: str) -> int | None:
        df = db.relation(name)
        if df is not None:
            return len(df.columns)
        table = db.schema.tables.get(name) if db.schema else None
        return len(table.columns) if table else None

    return arity


def query_datalog(db: Database, text: str | Program, output: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of one predicate of a Datalog program."""
    program = parse_datalog(text) if isinstance(text, str) else text
    heads = {r.pred: r for r in program.rules}
    if output not in heads:
        raise LogicError(f"no rule for {output}")
    df = Engine(db).run(program, [output])[output]
    names = columns or [getattr(a, "name", f"c{i}") for i, a in enumerate(heads[output].args)]
    return df.toDF(*names) if len(names) == len(df.columns) else df


def query_ql(db: Database, text: str, library: dict[str, str] | str | None = None) -> DataFrame:
    """The rows of the first select clause, with its labels and in its order."""
    return next(iter(query_all_ql(db, text, library).values()))


def query_all_ql(db: Database, text: str, library: dict[str, str] | str | None = None) -> dict[str, DataFrame]:
    """Every select clause and query predicate."""
    program = compile_ql(text, relation_arity(db), library)
    if not program.selects:
        raise LogicError("no select clause")
    found = Engine(db).run(program, [s.pred for s in program.selects])
    out = {}
    for s in program.selects:
        df = found[s.pred]
        out[s.pred] = column_order(df.toDF(*s.labels) if len(set(s.labels)) == len(df.columns) else df, s.order)
    return out
