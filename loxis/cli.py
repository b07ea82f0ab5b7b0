"""Command line: create databases, run Datalog and QL, analyse, show plans.

    python -m loxis.cli create --source src --into db
    python -m loxis.cli query  --database db --file q.ql --output table|csv|json|sarif
    python -m loxis.cli datalog --database db --file p.dl --show path,unreachable
    python -m loxis.cli tables --parquet folder
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .lang.datalog import parse_datalog
from .plans.engine import Engine
from .plans.ir import LogicError
from .session import query_all_ql
from .sinks import results
from .sources import extract_c, extract_java, extract_js, extract_python  # noqa: F401  register their languages
from .sources.database import Database
from .sources.extract import extract


def _database(spark: SparkSession, args: argparse.Namespace) -> Database:
    if args.database:
        return Database.load(spark, args.database)
    db = Database(spark)
    for folder in args.parquet or []:
        db.add_folder(folder, [p.name.removesuffix(".parquet") for p in sorted(Path(folder).glob("*.parquet"))])
    return db


def _shown(df, output: str, metadata: results.Metadata) -> str:
    return {"table": lambda: results.to_table(df), "csv": lambda: results.to_csv(df), "json": lambda: results.to_json(df, metadata), "sarif": lambda: results.to_sarif(df, metadata)}[output]()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="loxis", description="Logic queries over relations, on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    create = commands.add_parser("create", help="extract source files into a database")
    create.add_argument("--source", required=True)
    create.add_argument("--into", required=True)
    create.add_argument("--language", action="append")
    for name in ("query", "datalog", "tables"):
        c = commands.add_parser(name)
        c.add_argument("--database")
        c.add_argument("--parquet", action="append")
        if name != "tables":
            c.add_argument("--file", required=True)
            c.add_argument("--output", choices=["table", "csv", "json", "sarif"], default="table")
            c.add_argument("--explain", action="store_true")
            c.add_argument("--library" if name == "query" else "--show")
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("loxis").getOrCreate()
    try:
        if args.command == "create":
            db = extract(spark, args.source, args.into, root=str(Path(args.source).resolve()), languages=args.language or ("python",))
            db.save(args.into)
            print(f"{len(db.names())} relations in {args.into}")
            return 0
        db = _database(spark, args)
        if args.command == "tables":
            for name in db.names():
                print(f"{name}({', '.join(db.columns(name))})")
            return 0
        text = Path(args.file).read_text()
        if args.command == "query":
            found = query_all_ql(db, text, args.library)
        else:
            program = parse_datalog(text)
            wanted = args.show.split(",") if args.show else None
            found = Engine(db).run(program, wanted)
        metadata = results.parse_metadata(text)
        for name, df in sorted(found.items()):
            if args.explain:
                df.explain("formatted")
                continue
            if len(found) > 1:
                print(f"{name}:")
            print(_shown(df, args.output, metadata))
        return 0
    except (LogicError, FileNotFoundError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
