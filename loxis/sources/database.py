"""A database: named relations, each a DataFrame with columns by position, and an optional schema."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dbscheme import DbScheme, parse_dbscheme

#: The types of values: whole numbers, floating numbers, strings and booleans.
_WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


class Database:
    def __init__(self, spark: SparkSession, schema: DbScheme | str | None = None):
        self.spark = spark
        self.schema = parse_dbscheme(schema) if isinstance(schema, str) else schema
        self._relations: dict[str, DataFrame] = {}
        self._columns: dict[str, list[str]] = {}
        self._unique: set[str] = set()
        self._keys: dict[str, list[tuple[int, ...]]] = {}

    def add(self, name: str, df: DataFrame, unique: bool = False, key: Iterable[str] | None = None) -> Database:
        """Register a relation; columns keep their order. unique: it has no equal rows; key: columns that no two rows share."""
        if key:
            unique = True
            self._keys[name] = [tuple(df.columns.index(c) for c in key)]
        kinds = dict(df.dtypes)
        self._columns[name] = df.columns
        self._relations[name] = df.select(*(F.col(f"`{c}`").cast(_WIDER.get(kinds[c], kinds[c])).alias(f"c{i}") for i, c in enumerate(df.columns)))
        if unique or (self.schema and self.schema.has_key(name)):
            self._unique.add(name)
        return self

    def add_rows(self, name: str, rows: Iterable[tuple], schema: str | None = None) -> Database:
        """Register rows; a row given twice counts once."""
        rows = list(dict.fromkeys(map(tuple, rows)))
        if schema is None and self.schema and name in self.schema.tables:
            schema = self.schema.tables[name].ddl()
        return self.add(name, self.spark.createDataFrame(rows, schema or [f"c{i}" for i in range(len(rows[0]))]), unique=True)

    def add_folder(self, folder: str, names: Iterable[str]) -> Database:
        """Register Parquet tables by name; only what a query reads of them is scanned."""
        for name in names:
            self.add(name, self.spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))
        return self

    def names(self) -> list[str]:
        return sorted(self._relations)

    def columns(self, name: str) -> list[str]:
        return self._columns[name]

    def keys(self, name: str) -> list[tuple[int, ...]]:
        """Places of columns that tell the rows of a relation apart; none if it may have equal rows."""
        if name not in self._unique:
            return []
        out = list(self._keys.get(name, []))
        if self.schema and name in self.schema.tables:
            t = self.schema.tables[name]
            names = [c.name for c in t.columns]
            out += [(k,) for k, c in enumerate(t.columns) if c.unique] + [tuple(names.index(c) for c in k) for k in t.keysets]
        return [*out, tuple(range(len(self._relations[name].columns)))]

    def checked(self) -> Database:
        """Raise ValueError if two rows of a relation share what is given as its key: plans leave a distinct out for a key."""
        for name in self._unique & set(self._relations):
            for key in self.keys(name):
                again = self._relations[name].groupBy(*(f"c{k}" for k in key)).count().where("count > 1").head(1)
                if again:
                    raise ValueError(f"{name}: columns {', '.join(self._columns[name][k] for k in key)} are no key: {tuple(again[0])[:-1]} comes {again[0]['count']} times")
        return self

    def relation(self, name: str) -> DataFrame | None:
        """None if there is none: an undefined relation is empty."""
        if name in self._relations:
            return self._relations[name]
        if name.startswith("@") and name.endswith("#char") and self.schema:
            self._relations[name] = found = self._entities(name[: -len("#char")])
            return found
        return None

    def _entities(self, kind: str) -> DataFrame | None:
        """The ids of an entity type: of tables keyed by it, of the members of a union, of a case's rows."""
        parts = []
        for table, column in self.schema.keyed_by(kind):
            if (df := self.relation(table)) is not None:
                parts.append(df.select(F.col(f"c{column}").alias("c0")))
        for table, column, discriminator, value in self.schema.cases_of(kind):
            if (df := self.relation(table)) is not None:
                parts.append(df.where(F.col(f"c{discriminator}") == value).select(F.col(f"c{column}").alias("c0")))
        for member in self.schema.unions.get(kind, ()):
            if (df := self.relation(f"{member}#char")) is not None:
                parts.append(df)
        return reduce(DataFrame.union, parts).distinct() if parts else None

    def save(self, folder: str) -> None:
        """One Parquet folder for each relation, with the schema and the column names beside them."""
        for name, df in self._relations.items():
            if not name.startswith("@"):
                df.toDF(*self._columns[name]).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        meta = {"version": 1, "relations": {n: self._columns[n] for n in self._columns}, "unique": sorted(self._unique), "schema": self.schema.text if self.schema else None}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_meta")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Database:
        meta = json.loads(spark.read.text(f"{folder}/_meta", wholetext=True).first()[0])
        if meta.get("version") != 1:
            raise ValueError(f"unknown version of a database: {meta.get('version')}")
        db = cls(spark, meta["schema"])
        for name in meta["relations"]:
            db.add(name, spark.read.parquet(f"{folder}/{name}.parquet"), unique=name in meta["unique"])
        return db
