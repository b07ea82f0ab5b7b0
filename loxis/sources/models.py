"""Flow models: YAML rows as four relations, and access paths."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .database import Database

#: Columns of the model relations. A row of the files has a further column, `ext`, before output or input where it has them.
COLUMNS = {
    "sourceModel": ["package", "type", "subtypes", "name", "signature", "output", "kind", "provenance"],
    "sinkModel": ["package", "type", "subtypes", "name", "signature", "input", "kind", "provenance"],
    "summaryModel": ["package", "type", "subtypes", "name", "signature", "input", "output", "kind", "provenance"],
    "neutralModel": ["package", "type", "name", "signature", "kind", "provenance"],
}
_EXT_AT = 5


@dataclass
class Models:
    rows: dict[str, list[tuple]] = field(default_factory=lambda: {name: [] for name in COLUMNS})
    unknown: dict[str, list[list]] = field(default_factory=dict)  # other extensibles, as they are

    def merge(self, other: Models) -> Models:
        out = Models()
        for part in (self, other):
            for name, rows in part.rows.items():
                out.rows[name] += rows
            for name, rows in part.unknown.items():
                out.unknown.setdefault(name, []).extend(rows)
        return out

    def by_kind(self, relation: str, kind: str) -> list[tuple]:
        k = COLUMNS[relation].index("kind")
        return [r for r in self.rows[relation] if r[k] == kind]

    def by_callable(self, relation: str, package: str, type_: str, name: str) -> list[tuple]:
        at = [COLUMNS[relation].index(c) for c in ("package", "type", "name")]
        return [r for r in self.rows[relation] if tuple(r[i] for i in at) == (package, type_, name)]


class ModelError(ValueError):
    """A model file with a row that does not fit its relation."""


def parse_models(text: str) -> Models:
    import yaml

    out = Models()
    for x in (yaml.safe_load(text) or {}).get("extensions", []):
        name = x["addsTo"]["extensible"]
        for row in x.get("data") or []:
            if name not in COLUMNS:
                out.unknown.setdefault(name, []).append(row)
                continue
            cells = list(row)
            if len(cells) == len(COLUMNS[name]) + 1:
                del cells[_EXT_AT]
            if len(cells) != len(COLUMNS[name]):
                raise ModelError(f"{name} has {len(COLUMNS[name])} columns, a row has {len(row)}")
            out.rows[name].append(tuple(c if COLUMNS[name][k] == "subtypes" else "" if c is None else str(c) for k, c in enumerate(cells)))
    return out


def read_models(spark: SparkSession, paths: str | list[str]) -> Models:
    """All model files of some paths, through Spark's reader, so from any store."""
    out = Models()
    for r in spark.read.text(paths, wholetext=True).collect():
        out = out.merge(parse_models(r[0]))
    return out


def frames(spark: SparkSession, models: Models) -> dict[str, DataFrame]:
    kinds = {c: T.BooleanType() if c == "subtypes" else T.StringType() for names in COLUMNS.values() for c in names}
    return {name: spark.createDataFrame(list(dict.fromkeys(rows)), T.StructType([T.StructField(c, kinds[c]) for c in COLUMNS[name]])) for name, rows in models.rows.items()}


def add_models(db: Database, models: Models) -> Database:
    for name, df in frames(db.spark, models).items():
        db.add(name, df, unique=True)
    return db


@dataclass(frozen=True)
class Step:
    kind: str
    name: str | None = None


@dataclass(frozen=True)
class AccessPath:
    """root: Argument, Parameter, ReturnValue or Empty; argument: what stands in its brackets, as (form, numbers)."""

    root: str
    argument: tuple = ()
    steps: tuple[Step, ...] = ()


class AccessPathError(ValueError):
    """An access path that does not parse."""


#: Forms of an argument, tried in turn.
_ARGUMENTS = (("this", r"this"), ("all", r"\*"), ("range", r"(-?\d+)\.\.(-?\d+)"), ("dereferenced twice", r"\*\*(\d+)"), ("dereferenced element", r"\*@(\d+)"), ("dereferenced", r"\*(\d+)"), ("index", r"(-?\d+)"))
#: Steps of a path: with a name in brackets, and without one.
_NAMED, _PLAIN = ("Field", "SyntheticField"), ("MapKey", "MapValue", "ArrayElement", "Element", "WithElement", "WithoutElement")


def parse_access_path(text: str) -> AccessPath:
    text = text.strip()
    if not text:
        return AccessPath("Empty")
    m = re.match(r"(Argument|Parameter|ReturnValue)(?:\[([^\]]*)\])?", text)
    if not m or (m[1] != "ReturnValue" and m[2] is None):
        raise AccessPathError(f"not the beginning of an access path: {text}")
    if m[1] == "ReturnValue":
        argument = ("qualified", m[2]) if m[2] is not None else ()
    else:
        for form, pattern in _ARGUMENTS:
            if a := re.fullmatch(pattern, m[2]):
                argument = (form, *map(int, a.groups()))
                break
        else:
            raise AccessPathError(f"not an argument: {m[2]}")
    steps, rest = [], text[m.end() :]
    while rest:
        s = re.match(r"\.(\w+)(?:\[([^\]]*)\])?", rest)
        if not s:
            raise AccessPathError(f"not a step: {rest}")
        if s[1] in _NAMED and s[2] is not None:
            steps.append(Step("Deref" + s[1], s[2][1:]) if s[2].startswith("*") else Step(s[1], s[2]))
        elif s[1] in _PLAIN:
            steps.append(Step(s[1]))
        else:
            raise AccessPathError(f"not a step: {s[0]}")
        rest = rest[s.end() :]
    return AccessPath(m[1], argument, tuple(steps))
