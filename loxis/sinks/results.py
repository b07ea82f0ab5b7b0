"""Results as CSV, JSON and SARIF, and the metadata in a query's documentation comment.

Files of rows are written by Spark, in parallel; SARIF and single texts are for results of a readable size.
"""

from __future__ import annotations

import csv
import io
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: Severities of a problem as SARIF levels.
LEVELS = {"error": "error", "warning": "warning", "recommendation": "note"}
KINDS = ("problem", "path-problem", "table", "metric", "diagnostic", "graph")


@dataclass
class Metadata:
    name: str | None = None
    description: str | None = None
    kind: str = "table"
    id: str | None = None
    severity: str | None = None
    security_severity: str | None = None
    tags: list[str] = field(default_factory=list)
    other: dict[str, str] = field(default_factory=dict)


def parse_metadata(text: str) -> Metadata:
    """Metadata of the first documentation comment: `@name ...`, with lines that go on."""
    out = Metadata()
    m = re.search(r"/\*\*(.*?)\*/", text, re.DOTALL)
    if not m:
        return out
    found: list[list[str]] = []
    for line in m[1].splitlines():
        line = re.sub(r"^\s*\*?\s?", "", line).rstrip()
        if tag := re.match(r"@([\w.-]+)\s*(.*)", line):
            found.append([tag[1], tag[2]])
        elif found and line.strip():
            found[-1][1] += ("\n" if found[-1][0] == "tags" else " ") + line.strip()
    for key, value in found:
        value = value.strip()
        match key:
            case "name" | "description" | "id":
                setattr(out, key, value)
            case "kind":
                out.kind = value if value in KINDS else "table"
            case "problem.severity":
                out.severity = value
            case "security-severity":
                out.security_severity = value
            case "tags":
                out.tags = value.split()
            case _:
                out.other[key] = value
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with a header; quotes are doubled."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_parquet(df: DataFrame, path: str) -> None:
    """The result set that read_result reads; types and labels stay."""
    df.write.mode("overwrite").parquet(path)


def read_result(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _cell(x) -> str:
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def to_csv(df: DataFrame) -> str:
    """One text with a header; a cell with a comma, a quote or a line end is quoted."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    for r in df.toLocalIterator():
        w.writerow([_cell(x) for x in r])
    return out.getvalue()


def to_json(df: DataFrame, metadata: Metadata | None = None) -> str:
    m = metadata or Metadata()
    meta = {k: v for k, v in (("name", m.name), ("description", m.description), ("kind", m.kind), ("id", m.id)) if v}
    columns = [{"name": n, "type": {"bigint": "int", "double": "float"}.get(t, t)} for n, t in df.dtypes]
    return json.dumps({"metadata": meta, "columns": columns, "rows": [list(r) for r in df.toLocalIterator()]}, ensure_ascii=False, default=str)


def to_table(df: DataFrame, limit: int | None = None) -> str:
    rows = [[_cell(x) for x in r] for r in (df.limit(limit) if limit else df).toLocalIterator()]
    width = [max(len(c), *(len(r[k]) for r in rows)) if rows else len(c) for k, c in enumerate(df.columns)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width)) + " |"
    return "\n".join([line(df.columns), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows)])


def _location(url: str) -> dict | None:
    """file://path:line:column:line:column."""
    m = re.fullmatch(r"file://(.*?):(\d+):(\d+):(\d+):(\d+)", url or "")
    if not m:
        return None
    region = dict(zip(("startLine", "startColumn", "endLine", "endColumn"), map(int, m.groups()[1:])))
    return {"physicalLocation": {"artifactLocation": {"uri": m[1]}, "region": region}}


def to_sarif(df: DataFrame, metadata: Metadata, tool: str = "loxis") -> str:
    """SARIF 2.1.0. problem: element, message; path-problem: element, source, sink, message; else the cells as message.

    An element is placed where it is a file URL with four numbers.
    """
    level = LEVELS.get(metadata.severity or "warning", "warning")
    rule = metadata.id or "query"
    results = []
    for r in df.toLocalIterator():
        cells = [_cell(x) for x in r]
        if metadata.kind == "problem" and len(cells) >= 2:
            places, message = cells[:1], cells[1]
        elif metadata.kind == "path-problem" and len(cells) >= 4:
            places, message = cells[:1], cells[3]
        else:
            places, message = cells[:1], ", ".join(cells)
        one: dict = {"ruleId": rule, "ruleIndex": 0, "level": level, "message": {"text": message}}
        if found := [x for x in map(_location, places) if x]:
            one["locations"] = found
        if metadata.kind == "path-problem" and len(cells) >= 4:
            steps = [{"location": (_location(c) or {}) | {"message": {"text": c}}} for c in cells[1:3]]
            one["codeFlows"] = [{"threadFlows": [{"locations": steps}]}]
        results.append(one)
    about = {"id": rule, "name": metadata.name or rule, "shortDescription": {"text": metadata.name or rule}, "fullDescription": {"text": metadata.description or ""}, "defaultConfiguration": {"level": level}, "properties": {"tags": metadata.tags} | ({"security-severity": metadata.security_severity} if metadata.security_severity else {})}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [about]}}, "results": results}]}, ensure_ascii=False)
