"""Facts from source files: each file is parsed in an executor, into rows of (relation, cells).

Ids are hashes of the file's path and of what is in it, so they are the same in every run and on every
cluster. Languages register an extractor: a function of path and text to (relation, cells).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .dbscheme import DbScheme, parse_dbscheme

Facts = Iterator[tuple[str, tuple]]
EXTRACTORS: dict[str, tuple[tuple[str, ...], str, Callable[[str, str], Facts]]] = {}
#: What begins a comment that takes the rest of its line, and what encloses one.
COMMENTS = {"python": ("#", None), "ruby": ("#", None), "c": ("//", ("/*", "*/")), "cpp": ("//", ("/*", "*/")), "java": ("//", ("/*", "*/")), "csharp": ("//", ("/*", "*/")), "go": ("//", ("/*", "*/")), "javascript": ("//", ("/*", "*/")), "rust": ("//", ("/*", "*/")), "swift": ("//", ("/*", "*/"))}
EXTENSIONS = {"python": (".py",), "ruby": (".rb",), "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".cxx", ".hpp"), "java": (".java",), "csharp": (".cs",), "go": (".go",), "javascript": (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"), "rust": (".rs",), "swift": (".swift",)}
COMMON = """
files(unique int id: @file, string name: string ref);
folders(unique int id: @folder, string name: string ref);
containerparent(int parent: @container ref, unique int child: @container ref);
numlines(int element_id: @file ref, int num_lines: int ref, int num_code: int ref, int num_comment: int ref);
@container = @file | @folder;
"""


def entity(*parts: object) -> int:
    """A positive 63-bit id."""
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "big") >> 1


def extractor(language: str, scheme: str):
    def register(f: Callable[[str, str], Facts]):
        EXTRACTORS[language] = (EXTENSIONS[language], scheme, f)
        return f

    return register


def count_lines(text: str, language: str) -> tuple[int, int, int]:
    """All lines, lines with code and lines with comments; a line may have both."""
    line, block = COMMENTS[language]
    code = comment = 0
    inside = False
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    for raw in lines:
        rest, has_code, has_comment = raw.strip(), False, inside and bool(raw.strip())
        while rest:
            if inside:
                has_comment = True
                at = rest.find(block[1])
                rest, inside = (rest[at + len(block[1]) :].strip(), False) if at >= 0 else ("", True)
                continue
            starts = [(rest.find(x), x) for x in (line, block and block[0]) if x and rest.find(x) >= 0]
            if not starts:
                has_code, rest = True, ""
                continue
            at, mark = min(starts)
            has_code |= at > 0
            has_comment = True
            inside, rest = (True, rest[at + len(mark) :]) if mark != line else (False, "")
        code, comment = code + has_code, comment + has_comment
    return len(lines), code, comment


def place_facts(path: str, text: str, language: str) -> Facts:
    """The file, the folders it is in, and its line counts."""
    p = PurePosixPath(path)
    child = entity("file", path)
    yield "files", (child, path)
    yield "numlines", (child, *count_lines(text, language))
    for parent in p.parents:
        own = entity("folder", str(parent))
        yield "folders", (own, str(parent))
        yield "containerparent", (own, child)
        child = own


def language_of(path: str) -> str | None:
    return next((lang for lang, ends in EXTENSIONS.items() if path.endswith(ends)), None)


def extract(spark: SparkSession, paths: str | list[str], into: str, root: str = "", languages: tuple[str, ...] | list[str] = ("python",)) -> Database:
    """Extract all files under some paths into a database in the folder `into`.

    Files are read by Spark, in parallel and from any store; a file that doesn't parse gives its place and line
    counts only, and so do files of languages that are not named or have no extractor. Languages that name
    tables alike go to databases of their own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    facts_of(files, root, languages).write.mode("overwrite").partitionBy("relation").parquet(f"{into}/facts")
    return split_facts(spark, spark.read.parquet(f"{into}/facts"), scheme_of(languages))


def scheme_of(languages: tuple[str, ...] | list[str]) -> DbScheme:
    return parse_dbscheme(COMMON + "".join(EXTRACTORS[k][1] for k in languages if k in EXTRACTORS))


def facts_of(files: DataFrame, root: str, languages: tuple[str, ...] | list[str]) -> DataFrame:
    """files (path, content) -> (relation, cells)."""
    known = {k: EXTRACTORS[k][2] for k in languages if k in EXTRACTORS}
    prefix = root.rstrip("/") + "/" if root else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            relation, cells = [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                name = re.sub(r"^\w+:/*(?=/)", "", path)
                name = name.removeprefix(prefix)
                language = language_of(name)
                if language is None:
                    continue
                text = content.decode("utf-8", "replace")
                facts = list(place_facts(name, text, language))
                if language in known:
                    try:
                        facts += known[language](name, text)
                    except (SyntaxError, ValueError, RecursionError):
                        pass
                for r, c in facts:
                    relation.append(r)
                    cells.append([None if x is None else str(x) for x in c])
            yield pa.RecordBatch.from_arrays([pa.array(relation, pa.string()), pa.array(cells, pa.list_(pa.string()))], names=["relation", "cells"])

    return files.mapInArrow(run, "relation string, cells array<string>")


def split_facts(spark: SparkSession, facts: DataFrame, scheme: DbScheme) -> Database:
    """A relation for each table of the scheme; only its own partition is read."""
    db = Database(spark, scheme)
    for name, table in scheme.tables.items():
        columns = [F.get("cells", k).cast(f.dataType).alias(f.name) for k, f in enumerate(table.struct())]
        db.add(name, facts.where(F.col("relation") == name).select(*columns).distinct(), unique=True)
    return db


def source_roots(folder: str) -> list[str]:
    """Source folders of a build: what Gradle or Maven files name, else their usual places, else the folder itself."""
    top, found = Path(folder), []
    for pom in sorted(top.rglob("pom.xml")):
        own = re.search(r"<sourceDirectory>\s*(.*?)\s*</sourceDirectory>", pom.read_text(errors="replace"))
        found += [pom.parent / own[1]] if own else [pom.parent / "src/main/java"]
    for build in sorted([*top.rglob("build.gradle"), *top.rglob("build.gradle.kts")]):
        named = re.findall(r"srcDirs?\s*(?:=|\()?\s*[\[(]?\s*[\"']([^\"']+)[\"']", build.read_text(errors="replace"))
        found += [build.parent / n for n in named] if named else [build.parent / "src/main/java", build.parent / "src/main/kotlin"]
    if not any(p.is_dir() for p in found):
        found = [p for p in (top / "src/main/java", top / "src", top) if p.is_dir()][:1]
    return list(dict.fromkeys(str(p) for p in found if p.is_dir()))
