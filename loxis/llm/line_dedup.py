"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches, those of the largest ids first. A batch's line hashes, each with the number of
documents that hold it and the largest id of those, are merged against the runs of the batches before: what the
anti-join leaves are new hashes, which become a run of the lowest level; what it does not are repetitions, kept
apart with their counts. Runs are tables in buckets by hash, sorted within, so neither the merge with a batch nor
the compaction moves them: two runs of a level are merged into one of the next, bucket by bucket. A line goes when
its hash is held by enough documents and another document, with the largest id, keeps it.

Runs can be kept: state() tells where they are, opened() takes them up again in another session, and against()
takes from a further batch the lines that they hold, and adds its own.

Defined cases: a null or empty text is one empty line; a null id counts as a document of its own, smaller
than any other; rows with the same id are one document, and repeated rows each lose the same lines; lines
whose key has fewer than MIN_CHARS code points always stay; other columns, whatever they are called, are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sorted_table, staged

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def lower_ascii(text: Column) -> Column:
    """A-Z only; lower() does the same, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(docs: DataFrame) -> list[Column]:
    """The id as a number, and the text's hash, which tells rows of the same id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text")]


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """__id, __text, __at and __h of all lines whose key is long enough."""
    rows = docs.select(*_identity(docs), F.posexplode(_lines(F.col("text"))).alias("__at", "__line"))
    rows = rows.where(F.char_length("__line") >= min_chars).withColumn("__line", F.btrim("__line", F.lit(BLANKS)))
    rows = rows.where(F.char_length("__line") >= min_chars)
    return rows.select("__id", "__text", "__at", F.unhex(F.md5(lower_ascii(F.col("__line")).cast("binary"))).alias("__h"))


class Runs:
    """Sorted runs by level: of each hash the documents that held it first, and the largest id of those; no hash is in two.

    A table also has the hashes of its batch that were not new, with what the runs held of them.
    """

    COLUMNS = "__h binary, __docs bigint, __last bigint, __held bigint, __held_last bigint"

    def __init__(self) -> None:
        self.levels: list[list[tuple[DataFrame, str, int]]] = []
        self.again: list[DataFrame] = []

    def _runs(self) -> list[DataFrame]:
        return [t for level in self.levels for t, *_ in level]

    @staticmethod
    def _new(table: DataFrame) -> DataFrame:
        return table.where("__held is null").select("__h", "__docs", "__last")

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch (__h, __id) of documents that no batch before has; its table."""
        own = lines.groupBy("__h", "__id").agg(F.lit(1).alias("__one")).groupBy("__h").agg(F.count("*").alias("__docs"), F.max("__id").alias("__last"))
        own = own.select("*", F.lit(None).cast("long").alias("__held"), F.lit(None).cast("long").alias("__held_last"))
        for table in self._runs():
            run = self._new(table).select("__h", F.col("__docs").alias("__n"), F.col("__last").alias("__l"))
            own = own.join(run.hint("merge"), "__h", "left").select("__h", "__docs", "__last", F.coalesce("__held", "__n").alias("__held"), F.coalesce("__held_last", "__l").alias("__held_last"))
        table = sorted_table(own, "run", "__h", "__h")
        self.again.append(table[0].where("__held is not null"))
        self._put(0, table)
        return table[0]

    def _put(self, level: int, table: tuple[DataFrame, str, int]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) == FANOUT:
            first, *others = (self._new(t) for t, *_ in self.levels[level])
            for run in others:
                both = first.join(run.toDF("__h", "__n", "__l").hint("merge"), "__h", "full_outer")
                first = both.select("__h", F.coalesce("__docs", "__n").alias("__docs"), F.coalesce("__last", "__l").alias("__last"))
            self.levels[level] = []
            self._put(level + 1, sorted_table(first.select("*", F.lit(None).cast("long").alias("__held"), F.lit(None).cast("long").alias("__held_last")), "run", "__h", "__h"))

    def frequent(self, min_docs: int) -> DataFrame:
        """__h and __last of the hashes of at least so many documents."""
        enough = F.col("__docs") >= min_docs
        parts = [self._new(t).where(enough) for t in self._runs()]
        if self.again:
            more = self.again[0]
            for t in self.again[1:]:
                more = more.unionByName(t)
            parts.append(more.groupBy("__h").agg((F.sum("__docs") + F.max("__held")).alias("__docs"), F.max(F.greatest("__last", "__held_last")).alias("__last")).where(enough))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("__h").agg(F.max("__last").alias("__last"))

    def holds(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (__h, ...) whose hash is in a run."""
        if not self.levels:
            return lines.where("false")
        out = None
        for table in self._runs():
            met = lines.join(self._new(table).select("__h").hint("merge"), "__h", "left_semi")
            out = met if out is None else out.unionByName(met)
        return out

    def state(self) -> list[tuple[int, str, int]]:
        """Level, folder and number of buckets of each run."""
        return [(k, path, buckets) for k, level in enumerate(self.levels) for _, path, buckets in level]

    @classmethod
    def opened(cls, spark: SparkSession, state: list[tuple[int, str, int]]) -> Runs:
        out = cls()
        for level, path, buckets in state:
            name = f"loxis_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} ({cls.COLUMNS}) USING parquet CLUSTERED BY (__h) SORTED BY (__h) INTO {buckets} BUCKETS LOCATION '{path}'")
            while len(out.levels) <= level:
                out.levels.append([])
            out.levels[level].append((spark.table(name), path, buckets))
        return out


def _batch(docs: DataFrame) -> Column:
    """Of a row its batch: ranges of ids of about as many rows, the largest ids in batch 0."""
    bounds = docs.agg(F.percentile_approx(_identity(docs)[0], [k / BATCHES for k in range(1, BATCHES)])).first()[0]
    return sum((F.when(F.col("__id") <= b, 1).otherwise(0) for b in bounds or ()), F.lit(0))


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """__id, __text and __drop, the sorted numbers of the lines that go, of documents that lose any."""
    lines = staged(hashed_lines(docs, min_chars).withColumn("__batch", _batch(docs)), "lines", by="__batch")
    runs = Runs()
    for batch in range(BATCHES):
        runs.add(lines.where(F.col("__batch") == batch).select("__h", "__id"))
    frequent = staged(runs.frequent(min_docs), "frequent")
    hit = lines.join(frequent.hint("merge"), "__h").where(F.col("__id") != F.col("__last"))
    return _by_document(hit)


def _by_document(hit: DataFrame) -> DataFrame:
    return hit.groupBy("__id", "__text").agg(F.array_sort(F.collect_set("__at")).alias("__drop"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs as a column `row`, with __lines, __gone (the number of lines before, and of those that go) and __kept, the text left."""
    own = docs.select(F.struct("*").alias("row"), *_identity(docs))
    both = own.join(gone, ["__id", "__text"], "left")
    text = F.coalesce("row.text", F.lit(""))
    # The lines are bound once, as the only element of an array; each kept line is then taken by its number.
    bound = F.transform(F.array(F.struct(_lines(text).alias("l"), F.col("__drop").alias("d"))), lambda x: F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["d"]), lambda i: F.get(x["l"], i))))
    kept = F.when(F.col("__drop").isNull(), text).otherwise(F.element_at(bound, 1))
    count = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return both.select("row", count.cast("long").alias("__lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("__gone"), kept.alias("__kept"))


def _rewritten(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows as they were, but for the text; n_chars, if there is one, follows it."""
    new = {"text": F.col("__kept")} | ({"n_chars": F.char_length("__kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, n_dropped and kept_sha256."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _without(own, dropped(own))
    return out.select("row.doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_dropped"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


def deduped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, with all their columns, without the lines that go."""
    return _rewritten(docs, _without(docs, dropped(docs, min_chars, min_docs)))


def against(docs: DataFrame, runs: Runs, min_chars: int = MIN_CHARS) -> DataFrame:
    """A further batch, with all its columns, without the lines that the runs hold; its own lines are added to them."""
    lines = staged(hashed_lines(docs, min_chars), "lines")
    gone = staged(_by_document(runs.holds(lines)), "gone")
    runs.add(lines.select("__h", "__id"))
    return _rewritten(docs, _without(docs, gone))


#: The same rows in DuckDB, where doc_id is unique and not null.
ORACLE = r"""
WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM
           (SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.i, k.line, f.k IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
