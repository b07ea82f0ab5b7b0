"""Distinct-word tables without a row for every word of the corpus.

A block is some megabytes of whole documents, split in an executor. It keeps each document as codes of its
words, and its distinct words in buckets by hash. The buckets are dealt by number, so that every occurrence
of a word meets in one task, which answers each block's words in their order. Codes and answers meet again
by block. What is shuffled is a block's distinct words, packed, never the occurrences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, pack, unpack, width

BLOCK_BYTES = 16 << 20
BLOCKS = "block string, bucket int, words binary, docs binary, more binary"
SCHEMA = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("docs", pa.binary()), ("more", pa.binary())])


def planes(codes: np.ndarray) -> bytes:
    """The codes byte plane by byte plane, which compresses to about their entropy."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _rows(block: str, docs: dict, table: dict, codes: list, parts: int, extra: Callable | None) -> Iterator[pa.RecordBatch]:
    words, flat = list(table), np.array(codes, np.uint32)
    rank = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words get small codes
    new = np.empty(len(words), np.uint32)
    new[rank] = np.arange(len(words), dtype=np.uint32)
    flat, words = new[flat], [words[i] for i in rank]
    bucket = np.fromiter((zlib.crc32(w if isinstance(w, bytes) else w.encode()) % parts for w in words), np.uint32, len(words))
    of_words, of_bucket = extra(words, flat, docs, parts) if extra else (None, None)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(parts + 1))
    out: list[tuple] = [(block, -1, None, pack(docs | {"codes": planes(flat), "bucket": bucket.astype(np.uint16 if parts < 1 << 16 else np.uint32)}), None)]
    for b in range(parts):
        mine = order[ends[b] : ends[b + 1]]
        row = {"words": [words[i] for i in mine]} | (of_words(mine) if of_words else {})
        if len(mine):
            out.append((block, b, pack(row), None, None))
        if of_bucket and (more := of_bucket(b)):
            out.append((block, b, None, None, more))
    yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in out], SCHEMA)


def make_blocks(docs: DataFrame, columns: list[str], split: Callable, label: str, extra: Callable | None = None) -> DataFrame:
    """Stage the blocks of docs. split: text -> its words. columns: kept with each document.

    extra: (words, codes, kept columns, buckets) -> what to add to the packed words at some places, and the
    bytes of a further row of a bucket.
    """
    parts = width(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), count()

        def fresh():
            return {c: [] for c in columns} | {"n_words": []}, defaultdict(count().__next__), []

        kept, table, codes = fresh()
        held = 0
        for batch in batches:
            own = [batch.column(c).to_pylist() for c in columns]
            for text, *values in zip(batch.column("text"), *own):
                text = text.as_py() or ""
                before = len(codes)
                codes.extend(map(table.__getitem__, split(text)))
                kept["n_words"].append(len(codes) - before)
                for c, v in zip(columns, values):
                    kept[c].append(v)
                held += len(text) + 1
                if held >= BLOCK_BYTES:
                    yield from _rows(f"{part}-{next(serial)}", kept, table, codes, parts, extra)
                    kept, table, codes = fresh()
                    held = 0
        if kept["n_words"]:
            yield from _rows(f"{part}-{next(serial)}", kept, table, codes, parts, extra)

    return bucketed(docs.select(*columns, "text").mapInArrow(run, BLOCKS), label, "block")


def answer(blocks: DataFrame, reply: Callable, column: str = "words") -> DataFrame:
    """reply: a bucket and an iterator of its rows, as (block, what is in column), -> rows of block, bucket and answer."""
    names = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("answer", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.as_py(), block.as_py(), data.as_py()) for batch in batches for b, block, data in zip(*(batch.column(c) for c in ("bucket", "block", column))))
        for bucket, own in groupby(rows, key=lambda r: r[0]):
            for row in reply(bucket, ((block, data) for _, block, data in own)):
                yield pa.RecordBatch.from_pylist([dict(zip(names.names, row))], names)

    dealt = blocks.where("bucket >= 0").where(F.col(column).isNotNull()).select("bucket", "block", column)
    dealt = dealt.repartition(width(blocks.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block string, bucket int, answer binary")


def meet(blocks: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish: (documents of a block, its words' answers from bucket to packed bytes) -> record batches of schema."""

    def run(kept: pa.Table, answers: pa.Table) -> pa.Table:
        docs = unpack(kept.column("docs")[0].as_py())
        docs["codes"] = from_planes(docs["codes"])
        return pa.Table.from_batches(list(finish(docs, dict(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist())))))

    kept = blocks.where("bucket < 0").select("block", "docs").groupBy("block")
    return kept.cogroup(answers.select("block", "bucket", "answer").groupBy("block")).applyInArrow(run, schema)


def in_code_order(bucket: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values come bucket by bucket, each in the order of the block's codes; put them in the order of the codes."""
    out = np.empty_like(values)
    out[np.argsort(bucket, kind="stable")] = values
    return out


def answers_of(got: dict[int, bytes]) -> list:
    return [unpack(got[b]) for b in sorted(got)]
