"""Benchmark decontamination by Wu-Manber search over words.

Windows of benchmark words are the patterns. A table of shifts, by blocks of two words, skips positions that
no window can end at; where the shift is none, the buckets of the windows with that suffix give candidates,
whose words are compared one by one.

The benchmark is cut into pieces of PIECE_BYTES and searched for in blocks of BLOCK_BYTES of them, one pass over
the documents for each: a block is what the driver, a broadcast and a task hold of it. A worker makes a block's
tables once. One block needs no shuffle; of more, the hits (never texts) meet by document.

Defined cases: a null or empty text has no words and is not contaminated; a benchmark row without words has
no window; a benchmark row with a null id is searched for, and counts as an item with the empty id; rows with
the same id are one item; repeated documents give a row each; other columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .textops import ALNUM, chunks, mix, utf8, words

WINDOW = 13
#: Benchmark text of a piece, of one broadcast block, and of the words that a block's tables are made of at a time, in bytes.
PIECE_BYTES, BLOCK_BYTES, MADE_BYTES = 64 << 10, 16 << 20, 1 << 20
LANE = 2048
_K = np.uint64(0x9FB21C651E98DF25)


def pairs(codes: np.ndarray) -> np.ndarray:
    """At each place the hash of the block of two words that ends there."""
    out = np.zeros(len(codes), np.uint64)
    out[1:] = mix(codes[:-1] * _K + codes[1:])
    return out


@dataclass
class Text:
    """The words of a block of the benchmark: their bytes, where each begins and ends, and their hashes."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def spelt(self, first: int, size: int) -> list[bytes]:
        return [self.raw[x:y] for x, y in zip(self.start[first : first + size].tolist(), self.end[first : first + size].tolist())]


class Searcher:
    """Windows of one length: of a pattern, its first word in the text, and the items that hold it."""

    def __init__(self, size: int, text: Text, first: np.ndarray, item: np.ndarray):
        self.size, self.text = size, text
        self.first, which = self._patterns(first)
        both = np.unique((which << 32) | item)
        self.items = (both & 0xFFFFFFFF).astype(np.int32)
        self.cut = np.searchsorted(both >> 32, np.arange(len(self.first) + 1))
        block = min(2, size)
        self.bits = min(25, max(20, 3 + len(self.first).bit_length()))
        self.shift = np.full(1 << self.bits, size - block + 1, np.uint8)
        for at in range(block - 1, size):  # the later the place, the less the shift: it overwrites
            self.shift[self.cell(self.key(at))] = size - 1 - at
        last = self.key(size - 1)
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def _patterns(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of equal windows, and for each window which of these it is."""
        h = np.zeros(len(first), np.uint64)
        for j in range(self.size):
            h = mix(h * _K + self.text.hash[first + j])
        _, own, which = np.unique(h, return_index=True, return_inverse=True)
        odd = np.zeros(len(first), bool)  # of equal hash, but another window
        for j in range(self.size):
            odd |= self.text.hash[first + j] != self.text.hash[first[own[which]] + j]
        which[odd] = len(own) + np.arange(int(odd.sum()))
        return np.concatenate([first[own], first[odd]]), which.astype(np.int64)

    def key(self, at: int) -> np.ndarray:
        """Of each pattern the hash of the block that ends at this place."""
        now = self.text.hash[self.first + at]
        return mix(self.text.hash[self.first + at - 1] * _K + now) if self.size > 1 else now

    def cell(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def items_of(self, pattern: int) -> list[int]:
        return self.items[self.cut[pattern] : self.cut[pattern + 1]].tolist()

    def find(self, codes: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window ends, by hash, and which window."""
        key = blocks if self.size > 1 else codes
        shift, n = self.shift[self.cell(key)], len(codes)
        at = np.arange(self.size - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            step = shift[at]
            none = step == 0
            if none.any():
                found.append(at[none])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        at = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        low, high = np.searchsorted(self.suffix, key[at]), np.searchsorted(self.suffix, key[at], "right")
        each = high - low
        at = np.repeat(at, each)
        which = self.order[np.repeat(low - np.cumsum(each) + each, each) + np.arange(len(at))]
        for back in range(self.size):
            same = codes[at - back] == self.text.hash[self.first[which] + self.size - 1 - back]
            at, which = at[same], which[same]
        return at, which


def windows_of(texts: list[str | None], ids: list[str], size: int = WINDOW) -> tuple[list[Searcher], list[str]]:
    """Searchers by window length, and the distinct ids that their items number. A window that occurs again is one pattern."""
    names = sorted(set(ids))
    number = dict(zip(names, range(len(names))))
    of = np.array([number[i] for i in ids], np.int64)
    data, offsets = utf8(pa.array(texts, pa.string()))
    raw, parts, n, at = [], [], 0, 0
    for a, b in chunks(offsets, MADE_BYTES):
        w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
        each = np.diff(w.ends, prepend=0)
        length = np.minimum(size, each)
        windows = np.where(each > 0, each - length + 1, 0)
        row = np.repeat(np.arange(len(each)), windows)
        first = (w.ends - each)[row] + np.arange(len(row)) - (np.cumsum(windows) - windows)[row]
        parts.append((w.start + at, w.end + at, w.hash, first + n, length[row], of[a + row]))
        raw.append(w.low.tobytes())
        n, at = n + len(w.hash), at + len(raw[-1])
    if not parts:
        return [], names
    start, end, codes, first, length, item = (np.concatenate(x) for x in zip(*parts))
    text = Text(b"".join(raw), start, end, codes)
    return [Searcher(int(m), text, first[length == m], item[length == m]) for m in np.unique(length)], names


def matches(data: np.ndarray, offsets: np.ndarray, searchers: list[Searcher]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
    """By row: its number of words, the windows hit (first word in the row, words), and the items whose windows occur."""
    w = words(data, offsets, ALNUM)
    rows, each = len(w.ends), np.diff(w.ends, prepend=0)
    # A gap after each row, so that no window runs from a row into the next.
    place = np.arange(len(w.hash)) + np.repeat(np.arange(rows), each)
    codes = np.zeros(len(w.hash) + rows, np.uint64)
    codes[place] = w.hash
    word = np.full(len(codes), -1)
    word[place] = np.arange(len(w.hash))
    blocks, own = pairs(codes), Text(w.low.tobytes(), w.start, w.end, w.hash)
    hits: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    seen: list[set[tuple[int, int]]] = [set() for _ in range(rows)]
    for k, s in enumerate(searchers):
        at, which = s.find(codes, blocks)
        first = word[at - s.size + 1]
        row = np.searchsorted(w.ends, first, "right")
        for a, p, r in zip(first.tolist(), which.tolist(), row.tolist()):
            if own.spelt(a, s.size) == s.text.spelt(int(s.first[p]), s.size):
                hits[r].append((a - int(w.ends[r] - each[r]), s.size))
                seen[r].add((k, p))
    return each, hits, [{i for k, p in x for i in searchers[k].items_of(p)} for x in seen]


def covered(hits: list[tuple[int, int]]) -> int:
    """Words in the union of windows (first, number)."""
    total, end = 0, -1
    for a, n in sorted(hits):
        total += max(0, a + n - max(a, end))
        end = max(end, a + n)
    return total


def _pieces(benchmark: DataFrame, window: int, size: int) -> DataFrame:
    """(item_id, text) with texts of about size bytes at most; each begins with the last words of the piece before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if len(text) <= size // 4:
                    yield pa.RecordBatch.from_pylist([{"item_id": item, "text": text}])
                    continue
                data, offsets = utf8(pa.array([text], pa.string()))
                w = words(data, offsets, ALNUM)
                raw, first = data.tobytes(), 0
                while first < len(w.start):
                    last = max(first + window, int(np.searchsorted(w.end, w.start[first] + size)))
                    last = min(last, len(w.start))
                    yield pa.RecordBatch.from_pylist([{"item_id": item, "text": raw[w.start[first] : w.end[last - 1]].decode()}])
                    first = last - window + 1 if last < len(w.start) else last

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "item_id string, text string")


_LAST: list[tuple[object, int, tuple]] = []


def _tables(shared: Broadcast, window: int) -> tuple[list[Searcher], list[str]]:
    """The tables of a broadcast block; a worker keeps those of the last one."""
    if not _LAST or _LAST[0][0] is not shared or _LAST[0][1] != window:
        texts, ids = shared.value
        _LAST[:] = [(shared, window, windows_of(texts, ids, window))]
    return _LAST[0][2]


def _searched(docs: DataFrame, shared: Broadcast, window: int, told: Callable, schema: str) -> DataFrame:
    """told: (batch rows, words, hits and names of items by row) -> a record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, ids = _tables(shared, window)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in chunks(offsets):
                n_words, hits, items = matches(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], searchers)
                yield told(batch.slice(first, last - first), n_words, hits, [sorted(ids[i] for i in x) for x in items])

    return docs.mapInArrow(run, schema)


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[int, Broadcast]]:
    """The number of blocks, and each block as a broadcast of texts and ids."""
    spark = docs.sparkSession
    pieces = staged(_pieces(benchmark, window, min(PIECE_BYTES, block_bytes)), "pieces")
    total = pieces.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = int(total // block_bytes) + 1
    for k in range(count):
        found = pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        yield count, spark.sparkContext.broadcast(([r.text for r in found], [r.item_id for r in found]))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
KINDS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_HITS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int64()), ("n", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _digest(own: pa.RecordBatch, n_words, hits: list, items: list[list[str]]) -> pa.RecordBatch:
    n_hit = [covered(x) for x in hits]
    bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words)]
    columns = [own.column("doc_id"), n_words, n_hit, [len(x) for x in items], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], bad]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def _hits(own: pa.RecordBatch, n_words, hits: list, items: list[list[str]]) -> pa.RecordBatch:
    at = [k for k, x in enumerate(hits) if x]
    rows = {"doc_id": own.column("doc_id").take(pa.array(at, pa.int64())), "mark": own.column("mark").take(pa.array(at, pa.int64())), "hits": [[{"a": a, "n": n} for a, n in hits[k]] for k in at], "items": [items[k] for k in at]}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(rows.values(), _HITS)], schema=_HITS)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The hits of all blocks by document: rows of one id and text have the same ones, and count once in a block."""
    every = parts[0].where("false")
    for p in parts:
        every = every.unionByName(p.dropDuplicates(["doc_id", "mark"]))
    return every.groupBy("doc_id", "mark").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _by_blocks(rows: DataFrame, first: Broadcast, rest: Iterator[tuple[int, Broadcast]], window: int) -> DataFrame:
    """rows (doc_id, mark, text) -> the hits of all blocks, each searched for in a pass of its own."""
    schema, parts = "doc_id long, mark long, hits array<struct<a:bigint,n:bigint>>, items array<string>", []
    for shared in (first, *(b for _, b in rest)):
        parts.append(staged(_searched(rows, shared, window, _hits, schema), "hits"))
        shared.destroy()
    return staged(_merged(parts), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Search docs (doc_id, text) for the windows of benchmark (item_id, text).

    Returns doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    blocks = _blocks(docs, benchmark, window, block_bytes)
    count, shared = next(blocks)
    if count == 1:
        return _searched(own.drop("mark"), shared, window, _digest, KINDS)
    hits = _by_blocks(own, shared, blocks, window)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in chunks(offsets):
                n = np.diff(words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], ALNUM).ends, prepend=0)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(n, pa.int64())], names=["doc_id", "mark", "n_words"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(x["a"], x["n"]) for x in h or ()] for h in batch.column("hits").to_pylist()]
            yield _digest(batch, batch.column("n_words").to_pylist(), found, [x or [] for x in batch.column("items").to_pylist()])

    sizes = own.mapInArrow(counted, "doc_id long, mark long, n_words long")
    same = sizes["doc_id"].eqNullSafe(hits["doc_id"]) & (sizes["mark"] == hits["mark"])
    return sizes.join(hits, same, "left").select(sizes["doc_id"], "n_words", "hits", "items").mapInArrow(finish, KINDS)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of benchmark occurs.

    One window is enough, whatever the share of the document's words: a long document may hold a whole item.
    """
    blocks = _blocks(docs, benchmark, window, block_bytes)
    count, shared = next(blocks)
    if count == 1:
        return _searched(docs, shared, window, lambda own, _, hits, __: own.filter(pa.array([not x for x in hits], pa.bool_())), docs.schema)
    hits = _by_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")), shared, blocks, window)
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_mark"))
    same = own["id"].eqNullSafe(hits["doc_id"]) & (own["text_mark"] == hits["mark"])
    return own.join(hits, same, "left_anti").select("row.*")


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS t
      FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t
      FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
f AS (SELECT o.doc_id, o.i, o.m, p.item_id FROM o JOIN p ON o.m = p.m AND o.t = p.t),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM f) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(g.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(g.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""
