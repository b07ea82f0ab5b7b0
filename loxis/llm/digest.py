"""Document fingerprints by improbable features.

Every window of 64 bytes has an entropy; how rare that entropy is among all windows of the corpus ranks the
window. A window that is the rarest of enough of the spans it lies in is a feature. Features are hashed into
a chain of Bloom filters, and two fingerprints are compared by the overlap of their bits beyond chance.

Defined cases: a null text is the empty one, whose fingerprint is empty; a text of less than a window is one
feature; two empty fingerprints are alike (1), an empty and another are not (0); rows are in the order of
their ids, nulls first, and of a hash of their texts where ids are equal; a single document is its own next one;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import width
from .textops import chunks, mix, utf8

WINDOW, SPAN, POPULARITY = 64, 64, 16
FILTER_BITS, PROBES, FEATURES = 2048, 5, 128
BINS, _UNIT = 1025, 24
GROUP_BYTES = 1 << 20
#: Filters that are compared with as many others at a time.
STEP = 1024
#: n log2 n, scaled so that sums of it stay whole.
_G = np.array([0, *(round(n * np.log2(n) * 64) for n in range(1, WINDOW + 2))], np.int32)
_K = np.uint64(0x9FB21C651E98DF25)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """For each window its entropy, from 0 to 1024; a window is known by its first byte."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    ahead, behind = np.ones(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    # Moving a window by one: its first byte goes, of which it held `ahead`; one comes, of which it held `behind`.
    less, more = _G[1:] - _G[:-1], _G[1:] - _G[:-1]
    step = more[behind[WINDOW:]] - less[ahead[: n - WINDOW] - 1]
    total = np.empty(n - WINDOW + 1, np.int32)
    total[0] = _G[np.bincount(data[:WINDOW])].sum()
    total[1:] = step
    np.add.accumulate(total, out=total)
    return (_G[WINDOW] - total) // _UNIT


def inside(offsets: np.ndarray) -> np.ndarray:
    """Which windows lie in one row."""
    n = int(offsets[-1])
    change = np.zeros(n + 1, np.int32)
    big = np.diff(offsets) >= WINDOW
    np.add.at(change, offsets[:-1][big], 1)
    np.add.at(change, offsets[1:][big] - WINDOW + 1, -1)
    return np.cumsum(change[:-1])[: max(0, n - WINDOW + 1)] > 0


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and hash of each feature, in order."""
    n = len(data)
    out = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)]
    if n >= WINDOW:
        ok = inside(offsets)
        shift, kind = (21, np.uint32) if n < 1 << 21 else (40, np.uint64)
        none = np.iinfo(kind).max
        key = np.full(len(ok) + 2 * (SPAN - 1), none, kind)
        key[SPAN - 1 : SPAN - 1 + len(ok)] = np.where(ok, (rank[entropy_bins(data)].astype(kind) << kind(shift)) | np.arange(len(ok), dtype=kind), none)
        for s in (1, 2, 4, 8, 16, 32):
            key = np.minimum(key[:-s], key[s:])
        place = (key[key != none] & kind((1 << shift) - 1)).astype(np.int64)
        at = np.flatnonzero(np.bincount(place, minlength=1) >= POPULARITY)
        word = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].view("<u8")
        h = np.zeros(len(at), np.uint64)
        for j in range(WINDOW // 8):
            h = mix((h ^ word[:, j]) * _K + np.uint64(j))
        row = np.searchsorted(offsets, at, "right") - 1
        out = [row, at - offsets[row], h]
    size = np.diff(offsets)
    small = np.flatnonzero((size > 0) & (size < WINDOW))
    if len(small):
        raw = data.tobytes()
        h = [int.from_bytes(hashlib.sha256(raw[offsets[k] : offsets[k + 1]]).digest()[:8], "little") for k in small]
        row = np.concatenate([out[0], small])
        order = np.argsort(row, kind="stable")
        out = [x[order] for x in (row, np.concatenate([out[1], np.zeros(len(small), np.int64)]), np.concatenate([out[2], np.array(h, np.uint64)]))]
    return tuple(out)


def chains(rows: int, row: np.ndarray, place: np.ndarray, h: np.ndarray) -> list[list[tuple[int, bytes]]]:
    """By row its filters: the number of features and the bits. A feature counts once in a row."""
    order = np.lexsort((place, h, row))
    row, place, h = row[order], place[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, place, h = row[new], place[new], h[new]
    order = np.lexsort((place, row))
    row, h = row[order], h[order]
    number = np.bincount(row, minlength=rows)
    filters = -(-number // FEATURES)
    first = np.cumsum(filters) - filters
    of = first[row] + (np.arange(len(row)) - (np.cumsum(number) - number)[row]) // FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for k in range(PROBES):
        bits[of, ((h >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    packed, each = np.packbits(bits, axis=1), np.bincount(of, minlength=len(bits))
    return [[(int(each[f]), packed[f].tobytes()) for f in range(a, a + c)] for a, c in zip(first.tolist(), filters.tolist())]


def text_of(chain: list[tuple[int, bytes]]) -> str:
    return ";".join(f"{n}.{base64.b64encode(bits).decode()}" for n, bits in chain)


def chain_of(text: str) -> list[tuple[int, bytes]]:
    return [(int(n), base64.b64decode(bits)) for n, _, bits in (x.partition(".") for x in text.split(";") if x)]


def likeness(a: list[tuple[int, bytes]], b: list[tuple[int, bytes]]) -> float:
    """Mean over the filters of the shorter chain, by features, of the best normalised overlap with the other's."""
    if a == b or not a or not b:
        return float(a == b)
    if (len(a), sum(n for n, _ in a), a) > (len(b), sum(n for n, _ in b), b):
        a, b = b, a
    best = np.concatenate([_best(_bits(a[k : k + STEP]), b) for k in range(0, len(a), STEP)])
    return sum(n * float(x) for (n, _), x in zip(a, best)) / sum(n for n, _ in a)


def _bits(chain: list[tuple[int, bytes]]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(x for _, x in chain), np.uint8).reshape(len(chain), -1), axis=1).astype(np.float32)


def _best(own: np.ndarray, chain: list[tuple[int, bytes]]) -> np.ndarray:
    """For each filter the best normalised overlap with one of the chain: a product of bit matrices, part by part."""
    best, p = np.zeros(len(own)), own.sum(1, dtype=np.float64)[:, None]
    for k in range(0, len(chain), STEP):
        other = _bits(chain[k : k + STEP])
        q, both = other.sum(1, dtype=np.float64)[None, :], (own @ other.T).astype(np.float64)
        chance, most = p * q / FILTER_BITS, np.minimum(p, q)
        same = (both == p) & (both == q)
        found = np.where(most > chance, (both - chance) / np.where(most > chance, most - chance, 1), same)
        best = np.maximum(best, found.max(1))
    return best


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy among all windows of all documents, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in chunks(offsets, GROUP_BYTES):
                at = offsets[first : last + 1] - offsets[first]
                own = data[offsets[first] : offsets[last]]
                if len(own) >= WINDOW:
                    total += np.bincount(entropy_bins(own)[inside(at)], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(total)], names=["bin", "n"])

    found = {r.bin: r.n for r in docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    count = np.array([found.get(b, 0) for b in range(BINS)])
    rank = np.empty(BINS, np.int64)
    rank[np.lexsort((np.arange(BINS), count))] = np.arange(BINS)
    return rank


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id and fingerprint, by given ranks or those of the documents themselves."""
    rank = rarity(docs) if rank is None else rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in chunks(offsets, GROUP_BYTES):
                at = offsets[first : last + 1] - offsets[first]
                made = chains(last - first, *features(data[offsets[first] : offsets[last]], at, rank))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array([text_of(c) for c in made], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _bucket(place: Column, bounds: list[tuple[int, int]]) -> Column:
    """The number of bounds (key, mark) not above place, found in two steps of about the square root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    number = lambda xs: F.size(F.filter(xs, lambda b: b <= place))
    one = lambda b: F.struct(F.lit(b[0]).cast("long").alias("key"), F.lit(b[1]).cast("long").alias("mark"))
    coarse = F.greatest(number(F.array(*(one(x[0]) for x in fine))) - 1, F.lit(0))
    return coarse * step + number(F.get(F.array(*(F.array(*map(one, x)) for x in fine)), coarse))


def _in_order(docs: DataFrame) -> DataFrame:
    """bucket, last, doc_id, text: buckets of documents in order, each followed by the document after its last, marked.

    The order is by id, then by a hash of the text, so many rows of one id do not meet in one bucket, and texts
    are no sort keys.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("mark"))
    parts = 4 * width(spark)
    ids = rows.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)])).first()[0]
    many = {k: n for k, n in Counter(ids or ()).items() if n > 1}  # an id of more than a bucket's rows is split by the mark
    bounds = [(k, -(1 << 63)) for k in sorted(set(ids or ()))]
    if many:
        found = rows.where(F.col("key").isin([*many])).groupBy("key").agg(F.percentile_approx("mark", [k / parts for k in range(1, parts)]).alias("marks")).collect()
        bounds += [(r.key, m) for r in found for m in set(r.marks[:: max(1, parts // many[r.key])])]
    place = F.struct("key", "mark")
    rows = rows.withColumn("bucket", _bucket(place, sorted(set(bounds))) if bounds else F.lit(0))
    firsts = sorted((r.bucket, tuple(r.place)) for r in rows.groupBy("bucket").agg(F.min(place).alias("place")).collect())
    if not firsts:
        return rows.select("bucket", F.lit(0).alias("last"), "key", "mark", "doc_id", "text")
    after = spark.createDataFrame([(b, *p, firsts[i - 1][0]) for i, (b, p) in enumerate(firsts)], "bucket int, key long, mark long, before int")
    heads = rows.join(F.broadcast(after), ["bucket", "key", "mark"]).groupBy("before").agg(F.min("text").alias("text"))
    none = F.lit(None).cast("long")
    heads = heads.select(F.col("before").alias("bucket"), F.lit(1).alias("last"), none.alias("key"), none.alias("mark"), none.alias("doc_id"), "text")
    both = rows.select("bucket", F.lit(0).alias("last"), "key", "mark", "doc_id", "text").unionByName(heads)
    return both.repartition(width(spark), "bucket").sortWithinPartitions("bucket", "last", "key", "mark")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next."""
    rank = rarity(docs)
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(kinds)
    reach = WINDOW + SPAN - 2  # a feature depends on the bytes up to this far after its first

    def some(rows: list[tuple[int, int | None, str]]) -> Iterator[pa.RecordBatch]:
        """rows: (marked, id, text), each followed by its next document; the last is only that."""
        n = len(rows)
        raw = [t.encode() for _, _, t in rows]
        heads, tails, whole = [], [], []
        for (_, _, text), (_, _, after) in zip(rows, rows[1:]):
            k = len(text) // 4
            head = text[: len(text) - k]
            edited = (head + after[:k]).encode()
            cut = len(head.encode())
            # Features before `keep` are those of the text itself; for the others the edited text is enough from `begin` on.
            keep = max(0, cut - reach)
            begin = max(0, keep - SPAN + 1)
            if min(len(edited), len(text.encode())) < WINDOW:
                keep = begin = 0
            heads.append((keep, begin))
            tails.append(edited[begin:])
            whole.append(hashlib.sha256(edited).hexdigest())
        data = np.frombuffer(b"".join([*raw, *tails]), np.uint8)
        row, place, h = features(data, np.cumsum([0, *map(len, raw), *map(len, tails)]), rank)
        keep, begin = (np.array([x[i] for x in heads], np.int64) for i in (0, 1))
        own = row < n
        shared = row < n - 1
        shared[shared] = place[shared] < keep[row[shared]]
        tail = row >= n
        moved = place[tail] + begin[row[tail] - n]
        later = moved >= keep[row[tail] - n]
        made = chains(n, row[own], place[own], h[own])
        again = chains(n - 1, np.concatenate([row[shared], row[tail][later] - n]), np.concatenate([place[shared], moved[later]]), np.concatenate([h[shared], h[tail][later]]))
        out = [(i, len(t), whole[k], text_of(made[k]), text_of(again[k]), likeness(made[k], again[k]), likeness(made[k], made[k + 1])) for k, (marked, i, t) in enumerate(rows[:-1]) if not marked]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for marked, i, text in zip(batch.column("last").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                rows.append((marked, i, text.as_py()))
                held += len(rows[-1][2])
                if held >= GROUP_BYTES and len(rows) > 1:
                    yield from some(rows)
                    rows, held = rows[-1:], len(rows[-1][2])
        if len(rows) > 1:
            yield from some(rows)

    return _in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
