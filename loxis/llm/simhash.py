"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most four bits have, of three segments, one that differs in at most one; for a
distance d of other parameters it is one of d // 2 + 1. Each
segment is indexed under its values with one bit left out, so such fingerprints meet under an equal key, and
are verified there. Copies share a fingerprint and stand for themselves once; what meets under a key is
linked by a spanning forest when it is many, so a group of thousands makes no row for each pair.

Defined cases: a null or empty text, or one without words, has the fingerprint zero, which is linked like any
other; fewer words than a shingle make one shingle; a null id is passed over as the least of its component
unless there is no other; repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, width
from .components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Runs of equal keys up to this long are verified pair by pair, longer ones by a spanning forest.
SHORT = 16


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits): the least number of which one must differ in at most one bit."""
    n = distance // 2 + 1
    ends = [64 * k // n + (k * 64 % n > 0) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(sizes + 1) - sizes - 1
    end = start + sizes
    k = min(shingle, len(words))
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp): the 64 bits as a signed long; a third column of docs, a long `mark`, stays."""
    kept = ["doc_id", *docs.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(fp)], names=[*kept, "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kept[1:]).mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "fp"]))


def variants(fp: Column, distance: int = DISTANCE) -> Column:
    """One key for each bit of each segment: the segment's number and bit, and its value without that bit."""
    out, number = [], 0
    for first, bits in segments(distance):
        value = F.shiftrightunsigned(fp, first).bitwiseAND((1 << bits) - 1)
        for j in range(bits):
            rest = F.shiftleft(F.shiftright(value, j + 1), j).bitwiseOR(value.bitwiseAND((1 << j) - 1))
            out.append(rest.bitwiseOR(F.lit(number << 32)))
            number += 1
    return F.array(*out)


def _first_shared(x: np.ndarray, distance: int) -> np.ndarray:
    """Of fingerprints that differ in the bits x: the number of the first variant they share."""
    out = np.full(len(x), -1)
    for first, bits in reversed(segments(distance)):
        own = (x >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        one = np.bitwise_count(own) <= 1
        at = np.where(own == 0, 0, np.bitwise_count(own - np.uint64(1)))
        out = np.where(one, first + at, out)
    return out


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within one run."""
    out, rest = [], fp
    while len(rest):
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            p = waiting.pop()
            near = np.bitwise_count(rest ^ p) <= distance
            if near.any():
                out += [(int(p), int(q)) for q in rest[near]]
                waiting += list(rest[near])
                rest = rest[~near]
    return out


def _linked(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between equal keys; key is sorted."""
    begin = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    size = np.diff(np.append(begin, len(key)))
    us, vs = [], []
    short = np.repeat((size > 1) & (size <= SHORT), size)
    k, f = key[short], fp[short]
    for d in range(1, SHORT):
        x = f[d:] ^ f[:-d]
        hit = (k[d:] == k[:-d]) & (np.bitwise_count(x) <= distance)
        hit[hit] = _first_shared(x[hit], distance) == (k[d:][hit] >> 32)
        us.append(f[:-d][hit])
        vs.append(f[d:][hit])
    for a, n in zip(begin[size > SHORT], size[size > SHORT]):
        found = np.array(_forest(fp[a : a + n], distance), np.uint64).reshape(-1, 2)
        us.append(found[:, 0])
        vs.append(found[:, 1])
    return np.concatenate(us), np.concatenate(vs)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """distinct (fp) -> links (u, v) that connect all fingerprints within the distance of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key):
                u, v = _linked(key, fp, distance)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the run that may go on in the next batch
        for batch in batches:
            key, fp = (batch.column(c).to_numpy() for c in ("key", "fp"))
            fp = fp.view(np.uint64)
            if not len(key):
                continue
            if key[0] == key[-1] and held and held[0][0][0] == key[0]:
                held.append((key, fp))
                continue
            last = int(np.searchsorted(key, key[-1]))
            done = [*held, (key[:last], fp[:last])]
            yield from out(*(np.concatenate(x) for x in zip(*done)))
            held = [(key[last:], fp[last:])]
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held)))

    parts = width(distinct.sparkSession)
    dealt = distinct.select("fp").repartition(parts, "fp").select("fp", F.explode(variants(F.col("fp"), distance)).alias("key")).repartition(parts, "key")
    return dealt.sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _rooted(table: DataFrame, distance: int, **least: Column) -> DataFrame:
    """table (fp, ...) -> fp, what is asked for as the least of its rows, and the root of its component."""
    distinct = staged(table.groupBy("fp").agg(*(c.alias(name) for name, c in least.items())), "distinct")
    stars = components(links(distinct.select("fp"), distance))
    return distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", *least, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint and component_id, the least doc_id that it reaches by links."""
    table = staged(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    rooted = _rooted(table, distance, least=F.min("doc_id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    own = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return table.join(own, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The row of docs, with all its columns, that has the least id of its component, one for each component.

    A row is known by its id and a hash of its text, so rows of one id and different texts go each by its own
    component; of such rows in one component the one of least hash stays, of equal rows any one. Of the rows of
    null id of a component one stays too, the one of least hash.
    """
    table = fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), shingle)
    rooted = _rooted(table, distance, least=F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))), nameless=F.min(F.when(F.col("doc_id").isNull(), F.struct("doc_id", "mark"))))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"), F.min("nameless").alias("nameless"))
    name, mark = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("name"), F.xxhash64("text").alias("mark")
    chosen = least.select(F.inline(F.filter(F.array("least", "nameless"), lambda x: x.isNotNull()))).select(name, "mark")
    own = docs.select(F.struct("*").alias("row"), name, mark).join(chosen, ["name", "mark"], "left_semi")
    one = own.withColumn("n", F.row_number().over(Window.partitionBy("name", "mark").orderBy("row.text"))).where("n = 1")
    return one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
