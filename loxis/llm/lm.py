"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of pairs of words go to a filter: an n-gram of count c is entered under the numbers 1, 2, ...
up to its quantised log frequency, and is read back by probing those numbers until one is missing. Every one of
the training documents is entered, whatever the size of the corpus. The filter is in segments by bucket of words
or pairs, each made and probed in the task where the bucket's n-grams meet, which answers each block's distinct
ones in their order; so no task holds more of it than one segment. The base score has exact counts of words.

The score of a token mixes, by what the probes tell, the share of its pair in the history with the word's own
discounted probability. The discounted mass goes to as many unknown words as there are known ones.

Defined cases: a null or empty text has only the end token; a null id counts as the empty text for the fold;
without training documents every token is unknown, of probability 1 in both models; repeated rows give a row
each and are each learned from; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answer, answers_of, from_planes, in_code_order, make_blocks, meet, planes
from .common import crc_text, pack, staged, unpack
from .textops import mix

END = b"\n"
#: Base of the quantised log, bits of the filter for each entry, probes for each.
BASE, BITS, PROBES = 1.5, 10, 5
#: Weight of the pair's share.
LAMBDA = 0.2
_START, _K, _STEP, _LOW48 = (np.uint64(x) for x in (0x51ED270B7A2C9D35, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, (1 << 48) - 1))


def word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & _LOW48


def pair_hash(codes: np.ndarray, own: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """For each token, 48 bits of its pair with the token before it, or with the start of the document."""
    now = own[codes]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[np.cumsum(n_words) - n_words] = _START
    return mix(mix(before * _K + now) * _K) >> np.uint64(16)


def bucket_of(pair: np.ndarray, parts: int) -> np.ndarray:
    return ((pair >> np.uint64(24)) * np.uint64(parts)) >> np.uint64(24)


def _summed(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pair)
    pair = pair[order]
    first = np.flatnonzero(np.diff(pair, prepend=pair[:1] + np.uint64(1)))
    return pair[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def times_of(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(level > 0, BASE ** (level - 1.0), 0)


class Segment:
    """A part of the filter: the words or pairs of one bucket."""

    def __init__(self, size: int, bits: np.ndarray):
        self.size, self.bits = size, bits

    @staticmethod
    def cell(pair: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
        h = mix(pair * _K + np.uint64((level * PROBES + probe) * int(_STEP) % (1 << 64)))
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, pair: np.ndarray, n: np.ndarray, bits: int = BITS) -> Segment:
        level = np.floor(np.log(n) / math.log(BASE) + 1e-9).astype(np.int64) + 1
        size = max(64, int(level.sum()) * bits)
        cells = np.zeros(-(-size // 8), np.uint8)
        for i in range(1, int(level.max(initial=0)) + 1):
            for k in range(PROBES):
                h = cls.cell(pair[level >= i], i, k, size)
                np.bitwise_or.at(cells, h >> 3, np.uint8(1) << (h & 7).astype(np.uint8))
        return cls(size, cells)

    def levels(self, pair: np.ndarray) -> np.ndarray:
        """Probe 1, 2, ... for each pair until one is missing."""
        out, on, i = np.zeros(len(pair), np.int64), np.arange(len(pair)), 1
        while len(on):
            for k in range(PROBES):
                h = self.cell(pair[on], i, k, self.size)
                on = on[(self.bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1]
            out[on] = i
            i += 1
        return out


def lm_scores(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. bits: of the filter, for each entry."""

    def split(text: str) -> list[bytes]:
        return [*text.encode().lower().split(), END]

    def extra(words: list[bytes], codes: np.ndarray, kept: dict, parts: int):
        sizes = np.array(kept["n_words"])
        train = np.repeat(~np.array(kept["held_out"], bool), sizes)
        seen = np.bincount(codes[train], minlength=len(words))
        pair, n = _summed(pair_hash(codes, word_hash(words), sizes), train.astype(np.int64))
        ends = np.searchsorted(bucket_of(pair, parts), np.arange(parts + 1))

        def of_bucket(b: int) -> bytes | None:
            own = slice(ends[b], ends[b + 1])
            if ends[b] == ends[b + 1]:
                return None
            step = np.diff(pair[own], prepend=np.uint64(0))
            return pack((planes((step & np.uint64(0xFFFFFFFF)).astype(np.uint32)), (step >> np.uint64(32)).astype(np.uint16), n[own].astype(np.uint32)))

        return (lambda mine: {"seen": seen[mine]}), of_bucket

    def count(bucket: int, told: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
        total: dict[bytes, int] = defaultdict(int)
        rows = [*told]
        for _, data in rows:
            row = unpack(data)
            for w, n in zip(row["words"], row["seen"].tolist()):
                total[w] += n
        seen = np.fromiter(total.values(), np.int64, len(total))
        found, own = seen[seen > 0], word_hash([*total])
        filter = Segment.build(own[seen > 0], found, bits)
        for block, data in rows:
            words = unpack(data)["words"]
            h = word_hash(words)
            yield block, bucket, pack((np.fromiter((total[w] for w in words), np.int64, len(words)), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16), filter.levels(h).astype(np.uint8)))
        told = float(times_of(filter.levels(own[seen > 0])).sum())
        yield None, bucket, pack((len(found), int(found.sum()), int((found == 1).sum()), int((found == 2).sum()), told))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.pmod(crc_text("doc_id"), F.lit(7)) == 2).alias("held_out"), "text")
    blocks = make_blocks(own, ["doc_id", "held_out"], split, "lm", extra)
    counts = staged(answer(blocks, count), "counts")
    stats = [unpack(r.answer) for r in counts.where("block is null").select("answer").collect()]
    types, tokens, once, twice = (sum(x[k] for x in stats) for k in range(4))
    mass = math.fsum(x[4] for x in stats)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def enter(bucket: int, given: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
        rows = [*given]

        def told(data: bytes) -> tuple[np.ndarray, np.ndarray]:
            low, high, k = unpack(data)
            return np.cumsum((high.astype(np.uint64) << np.uint64(32)) | from_planes(low), dtype=np.uint64), k.astype(np.int64)

        pair, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for _, data in rows:
            waiting.append(told(data))
            if sum(len(p) for p, _ in waiting) > max(1 << 20, len(pair)):
                pair, n = _summed(np.concatenate([pair, *(p for p, _ in waiting)]), np.concatenate([n, *(k for _, k in waiting)]))
                waiting = []
        pair, n = _summed(np.concatenate([pair, *(p for p, _ in waiting)]), np.concatenate([n, *(k for _, k in waiting)]))
        level = Segment.build(pair[n > 0], n[n > 0], bits).levels(pair).astype(np.uint8)
        for block, data in rows:
            yield block, parts + bucket, pack(level[np.searchsorted(pair, told(data)[0])])

    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(kept: dict, got: dict) -> Iterator[pa.RecordBatch]:
        replies = answers_of({b: x for b, x in got.items() if b < parts})
        seen = in_code_order(kept["bucket"], np.concatenate([x[0] for x in replies]))
        h = in_code_order(kept["bucket"], np.concatenate([x[1].astype(np.uint64) | (x[2].astype(np.uint64) << np.uint64(32)) for x in replies]))
        sizes, codes = np.array(kept["n_words"]), kept["codes"]
        first = np.cumsum(sizes) - sizes
        base_word = np.log10((seen + 1) / (tokens + 1 * (types + 1)))
        times = times_of(in_code_order(kept["bucket"], np.concatenate([x[3] for x in replies])).astype(np.int64))
        one_word = np.where(times > 0, times - discount, discount) / mass if tokens else np.ones(len(seen))
        _, back = np.unique(pair_hash(codes, h, sizes), return_inverse=True)
        level = np.concatenate(answers_of({b: x for b, x in got.items() if b >= parts}))[back].astype(np.int64)
        history = np.empty(len(codes))
        history[1:] = times[codes[:-1]]
        history[first] = times[codes[first + sizes - 1]]  # the end of a document stands for the start of the next
        share = np.minimum(1, times_of(level) / np.maximum(history, 1))
        p = LAMBDA * share + (1 - LAMBDA) * one_word[codes]
        known = np.add.reduceat((seen[codes] > 0).astype(np.int64), first)
        columns = [kept["doc_id"], kept["held_out"], sizes, known, np.full(len(sizes), tokens), np.add.reduceat(base_word[codes], first), np.add.reduceat(np.log10(p), first)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    answers = counts.where("block is not null").unionByName(answer(blocks, enter, "more"))
    return meet(blocks, answers, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
