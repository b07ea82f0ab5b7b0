"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, a gated attention learned from the labels of whole
documents weighs the passages, and the weighted sum is scored. Inputs are the bytes of the text alone.

Defined cases: a null text is scored as the empty one, which has one empty passage; of labels of the same
document the mean decides, a tie for 1; labels of null quality are not used; with labels of one class only,
or none, every score is the class (0.5 if none); repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_text
from .textops import SOLID, chunks, utf8, words

PASSAGE_WORDS, GRAMS = 48, 32
#: Labelled documents of each class to learn from, and passages of each, evenly spaced, at most: the bound of the sample that reaches the driver.
SAMPLE, SAMPLE_PASSAGES = 1000, 256
THRESHOLD = 0.3
CODE, GATE, STEPS, RATE = 16, 8, 150, 0.03
CLASSES = 12


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, 11, np.uint8)
    groups = [range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,;:", b"!?", b"|", b"#$%&*", b"-_/\\<>{}[]()=+~^`", range(128, 256)]
    for k, group in enumerate(groups):
        kind[list(group)] = k
    gram = np.random.default_rng(11).integers(0, GRAMS, 1 << 16, dtype=np.uint8)
    return kind, gram


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and by row the number of passages up to its end."""
    kind, gram = _tables()
    w = words(data, offsets, SOLID)
    n_words = np.diff(w.ends, prepend=0)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    ends = np.cumsum(n_pass)
    total = int(ends[-1]) if len(ends) else 0
    row_of_word = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(w.start)) - (w.ends - n_words)[row_of_word]
    of_word = (ends - n_pass)[row_of_word] + place // PASSAGE_WORDS
    # Bytes belong to the passage of the word that they are in or follow; those before a row's first word to its first passage.
    first = np.flatnonzero(np.diff(of_word, prepend=-1))
    begin = np.zeros(total, np.int64)
    begin[of_word[first]] = w.start[first]
    begin[ends - n_pass] = offsets[:-1]
    of_byte = np.repeat(np.arange(total), np.diff(np.append(begin, len(data))))
    counts = np.bincount(of_byte * CLASSES + kind[data], minlength=total * CLASSES)[: total * CLASSES].reshape(total, CLASSES)
    if len(data) > 1:
        two = (data[:-1].astype(np.int32) << 8) | data[1:]
        inside = np.ones(len(data), bool)  # a row's last byte and the next row's first are no pair
        inside[offsets[1:][np.diff(offsets) > 0] - 1] = False
        grams = np.bincount((of_byte * GRAMS)[:-1][inside[:-1]] + gram[two][inside[:-1]], minlength=total * GRAMS).reshape(total, GRAMS)
    else:
        grams = np.zeros((total, GRAMS))
    size = np.maximum(counts.sum(1), 1)
    in_words = np.bincount(of_word, minlength=total)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((w.hash, of_word))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    per = np.maximum(in_words, 1)
    own = [
        np.log1p(in_words), np.bincount(of_word, weights=w.end - w.start, minlength=total) / per / 10,
        np.bincount(of_word, weights=again, minlength=total) / per, np.bincount(of_word[order], weights=fresh, minlength=total) / per,
    ]
    return np.column_stack([counts / size[:, None], grams / size[:, None], *own]), ends


def _forward(x: np.ndarray, first: np.ndarray, p: dict) -> dict:
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    e = np.tanh(x @ p["we"] + p["be"])
    t, g = np.tanh(e @ p["v"]), 1 / (1 + np.exp(-np.clip(e @ p["u"], -30, 30)))
    s = (t * g) @ p["w"]
    a = np.exp(s - np.maximum.reduceat(s, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * e, first)
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
    return {"bag": bag, "e": e, "t": t, "g": g, "a": a, "z": z, "y": y}


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict:
    """Full-batch Adam on balanced classes. first: where each bag begins among the rows of x."""
    if len(set(label.tolist())) < 2:
        return {"constant": float(label[0]) if len(label) else 0.5}
    rng = np.random.default_rng(3)
    mean, std = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / std, -6, 6)
    d = x.shape[1]
    p = {"we": rng.normal(0, d**-0.5, (d, CODE)), "be": np.zeros(CODE), "v": rng.normal(0, CODE**-0.5, (CODE, GATE)), "u": rng.normal(0, CODE**-0.5, (CODE, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, CODE**-0.5, CODE), "b": np.zeros(1)}
    m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    for step in range(1, STEPS + 1):
        f = _forward(x, first, p)
        dy = (f["y"] - label) * weight
        dz = dy[:, None] * p["c"]
        of = f["bag"]
        ds = f["a"] * ((f["e"] - f["z"][of]) * dz[of]).sum(1)
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        de = (f["a"][:, None] * dz[of] + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["e"] ** 2)
        grad = {"we": x.T @ de, "be": de.sum(0), "v": f["e"].T @ dt, "u": f["e"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "b": dy.sum(keepdims=True)}
        for k, q in p.items():
            g = grad[k] + 1e-4 * q
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            q -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "std": std}


def score(data: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    rows = len(offsets) - 1
    if "constant" in model or not rows:
        return np.full(rows, model.get("constant", 0.5))
    x, ends = passages(data, offsets)
    x = np.clip((x - model["mean"]) / model["std"], -6, 6)
    return _forward(x, np.concatenate([[0], ends[:-1]]), model)["y"]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most sample labelled documents of each class, those whose id hashes lowest."""
    marked = labels.where("quality is not null and doc_id is not null").where(F.pmod(crc_text("doc_id"), F.lit(5)) != 0)
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = [r for k in (0, 1) for r in marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not chosen:
        return fit(np.zeros((0, 1)), np.zeros(0, int), np.zeros(0, int))
    few = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in chunks(offsets):
                x, ends = passages(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                cut = np.concatenate([[0], ends])
                rows = [x[a + (np.arange(n) * (b - a)) // n].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:]) for n in [min(b - a, SAMPLE_PASSAGES)]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), batch.column("label").slice(first, last - first), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    bags = sorted(texts.mapInArrow(run, "doc_id long, label int, x binary").collect())
    if not bags:
        return fit(np.zeros((0, 1)), np.zeros(0, int), np.zeros(0, int))
    width = CLASSES + GRAMS + 4
    x = [np.frombuffer(r.x, np.float32).reshape(-1, width) for r in bags]
    first = np.cumsum([0, *map(len, x)])[:-1]
    return fit(np.concatenate(x).astype(np.float64), first, np.array([r.label for r in bags]))


def classify(docs: DataFrame, labels: DataFrame, keep_good: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """Score docs (doc_id, text) by labels (doc_id, quality).

    Returns doc_id, held_out, score and predicted; with keep_good instead the rows of docs, with all their
    columns, that are predicted 1.
    """
    model = learn(docs, labels)

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = utf8(batch.column("text"))
        parts = [score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model) for a, b in chunks(offsets)]
        return np.concatenate([np.zeros(0), *parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = scores(batch)
            if keep_good:
                yield batch.filter(pa.array(y >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(y), pa.array((y >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    if keep_good:
        return docs.mapInArrow(run, docs.schema)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.pmod(crc_text("doc_id"), F.lit(5)) == 0).alias("held_out"), "text")
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
