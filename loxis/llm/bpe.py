"""BPE encoding and decoding over a distinct-word table.

Documents are split into pre-tokens in the executors, each distinct word is encoded once, the ids are joined
back by position, and decoding looks each id up in the table of pieces.

Defined cases: a null text is encoded like the empty one (no ids, empty decoded text); repeated rows and
null ids give a row each; an empty table gives no rows; other columns of the input are not read; a vocabulary whose
tokenizer is not a plain byte-level one is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .blocks import answer, answers_of, in_code_order, make_blocks, meet
from .common import pack, unpack

#: Fixed value: how byte-level BPE of this family splits text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids are encoded at a time, and words of documents that are joined at a time.
CACHE_WORDS, JOIN_WORDS = 1 << 20, 1 << 18


def _refuse_others(told: dict) -> None:
    """Words are split by PATTERN and pieces spelt by bytes here: a tokenizer that does otherwise would get wrong ids."""
    split, spell = told["pre_tokenizer"] or {}, told["decoder"] or {}
    wrong = [
        told["normalizer"] is not None and "a normalizer",
        (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True) and "another pre-tokenizer than byte-level without a prefix space",
        spell.get("type") != "ByteLevel" and "another decoder than byte-level",
        told["model"].get("type") != "BPE" and "another model than BPE",
        any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]) and "added tokens that take blanks or are words only",
    ]
    if any(wrong):
        raise ValueError("this tokenizer has " + ", ".join(w for w in wrong if w))


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    _refuse_others(json.loads(found.to_str()))
    found.no_truncation()
    found.no_padding()
    return found


@cache
def _splitter(path: str):
    tok = _tokenizer(path)
    words = regex.compile(PATTERN).findall
    # Letters and digits that are newer than the tokenizer's own tables: texts with them are split by the tokenizer itself.
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    newer = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    odd = np.zeros(0x110000, bool)
    odd[newer] = True
    least = min(newer, default=0x110000)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def plain(text: str) -> list[str]:
        if not text.isascii() and (points := np.frombuffer(text.encode("utf-32-le"), "<u4")).max() >= least and odd[points].any():
            return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]
        return words(text)

    def split(text: str) -> list[str]:
        if special is None or not special.search(text):
            return plain(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + plain(text[at:])

    return split


@cache
def _pieces(path: str) -> tuple[pa.Array, pa.Array]:
    """By id: the bytes of its piece, and its decimal with a comma."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    tok = _tokenizer(path)
    table = []
    for i in range(tok.get_vocab_size()):
        piece = tok.id_to_token(i) or ""
        table.append(bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode())
    return pa.array(table, pa.large_binary()), pa.array([b"%d," % i for i in range(len(table))], pa.large_binary())


def _lookup(table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """Join ids to the table and cut the joined bytes at ends, counted in ids."""
    found = table.take(pa.array(ids))
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data, at = memoryview(found.buffers()[2] or b""), 0
    for end in offsets[ends]:
        yield bytes(data[at:end])
        at = end


def text_of(ids, path: str) -> str:
    """The decoded text of one list of ids."""
    ids = np.asarray(ids, np.int64)
    return next(_lookup(_pieces(path)[0], ids, np.array([len(ids)]))).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encode docs (doc_id, text) and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, and the ids themselves if with_ids.
    """

    def split(text: str) -> list[str]:
        return _splitter(vocabulary)(text)

    _tokenizer(vocabulary)

    def reply(bucket: int, rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
        tok, known = _tokenizer(vocabulary), {}
        kind = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32
        for block, data in rows:
            words = unpack(data)["words"]
            if len(known) > CACHE_WORDS:
                known = {}
            new = [w for w in words if w not in known]
            for w, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False)):
                known[w] = np.array(e.ids, kind).tobytes()
            ids = [known[w] for w in words]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(kind).itemsize
            yield block, bucket, pack((sizes.astype(np.uint32), np.frombuffer(b"".join(ids), kind)))

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)

    def finish(docs: dict, got: dict) -> Iterator[pa.RecordBatch]:
        pieces, digits = _pieces(vocabulary)
        parts = answers_of(got)
        sizes = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in parts)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint16), *(i for _, i in parts)])
        size, start = in_code_order(docs["bucket"], sizes), in_code_order(docs["bucket"], np.cumsum(sizes) - sizes)
        ends = np.cumsum(docs["n_words"])
        first = 0
        while first < len(ends):
            begin = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + JOIN_WORDS)))
            codes = docs["codes"][begin : ends[last - 1]]
            each = size[codes]
            total = np.cumsum(each)
            ids = flat[np.repeat(start[codes] - (total - each), each) + np.arange(total[-1] if len(total) else 0)].astype(np.int32)
            cut = np.concatenate([[0], total])[ends[first:last] - begin]
            out = {"doc_id": docs["doc_id"][first:last], "n_tokens": np.diff(cut, prepend=0)}
            out["ids_sha256"] = [hashlib.sha256(x[:-1]).hexdigest() for x in _lookup(digits, ids, cut)]
            out["decoded_sha256"] = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in _lookup(pieces, ids, cut)]
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cut]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            first = last

    blocks = make_blocks(docs, ["doc_id"], split, "bpe")
    answers = answer(blocks, reply)
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return meet(blocks, answers, finish, kinds)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Decode (doc_id, ids array<int>) to (doc_id, text); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(batch.column("ids"))
            flat, each = np.asarray(ids.flatten()), np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
            texts = [x.decode("utf-8", "replace") for x in _lookup(_pieces(vocabulary)[0], flat, np.cumsum(each))]
            texts = [t if ok else None for t, ok in zip(texts, ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
