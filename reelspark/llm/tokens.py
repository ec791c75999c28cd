"""Encoding of the whole corpus with a public tokenizer (problem 8).

Method: monoid tree reduction.  A text is halved until the pieces are short;
the pieces are encoded; neighbours are joined bottom-up.  A byte-level BPE
never merges across the boundary of two pre-tokens, so a join only re-encodes
a window around the seam.  The window grows to both sides until it ends at
places where every context has a pre-token boundary: after a letter or digit
that is followed by a character of another class, and before white space that
follows another character.  Left of the first such place and right of the
second the token ids are proven not to change; if there is none, the window
grows to the whole text.  Decoding is the concatenation up the tree.

Defined results: a null and an empty text both give an empty list; strings
that spell a special token are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The folder with the vocabulary files.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Texts up to this many characters are one piece.
LEAF = 4096

# Fixed value: the pre-token pattern of this vocabulary, from the tokenizers' README.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A place with a pre-token boundary in every context.
_HARD = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201
    """The encoder of a ``.tiktoken`` file; one per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return f"{folder or TOKENIZER_DIR}/{name}.tiktoken"


def _left(text: str, start: int, seam: int) -> int:
    """The last certain boundary in (start, seam), judged from text[start:seam] alone; start if there is none."""
    size = 64
    while True:
        lo = max(start, seam - size)
        at = [m.start() for m in _HARD.finditer(text, lo, seam) if lo < m.start() < seam]
        if at:
            return at[-1]
        if lo == start:
            return start
        size *= 2


def _right(text: str, seam: int, end: int) -> int:
    """The first certain boundary in (seam, end), judged from text[seam:end] alone; end if there is none."""
    size = 64
    while True:
        hi = min(end, seam + size)
        at = next((m.start() for m in _HARD.finditer(text, seam, hi) if seam < m.start() < hi), None)
        if at is not None:
            return at
        if hi == end:
            return end
        size *= 2


def encode_tree(text: str, leaf: int, encode) -> np.ndarray:  # noqa: ANN001
    """Token ids of ``text`` by halving, encoding and joining; ``encode`` maps a string to an array of ids."""

    def node(a: int, b: int) -> np.ndarray:
        if b - a <= leaf:
            return encode(text[a:b])
        m = (a + b) // 2
        left, right = node(a, m), node(m, b)
        p, q = _left(text, a, m), _right(text, m, b)
        cut_left, cut_right = len(encode(text[p:m])), len(encode(text[m:q]))
        return np.concatenate([left[: len(left) - cut_left], encode(text[p:q]), right[cut_right:]])

    return node(0, len(text))


def _encoder(path: str):  # noqa: ANN202
    core = encoding(path)._core_bpe

    def encode(t: str) -> np.ndarray:
        return np.frombuffer(core.encode_to_tiktoken_buffer(t, set()), dtype=np.uint32)

    return encode


def encode_documents(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, leaf: int = LEAF, counts_only: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` with ``ids`` (or only ``n_tokens``)."""
    from pyspark.sql import types as T

    path = path or vocabulary()
    last = T.StructField("n_tokens", T.IntegerType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    rows = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        none = np.empty(0, np.uint32)
        for b in batches:
            parts = [encode_tree(t, leaf, encode) if t else none for t in b.column(b.num_columns - 1).to_pylist()]
            sizes = np.fromiter(map(len, parts), np.int32, len(parts))
            if counts_only:
                out = pa.array(sizes, pa.int32())
            else:
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.concatenate([none, *parts]).view(np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], last.name])

    return rows.mapInArrow(run, schema)


def decode(ids: list[int], path: str | None = None) -> bytes:
    """The bytes of a list of ids."""
    return encoding(path or vocabulary()).decode_bytes([int(i) for i in ids])
