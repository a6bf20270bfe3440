"""Encoding a corpus with a public byte-pair vocabulary.

The text is cut by the vocabulary's published pattern; every piece is merged with
a segment tree over its byte positions.  A leaf holds the rank of the pair that
starts at that byte, an inner node the smaller of its children, the left one on a
tie, so the root tells the leftmost pair of least rank in O(log n), and a merge
updates the leaves of the two live neighbours only.  A piece of a million letters
thus costs n log n, where a scan per merge would be quadratic.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabulary files lie; a parameter everywhere below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a Python worker; beyond that the memory is emptied.
MEMO_PIECES = 200_000
_NONE = 1 << 60


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece, by leftmost-least-rank merges."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NONE)
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n))  # start of the token before
    while (least := tree[1]) != _NONE:
        node = 1
        while node < size:
            node = 2 * node if tree[2 * node] == least else 2 * node + 1
        i = node - size
        j = end[i]
        stop = end[i] = end[j]
        changed = [(j, _NONE)]
        if stop < n:
            before[stop] = i
            changed.append((i, get(piece[i : end[stop]], _NONE)))
        else:
            changed.append((i, _NONE))
        h = before[i]
        if h >= 0:
            changed.append((h, get(piece[h:stop], _NONE)))
        for at, rank in changed:
            node = size + at
            tree[node] = rank
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                value = left if left <= right else right
                if tree[node] == value:
                    break
                tree[node] = value
                node >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Ids of texts; remembers the pieces it has merged."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        self.ranks = load_ranks(data)
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo = self.memo
        pieces = self.find(text)
        found = list(map(memo.get, pieces))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    piece = pieces[k]
                    ids = memo.get(piece)
                    if ids is None:
                        ids = merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
                        if len(memo) >= MEMO_PIECES:
                            memo.clear()
                        if len(piece) <= 64:
                            memo[piece] = ids
                    found[k] = ids
        return list(chain.from_iterable(found))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder(data: bytes, pattern: str = PATTERN) -> Encoder:
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data, pattern)
    return _ENCODERS[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of every row; no special tokens.

    A null and an empty text both give an empty list.  Rows are mapped one for one
    without any shuffle, so repeated rows and any sizes are kept; other columns,
    whatever their names, are not read.  The vocabulary (under 1 MB) is read by
    the driver and broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            rows = [enc.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, columns: list[str], text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``columns`` plus n_tokens of ``text``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = documents.select(*columns).schema
    names = [*columns, "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            counts = pa.array([len(enc.encode(t)) for t in batch.column(len(columns)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], counts], names=names)

    return documents.select(*columns, text).mapInArrow(run, schema.add("n_tokens", "long"))
