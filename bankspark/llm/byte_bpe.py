"""Byte-level BPE over padded matrices of token ids.

Texts are split by the vocabulary's pattern. Distinct pieces become rows of matrices, one matrix per
length bucket and padded to the bucket's width. In each round every row merges its leftmost pair of
minimum rank, so that all live rows get shorter by one and the matrix is compacted; rows without a
pair in the vocabulary are done and leave. Ranks of pairs come from an open-addressing hash table.

Ranks must come from merges, as those of trained vocabularies do: a merged token then forms only
pairs of higher rank. Rows wider than ``LONG`` use that: one round merges all places of the row's
minimum rank, from left to right, which is what as many rounds of one merge each give.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_PIECES = 500_000  # distinct pieces that a Python worker remembers
SLICE_CHARS = 1 << 20  # characters of text split into pieces at once
MATRIX_CELLS = 1 << 22  # cells of one matrix; longer buckets are worked off in blocks of rows
LONG = 512
NONE = np.int32(2**31 - 1)  # rank of a pair that the vocabulary does not have

#: After a character that is no white space, no piece of the patterns used here goes on over a blank.
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")


def text_slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only where a blank follows a word."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class PairRanks:
    """Rank of the token that two neighbouring tokens form, by a hash table with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._home(key)
        while len(key):
            free = self.keys[at] == -1
            first = np.unique(at[free], return_index=True)[1]  # one entry takes a free slot, others go on
            chosen = np.flatnonzero(free)[first]
            self.keys[at[chosen]], self.values[at[chosen]] = key[chosen], value[chosen]
            left = np.ones(len(key), bool)
            left[chosen] = False
            key, value, at = key[left], value[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        shape, key = key.shape, key.ravel()
        at = self._home(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.values[at], NONE)
        open_ = np.flatnonzero((seen != key) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.pair_rank = PairRanks(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pad = max(ranks.values()) + 1
        self.token = [b""] * self.pad
        for token, rank in ranks.items():
            self.token[rank] = token
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start = array("i"), array("q", [0])
        self.arrays = None

    def _matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """The ids of each row after all merges; rows are padded with ``self.pad``."""
        done: list[np.ndarray | None] = [None] * len(ids)
        row = np.arange(len(ids))
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        while len(row):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), best] if rank.shape[1] else np.full(len(row), NONE)
            live = least != NONE
            if not live.all():
                for k in np.flatnonzero(~live):
                    done[row[k]] = ids[k][ids[k] != self.pad]
                row, ids, rank, best, least = row[live], ids[live], rank[live], best[live], least[live]
                if not len(row):
                    break
            at = np.arange(len(row))
            ids[at, best] = least
            keep = np.ones(ids.shape, bool)
            keep[at, best + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            keep = np.ones(rank.shape, bool)
            keep[at, best] = False
            rank = rank[keep].reshape(len(row), -1)
            inner = np.flatnonzero(best > 0)
            rank[inner, best[inner] - 1] = self.pair_rank(ids[inner, best[inner] - 1], ids[inner, best[inner]])
            inner = np.flatnonzero(best < rank.shape[1])
            rank[inner, best[inner]] = self.pair_rank(ids[inner, best[inner]], ids[inner, best[inner] + 1])
        return done

    def _long_row(self, ids: np.ndarray) -> np.ndarray:
        """The same for a matrix of one wide row: a round merges all places of the least rank."""
        rank = self.pair_rank(ids[:-1], ids[1:])
        while len(rank):
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            first = np.ones(len(at), bool)  # of places next to each other every second one is merged
            first[1:] = np.diff(at) > 1
            head = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            ids[at] = least
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            at = at - np.arange(len(at))
            near = np.concatenate([at - 1, at])
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.pair_rank(ids[near], ids[near + 1])
        return ids

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece (any bytes), by buckets of lengths up to 4, 8, 16, ..."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 4
        todo = np.argsort(lengths, kind="stable")
        while len(todo):
            n = np.searchsorted(lengths[todo], width, "right") if width <= LONG else len(todo)
            bucket, todo = todo[:n], todo[n:]
            if width > LONG:
                for k in bucket:
                    out[k] = self._long_row(self.byte_id[np.frombuffer(pieces[k], np.uint8)])
                break
            block = MATRIX_CELLS // width
            for lo in range(0, len(bucket), block):
                rows = bucket[lo : lo + block]
                ids = np.full((len(rows), width), self.pad, np.int32)
                ids[np.arange(width) < lengths[rows][:, None]] = self.byte_id[np.frombuffer(b"".join(pieces[k] for k in rows), np.uint8)]
                for k, found in zip(rows, self._matrix(ids), strict=True):
                    out[k] = found
            width *= 2
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the place after each text's last id."""
        parts, ends = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        total, k = 0, 0
        for own, slices in self._grouped(texts):
            pieces: list[str] = []
            at = []
            for text in slices:
                pieces += self.pattern.findall(text)
                at.append(len(pieces))
            ids, sizes = self._gather(pieces)
            parts.append(ids)
            after = np.concatenate([[0], np.cumsum(sizes)])
            for k, stop in zip(own, at, strict=True):  # a later slice of the same text moves its end on
                ends[k] = total + after[stop]
            total += int(after[-1])
        return np.concatenate(parts), ends

    @staticmethod
    def _grouped(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        own, slices, size = [], [], 0
        for k, text in enumerate(texts):
            for part in text_slices(text):
                own.append(k)
                slices.append(part)
                size += len(part)
                if size >= SLICE_CHARS:
                    yield own, slices
                    own, slices, size = [], [], 0
        if own:
            yield own, slices

    def _gather(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = list(set(pieces).difference(self.place))
        if len(self.place) + len(new) > CACHE_PIECES:
            self._clear()
            new = list(set(pieces))
        for piece, ids in zip(new, self.merge([p.encode() for p in new]), strict=True):
            self.place[piece] = len(self.place)
            self.flat.frombytes(np.ascontiguousarray(ids, np.int32).tobytes())
            self.start.append(len(self.flat))
        if new or self.arrays is None:
            self.arrays = np.array(self.flat, np.int32), np.array(self.start, np.int64)
        flat, start = self.arrays
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        size = start[at + 1] - start[at]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        return flat[np.repeat(start[at] - (after - size), size) + np.arange(total)], size

    def decode(self, ids: list[int | None]) -> bytes | None:
        """The bytes of the ids; None where one of them is not in the vocabulary."""
        if any(i is None or not 0 <= i < self.pad for i in ids):
            return None
        return b"".join(map(self.token.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """The vocabulary of a rank file (base64 token and rank a line), read once per process."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path, pattern] = ByteBpe(ranks, pattern)
    return _loaded[path, pattern]


def encode_texts(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the token ids of every whole text, without special tokens.

    A null or empty text has no ids (an empty array). Rows are worked on one by one: repeated rows
    and null ids give a row each, an empty table gives none. Other columns are ignored, whatever
    their names. ``path`` names the rank file on every worker.
    """
    source = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            ids, ends = bpe.encode(batch.column(1).fill_null("").to_pylist())
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return source.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids_column: str = "ids") -> DataFrame:
    """(row, decoded binary): each row's other columns as a struct, and the bytes that its ids stand for.

    Null ids, and ids that the vocabulary does not have, give null; no ids give no bytes.
    """
    others = [F.col(f"`{c}`") for c in encoded.columns if c != ids_column]
    source = encoded.select(F.struct(*others).alias("row"), F.col(f"`{ids_column}`").alias("ids"))
    schema = T.StructType([source.schema["row"], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            found = [None if not x.is_valid else bpe.decode(x.values.to_pylist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["row", "decoded"])

    return source.mapInArrow(run, schema)
