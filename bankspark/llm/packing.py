"""Best-fit packing by patterns and non-negative least squares.

Pieces of token sequences are packed by length only: their histogram (one count per possible
length, so of a fixed size whatever the corpus) is fitted by patterns of up to three lengths that
fill a sequence exactly. Repeat counts come from non-negative least squares, are rounded, and what
is left over is packed best-fit decreasing, still as counts. Each piece then finds its place from
its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bankspark.session import cut_lineage

CACHE_WORDS = 1_000_000  # distinct words that a Python worker remembers
SLICE_BYTES = 4 << 20


class WordEncoder:
    """Token ids of white-space separated words, each distinct word encoded once.

    The tokenizer drops white space and never joins characters across it, so a text's ids are
    those of its words in turn. Words of plain Latin letters are cut by the vocabulary's own
    pattern and encoded by its merges; any other word goes through the whole tokenizer.
    """

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in own]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.clear()

    def clear(self) -> None:
        self.place = {b"": 0}  # the empty word ends a document: id 0
        self.flat, self.start = array("I", [0]), array("q", [0, 1])
        self.known: dict[str, list[int]] = {}  # by piece
        self.arrays = None

    def _ids(self, word: bytes) -> list[int]:
        text = word.decode()
        if "<|" in text or max(text) >= "ɐ":
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        text = text.lower()
        if text.isalpha():
            pieces = [text]
        elif text[:-1].isalpha() and not text[-1].isspace():
            pieces = [text[:-1], text[-1]]
        else:
            pieces = self.PIECES.findall(text)
        ids: list[int] = []
        for piece in pieces:
            got = self.known.get(piece)
            if got is None:
                letters = piece.encode().decode("latin-1").translate(self.letters)
                got = self.known[piece] = [t.id for t in self.tokenizer.model.tokenize(letters)]
            ids += got
        return ids

    def encode(self, documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, 0 after each document, and the place after each document's last id."""
        words: list[bytes] = []
        ends = np.empty(len(documents), np.int64)
        for k, document in enumerate(documents):
            words += (document if b"<|" in document else document.lower()).split()
            words.append(b"")
            ends[k] = len(words)
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS:
            self.clear()
            new = set(words).difference(self.place)
        for word in new:
            self.place[word] = len(self.place)
            self.flat.extend(self._ids(word))
            self.start.append(len(self.flat))
        if new or self.arrays is None:
            self.arrays = np.array(self.flat, np.uint32), np.array(self.start, np.int64)
        flat, start = self.arrays
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        first = start[at]
        size = start[at + 1] - first
        after = np.cumsum(size)
        ids = flat[np.repeat(first - (after - size), size) + np.arange(after[-1] if len(after) else 0)]
        return ids, after[ends - 1]


_encoders: dict[str, WordEncoder] = {}


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents' ids, id 0 at the end, cut where longer."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            lo = 0
            while lo < batch.num_rows:
                hi, size, part = lo, 0, []
                while hi < batch.num_rows and (hi == lo or size < SLICE_BYTES):
                    part.append((texts[hi].as_py() or "").encode())
                    size += len(part[-1])
                    hi += 1
                ids, ends = encoder.encode(part)
                ids = ids.astype("<u4")
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                begin = 0
                for key, end in zip(keys[lo:hi], ends.tolist(), strict=True):
                    for piece, at in enumerate(range(begin, end, capacity)):
                        to = min(at + capacity, end)
                        out["doc_id"].append(key)
                        out["piece"].append(piece)
                        out["start"].append(at - begin)
                        out["length"].append(to - at)
                        out["ids_crc32"].append(zlib.crc32(ids[at:to].tobytes()))
                    begin = end
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))
                lo = hi

    return documents.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill a sequence exactly with one to three of ``lengths``; 0 stands for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    longest = lengths[::-1]
    for a in longest[longest < capacity]:
        b = lengths[(lengths <= a) & (lengths <= capacity - a)]
        c = capacity - a - b
        ok = (c == 0) | ((c <= b) & there[c])
        if ok.any():
            found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _least_squares(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that make sum(x * pattern) come close to the histogram.

    Accelerated projected gradient; long lengths weigh more, since short leftovers still fill gaps.
    """
    n = len(histogram)
    weight = 0.1 + np.arange(n) / n
    weight[0] = 0
    use = lambda x: np.bincount(patterns.ravel(), np.repeat(x, 3), n)
    step_of = lambda r: (weight * r)[patterns].sum(axis=1)
    probe = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue, for the step size
        probe = step_of(use(probe))
        top = np.linalg.norm(probe)
        probe /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + step_of(histogram - use(y)) / (1.05 * top))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


#: Shares of the fitted repeat counts that are tried; the plan with the fewest sequences is used.
SHARES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.0)


def packing_plan(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, how often)] that uses each length as often as the histogram has it.

    With few documents per length, holding back a part of the fitted patterns leaves the residual
    the short lengths it needs to fill gaps.
    """
    histogram = histogram.astype(np.int64)
    patterns = _patterns(np.flatnonzero(histogram), capacity)
    if not len(patterns):
        return _best_fit(histogram, capacity)
    wanted = _least_squares(patterns, histogram.astype(float))
    order = np.lexsort((-wanted, -patterns[:, 0]))
    plans = (_rounded(patterns[order], share * wanted[order], histogram, capacity) for share in SHARES)
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _rounded(patterns: np.ndarray, wanted: np.ndarray, histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Whole repeat counts; what rounding cuts off goes to the next pattern with the same longest length."""
    left = histogram.tolist()
    carry = [0.0] * (capacity + 1)
    plan: list[tuple[list[int], int]] = []
    for (a, b, c), x in zip(patterns.tolist(), wanted.tolist(), strict=True):
        carry[a] += x
        if carry[a] < 0.5:
            continue
        lengths = [v for v in (a, b, c) if v]
        times = min(round(carry[a]), *(left[v] // lengths.count(v) for v in lengths))
        if times > 0:
            carry[a] -= times
            for v in lengths:
                left[v] -= times
            plan.append((lengths, times))
    return plan + _best_fit(np.array(left), capacity)


def _best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: free space -> [(lengths so far, how many such sequences)]."""
    free: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        count = int(histogram[length])
        for space in range(length, capacity):
            while count and free[space]:
                lengths, n = free[space].pop()
                take = min(n, count)
                if take < n:
                    free[space].append((lengths, n - take))
                free[space - length].append((lengths + [length], take))
                count -= take
            if not count:
                break
        if count:
            each = capacity // length
            if count >= each:
                free[capacity - each * length].append(([length] * each, count // each))
            if count % each:
                free[capacity - count % each * length].append(([length] * (count % each), 1))
    return [x for groups in free.values() for x in groups]


def _slots(plan: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, for rising ranks: first rank, first sequence and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used = [0] * (capacity + 1)
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            runs[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of a document.

    A document is its token ids and then id 0 (null or empty text: only id 0); only documents
    longer than ``capacity`` are cut. Sequences hold pieces without gaps from offset 0 and at most
    ``capacity`` tokens. Repeated rows, equal and null ids are packed like any others; rows that
    are equal in all columns may trade places. An empty table gives an empty result. Other columns
    are ignored.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = cut_lineage(token_pieces(source, tokenizer_path, capacity))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most capacity rows
        histogram[length] = n
    slots = _slots(packing_plan(histogram, capacity), capacity)
    sent = spark.sparkContext.broadcast(slots)  # bounded by the number of patterns, not by the corpus

    # Rank among pieces of equal length: groups of about the square root of all pieces are numbered
    # one by one, then shifted by what the groups before them hold.
    groups = max(1, int(histogram.sum() ** 0.5))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
        .select("length", "bucket", "before")
    )
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("row", F.row_number().over(order)).join(before, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                own = length == k
                first, start, at = sent.value[int(k)]
                run = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = start[run] + rank[own] - first[run]
                offset[own] = at[run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
