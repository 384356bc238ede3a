"""Benchmark decontamination with an FM-index per training shard.

The words of a shard of documents become a sequence over the words of the test phrases; a run of
words that no phrase has is one separator, since no phrase reaches across it. The shard's suffix
array gives its Burrows-Wheeler transform, kept in a wavelet matrix. Phrases are searched backwards
through the ranks of the matrix, occurrences are located by walking to sampled suffix positions, and
the found spans of a document are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.llm.rows import map_rows
from bankspark.llm.words import PLAIN_WORDS

SHARD_WORDS = 1 << 18
SAMPLE = 16  # every so many suffix positions are kept
PHRASE_BYTES = 4 << 20  # of test items that are searched, and broadcast, at a time


def plain_words(text: str | None) -> list[bytes]:
    """Words of a text: ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return (text or "").encode().translate(PLAIN_WORDS).split()


class Phrases:
    """Distinct test phrases over an alphabet of word numbers (from 1; 0 is the separator)."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(text)]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[i : i + size]), set()).add(item)
        self.items = [frozenset(v) for v in found.values()]
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.symbols = np.zeros((len(found), size), np.int64)
        for k, phrase in enumerate(found):
            self.symbols[k, : len(phrase)] = phrase


def suffix_array(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Positions of all suffixes in order; separators (0) count as distinct, in text order.

    Prefix doubling: only suffixes that still share their rank are sorted again.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64)
    stop = np.flatnonzero(symbols == 0)
    rank[stop] = np.arange(len(stop))
    rank[symbols > 0] += len(stop)  # unique separators come first
    bits = max(1, int(len(stop) + alphabet + 1).bit_length())
    take = max(1, 62 // bits)
    padded = np.zeros(n + take, np.int64)
    padded[:n] = rank + 1
    key = np.zeros(n, np.int64)
    for k in range(take):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    rank = _ranks(order, key[order])
    depth = take
    while True:
        sorted_rank = rank[order]
        same = np.zeros(n + 1, bool)
        same[1:-1] = sorted_rank[1:] == sorted_rank[:-1]
        open_at = np.flatnonzero(same[1:] | same[:-1])
        if not len(open_at):
            return order
        part = order[open_at]
        after = np.where(part + depth < n, rank[np.minimum(part + depth, n - 1)] + 1, 0)
        key = sorted_rank[open_at] * (n + 1) + after
        again = np.argsort(key, kind="stable")
        order[open_at] = part[again]
        # ranks are places of the first suffix of a tie, so ties keep their place in the order
        key = key[again]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        rank[order[open_at]] = open_at[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        depth *= 2


def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return rank


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit row per binary digit of the symbols."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            current = np.concatenate([current[~bit], current[bit]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs ahead of place ``before``."""
        lo, hi = np.zeros_like(before), before
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> level) & 1 == 1
            l1, h1 = self.ones[k][lo], self.ones[k][hi]
            lo, hi = np.where(one, self.zeros[k] + l1, lo - l1), np.where(one, self.zeros[k] + h1, hi - h1)
        return hi - lo


class FMIndex:
    """Backward search and location of phrases in one sequence that ends with a separator."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_array(symbols, alphabet)
        self.n = len(symbols)
        self.bwt = symbols[order - 1]  # the suffix at 0 takes the last symbol, a separator
        self.wavelet = WaveletMatrix(self.bwt, alphabet)
        counts = np.bincount(symbols, minlength=alphabet + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        kept = (order % SAMPLE == 0) | (self.bwt == 0)
        self.sample_rank = np.cumsum(kept) - kept
        self.kept = kept
        self.samples = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end row) of the suffix interval of each phrase that occurs."""
        which = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for step in range(phrases.shape[1]):
            at = lengths[which] - 1 - step
            going = at >= 0
            if not going.any():
                break
            symbol = phrases[which[going], at[going]]
            lo[going] = self.first[symbol] + self.wavelet.rank(symbol, lo[going])
            hi[going] = self.first[symbol] + self.wavelet.rank(symbol, hi[going])
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
            if not len(which):
                break
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled position, then counted forward."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.kept[rows])
        while len(going):
            symbol = self.bwt[rows[going]]
            rows[going] = self.first[symbol] + self.wavelet.rank(symbol, rows[going])
            steps[going] += 1
            going = going[~self.kept[rows[going]]]
        return self.samples[self.sample_rank[rows]] + steps


def _shard_hits(phrases: Phrases, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first word, end word) of all occurrences; ``words`` has a 0 after each document."""
    # of each run of separators one stays; a document ends with one in any case
    stay = np.ones(len(words), bool)
    stay[1:] = (words[1:] > 0) | (words[:-1] > 0)
    symbols, origin = words[stay], np.flatnonzero(stay)
    if not symbols.any():
        return (np.zeros(0, np.int64),) * 3
    index = FMIndex(symbols, len(phrases.vocabulary))
    which, lo, hi = index.search(phrases.symbols, phrases.lengths)
    if not len(which):
        return (np.zeros(0, np.int64),) * 3
    times = hi - lo
    phrase = np.repeat(which, times)
    rows = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
    start = origin[index.locate(rows)]
    return phrase, start, start + phrases.lengths[phrase]


def _shards(texts: pa.Array, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word numbers with a 0 after each row, places of these zeros) of shards of rows."""
    row, first, parts, ends, total = 0, 0, [], [], 0
    while row < len(texts):
        words = (texts[row].as_py() or "").encode().translate(PLAIN_WORDS).split()
        own = np.zeros(len(words) + 1, np.int64)
        own[:-1] = np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int64, len(words))
        parts.append(own)
        total += len(own)
        ends.append(total - 1)
        row += 1
        if total >= SHARD_WORDS or row == len(texts):
            yield first, np.concatenate(parts), np.array(ends)
            first, parts, ends, total = row, [], [], 0


def _find(columns: list[pa.Array], phrases: Phrases) -> list[pa.Array]:
    texts, old_spans, old_items = columns[0], columns[1].to_pylist(), columns[2].to_pylist()
    n_words, spans, items = [], [], []
    for first, words, ends in _shards(texts, phrases):
        begins = np.concatenate([[0], ends[:-1] + 1])
        n_words += (ends - begins).tolist()
        phrase, start, stop = _shard_hits(phrases, words, ends)
        row = np.searchsorted(ends, start)
        found: dict[int, tuple[list, set]] = {}
        for r, p, s, e in zip(row.tolist(), phrase.tolist(), start.tolist(), stop.tolist(), strict=True):
            own = found.setdefault(r, ([], set()))
            own[0].append((s - int(begins[r]), e - int(begins[r])))
            own[1].update(phrases.items[p])
        for r in range(len(ends)):
            more, names = found.get(r, ((), ()))
            before = [(x["start"], x["end"]) for x in old_spans[first + r] or ()]
            merged: list[list[int]] = []
            for s, e in sorted([*before, *more]):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            spans.append([{"start": s, "end": e} for s, e in merged])
            items.append(sorted({*(old_items[first + r] or ()), *(str(x) for x in names if x is not None)}))
    span = pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))
    return [pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]


def with_benchmark_hits(
    documents: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    phrase_bytes: int = PHRASE_BYTES,
) -> DataFrame:
    """(row, n_words, spans, items): every row packed in ``row``, with what it shares with test items.

    Phrases are all runs of ``size`` words of an item, or a shorter item as a whole; an item
    without words has none. ``spans``: merged word ranges [start, end) covered by occurrences;
    ``items``: ids, as sorted strings, of items with an occurring phrase (a null id is left out of
    the list, its phrases still count in ``spans``). Null and empty texts have no words. Test items
    are searched in blocks of bounded size, each one a further narrow pass over the rows, so
    neither table has to be small. Repeated rows, null ids and other columns do no harm.
    """
    spark = documents.sparkSession
    tests = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // phrase_bytes + 1
    added = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    rows = documents
    for k in range(blocks):
        own = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        phrases = spark.sparkContext.broadcast(Phrases([(r.item, r.text) for r in own.collect()], size))
        if k == 0:
            read: list[Column] = [F.col(f"`{text}`"), F.lit(None).cast("array<struct<start:long,end:long>>"), F.lit(None).cast("array<string>")]
        else:
            read = [F.col("row").getField(text), F.col("spans"), F.col("items")]

        def make(phrases=phrases):
            return lambda columns: _find(columns, phrases.value)

        found = map_rows(rows, read, added, make)
        rows = found if k == 0 else found.select("row.row", "n_words", "spans", "items")
    return rows


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) per document.

    ``contaminated``: a word is hit, and the hit words are at least one in ``one_in``.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_benchmark_hits(rows, benchmark, size)
    hit = hit_words()
    return found.select(
        "row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (one_in * hit >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
