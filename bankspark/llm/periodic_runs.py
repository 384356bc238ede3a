"""Periodic runs of words by Lyndon roots.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run of
two or more periods has, under one of the two orders of the words, a Lyndon root: a longest Lyndon
word of q words. Phase one of Baier's suffix sorter, which groups suffixes by their longest Lyndon
prefix, gives these lengths directly: once for the order of the words and once for its reverse. Each
root is then extended to both sides by longest-common-extension queries.

Only stretches that can hold a long run are grouped: a run of ``min_length`` words and
``min_exponent`` periods is covered by short word windows that stand three times in its document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bankspark.llm.words import mix, shingle

PART_BYTES = 1 << 20  # text worked on at once; a longer text is a part of its own

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place.

    Groups hold the suffixes whose longest Lyndon prefix begins with the same word, as far as it is
    known. From the highest group down, each member of a group joins its word to the nearest place on
    its left that is still open; places that got equally many copies form a new group, just above
    their old one. A group's word is final when its turn comes.
    """
    n = len(symbols)
    found = [1] * n
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    members: list[list[int]] = [part.tolist() for part in np.split(order, cuts)]
    group = np.empty(n, np.int64)
    group[order] = np.repeat(np.arange(len(members)), np.diff(np.concatenate([[0], cuts, [n]])))
    group_of = group.tolist()
    size = [1] * len(members)
    lower = list(range(-1, len(members) - 1))
    higher = list(range(1, len(members) + 1))
    opened = list(range(n + 1))  # place i is node i + 1; a closed node points to one on its left
    current = len(members) - 1
    while current >= 0:
        own = [i for i in members[current] if group_of[i] == current]
        members[current] = []
        length = size[current]
        for i in own:
            found[i] = length
            opened[i + 1] = i
        copies: dict[int, int] = {}
        for i in own:
            node = i
            while opened[node] != node:
                opened[node] = node = opened[opened[node]]
            if node:
                copies[node - 1] = copies.get(node - 1, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for place, times in copies.items():
            split.setdefault((times, group_of[place]), []).append(place)
        for times, below in sorted(split, reverse=True) if len(split) > 1 else split:
            places = split[times, below]
            new, above = len(size), higher[below]
            size.append(size[below] + times * length)
            members.append(places)
            lower.append(below)
            higher.append(above)
            higher[below] = lower[above] = new
            for place in places:
                group_of[place] = new
        current = lower[current]
    return np.array(found, np.int64)


class CommonExtensions:
    """Exact lengths of common extensions, by names of all stretches of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray, longest: int):
        names = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.levels = [names]
        width = 1
        while 2 * width <= longest and 2 * width <= len(symbols):
            pair = names[:-width] * np.int64(len(symbols) + 1) + names[width:]
            names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            self.levels.append(names)
            width *= 2

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols from ``x`` and ``y`` (x < y) on are equal."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            inside = np.flatnonzero(y + out < len(names))
            at = inside[names[x[inside] + out[inside]] == names[y[inside] + out[inside]]]
            out[at] += 1 << k
        return out

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols up to and with ``x`` and ``y`` (x < y) are equal."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[k], 1 << k
            inside = np.flatnonzero(x - out - width + 1 >= 0)
            at = inside[names[x[inside] - out[inside] - width + 1] == names[y[inside] - out[inside] - width + 1]]
            out[at] += width
        return out


def runs_of(stretches: list[np.ndarray], min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, length, period) of all long runs; symbols are integers from 1 on."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    offset = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])  # a separator before each stretch and at the end
    symbols = np.zeros(int(offset[-1]), np.int64)
    for s, at in zip(stretches, offset, strict=False):
        symbols[at : at + len(s)] = s
    dense = np.unique(symbols, return_inverse=True)[1].astype(np.int64)  # separators are the smallest: 0
    turned = np.where(dense == 0, 0, dense.max() + 1 - dense)
    n = len(dense)
    places, periods = [], []
    for ordered in (dense, turned):
        period = lyndon_lengths(ordered)
        at = np.flatnonzero(dense != 0)
        at = at[at + period[at] < n]
        p = period[at]
        alike = (dense[at] == dense[at + p]) | (dense[at - 1] == dense[at + p - 1])
        places.append(at[alike])
        periods.append(p[alike])
    i, p = np.concatenate(places), np.concatenate(periods)
    own = symbols.copy()
    own[dense == 0] = -1 - np.arange(int((dense == 0).sum()))  # separators differ from each other
    extend = CommonExtensions(own, int(sizes.max(initial=1)))
    left, right = extend.backward(i - 1, i + p - 1), extend.forward(i, i + p)
    length = p + left + right
    long_enough = (length >= min_length) & (length >= min_exponent * p)
    found = np.unique(np.stack([(i - left)[long_enough], p[long_enough], length[long_enough]], axis=1), axis=0)
    stretch = np.searchsorted(offset, found[:, 0], "right") - 1
    return stretch, found[:, 0] - offset[stretch], found[:, 2], found[:, 1]


def long_runs(words: np.ndarray, document: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the long runs in flat word numbers (from 1 on); runs stay in a document."""
    none = np.zeros(0, np.int64)
    size = max(1, min_length * (min_exponent - 2) // min_exponent)
    if len(words) < min_length:
        return none, none, none
    window = shingle(words.astype(np.uint64), size)
    window = mix(window + mix(document[: len(window)].astype(np.uint64)))
    inside = document[: len(window)] == document[size - 1 :]
    at = np.flatnonzero(inside)
    at = at[np.argsort(window[at], kind="stable")]
    cuts = np.concatenate([[0], np.flatnonzero(window[at][1:] != window[at][:-1]) + 1, [len(at)]])
    times = np.repeat(np.diff(cuts), np.diff(cuts))
    often = at[times >= 3]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    begins = covered.copy()
    begins[1:] &= ~covered[:-1] | (document[1:] != document[:-1])
    ends = covered.copy()
    ends[:-1] &= ~covered[1:] | (document[1:] != document[:-1])
    first, after = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long_enough = after - first >= min_length
    first, after = first[long_enough], after[long_enough]
    if not len(first):
        return none, none, none
    stretch, start, length, period = runs_of([words[a:b] for a, b in zip(first, after, strict=True)], min_length, min_exponent)
    return first[stretch] + start, length, period


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > PART_BYTES:
            yield lo, k
            lo, size = k, 0
        size += len(text) + 64
    if lo < len(texts):
        yield lo, len(texts)


def periodic_runs(documents: DataFrame, min_length: int = 24, min_exponent: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the long runs of each whole text, and the text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` holds (start, length, period) by start,
    then period, of every run of at least ``min_length`` words and ``min_exponent`` (3 or more) periods.
    ``collapsed`` is the words joined by one space, without those that some run holds after its first
    period. A null, empty or blank text has no words, no runs and an empty ``collapsed``. Rows are
    worked on one by one: repeated rows and null ids give a row each, an empty table gives none.
    Other columns are ignored, whatever their names.
    """
    if min_exponent < 3 or min_length < min_exponent:
        raise ValueError("min_exponent must be 3 or more, and min_length not less than it")
    source = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    schema = T.StructType([
        source.schema["doc_id"], T.StructField("n_words", T.LongType(), False),
        T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary()).to_pylist()
            for lo, hi in _parts(texts):
                yield part(batch.column(0)[lo:hi], texts[lo:hi])

    def part(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        words = [text.split() for text in texts]
        counts = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        number: dict[bytes, int] = {}
        flat = np.fromiter((number.setdefault(w, len(number) + 1) for own in words for w in own), np.int64, int(first[-1]))
        document = np.repeat(np.arange(len(texts)), counts)
        start, length, period = long_runs(flat, document, min_length, min_exponent)
        owner = np.searchsorted(first, start, "right") - 1
        order = np.lexsort([period, start])  # flat places: by document as well
        start, length, period, owner = start[order], length[order], period[order], owner[order]
        edge = np.zeros(len(flat) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        kept = np.cumsum(edge[:-1]) == 0
        collapsed = [b" ".join(own) for own in words]
        for k in np.unique(owner):
            collapsed[k] = b" ".join(w for w, keep in zip(words[k], kept[first[k] : first[k + 1]].tolist(), strict=True) if keep)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        runs = pa.StructArray.from_arrays([pa.array(start - first[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(counts), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    return source.mapInArrow(run, schema)
