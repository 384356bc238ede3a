"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns (a fixed number of patterns, whatever the corpus)
estimates how often each labeller votes what on good and on bad documents, and so the posterior of
each pattern. Posteriors are the soft labels from which a linear scorer over hashed words learns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.llm.likelihood import text_statistics
from bankspark.llm.rows import map_rows
from bankspark.llm.words import SPACE, text_bytes
from bankspark.session import cut_lineage

BUCKETS = 1 << 16
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "capitals", "repeats", "clean_words", "sentence_ends", "length", "bars", "variety")
BINS = 2000  # of the raw score, when its slope and intercept are fitted
BOUND = 10.0

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


#: A word of letters with at most one sign after it.
_CLEAN = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff]+[.,;:!?]?(?!\S)")


def _vote(value: float, good: tuple[float, float] | None, bad: tuple[float, float]) -> int:
    """Good within the first range (a labeller of defects has none), bad outside the second, else nothing."""
    return GOOD if good and good[0] <= value <= good[1] else BAD if not bad[0] <= value <= bad[1] else NONE


def votes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (texts x labellers), then the word hashes and the place of each text's first word."""
    statistics, words, at = text_statistics(texts)
    data, offsets = text_bytes(texts)
    upper, letter, end = _UPPER[data], _LETTER[data], _END[data]
    if len(data):  # a sentence ends before white space or with the text
        last = np.append(SPACE[data[1:]], True)
        last[(offsets[1:] - 1)[np.diff(offsets) > 0]] = True
        end &= last
    out = np.full((len(texts), len(LABELLERS)), NONE, np.int8)
    for i in range(len(texts)):
        n = statistics["n_words"][i]
        if n == 0:
            out[i] = BAD
            continue
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        part = lambda mask: int(np.count_nonzero(mask[lo:hi]))  # noqa: B023, E731
        letters = max(1, part(letter))
        raw = data[lo:hi].tobytes()
        out[i] = (
            _vote(statistics["n_symbols"][i] / n, None, (0, 0.25)),
            _vote(part(upper) / letters, None, (0, 0.4)),
            _vote(statistics["n_repeat_words"][i] / n, None, (0, 0.4)),
            _vote(len(_CLEAN.findall(raw)) / n, (0.9, 1), (0.6, 1)),
            _vote(part(end) / n, (0.02, 0.3), (0.005, 0.5)),
            _vote(n, (60, np.inf), (20, np.inf)),
            _vote(raw.count(b" | ") / n, None, (0, 0.1)),
            _vote(len(np.unique(words[at[i] : at[i + 1]])) / n**0.8, (0.7, np.inf), (0.35, np.inf)),
        )
    return out, words, at


def pattern_code(votes_: np.ndarray) -> np.ndarray:
    return votes_.astype(np.int64) @ (3 ** np.arange(len(LABELLERS)))


def fit_labellers(counts: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """({pattern: posterior of good} as an array over all patterns, P(vote | class) per labeller).

    Starts from the majority of votes, so that the first class is the one labellers call good.
    """
    m = len(LABELLERS)
    codes = np.arange(3**m)
    table = (codes[:, None] // 3 ** np.arange(m)) % 3
    weight = np.zeros(3**m)
    for code, n in counts.items():
        weight[code] = n
    good, bad = (table == GOOD).sum(axis=1), (table == BAD).sum(axis=1)
    posterior = (good + 1) / (good + bad + 2)
    chance = np.full((m, 2, 3), 1 / 3)
    if not weight.sum():
        return posterior, chance
    for _ in range(rounds):
        share = np.stack([weight * (1 - posterior), weight * posterior])
        prior = (share.sum(axis=1) + 1) / (share.sum() + 2)
        for v in range(3):
            chance[:, :, v] = ((share @ (table == v)) + 1).T
        chance /= chance.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(chance[k])[:, table[:, k]] for k in range(m))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, chance


def label_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, pattern, features) of rows with doc_id and text: votes, and hash buckets of the
    distinct words (two bytes each). A written table, so that texts are read once."""

    def make():
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            cast, words, at = votes(columns[0])
            features = [(np.unique(words[at[i] : at[i + 1]]) % np.uint64(BUCKETS)).astype("<u2").tobytes() for i in range(len(columns[0]))]
            return [pa.array(pattern_code(cast)), pa.array(features, pa.binary())]

        return work

    return cut_lineage(map_rows(documents, [F.col("text")], "pattern long, features binary", make).select("row.doc_id", "pattern", "features"))


def count_patterns(labelled: DataFrame) -> dict[int, int]:
    counts = labelled.groupBy("pattern").agg(F.count("*").alias("n"))  # a fixed number of patterns
    return {r.pattern: r.n for r in counts.collect()}


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All features of a batch, the row of each, and the number of features of each row."""
    raw = column.to_pylist()
    size = np.array([len(r) // 2 for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), "<u2").astype(np.int64), np.repeat(np.arange(len(raw)), size), size


def _raw(weight: np.ndarray, column: pa.Array) -> np.ndarray:
    """Mean weight of each row's features; the lowest score for a row without any."""
    features, row, size = _features(column)
    total = np.bincount(row, weight[features], minlength=len(size))
    return np.where(size > 0, total / np.maximum(size, 1), -BOUND)


def _soft(posterior: np.ndarray, patterns: pa.Array) -> np.ndarray:
    """Posteriors in whole thousandths: their sums do not depend on the order of rows."""
    return np.rint(posterior[patterns.to_numpy()] * 1000).astype(np.int64)


def fit_scorer(labelled: DataFrame, posterior: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weight per bucket, slope, intercept): log odds of buckets under the soft labels of all
    documents, then a logistic curve from their mean to the posterior, fitted on binned counts."""
    context = labelled.sparkSession.sparkContext
    sent = context.broadcast(posterior)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, every = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            features, row, _ = _features(batch.column(1))
            every += np.bincount(features, minlength=BUCKETS)
            good += np.rint(np.bincount(features, _soft(sent.value, batch.column(0))[row], minlength=BUCKETS)).astype(np.int64)
        there = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(good[there]), pa.array(every[there])], names=["bucket", "good", "every"])

    rows = labelled.select("pattern", "features")
    good, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    found = rows.mapInArrow(count, "bucket long, good long, every long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("every").alias("every"))
    for r in found.collect():  # at most BUCKETS rows
        good[r.bucket], every[r.bucket] = r.good / 1000, r.every
    bad = every - good
    weight = np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((bad + 1) / (bad.sum() + BUCKETS))
    model = context.broadcast(weight)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, soft = np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1, np.int64)
        for batch in batches:
            raw = _raw(model.value, batch.column(1))
            bin_ = np.rint((np.clip(raw, -BOUND, BOUND) / BOUND + 1) / 2 * BINS).astype(np.int64)
            np.add.at(total, bin_, 1)
            np.add.at(soft, bin_, _soft(sent.value, batch.column(0)))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there]), pa.array(soft[there])], names=["bin", "n", "good"])

    bins = rows.mapInArrow(spread, "bin long, n long, good long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    x, n, y = [], [], []
    for r in sorted(bins.collect(), key=lambda r: r.bin):  # at most BINS + 1 rows
        x.append((r.bin / BINS * 2 - 1) * BOUND)
        n.append(r.n)
        y.append(r.good / 1000 / r.n)
    return weight, *_logistic(np.array(x), np.array(y), np.array(n, float))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a slight pull to slope 1."""
    a, b = 1.0, 0.0
    if not len(x):
        return a, b
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        gradient = np.array([(n * (y - p) * x).sum() - 0.1 * (a - 1), (n * (y - p)).sum() - 0.1 * b])
        hessian = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        a, b = a + step[0] * min(1, 5 / max(size, 1e-12)), b + step[1] * min(1, 5 / max(size, 1e-12))
        if size < 1e-9:
            break
    return float(a), float(b)


def classify_quality(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, posterior, score, kept) per row.

    ``posterior``: probability of good from the labellers' votes alone. ``score``: the linear
    scorer's probability. ``kept``: the mean of both reaches ``threshold``. All statistics cover
    every document. A null or empty text gets bad votes; repeated rows, null ids and other columns do
    no harm; an empty table gives an empty result.
    """
    labelled = label_documents(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    posterior, _ = fit_labellers(count_patterns(labelled))
    weight, slope, intercept = fit_scorer(labelled, posterior)
    sent = documents.sparkSession.sparkContext.broadcast((posterior, weight, slope, intercept))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        soft, w, a, b = sent.value
        for batch in batches:
            linear = 1 / (1 + np.exp(-np.clip(a * _raw(w, batch.column(2)) + b, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(soft[batch.column(1).to_numpy()]), pa.array(linear)], names=["doc_id", "posterior", "score"]
            )

    return labelled.mapInArrow(score, "doc_id long, posterior double, score double").withColumn(
        "kept", F.col("posterior") + F.col("score") >= 2 * threshold
    )
