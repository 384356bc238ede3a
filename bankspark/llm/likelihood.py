"""Quality rules by likelihood ratio: hashed n-grams of trusted documents against the whole corpus.

Word unigrams and bigrams fall into a fixed number of hash buckets. Two multinomials over the
buckets are counted, one on trusted documents and one on all documents; a text's score is the mean
log ratio of its n-grams, and one threshold, fixed by labelled documents, decides for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.llm.rows import map_rows
from bankspark.llm.words import SPACE, shingle, text_bytes, word_hashes

BUCKETS = 1 << 16
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Scores are binned this fine, and cut to this range, when the threshold is chosen.
BINS_PER_UNIT, RANGE = 1000, 10.0


def text_statistics(texts: pa.Array) -> tuple[dict[str, list[int]], np.ndarray, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then all word hashes
    and the place of each text's first word. A null text has no words."""
    data, offsets = text_bytes(texts)
    words, _, at = word_hashes(texts, lower=False)
    inside = ((data & 0xC0) != 0x80) & ~SPACE[data]
    symbol = SYMBOL[data]
    out: dict[str, list[int]] = {"n_words": np.diff(at).tolist(), "word_chars": [], "n_symbols": [], "n_dup_lines": [], "n_repeat_words": []}
    for i in range(len(texts)):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        out["word_chars"].append(int(np.count_nonzero(inside[lo:hi])))
        out["n_symbols"].append(int(np.count_nonzero(symbol[lo:hi])))
        lines = [x for x in data[lo:hi].tobytes().split(b"\n") if x.strip()]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        n = int(at[i + 1] - at[i])
        repeated = 0
        if n > 3:
            grams = shingle(words[at[i] : at[i + 1]], 3)
            _, place, times = np.unique(grams, return_inverse=True, return_counts=True)
            twice = times[place] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
        out["n_repeat_words"].append(repeated)
    return out, words, at


def _buckets(words: np.ndarray, at: np.ndarray, i: int) -> np.ndarray:
    own = words[at[i] : at[i + 1]]
    grams = np.concatenate([own, shingle(own, 2)]) if len(own) > 1 else own
    return (grams % np.uint64(BUCKETS)).astype(np.int64)


def labelled(labels: DataFrame, id_column: str = "doc_id", quality_column: str = "quality") -> DataFrame:
    """(id, label): 1 trusted, 0 not, a row per labelled id.

    An id labelled both ways is not trusted; null ids and labels are left out.
    """
    rows = labels.select(F.col(id_column).cast("long").alias("id"), F.col(quality_column).cast("int").alias("quality"))
    return rows.where("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("label"))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, buckets of the n-grams as packed 16-bit numbers) of (id, text)."""
    for batch in batches:
        words, _, at = word_hashes(batch.column(1), lower=False)
        packed = [_buckets(words, at, i).astype(np.uint16).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "grams"])


def _counts(documents: DataFrame, known: DataFrame | None = None) -> np.ndarray:
    """How many n-grams fall into each bucket, of all documents or of those whose id is in ``known``.

    Not the texts but two bytes an n-gram meet the known ids.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for packed in batch.column("grams"):
                got = np.bincount(np.frombuffer(packed.as_buffer(), np.uint16), minlength=1)
                total[: len(got)] += got
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["bucket", "n"])

    rows, out = documents.select("doc_id", "text"), "bucket int, n long"
    if known is None:
        parts = rows.mapInArrow(lambda batches: count(_grams(batches)), out)
    else:  # by hash at any size: a broadcast would grow with the labels
        grams = rows.mapInArrow(_grams, "id long, grams binary")
        parts = grams.join(known.select("id").hint("shuffle_hash"), "id").select("grams").mapInArrow(count, out)
    total = np.zeros(BUCKETS)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        total[r.bucket] = r.n
    return total


def log_ratios(documents: DataFrame, known: DataFrame) -> np.ndarray:
    """log p_trusted - log p_corpus per bucket; the corpus side counts every document, the trusted
    side every document with label 1."""
    target = _counts(documents, known.where("label = 1"))
    if not target.sum():
        return np.zeros(BUCKETS)
    raw = _counts(documents)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _llr(weight: np.ndarray, words: np.ndarray, at: np.ndarray, n: int) -> list[float]:
    return [float(weight[b].mean()) if len(b := _buckets(words, at, i)) else 0.0 for i in range(n)]


def _scored(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(row, n_words ... n_repeat_words, llr) for rows with doc_id and text."""
    sent = documents.sparkSession.sparkContext.broadcast(ratios)

    def make():
        weight = sent.value

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            statistics, words, at = text_statistics(columns[0])
            llr = _llr(weight, words, at, len(columns[0]))
            return [*(pa.array(v, pa.int64()) for v in statistics.values()), pa.array(llr, pa.float64())]

        return work

    return map_rows(documents, [F.col("text")], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double", make)


def _ratio_of_ids(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(id, llr) of every document; the texts stay where they are read."""
    sent = documents.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _, at = word_hashes(batch.column(1), lower=False)
            llr = _llr(sent.value, words, at, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(llr, pa.float64())], names=["id", "llr"])

    return documents.select("doc_id", "text").mapInArrow(score, "id long, llr double")


def choose_threshold(documents: DataFrame, known: DataFrame, ratios: np.ndarray, keep: float) -> float:
    """The score that best separates the labelled documents and keeps a part ``keep`` of the trusted.

    Without trusted rows nothing is rejected. Ties go to the lower threshold.
    """
    if known.where("label = 1").isEmpty():
        return -RANGE
    llr = F.least(F.greatest("llr", F.lit(-RANGE)), F.lit(RANGE))
    bins = (
        _ratio_of_ids(documents, ratios).join(known.hint("shuffle_hash"), "id")
        .groupBy("label", F.floor(llr * BINS_PER_UNIT).alias("bin")).count().collect()
    )
    size = int(RANGE * BINS_PER_UNIT)
    counts = np.zeros((2, 2 * size + 1))
    for r in bins:
        counts[r.label, r.bin + size] += r["count"]
    lost = np.concatenate([[0], np.cumsum(counts[1])]) / max(1, counts[1].sum())
    caught = np.concatenate([[0], np.cumsum(counts[0])]) / max(1, counts[0].sum())
    gain = np.where(lost <= 1 - keep, caught - lost, -1)
    return (int(np.argmax(gain)) - size) / BINS_PER_UNIT


def quality_rules(documents: DataFrame, labels: DataFrame, keep: float = 0.99) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr).

    Words are runs of characters other than ASCII white space. ``base_failed``: under 50 words, or
    over half of them in repeated three-word windows. ``kept``: not failed, and ``llr`` not below
    the threshold. Trusted documents and the threshold come from all labelled rows, the corpus
    counts and the decision from every document. Null and empty texts have no words and fail;
    repeated rows, null ids and other columns do no harm.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labelled(labels)
    ratios = log_ratios(rows, known)
    threshold = choose_threshold(rows, known, ratios, keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return _scored(rows, ratios).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr",
    )
