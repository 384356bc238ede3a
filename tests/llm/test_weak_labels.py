import numpy as np
import pyarrow as pa

from bankspark.llm.weak_labels import BAD, GOOD, LABELLERS, NONE, classify_quality, count_patterns, fit_labellers, label_documents, pattern_code, votes


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    m, n = len(LABELLERS), 40000
    right = np.linspace(0.6, 0.95, m)
    truth = rng.random(n) < 0.7
    cast = np.where(rng.random((n, m)) < right, truth[:, None], ~truth[:, None]).astype(int)
    cast = np.where(rng.random((n, m)) < 0.3, NONE, cast)
    codes, counts = np.unique(pattern_code(cast), return_counts=True)
    posterior, chance = fit_labellers(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    assert np.abs(chance[:, 1, GOOD] - 0.7 * right).max() < 0.02 and np.abs(chance[:, 0, BAD] - 0.7 * right).max() < 0.03
    assert ((posterior[pattern_code(cast)] > 0.5) == truth).mean() > 0.94


def test_separates_labelled_documents(spark, folder):
    sf = folder.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert sum(count_patterns(label_documents(docs.select("doc_id", "text"))).values()) == docs.count()
    kept = {r.doc_id: r.kept for r in classify_quality(docs).collect()}
    assert len(kept) == docs.count()
    known = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([kept[d] for d, q in known.items() if q == k] for k in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_edges(spark):
    texts = [None, "", "word", "the words of a text " * 50000, "é"]
    rows = [(k, t, 1.0) for k, t in enumerate(texts)] + [(None, "word", 1.0), (2, "word", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = classify_quality(docs).collect()
    assert len(got) == len(rows)
    assert not any(r.kept for r in got if r.doc_id in (0, 1))
    assert all(0 <= r.posterior <= 1 and 0 <= r.score <= 1 for r in got)
    assert len({tuple(r)[1:] for r in got if r.doc_id in (None, 2)}) == 1
    assert classify_quality(docs.limit(0)).collect() == []
    assert (votes(pa.array([None, "a | b"]))[0][0] == BAD).all()
