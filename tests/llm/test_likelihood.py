import re
from collections import Counter

import numpy as np

from bankspark.llm.likelihood import BUCKETS, choose_threshold, labelled, log_ratios, quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_on_documents(spark, folder):
    sf = folder.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = quality_rules(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    known = {r.doc_id: r.quality for r in labels.collect()}
    good = [r for r in rows if known.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if known.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.4 * len(bad)


def test_edges(spark):
    many = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " \n\v ", "é# é#\né# é#\n\n\n x\n x", many, "a b c " * 30000, many.upper() + "\r\n" + many]
    rows = [(k, t, "l", 1) for k, t in enumerate(texts)] + [(None, many, "l", 1), (4, many, "l", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, llr int")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (3, None, 0), (77, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules(docs, labels).collect()
    assert [tuple(r)[1:6] for r in got] == [brute(t) for _, t, *_ in rows]
    assert [r.kept for r in got][:6] == [False, False, False, False, True, False]
    none = quality_rules(docs, labels.limit(0)).collect()
    assert [r.kept for r in none] == [not r.base_failed for r in none]
    assert quality_rules(docs.limit(0), labels).collect() == []


def test_all_labelled_rows_count(spark):
    n = 41000  # more of each kind than any fixed sample of the past held
    rows = spark.range(n).selectExpr("id AS doc_id", "concat('w', id, if(id % 2 = 1, ' good', ' bad')) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality").union(spark.sql("SELECT 1L, 0"))
    known = labelled(labels)
    assert {r.label: r["count"] for r in known.groupBy("label").count().collect()} == {0: n // 2 + 1, 1: n // 2 - 1}
    ratios = log_ratios(rows, known)
    # three n-grams a document; where every n-gram of a bucket is trusted the ratio is that of the totals
    target, raw = 3 * (n // 2 - 1) + BUCKETS, 3 * n + BUCKETS
    assert abs(ratios.max() - np.log(raw / target)) < 1e-9
    assert -10 < choose_threshold(rows, known, ratios, 0.99) < 10
