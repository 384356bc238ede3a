import re
import time

from bankspark.llm.licenses import PHRASES, TEMPLATES, Template, license_scan, plain


def words_of(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_base(text):
    w = words_of(text)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


MIT = re.sub(r"\[\[.*?\]\]", "", TEMPLATES["mit-text"])


def test_base_columns(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_automata():
    t = Template("[[copyright <<3>>]] all [[the [[best]] new]] rights reserved")
    yes = ["all rights reserved", "x copyright 2020 by me all rights reserved y", "all the new rights reserved", "ALL the best new rights, reserved", "copyright all rights reserved",
           "copyright a b c d all rights reserved"]
    no = ["all best rights reserved", "all the rights reserved", "all rights", "rights reserved", "all rights are reserved", ""]
    assert all(t.accepts(plain(x)) for x in yes) and not any(t.accepts(plain(x)) for x in no)
    assert t.found_in(b" the rights reserved all rights reserved ", plain("the rights reserved all rights reserved"))


def test_labels_and_edges(spark):
    texts = [None, "", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "x " * 50000 + MIT + " tail", MIT.replace("sublicense", "sell"),
             MIT.replace("shall be", "(including the next paragraph) shall be"), "under the mit license under the MIT license", "ünder the mit license"]
    rows = [(k, t, 0, "z") for k, t in enumerate(texts)] + [(None, texts[2], 0, "z"), (2, texts[2], 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string")
    got = license_scan(docs).collect()
    assert [(r.base_labels, r.labels, r.score) for r in got] == [
        ("", "", 0.0), ("", "", 0.0), ("mit", "mit,mit-notice", 1.0), ("apache-2", "apache-2,apache-2-notice", 1.0),
        ("cc-by-nc", "cc-by-nc,cc-by-nc-notice", 1.0), ("", "gpl-3-notice", 1.0), ("", "mit-text", 1.0), ("", "", 0.0), ("", "mit-text", 1.0),
        ("mit", "mit,mit-notice", 1.0), ("", "", 0.0), ("mit", "mit,mit-notice", 1.0), ("mit", "mit,mit-notice", 1.0)]
    assert [tuple(r)[1:6] for r in got] == [brute_base(t) for _, t, *_ in rows]
    assert license_scan(docs.limit(0)).collect() == []


def test_many_places(spark):
    n = 100_000
    texts = ["under the mit license " * n, "x under the mit license" * n, " ".join(["all rights reserved"] * n) + " " + MIT, "word " * 50 * 2000 + MIT]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    started = time.perf_counter()
    got = license_scan(docs).collect()
    assert time.perf_counter() - started < 60
    assert [tuple(r)[1:6] for r in got] == [brute_base(t) for t in texts]
    assert got[0].n_base == n and "mit-text" in got[2].labels and "mit-text" in got[3].labels
