import random
import re

import pytest

import corpus_pipeline
from bankspark.llm import jaccard
from bankspark.llm.jaccard import jaccard_components


def brute(rows, size=3, p=90, q=100):
    sets = []
    for _, text in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and q * both >= p * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard_components(docs, **options).collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        if rows and rng.random() < 0.7:
            t = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(t) + 1)
                rng.choice([lambda: t.insert(k, rng.choice(words)), lambda: t.pop(min(k, len(t) - 1)) if len(t) > 1 else None,
                            lambda: t.__setitem__(min(k, len(t) - 1), rng.choice(words).upper())])()
            rows.append((len(rows) * 7 % (n * 5), " ".join(t)))
        else:
            rows.append((len(rows) * 7 % (n * 5), " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 12, 30, 90, 300])))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    rows = corpus(seed, 150)
    assert run(spark, rows) == brute(rows)


def test_other_threshold(spark):
    rows = corpus(5, 80)
    assert run(spark, rows, size=2, numerator=80) == brute(rows, 2, 80)


def test_edges(spark):
    long = " ".join(f"a{i % 5000}b{i % 77}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, "X"), (5, "x"), (6, "a b"), (7, "A  b"), (8, "é É"), (9, "É é"),
            (None, "x"), (None, "only"), (10, long), (11, long + " end"), (12, "x" * 300000), (12, "other text for the same id")]
    assert run(spark, rows) == brute(rows)


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n long, key string")
    assert jaccard_components(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c d", 5, "k", "z")], "doc_id long, text string, n long, key string, component_id string")
    assert [tuple(r) for r in jaccard_components(docs).collect()] == [(1, 2, 1)]


def test_linked_only_through_a_base(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(100, " ".join(base))]
    for i in range(40):
        t = list(base)
        t[5 + rng.randrange(50)] = f"u{i}"
        rows.append((i, " ".join(t)))
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[2] for r in got} == {0}


def test_one_row_of_each_component(spark):
    x, y, z = "one clean text of its own", "another text with other words", "the third text is linked twice"
    rows = [(None, "no id but a clean text here", "s"), (5, x, "s"), (5, x, "s"), (5, x, "t"), (3, y, "s"), (5, y, "s"), (None, y, "s"),
            (None, z, "a"), (None, z, "a"), (None, z, "b"), (7, None, "s"), (7, None, "s"), (None, " ", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert sorted(r[:2] for r in got if r[0] is not None and r[1]) == [(3, y), (5, x)]
    assert sorted(r[1] for r in got if r[0] is None) == [" ", "no id but a clean text here", z]
    assert got.count((7, None, "s")) == 2 and len(got) == 7


def test_class_texts_meet_only_their_own_rows(spark, monkeypatch):
    met = []
    only_own_text = jaccard._only_own_text
    monkeypatch.setattr(jaccard, "_only_own_text", lambda rows, size: met.append(rows.count()) or only_own_text(rows, size))
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*base[:k], "new", *base[k + 1 :]])) for k in range(5, 55)]
    assert run(spark, rows) == brute(rows)
    assert met and met[0] <= len(rows)
