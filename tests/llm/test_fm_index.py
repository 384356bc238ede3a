import hashlib
import random
import re

import numpy as np
import pytest

from bankspark.llm.fm_index import FMIndex, contamination, suffix_array, with_benchmark_hits


def words_of(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, bench, size=13):
    out = []
    for d, text in docs:
        w = words_of(text)
        hit, items = set(), set()
        for item, t in bench:
            b = words_of(t)
            windows = [b[i : i + size] for i in range(max(1, len(b) - size + 1))] if b else []
            for p in windows:
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit.update(range(i, i + len(p)))
                        items.add(item)
        ids = sorted(str(i) for i in items if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    return sorted((tuple(r) for r in contamination(d, b).drop("spans").collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_index_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    symbols = np.append(rng.integers(0, 4, 3000), 0)
    if seed == 3:
        symbols = np.append(np.ones(500, int), 0)
    order = suffix_array(symbols, 3)
    marks = np.cumsum(symbols == 0)
    keyed = [(0, int(marks[i])) if s == 0 else (1, int(s)) for i, s in enumerate(symbols)]
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: keyed[i:])
    index = FMIndex(symbols, 3)
    phrases = rng.integers(1, 4, (60, 5))
    lengths = rng.integers(1, 6, 60)
    which, lo, hi = index.search(phrases, lengths)
    at = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, lo, hi, strict=True)}
    for k in range(60):
        p = phrases[k, : lengths[k]]
        want = [i for i in range(len(symbols) - len(p) + 1) if (symbols[i : i + len(p)] == p).all()]
        assert at.get(k, []) == want


def tables(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ça", "x1"]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(12)]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary + ["none", "other"], k=rng.randrange(200))
        for _ in range(rng.randrange(3)):
            b = words_of(rng.choice(bench)[1])
            a = rng.randrange(len(b) + 1)
            k = rng.randrange(len(w) + 1)
            w[k:k] = [x.upper() for x in b[a : a + rng.choice([5, 13, 40])]]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    return docs, bench


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    docs, bench = tables(seed)
    assert got(spark, docs, bench) == brute(docs, bench)


def test_edges(spark):
    phrase = " ".join(f"p{i}" for i in range(14))
    docs = [(1, None), (2, ""), (3, "... !!"), (4, phrase), (4, phrase), (None, phrase), (5, "the " * 40000), (6, "p1 p2"),
            (7, phrase.upper() + " tail " + "z " * 20000 + phrase), (8, "short")]
    bench = [(1, phrase), (2, None), (3, ""), (4, "the " * 13), (5, "short"), (5, "Short"), (None, "tail z"), (10, "p1  p2"), (2, "p1 p2")]
    fast = [(d, t) for d, t in docs if d not in (5, 7)]
    assert [r for r in got(spark, docs, bench) if r[0] not in (5, 7)] == brute(fast, bench)
    by = {r[0]: r for r in got(spark, docs, bench)}
    assert by[5][1:4] == (40000, 40000, 1) and by[7][1:4] == (20029, 28 + 2, 3) and not by[7][5]
    assert got(spark, [], bench) == []
    assert all(r[2] == 0 for r in got(spark, docs, []))


def test_blocks_of_items_give_the_same(spark):
    docs, bench = tables(9)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, row long")
    b = spark.createDataFrame(bench, "item_id long, text string")
    one = with_benchmark_hits(d, b).collect()
    many = with_benchmark_hits(d, b, phrase_bytes=100).collect()
    assert sorted(one, key=repr) == sorted(many, key=repr)
