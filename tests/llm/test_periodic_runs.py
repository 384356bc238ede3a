import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from bankspark.llm import llm_queries, periodic_runs
from bankspark.llm.periodic_runs import long_runs, lyndon_lengths


def brute_runs(words, min_length, min_exponent):
    """All runs by comparing every word with the one q words on, for every q."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_exponent * q):
                run = words[i : i + length]
                if not any(run[: length - p] == run[p:] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def random_words(rng, limit, symbols=3):
    words, target = [], rng.randrange(limit)
    while len(words) < target:
        if rng.random() < 0.5:
            root = [rng.randrange(1, symbols + 1) for _ in range(rng.randrange(1, 9))]
            words += (root * 60)[: rng.randrange(2, 60)]
        else:
            words += [rng.randrange(1, symbols + 1) for _ in range(rng.randrange(6))]
    return words


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(1500):
        s = random_words(rng, 40, rng.randrange(1, 5))
        want = []
        for i in range(len(s)):
            j = i + 1
            while j < len(s) and s[j:] > s[i:]:
                j += 1
            want.append(j - i)
        assert lyndon_lengths(np.array(s, np.int64)).tolist() == want


@pytest.mark.parametrize("min_length,min_exponent", [(24, 3), (6, 3), (9, 3), (12, 4), (3, 3), (10, 5)])
def test_runs_of_random_words(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(250):
        docs = [random_words(rng, 150) for _ in range(rng.randrange(1, 4))]
        flat = np.array([w for d in docs for w in d], np.int64)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = set(zip(*(x.tolist() for x in long_runs(flat, owner, min_length, min_exponent)), strict=True))
        want, before = set(), 0
        for d in docs:
            want |= {(s + before, n, q) for s, n, q in brute_runs(d, min_length, min_exponent)}
            before += len(d)
        assert got == want


def test_long_texts():
    for words, want in [(list(range(1, 6)) * 40_000, (0, 200_000, 5)), ([1] * 200_000, (0, 200_000, 1)), (list(range(1, 50_001)) * 3, (0, 150_000, 50_000))]:
        got = long_runs(np.array(words, np.int64), np.zeros(len(words), np.int64), 24, 3)
        assert [tuple(int(x[0]) for x in got)] == [want] and len(got[0]) == 1


def test_rows(spark):
    texts = [None, "", " \n\t", "one", "a b " * 12, "a b " * 12, "é x y " * 30 + "end", "\x1c " * 24, "a b c " * 50_000]
    rows = [(k if k != 4 else None, t, 1, 2) for k, t in enumerate(texts)] + [(3, "one", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed int")
    got = sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()], key=str)
    want = []
    for d, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words, 24, 3) if len(words) < 1000 else [(0, len(words), 3)]
        want.append((d, len(words), runs, brute_collapsed(words, runs)))
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_exponent=2)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_against_brute_force(spark, folder):
    got = {r.doc_id: r for r in llm_queries()["op11_periodic_run_detection"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    found = 0
    for d, text in rows:
        words = planted(d, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        runs = brute_runs(words, 24, 3) if len(words) < 3000 else None
        if runs is None:
            continue
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
        found += bool(runs)
    assert found > 5
