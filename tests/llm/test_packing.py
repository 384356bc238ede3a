import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bankspark.llm.packing import WordEncoder, pack_documents, packing_plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(histogram, capacity):
    plan = packing_plan(histogram, capacity)
    used = np.zeros_like(histogram)
    for lengths, times in plan:
        assert times > 0 and sum(lengths) <= capacity
        for v in lengths:
            used[v] += times
    assert (used == histogram).all()
    return sum(n for _, n in plan)


def first_fit(histogram, capacity):
    free = []
    for v in range(capacity, 0, -1):
        for _ in range(histogram[v]):
            at = next((k for k, f in enumerate(free) if f >= v), None)
            if at is None:
                free.append(capacity - v)
            else:
                free[at] -= v
    return len(free)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    h = rng.integers(0, 4 ** seed + 2, capacity + 1)
    h[0] = 0
    total = int((h * np.arange(capacity + 1)).sum())
    assert -(-total // capacity) <= check_plan(h, capacity) <= first_fit(h, capacity) * 1.01 + 1
    assert check_plan(np.zeros(9, int), 8) == 0
    one = np.zeros(9, int)
    one[5] = 7
    assert check_plan(one, 8) == 7


def test_ids_are_the_tokenizers(seed=1):
    rng = random.Random(seed)
    t, e = Tokenizer.from_file(PATH), WordEncoder(PATH)
    letters = "abcABC0129 \t\n\x0b\x0c\r\x1c\x85 'sétÉñß.,!<|endoftext|>ΣσİıŉǅĿ中文नि🙂é\u0000 ²ªº½'ll"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(2000)] + ["<|endoftext|>x <|startoftext|>", "I'LL don't 'S", "<|ENDOFTEXT|>"]
    ids, ends = e.encode([x.encode() for x in texts])
    for x, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert ids[a:b].tolist() == t.encode(x, add_special_tokens=False).ids + [0]


def test_documents_packed_whole(spark):
    rng = random.Random(4)
    texts = [None, "", "one", "one"] + [" ".join(rng.choices("the of and Étoile 42, it's".split(), k=rng.choice([3, 20, 60, 200]))) for _ in range(150)]
    rows = [(k if k != 7 else None, t, 1, 2) for k, t in enumerate(texts)] + [(3, "one", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int, length int")
    got = pack_documents(docs, PATH, capacity=64).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for d, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want.append((d, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    histogram = np.bincount([w[3] for w in want], minlength=65)
    assert len(sequences) <= first_fit(histogram, 64) + 1
    assert pack_documents(docs.limit(0), PATH).collect() == []
