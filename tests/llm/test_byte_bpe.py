import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from bankspark.llm import byte_bpe, llm_queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, library):
    ids, ends = byte_bpe.load(PATH, PATTERN).encode(texts)
    for text, lo, hi in zip(texts, [0, *ends], ends, strict=False):
        assert ids[lo:hi].tolist() == library.encode_ordinary(text), text[:80]


def test_random_texts(library):
    rng = random.Random(1)
    letters = "ab cd\n\t \r\x0b\x0c\x1c\x1d\x85\xa0 é1²'ſstllveREd中文नि🙂!?ⅷ\u0000"
    check(["", *("".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(3000)), "<|endoftext|>"], library)


def test_every_code_point(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    check(["a ".join(points[k : k + 4096]) for k in range(0, len(points), 4096)], library)


def test_a_vocabulary_of_merges_gives_each_token_back():
    bpe = byte_bpe.load(PATH, PATTERN)
    assert all(len(ids) == 1 and ids[0] == k for k, ids in enumerate(bpe.merge(bpe.token)))


def test_wide_rows(library):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    rows = ["a" * 100_001, "ab" * 3001, "acgt" * 3 + "".join(rng.choices("acgt", k=30_000)), " " * 10_000, "\n" * 5000 + "x", long]
    check(rows, library)
    check([long[:n] for n in (1, 2, 3, 4, 5, 8, 9, 511, 512, 513)], library)


def test_a_small_cache_and_small_slices_change_nothing(library, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["one", " two", "\n three ", "4\t", "fünf"], k=rng.randrange(200))) for _ in range(60)]
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "MATRIX_CELLS", 8)
    check(texts, library)
    assert all("".join(byte_bpe.text_slices(t, 20)) == t for t in texts)
    monkeypatch.setattr(byte_bpe.text_slices, "__defaults__", (20,))
    check(texts, library)


def test_rows(spark, library):
    rows = [(1, "a b", 7, 8), (1, "a b", 7, 8), (None, None, 1, 1), (3, "", None, None), (None, "x" * 100_000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded int")
    ids = byte_bpe.encode_texts(docs, PATH, PATTERN)
    key = lambda r: (str(r[0]), r[1])
    want = sorted([(d, library.encode_ordinary(t or "")) for d, t, *_ in rows], key=key)
    assert sorted([tuple(r) for r in ids.collect()], key=key) == want
    back = byte_bpe.decode_ids(ids, PATH, PATTERN).collect()
    assert sorted([bytes(r.decoded).decode() for r in back]) == sorted(t or "" for _, t, *_ in rows)
    odd = spark.createDataFrame([(1, None), (2, [50256]), (3, [-1]), (4, [None]), (5, [])], "row int, ids array<int>")
    assert sorted((r.row.row, r.decoded) for r in byte_bpe.decode_ids(odd, PATH, PATTERN).collect() if r.decoded is not None) == [(5, b"")]
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(docs.limit(0), PATH, PATTERN), PATH, PATTERN).collect() == []


def test_query_against_the_library(spark, folder, library):
    got = {r.doc_id: r for r in llm_queries()["op13_byte_level_bpe"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
