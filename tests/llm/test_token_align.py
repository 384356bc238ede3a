import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bankspark.llm import llm_queries, token_align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("a_ids", "b_ids", "a_stops", "b_stops", "a_links", "b_links", "groups")


@pytest.fixture(scope="module")
def brute():
    """Whole texts through both libraries, common ends by sets."""
    left = Tokenizer.from_file(PATHS[0])
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    value = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}

    def align(text):
        none = ([], [], [], [], [], [], "")
        if not text:
            return none
        a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
        a_bytes = [bytes(value[c] for c in left.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return none
        a_end, b_end = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
        a_at, b_at = {e: k + 1 for k, e in enumerate(a_end)}, {e: k + 1 for k, e in enumerate(b_end)}
        ends = [e for e in a_end if e in b_at]
        a_stop, b_stop = [a_at[e] for e in ends], [b_at[e] for e in ends]
        spans = zip([0, *a_stop], a_stop, [0, *b_stop], b_stop, strict=False)
        text = ";".join(",".join(map(str, a[x:y])) + "|" + ",".join(map(str, b[u:v])) for x, y, u, v in spans)
        return a, b, a_stop, b_stop, [a[x - 1] for x in a_stop], [b[x - 1] for x in b_stop], text

    return align


def some_texts(rng, n):
    letters = "ab  cd\n\t \r\x0b\x0c\x1c\x1d\x85\xa0 ▁ é1²'ſstllveREd中文नि🙂!?ⅷ\x00ÀÁ"
    words = "the of and house Étoile <|endoftext|> </s> <unk> <s> <0x41> running, 1234 don't .\n\nNext  two   three\n x \t".split(" ")
    for _ in range(n):
        yield "".join(rng.choices(letters, k=rng.randrange(25))) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randrange(30)))


@pytest.mark.parametrize("slice_chars", [1 << 19, 40])
def test_random_texts(brute, monkeypatch, slice_chars):
    monkeypatch.setattr(token_align, "SLICE_CHARS", slice_chars)
    rng = random.Random(slice_chars)
    pairs = token_align.TokenPairs(*PATHS)
    texts = [None, "", " ", "  ", "a", " a", "\n", " \n ", *some_texts(rng, 1500)]
    at = 0
    while at < len(texts):
        part = texts[at : at + rng.randrange(1, 80)]
        got = [c.to_pylist() for c in token_align.align_part(pairs, part)][3:]
        for k, text in enumerate(part):
            assert tuple(c[k] for c in got) == brute(text), text
        at += len(part)


def test_a_small_cache_changes_nothing(brute, monkeypatch):
    monkeypatch.setattr(token_align, "CACHE_WORDS", 5)
    monkeypatch.setattr(token_align, "SLICE_CHARS", 50)
    texts = list(some_texts(random.Random(9), 100))
    got = [c.to_pylist() for c in token_align.align_part(token_align.TokenPairs(*PATHS), texts)][3:]
    assert [tuple(c[k] for c in got) for k in range(len(texts))] == [brute(t) for t in texts]


def test_gallop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        longer = np.unique(rng.integers(0, 500, rng.integers(1, 200)))
        needles = np.sort(rng.integers(0, longer[-1] + 1, rng.integers(0, 50)))
        place = np.searchsorted(longer, needles)
        start = (place * rng.random(len(place))).astype(np.int64)
        assert token_align.gallop(needles, longer, start).tolist() == place.tolist()


def expected(rows, brute):
    aligned = [(d, *brute(t)) for d, t in rows]
    counts = Counter(pair for r in aligned for pair in zip(r[5], r[6], strict=True))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for d, a, b, stops, _, x, y, text in aligned:
        links = list(zip(x, y, strict=True))
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(stops), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


def test_rows(spark, brute, tmp_path):
    texts = [None, "", "one", "one", "x▁y", "no blanks" * 3000, " ".join(["many words here,"] * 20_000), *some_texts(random.Random(4), 60)]
    rows = [(k if k != 5 else None, t, 1, 2) for k, t in enumerate(texts)] + [(3, "one", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codes int, groups int").repartition(3)
    aligned = token_align.align_tokens(docs, *PATHS)
    key = lambda r: (str(r[0]), r[1:])
    assert sorted([(r.doc_id, *[r[f] for f in FIELDS]) for r in aligned.collect()], key=key) == sorted([(d, *brute(t)) for d, t, *_ in rows], key=key)
    assert {(r.n_a, r.n_b, r.n_groups) == (len(r.a_ids), len(r.b_ids), len(r.a_stops)) for r in aligned.collect()} == {True}
    token_align.coded_links(aligned, part_links=500).write.parquet(str(tmp_path / "coded"))
    coded = spark.read.parquet(str(tmp_path / "coded"))
    assert coded.where("pairs is not null").count() == coded.select("part").distinct().count() > 5
    scored = token_align.score_links(coded)
    got = [(r.doc_id, len(r.a_ids), len(r.b_ids), len(r.a_stops), r.n_links, r.n_best, r.count_sum) for r in scored.collect()]
    assert sorted(got, key=key) == sorted([r[:7] for r in expected([(d, t) for d, t, *_ in rows], brute)], key=key)
    assert token_align.align_tokens(docs.limit(0), *PATHS).collect() == []


def test_query_against_brute_force(spark, folder, brute):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in llm_queries()["op12_cross_tokenizer_alignment"](spark, folder).collect()) == sorted(expected(rows, brute))


def test_parts_with_many_pairs(spark, tmp_path):
    n = 70_000  # more pairs than two bytes number
    rows = [(1, [k % 50_000 for k in range(n)], [k // 50_000 for k in range(n)]), (2, [], []), (3, [7, 7, 9], [0, 1, 0])]
    aligned = spark.createDataFrame(rows, "doc_id long, a_links array<int>, b_links array<int>").coalesce(1)
    token_align.coded_links(aligned).write.parquet(str(tmp_path / "coded"))
    got = sorted(tuple(r) for r in token_align.score_links(spark.read.parquet(str(tmp_path / "coded"))).collect())
    counts = Counter(p for _, a, b in rows for p in zip(a, b, strict=True))
    highest = {x: max(c for (_, b), c in counts.items() if b == x) for x in (0, 1)}
    assert got == [(d, len(a), sum(counts[p] == highest[p[1]] for p in zip(a, b)), sum(counts[p] for p in zip(a, b))) for d, a, b in rows]
