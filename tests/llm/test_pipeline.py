"""The pipeline against brute force: each stage's decision is made again in plain Python."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bankspark.llm.language import language_dictionaries
from bankspark.llm.queries import PSEUDONYM_KEY
from tests.llm.test_fm_index import brute as brute_hits
from tests.llm.test_jaccard import brute as brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(seed):
    rng = random.Random(seed)
    words = {"aa": [f"alpha{c}ba" for c in "bcdfghklmnprst"] + ["gamma", "delta"], "bb": [f"und{c}ich" for c in "bcdfghklmnprst"] + ["zwei", "drei"]}
    rows, items = [], []
    for i in range(12):
        items.append((i, " ".join(rng.choices(words["aa"], k=rng.choice([5, 20, 30])))))
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        t = rng.choices(words[lang], k=rng.choice([4, 30, 80, 200]))
        if rng.random() < 0.2:
            t += rng.choice(items)[1].split()
        if rng.random() < 0.2:
            t += ["4845168114407329", "9807915762804490", "x@mail.example.com"]
        text = " ".join(t)
        rows.append((i, text, lang, "s", len(text)))
        if rng.random() < 0.4:
            changed = " ".join([*t, rng.choice(words[lang])])
            rows.append((1000 + i, rng.choice([text, changed]), lang, "s", 1))
    rows += [(2000, None, "aa", "s", 0), (2001, "", "aa", "s", 0), (2002, "123 456", None, "s", 7), (None, " ".join(words["aa"]), "aa", "s", 1)]
    return rows, items


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, items = make(3)
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, folder


def key(row):
    return repr(tuple(row))


def test_stages_one_by_one(spark, made):
    rows, items, folder = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = sorted(rows, key=key)
    stages = dict(corpus_pipeline.STAGES)

    docs = spark.createDataFrame(
        stages["known_language"](spark, docs, folder).collect(), COLUMNS)
    kept = sorted((tuple(r) for r in docs.collect()), key=key)
    gone = [r for r in left if r not in kept]
    assert {r[0] for r in gone} >= {2000, 2001, 2002} and len(gone) <= 8 and all(r in left for r in kept)

    docs = spark.createDataFrame(stages["one_of_each_group"](spark, docs, folder).collect(), COLUMNS)
    # by row, not by id: of each component one row with the smallest id (nulls last) stays
    group = {k: c for k, _, c in brute_components([(k, r[1]) for k, r in enumerate(kept)])}
    left = sorted((tuple(r) for r in docs.collect()), key=key)
    assert len(left) == len(set(group.values())) and None in {r[0] for r in left}
    for c in set(group.values()):
        own = [kept[k] for k in group if group[k] == c]
        smallest = min((r[0] is None, r[0] or 0) for r in own)
        assert [(r[0] is None, r[0] or 0) for r in left if r in own] == [smallest]
    kept = left

    docs = spark.createDataFrame(stages["without_benchmark"](spark, docs, folder).collect(), COLUMNS)
    bad = {r[0] for r in brute_hits([(r[0], r[1]) for r in kept], items) if r[5]}
    assert bad
    kept = [r for r in kept if r[0] not in bad]
    assert sorted((tuple(r) for r in docs.collect()), key=key) == kept

    new = stages["with_pseudonyms"](spark, docs, folder)
    assert new.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: r for r in new.collect()}
    assert len(got) == len(kept)
    for d, text, lang, source, _ in kept:
        r = got[d]
        assert (r.lang, r.source, r.n_chars) == (lang, source, len(r.text))
        assert "4845168114407329" not in r.text and "x@mail" not in r.text
        assert len(r.text) == len(text) and ("9807915762804490" in text) == ("9807915762804490" in r.text)
        assert re.sub(r"\b4\d{15}|\w@mail", "", r.text) == re.sub(r"\b4\d{15}|\w@mail", "", text)

    pieces = stages["packed"](spark, spark.createDataFrame(list(got.values()), COLUMNS), folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, r in got.items():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.piece)
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]


def test_run_is_the_stages(spark, made):
    rows, _, folder = made
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:2] == ["doc_id", "piece"] and 0 < out.select("doc_id").distinct().count() < len(rows)
    assert language_dictionaries(spark.read.parquet(f"{folder}/documents.parquet")) and PSEUDONYM_KEY


def test_empty_and_extra_columns(spark, made):
    _, _, folder = made
    more = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words int, component_id int"
    empty = spark.createDataFrame([], more)
    filled = spark.createDataFrame([(1, "alphababa gamma delta", "aa", "s", 5, "r", 1, 2)] * 2 + [(None, None, None, None, None, None, None, None)], more)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
        got = stage(spark, filled, folder)
        got.collect()
        assert name == "packed" or got.columns == filled.columns
