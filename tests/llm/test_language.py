import zlib

from pyspark.sql import functions as F

from bankspark.llm.language import identify_languages, language_dictionaries, with_language


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    dictionaries = language_dictionaries(docs)
    assert [n for n, _ in dictionaries][0] == "en" and len(dictionaries) == 4
    rows = identify_languages(docs, dictionaries).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 0.03 * len(rows)


def test_learns_nothing_from_held_out_rows(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "held out words" if i in held else "die und der" if i % 2 else "the and of", "xx" if i in held else "de" if i % 2 else "en") for i in range(400)]
    found = language_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {n for n, _ in found} == {"de", "en"}
    assert not any(b"held" in c for _, c in found)


def test_edges(spark):
    dictionaries = [("aa", b"alpha beta gamma delta " * 20), ("bb", b"eins zwei drei vier " * 20)]
    texts = [None, "", "123 ... 456", "ALPHA beta!! gamma", "eins zwei drei", "alpha beta gamma " * 30000, "中文", "x" * 100000]
    rows = [(k, t, 5, "s") for k, t in enumerate(texts)] + [(None, "eins zwei drei", 5, "s"), (4, "eins zwei drei", 5, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, lang_pred string")
    got = identify_languages(docs, dictionaries).collect()
    assert len(got) == len(rows)
    pred = [r.lang_pred for r in got]
    assert pred[:6] == ["und", "und", "und", "aa", "bb", "aa"] and pred[8:] == ["bb", "bb"]
    assert pred[6] in ("aa", "bb") and got[8].held_out is False
    assert [r.rejected for r in got][:5] == [True, True, True, False, False]
    assert {r.lang_pred for r in identify_languages(docs, []).collect()} == {"und"}
    assert language_dictionaries(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) == []
    assert identify_languages(docs.limit(0), dictionaries).collect() == []
    assert with_language(docs, dictionaries).select("row.*").columns == docs.columns
