"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled
documents. A text is compressed with every dictionary, in pieces short enough for the dictionary
to matter throughout; the language whose dictionary makes it smallest wins, and where the next one
comes close the text is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.llm.rows import map_rows

LETTER = regex.compile(r"\p{L}")
PIECE = 4096  # bytes compressed at once
LEVEL = 6
SHORTEST_MATCH = 3  # bytes: texts of a few words still match the dictionary
#: bytes.translate table: ASCII that is no lower-case letter becomes a space.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def plain_letters(text: str) -> bytes:
    """The whole text in lower case, without digits, signs and repeated white space."""
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def held_out(id_column: str | Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column.cast("string")) % 4 == 2, F.lit(False))


def language_dictionaries(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    sample: int = 256, dictionary_bytes: int = 131072,
) -> list[tuple[str, bytes]]:
    """(language, dictionary) learned from labelled documents that are not held out.

    Bound: of each language at most ``sample`` documents, one for each residue of a hash of the
    id (the one of smallest hash), and at most ``dictionary_bytes`` of text, each document adding
    an equal share. Languages are returned by falling number of documents, then by name.
    """
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")
    ).where("text is not null and lang is not null and doc_id is not null").where(~held_out("doc_id"))
    hashed = rows.withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    chosen = (
        hashed.groupBy("lang", F.pmod("h", F.lit(sample)).alias("slot"))
        .agg(F.min(F.struct("h", "doc_id")).alias("first"), F.count("*").alias("n")).collect()
    )
    if not chosen:
        return []
    ids = [r["first"]["doc_id"] for r in chosen]
    counts: dict[str, int] = {}
    for r in chosen:
        counts[r.lang] = counts.get(r.lang, 0) + r.n
    share = F.lit(dictionary_bytes)  # characters of one document that can matter at all
    texts = (
        rows.where(F.col("doc_id").isin(ids)).groupBy("lang", "doc_id")
        .agg(F.min(F.substring("text", 1, share)).alias("text")).orderBy("lang", "doc_id").collect()
    )
    found: list[tuple[str, bytes]] = []
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        own = [plain_letters(t.text) for t in texts if t.lang == lang]
        own.sort(key=len)
        left, content = dictionary_bytes, []
        for k, text in enumerate(own):  # what short documents leave unused goes to longer ones
            content.append(text[: left // (len(own) - k)])
            left -= len(content[-1])
        found.append((lang, b"\n".join(content)))
    even = max(8192, min(len(c) for _, c in found))  # equal sizes: no language wins by its amount
    return [(lang, content[-even:]) for lang, content in found]


def with_language(documents: DataFrame, dictionaries: list[tuple[str, bytes]], text_column: str = "text", least_margin: float = 0.001) -> DataFrame:
    """(row, lang_pred, score, rejected): every row packed in ``row``, with its language.

    ``lang_pred`` is the language of the smallest compressed size (ties: the more frequent one in
    learning), ``und`` for a null text, one without letters, or when nothing was learned.
    ``score`` is the part of the second-smallest size that the best one saves, 0 for ``und``.
    ``rejected``: ``und``, or a score below ``least_margin``. Whole texts are read, their letters in
    lower case.
    Repeated rows, null ids and other columns do no harm.
    """
    sent = documents.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        names, compressors = [], []
        for name, content in sent.value:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=PIECE, dict_size=len(content), min_match=SHORTEST_MATCH,
                write_content_size=False, write_dict_id=False, write_checksum=False,
            )
            d.precompute_compress(compression_params=settings)
            names.append(name)
            compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings))

        def classify(columns: list[pa.Array]) -> list[pa.Array]:
            best, score = [], []
            for value in columns[0]:
                text = value.as_py()
                if not names or text is None or not LETTER.search(text):
                    best.append("und")
                    score.append(0.0)
                    continue
                data = plain_letters(text)
                pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors], np.int64)
                order = np.argsort(sizes, kind="stable")
                best.append(names[order[0]])
                second = sizes[order[1]] if len(order) > 1 else len(data) + sizes[order[0]]
                score.append(float(1 - sizes[order[0]] / second))
            reject = [b == "und" or s < least_margin for b, s in zip(best, score, strict=True)]
            return [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())]

        return classify

    return map_rows(documents, [F.col(text_column)], "lang_pred string, score double, rejected boolean", make)


def identify_languages(documents: DataFrame, dictionaries: list[tuple[str, bytes]], least_margin: float = 0.001) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row; see ``with_language``."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_language(rows, dictionaries, "text", least_margin).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )
