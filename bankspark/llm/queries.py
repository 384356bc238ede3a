"""The registered queries of the corpus operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankspark.llm.byte_bpe import decode_ids, encode_texts
from bankspark.llm.fm_index import contamination
from bankspark.llm.jaccard import jaccard_components
from bankspark.llm.language import identify_languages, language_dictionaries
from bankspark.llm.licenses import license_scan
from bankspark.llm.likelihood import quality_rules
from bankspark.llm.packing import pack_documents
from bankspark.llm.periodic_runs import periodic_runs
from bankspark.llm.pseudonyms import pseudonymise
from bankspark.llm.quotations import link_quotations
from bankspark.llm.sql import ORACLE_SQL
from bankspark.llm.token_align import align_tokens, coded_links, score_links
from bankspark.llm.warc_chunks import read_back
from bankspark.llm.weak_labels import classify_quality
from bankspark.session import configure, cut_lineage, ship_package

#: Key of the registered query; whoever publishes a corpus passes a secret one.
PSEUDONYM_KEY = "registered query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def llm_query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name; settings and package go to the session first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@llm_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, numerator=90, denominator=100)


@llm_query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"))


@llm_query
def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


@llm_query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=2048)


@llm_query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@llm_query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13, one_in=20).drop("spans")


@llm_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@llm_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify_languages(documents, language_dictionaries(documents))


@llm_query
def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(table(spark, sf_dir, "pages"))


@llm_query
def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(documents, PSEUDONYM_KEY)


def with_planted_period(documents: DataFrame) -> DataFrame:
    """(doc_id, text): with h the CRC-32 of the id, a text of n words whose h ends in 0 repeats p of its words from word a on."""
    spread = F.floor(F.crc32(F.col("doc_id").cast("string")) / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = spread % n
        p = 1 + F.floor((n - a) / (3 + spread % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int")))), " ")

    planted = F.element_at(F.transform(F.array(words), repeated), 1)
    return documents.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


@llm_query
def op11_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_period(table(spark, sf_dir, "documents")), min_length=24, min_exponent=3)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    higher = lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)
    top = F.aggregate("runs", none, higher)  # runs stand by start, then period: the first of equals stays
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@llm_query
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    aligned = align_tokens(table(spark, sf_dir, "documents"), *paths, outputs=("groups", "a_links", "b_links"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    kept = aligned.select("doc_id", "n_a", "n_b", "n_groups", digest, "a_links", "b_links")
    scored = score_links(cut_lineage(coded_links(kept)))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@llm_query
def op13_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encode_texts(table(spark, sf_dir, "documents"), path, pattern)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    decoded = decode_ids(ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"), path, pattern)
    return decoded.select("row.*", F.sha2("decoded", 256).alias("decoded_sha256"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
