"""The queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagraph.llm import bpe, classlm, collocations, htmltext, lexical, licenses, mixing, oracle, pq, quality, simhash, text_oracle, tokenfile, topk, urlfilter
from sylvagraph.sources.tables import read_table


def op7_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, ranks, pattern, keep=["doc_id"]), ranks, pattern)
    return both.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, constant = urlfilter.train(urlfilter.labelled_table(spark))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, weights, constant, urlfilter.RULES).select("page_id", "host", "path", "rule", "verdict", "p_unwanted")


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs).select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_row").alias("row_in_block"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_pq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.fit_and_score(read_table(spark, sf_dir, "documents"), rounds=classlm.ROUNDS)


def op10_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = tokenfile.write(docs, tokenfile.fresh_path(spark), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    sums = tokenfile.checksums(tokenfile.read(spark, path), ["doc_id", "n_tokens", "part", "row"])
    return tokenfile.with_starts(sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"]), ["doc_id"])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_pfair_mixing": op2_pfair_mixing,
    "op3_html_text": op3_html_text,
    "op4_quality_discriminant": op4_quality_discriminant,
    "op5_pq_neardup": op5_pq_neardup,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op7_voronoi_topk": op7_voronoi_topk,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_class_lm": op9_class_lm,
    "op10_token_parquet": op10_token_parquet,
    "op11_license_scan": op11_license_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op2_pfair_mixing": oracle.pfair_mixing(),
    "op5_pq_neardup": oracle.NEAR_VECTORS,
    "op7_voronoi_topk": oracle.TOP_K,
    "op11_license_scan": text_oracle.license_scan(),
    "op12_lexical_search": text_oracle.LEXICAL,
    "op13_collocations": text_oracle.COLLOCATIONS,
}
