"""The registered corpus queries: thin calls of the operators over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gazeloom.llm import conversation_repair, decontaminate, language_id, line_dedup, media_ts, packing, quality, simhash, suffix_dedup, token_alignment, token_counts, url_filter, warc

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_line_dedup", line_dedup.ORACLE.replace("{docs}", "documents"))
def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op10_media_ts")
def op10_media_ts(spark, sf_dir):
    return media_ts.to_transport_stream(table(spark, sf_dir, "documents"), keep_media=False).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op7_url_filter", url_filter.ORACLE)
def op7_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.is_held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.drop("lang"), model, keep_text=False).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    import public_tokenizers as P
    return token_alignment.align(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


@query("op11_warc", warc.ORACLE)
def op11_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
