"""The queries op1_ to op13_ over the given tables, with comparison SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.llm import (
    conversation_repair, decontaminate, katz, language_id, licenses, line_dedup, ngram_join, packing, periodic_runs, quality_rules,
    suffix_dedup, token_counts, warc,
)
from pagefacts.llm.common import crc_mod, table
from pagefacts.llm.oracles import ORACLES
from pagefacts.session import durable_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_join(spark, sf_dir):
    return ngram_join.link_counts(table(spark, sf_dir, "documents"))


@query
def op2_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op3_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    folder = f"{durable_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, folder)
    found = warc.records(warc.read_chunks(spark, folder, with_data=False))
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


@query
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_line_dedup(spark, sf_dir):
    out = line_dedup.report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


@query
def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.fit(docs, ~held_out)
    named = language_id.identify(docs.select("doc_id", "text"), model)
    return named.select("row.doc_id", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans")).withColumn(
        "held_out", held_out
    )


@query
def op9_katz_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 7) == 2
    return katz.score(docs, katz.fit(docs, ~held_out)).withColumn("held_out", held_out)


@query
def op10_decontamination(spark, sf_dir):
    out = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op11_periodic_runs(spark, sf_dir):
    docs = periodic_runs.repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.collapse(docs))


@query
def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.remove_shared(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op13_conversation_repair(spark, sf_dir):
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, present="present")
