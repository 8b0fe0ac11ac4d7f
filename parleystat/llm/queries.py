"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleystat.llm import (
    chat,
    decontaminate,
    jaccard_join,
    language_id,
    line_quality,
    oracle,
    quality_rules,
    secrets,
    sentencepiece_fst,
    token_alignment,
    token_files,
    toxic_spans,
    warc,
    whitening,
)
from parleystat.llm.common import scratch, stored, table

END_ID = 2


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(warc.with_revisits(table(spark, folder, "pages"), least_bytes=0), path)
    return warc.page_results(warc.read_warc(spark, path))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_fst.encode_documents(table(spark, folder, "documents"), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_equal")


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "token-files")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(table(spark, folder, "documents"), path, tokenizer, public_tokenizers.PATTERN, END_ID)
    return token_files.read_token_files(spark, path)


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.components(table(spark, folder, "documents"), width=3, threshold=(90, 100))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = stored(quality_rules.measures(table(spark, folder, "documents")), "measures")
    judged = quality_rules.judged(measured, quality_rules.fit(measured))
    base = [f"m.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *base, "base_failed", "kept", "quality")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.with_spans(table(spark, folder, "documents"))

    def digest(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id",
        *map(count, secrets.BASE),
        F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.with_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (decontaminate.n_hit() > 0).alias("contaminated"),
    )


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs.where(_remainder(4) != 2))
    return language_id.predict(docs, model).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op9_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = line_quality.fit(docs, labels.where(_remainder(3) != 1))
    return line_quality.predict(docs, model).select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


ESCAPED = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    role = F.coalesce("role", F.lit("")).alias("role")
    records = rows.select("conv_id", F.to_json(F.struct("turn", role, "text")).alias("record"))
    extra = [(-7, json.dumps({"turn": k, "role": role, "text": ESCAPED})) for k, role in enumerate(("user", "assistant"))]
    records = records.unionByName(spark.createDataFrame(extra, "conv_id long, record string"))
    path = scratch(spark, "chat")
    chat.format_conversations(chat.canonical_turns(records)).write.parquet(path)
    return chat.read_back(spark.read.parquet(path))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    names = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.link_strengths(token_alignment.aligned(table(spark, folder, "documents"), *names))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    model = whitening.fit(vectors, "embedding", components=8)
    error = whitening.identity_error(vectors, "embedding", model)
    return whitening.whiten(vectors, "vec_id", "embedding", model).withColumn("identity_error", F.lit(error))


def op13_toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    tagger = toxic_spans.fit(docs, labels.where(_remainder(5) != 0))
    return toxic_spans.predict(docs, tagger).select(
        "doc_id",
        (_remainder(5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def queries() -> dict:
    found = (
        op1_warc,
        op2_sentencepiece,
        op3_token_files,
        op4_jaccard_join,
        op5_quality_rules,
        op6_secrets,
        op7_decontaminate,
        op8_language_id,
        op9_line_quality,
        op10_chat,
        op11_token_alignment,
        op12_whitening,
        op13_toxic_spans,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
