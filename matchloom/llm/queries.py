"""The registered queries of the corpus operators, ``opN_<name>``, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.llm import bpe, chat, langid, media, neardup, packing, secrets, topk, toxicity, warc
from matchloom.llm.common import crc_mod, read, stage

#: The learned share of documents, as crc32(doc_id as text) modulo a number.
LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 3, 1
TOXIC_FOLDS, TOXIC_HELD_OUT = 5, 0


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def language_training(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", LANGUAGE_FOLDS) != LANGUAGE_HELD_OUT)


def toxic_training(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod("doc_id", TOXIC_FOLDS) != TOXIC_HELD_OUT)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.archive(spark, read(spark, sf_dir, "pages")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(language_training(docs)))
    held = F.coalesce(crc_mod("doc_id", LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.digest(docs, secrets.fit(docs))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(chat.format_chats(rows.unionByName(extra)))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(topk.usable("embedding")).select("vec_id", topk.integers("embedding").alias("vector"))
    return topk.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, toxic_training(read(spark, sf_dir, "labels"))))
    held = F.coalesce(crc_mod("doc_id", TOXIC_FOLDS) == TOXIC_HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_near_dedup, op2_warc, op3_language_id, op4_secret_scan, op5_chat_format, op6_exact_topk, op7_toxicity, op8_packing, op9_media, op10_bpe, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    warc_sql = """
        with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d, cast(octet_length(encode(coalesce(html, ''))) as bigint) n from pages),
        m as (select *, case when n >= 1000 then max(page_id) over (partition by d) end top from p)
        select page_id, n as payload_bytes, d as payload_digest, case when page_id < top then 'revisit' else 'response' end as record_type,
               case when page_id < top then top end as refers_to
        from m"""
    chat_sql = """
        with rows_ as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
                       union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e as (select *, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') et,
                     lag(r) over (partition by conv_id order by turn, r, t) is not distinct from r as merged from rows_)
        select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) as turns_sha256,
               cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) as loss_chars,
               sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), '')) as loss_sha256,
               cast(sum(length(et) + case when merged then 3 else length(r) + 8 end) as bigint) as formatted_chars
        from e group by conv_id"""
    topk_sql = """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) w from embeddings),
        s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.w, c.w) as bigint) score
              from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20"""
    return {"op2_warc": warc_sql, "op5_chat_format": chat_sql, "op6_exact_topk": topk_sql}
