"""The registered queries: each applies one operator with its production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landlace.llm import decontam, langid, media, ngrams, packing, pii, quality, simhash, tokens, tokenstore, toxicity
from landlace.llm.common import is_held_out, shared_dir, table, written

Query = Callable[[SparkSession, str], DataFrame]


def _with_fold(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", is_held_out(F.col("doc_id")))


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngrams.score(table(spark, sf_dir, "documents"), order=3, alpha=0.4)
    return scored.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _with_fold(toxicity.score(docs, model, 0.3)).select("doc_id", "held_out", "score", "predicted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), words=4, bits=4)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, tokens.public_path("piece_bpe_32k.model"))
    return _with_fold(langid.predict(docs, model)).select("doc_id", "held_out", "lang_pred", "score")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.text_media(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its ordered elements, with media references resolved against the store of the documents' payloads."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("key"), F.encode("text", "utf-8").alias("payload"))
    media.put(docs, f"{folder}/media")
    found = written(media.described(spark, f"{folder}/media"), f"{folder}/described")
    out = media.interleaved(table(spark, sf_dir, "pages"), found)
    kinds = F.concat_ws("", F.transform("elements", lambda e: F.when(e["kind"] == "media", "m").otherwise("t")))
    return out.select("page_id", F.size("elements").alias("n_elements"), kinds.alias("kinds"), F.sha2(F.to_json("elements"), 256).alias("elements_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _with_fold(quality.score(docs, model, 0.7)).select("doc_id", "held_out", "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.with_end("word_bpe_49k.json", 1), length=2048)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store(table(spark, sf_dir, "documents"), packing.with_end("word_bpe_49k.json", 2), vocabulary=49_408)


def queries() -> dict[str, Query]:
    own = (op1_decontam, op2_backoff, op3_toxicity, op4_simhash, op5_langid, op6_media, op7_quality, op8_packing, op9_pii, op10_tokens, media_pages)
    return {f.__name__: f for f in own}


BACKOFF_SQL = r"""
with words as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') as w from documents),
t as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from words),
p as (select *, lag(x, 1) over d as x1, lag(x, 2) over d as x2 from t window d as (partition by doc_id order by i)),
c as (select *, count(*) over (partition by x) - count(*) over (partition by doc_id, x) as l1,
  case when i >= 2 then count(*) over (partition by x1, x) - count(*) over (partition by doc_id, x1, x) end as l2,
  case when i >= 3 then count(*) over (partition by x2, x1, x) - count(*) over (partition by doc_id, x2, x1, x) end as l3,
  count(*) over () - count(*) over (partition by doc_id) as rest from p),
s as (select *, lag(l1) over d as k2, lag(l2) over d as k3 from c window d as (partition by doc_id order by i)),
v as (select doc_id, case when i >= 3 and l3 > 0 then ln(l3 / k3) when i >= 2 and l2 > 0 then ln(l2 / k2) + (case when i >= 3 then 1 else 0 end) * ln(0.4::double)
  when l1 > 0 then ln(l1 / rest) + least(i - 1, 2) * ln(0.4::double) else least(i - 1, 2) * ln(0.4::double) - ln(rest + 1) end as score from s),
g as (select doc_id, count(*) as n, sum(score) as s from v group by doc_id)
select doc_id, coalesce(n, 0) as n_tokens, round(coalesce(s, 0), 4) as log_score, round(s / n, 6) as mean_log_score from documents left join g using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL can say the n-gram scores; the other operators rest on models, hashes, tokenizers or media, which the tests hold against brute force."""
    return {"op2_backoff": BACKOFF_SQL}
