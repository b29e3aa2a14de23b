"""One registered query per operator of this subpackage, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import alignment, bpe, decontaminate, htmltext, languages, lines, mixing, passages, simhash, spelling, topk, toxicity, warc
from tidewatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return build

    return register


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash(table(spark, folder, "documents"), words=3, radius=3)


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_dedup(table(spark, folder, "documents"))


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_mixing")
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, folder, "documents"))


@query("op1_warc", """
with p as (
  select page_id, coalesce(url, '') as url, octet_length(encode(coalesce(html, ''))) as payload_bytes,
    sha1(encode(coalesce(html, ''))) as payload_digest,
    strftime(to_timestamp(1704067200 + page_id % 31536000) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as captured_at
  from pages
), k as (
  select *, max(page_id) over (partition by payload_digest) as response,
    array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[0-9]*\\.', ''), '.')), ',')
      || ')' || lower(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '', 's')) as url_key
  from p
), r as (
  select *, case when payload_bytes >= 1000 and response <> page_id then response end as refers_to from k
)
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to,
  url_key, captured_at, row_number() over (order by url_key, captured_at, page_id) as position
from r
""")
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.capture_index(table(spark, folder, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")


@query("op2_topk", """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s
qualify rank <= 20
""")
def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, folder, "embeddings"))
    return topk.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


@query("op4_languages")
def op4_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.language_id(table(spark, folder, "documents"))


@query("op6_htmltext")
def op6_htmltext(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages"))


@query("op8_passages")
def op8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.aligned_documents(table(spark, folder, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.tokens(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_spelling")
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))
