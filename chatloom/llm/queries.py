"""The numbered operators as queries over the given tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import bestfit, bpe, forest, jaccard, langid, metric, packing, periods, planes, quality, secrets, suffixes, warc
from chatloom.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").where((fold() != 1) & F.col("quality").isNotNull()).select("doc_id", "quality")
    # At most TRAIN_ROWS ids, so sending them to the documents is bounded.
    rows = docs.join(F.broadcast(quality.choose(labels)), "doc_id")
    model = quality.fit(rows, "quality", declared="n_chars")
    judged = quality.score(docs.withColumn("held_out", fold() == 1), model, declared="n_chars")
    return judged.select("doc_id", "held_out", "score", "predicted")


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of the pages: each page's response, a later revisit of it under
    another spelling of its URL, and a capture of its host's front page, of which one
    in four is a response.  Some validators are weak, wrong, or left out."""
    def record(number, url, fetched, status, **headers):
        told = ", ".join(f"struct('{n.replace('_', '-')}' as name, cast({v} as string) as value)" for n, v in headers.items())
        return f"struct({number} as record_id, {url} as url, {fetched} as fetched, {status} as status, array({told}) as headers)"

    front = "substring_index(url, '/', 3)"
    tag = "case when page_id % 11 = 0 then null when page_id % 7 = 0 then 'other' when page_id % 3 = 0 then concat('W/', md5(html)) else md5(html) end"
    full = record("page_id * 3", "url", "page_id * 10", "200", Date="page_id * 10", ETag="md5(html)",
                  Content_Length="length(html)", Cache_Control="'max-age=60'")
    again = record("page_id * 3 + 1", f"concat(upper({front}), substring(url, length({front}) + 1), '#seen')",
                   "page_id * 10 + 1000", "304", date="page_id * 10 + 1000", etag=tag, content_length="'0'", cache_control="'max-age=600'")
    home = record("page_id * 3 + 2", "concat('http://', host, '/')", "page_id * 10 + 5", "if(page_id % 4 = 0, 200, 304)",
                  Date="page_id * 10 + 5", ETag="md5(concat(host, cast(page_id div 400 as string)))", Server="'s'",
                  Vary="if(page_id % 4 = 0, 'accept', 'accept-encoding')")
    named = pages.withColumn("host", F.regexp_extract("url", "^https?://([^/?#]*)", 1))
    made = named.selectExpr(f"inline(array({full}, {again}, {home}))")
    return made.withColumn("headers", F.filter("headers", lambda h: h["value"].isNotNull()))


@query
def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


@query
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold() != 1).select("text", "lang"))
    judged = langid.predict(docs.select("doc_id", (fold() == 1).alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return forest.search(rows, F.col("vec_id") % 50 == 0)


@query
def op9_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.links(table(spark, sf_dir, "embeddings"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents")).withColumnRenamed("kept_text", "text")


@query
def op11_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.cluster(table(spark, sf_dir, "embeddings"))


def planted(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text; one text in ten repeats a stretch of itself from some word on."""
    words = text.split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.table(table(spark, sf_dir, "documents"), cut=planted)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.*",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
