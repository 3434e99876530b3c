"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html_main, mixing, quality_gam, secrets, simhash, sql, token_counts, url_filter, warc
from .common import cut, remove, shared_dir, table

#: op1: domains are groups of sources; weights by tree path.
DOMAINS = sql.DOMAINS
MIX = mixing.Weights({**{(d,): w for d, w in sql.DOMAIN_WEIGHTS.items()}, **{(d, "en"): sql.ENGLISH_WEIGHT for d in sql.DOMAIN_WEIGHTS}})


def source_group() -> F.Column:
    first = F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 4)
    return F.concat(F.lit("group"), (F.conv(first, 16, 10).cast("long") % DOMAINS).cast("string"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, source_group(), MIX, share=0.5, seed=17, max_epochs=4).drop("text")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def packing_edits() -> F.Column:
    """op3, first round: a head, a cut of 16 characters in the middle, a tail."""
    n = F.length(F.coalesce("text", F.lit("")))
    return F.array(_edit(F.lit(0), F.lit(0), "<doc>\n"), _edit(F.floor(n / 2), F.floor(n / 2) + 16, ""), _edit(n, n, "\n</doc>"))


def late_edits() -> F.Column:
    """op3, second round, on the texts of the first: another word after a third,
    and another closing mark."""
    n = F.length("text")
    return F.array(_edit(F.floor(n / 3), F.floor(n / 3) + 5, " word "), _edit(n - 6, n, "<end>"))


def _edit(start: F.Column, end: F.Column, text: str) -> F.Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(text).alias("text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_counts.build(docs).write.option("compression", "zstd").parquet(path)
    chars = lambda name: F.length(F.coalesce("text", F.lit(""))).cast("long").alias(name)
    kept = spark.read.parquet(path).select("doc_id", "text", "tree", chars("n_chars"), F.col("tree.n_pretokens"), F.col("tree.n_tokens"))
    counts = ["n_chars", "n_pretokens", "n_tokens"]
    first = token_counts.apply(kept, packing_edits())
    first = first.withColumns({"n_chars_after": F.length("text").cast("long"), "n_tokens_after": F.col("tree.n_tokens"), "n_reencoded": F.col("edited")})
    counts += ["n_chars_after", "n_tokens_after", "n_reencoded"]
    second = token_counts.apply(first, late_edits())
    rows = cut(second.select("doc_id", *counts, chars("n_chars_later"), F.col("tree.n_tokens").alias("n_tokens_later"), F.col("edited").alias("n_reencoded_later")))
    remove(spark, path)
    return rows


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.span_list(secrets.KINDS[:3])
    counts = {f"n_{k}": F.size(k).cast("long") for k in secrets.KINDS[:3]}
    return found.select("doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(base, 256).alias("base_sha256"), secrets.span_list(secrets.KINDS).alias("spans"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    rows = warc.read_warc(spark, path, payloads=False).where("kind = 'record'")
    rows = cut(rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, path)
    return rows


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model).select("doc_id", quality_gam.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), window=10)
    items = F.col("leak.items")
    return found.select("doc_id", "leak.n_words", "leak.n_hit", F.size(items).cast("long").alias("n_items"), decontaminate.digest(items).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"))


def op10_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = divergence.judge(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_html_main_text": op2_html_main_text,
    "op3_token_counts": op3_token_counts,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_quality_gam": op8_quality_gam,
    "op9_decontaminate": op9_decontaminate,
    "op10_divergence": op10_divergence,
}
ORACLE_SQL = sql.ORACLE_SQL
