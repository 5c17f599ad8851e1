"""Queries of the subpackage, each applying one operator to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, decontam, embdup, langid, lm, pii, simhash, suffixdup, toxicity, urlfilter
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op2_decontamination(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), vocabulary("piece_bpe_32k.model"))


def op4_embeddings(spark, sf_dir):
    return embdup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffixes(spark, sf_dir):
    return suffixdup.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_urls(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages", "page_id", "url"), urlfilter.RULES)


def op8_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op10_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op1_bpe": op1_bpe, "op2_decontamination": op2_decontamination, "op3_language": op3_language, "op4_embeddings": op4_embeddings, "op5_simhash": op5_simhash, "op6_suffixes": op6_suffixes, "op7_urls": op7_urls, "op8_lm": op8_lm, "op9_toxicity": op9_toxicity, "op10_pii": op10_pii}

ORACLES = {
    "op7_urls": r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT u.page_id, u.host, u.path, r.rh || r.rp AS rule, r.v,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.rh || r.rp) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
}
