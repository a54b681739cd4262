"""Queries opN_<name> over the shared tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import decontaminate
from .jaccard_join import jaccard_join
from .language_id import language_id
from .lm_scoring import lm_score
from .mixing import mix
from .quality_classifier import quality_classifier
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .simhash_dedup import simhash_dedup
from .spelling_variants import spelling_variants
from .token_alignment import token_alignment
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filters import url_filter


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("mark")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    return token_alignment(table(spark, sf_dir, "documents"), *files, shown=digest).withColumnRenamed("groups", "groups_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules, op2_language_id, op3_token_counts, op4_url_filters, op5_lm_scoring,
        op6_decontamination, op7_toxicity, op8_quality_classifier, op9_mixing, op10_jaccard_join,
        op11_simhash_dedup, op12_token_alignment, op13_spelling_variants,
    )
    return {f.__name__: f for f in found}


def _quality_sql() -> str:
    limits = " and ".join(f"{r.measure} {sign} {bound}" for r in RULES for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d
), windows as (
  select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as win
  from (select rid, words, unnest(range(1, greatest(len(words) - 1, 1))) as i from w)
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, win) as n from windows) where n > 1
), covered as (
  select rid, count(distinct i + k) as n from twice, (values (0), (1), (2)) as s(k) group by rid
), m as (
  select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words,
    length(text) - length(replace(text, '!', '')) as n_shouts,
    len(list_filter(words, lambda x: lower(x) in ({stops}))) as n_stop_words
  from w left join covered c using (rid)
), r as (
  select *, word_chars / greatest(n_words, 1) as mean_word_chars, n_symbols / greatest(word_chars, 1) as symbol_ratio,
    n_shouts / greatest(n_words, 1) as shout_ratio, n_dup_lines / greatest(n_lines, 1) as duplicate_line_ratio,
    n_repeat_words / greatest(n_words, 1) as repeated_word_ratio, n_stop_words / greatest(n_words, 1) as stop_word_ratio,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {limits} as kept from r
"""


_DECONTAMINATION_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), b as (
  select item_id::varchar as item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark where item_id is not null and text is not null
), bw as (
  select distinct item, least(len(words), 13) as size, array_to_string(words[i:i + 12], ' ') as win
  from (select item, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as i from b where len(words) > 0)
), sizes as (select distinct size from bw
), dw as (
  select rid, i, size, array_to_string(words[i:i + size - 1], ' ') as win
  from (select rid, words, size, unnest(range(1, len(words) - size + 2)) as i from d, sizes where len(words) >= size)
), hits as (select rid, i, bw.size, item from dw join bw on dw.win = bw.win and dw.size = bw.size
), covered as (
  select rid, count(distinct pos) as n from (select rid, unnest(range(i, i + size)) as pos from (select distinct rid, i, size from hits)) group by rid
), items as (
  select rid, count(*) as n, sha256(string_agg(item, ',' order by item)) as digest from (select distinct rid, item from hits) group by rid
)
select doc_id, len(words)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items,
  coalesce(i.digest, sha256('')) as items_sha256, coalesce(c.n, 0) > 0 and 20 * coalesce(c.n, 0) >= len(words) as contaminated
from d left join covered c using (rid) left join items i using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _quality_sql(), "op6_decontamination": _DECONTAMINATION_SQL}
