"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, audit, bpe, exact, lm_score, packing, periodic, simhash, spotsigs, suffix, toxicity, urlfilter, warc
from .storage import table


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": lm_score.query,
    "op2_warc_archive": warc.query,
    "op3_bin_slack": packing.query,
    "op4_spotsigs": spotsigs.query,
    "op5_simhash_dedup": simhash.query,
    "op6_suffix_dedup": suffix.query,
    "op7_bpe_trie": op7_bpe_trie,
    "op8_ann_search": ann.query,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": toxicity.query,
    "op11_exact_dedup": exact.query,
    "op12_periodic_runs": periodic.query,
    "op13_filter_audit": audit.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_archive": warc.ORACLE_SQL,
    "op4_spotsigs": spotsigs.ORACLE_SQL,
    "op6_suffix_dedup": suffix.ORACLE_SQL,
    "op9_url_filter": urlfilter.oracle_sql(),
    "op11_exact_dedup": exact.ORACLE_SQL,
    "op12_periodic_runs": periodic.ORACLE_SQL,
    "op13_filter_audit": audit.ORACLE_SQL,
}
