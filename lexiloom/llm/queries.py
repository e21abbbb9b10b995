"""The queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..queries import ids_sql
from . import bpe, chroma, html, langid, mixing, quality, secrets, simhash, suffixes, warc
from .common import table

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), VOCAB), VOCAB)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.later_copies(table(spark, sf_dir, "documents"))


def later_copies_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without what op2 finds."""
    return suffixes.remove_later_copies(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), marks=True)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.linked(chroma.fingerprints(chroma.embedding_notes(table(spark, sf_dir, "embeddings")), samples_col="notes", play=chroma.melody))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract_pages(pages, html.fit(html.training_pairs(pages, table(spark, sf_dir, "documents"))))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.flat_headers(warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages"))))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op")} | {"later_copies_removed": later_copies_removed}


def oracle_sql() -> dict[str, str]:
    encoded = f"{ids_sql()} SELECT doc_id, ids AS token_ids, len(ids)::INTEGER AS n_tokens, text FROM encoded JOIN documents USING (doc_id)"
    return {"op1_byte_bpe": encoded, "op3_quality_rules": quality.SQL, "op4_mix_sources": mixing.SQL, "op5_secret_scan": secrets.sql(), "op8_warc_revisits": warc.SQL}
