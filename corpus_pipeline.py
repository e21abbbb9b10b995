"""From raw documents to token ids, in stages that are each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import bpe, langid, mixing, secrets, simhash
from lexiloom.llm.common import shared_folder, table
from lexiloom.llm.queries import VOCAB


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no known language explains most words go, and those without any letter (null and empty texts too).

    Each row is decided by its text alone: null or repeated ids, repeated rows, and null or clashing other columns make no
    difference. The models are fitted on a bounded sample of the rows that have an id and a language. An empty
    table stays empty.
    """
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the least id, a null id coming last.

    Rows that share an id but not a text are different documents; of rows with the same id and text the least by
    its other columns stays. Texts without any word (null and empty ones too) are near nothing and stay. Columns
    of any name stay as they are; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows where that happened; no row goes.

    Null and empty texts, null or repeated ids, repeated rows and columns of any name stay as they are.
    """
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat, or go, so that sources have their target weights; the order is random.

    A null source is a source. Rows that share an id have one count; a row without an id draws it from its text, a null
    text among them. Columns named mix_copy or mix_key are left out, all others stay. An empty table stays empty.
    """
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, text): each row's token ids, and the text that they decode to.

    A null text has nulls, an empty one no ids. Ids may be null or repeat; other columns are left out.
    """
    return bpe.bpe_decode(bpe.bpe_encode(docs, VOCAB), VOCAB)


STAGES = [("language ID", identify), ("near-dedup", deduplicate), ("secrets", mask), ("mixing", mix), ("byte-level BPE", encode)]

#: SQL can express neither the language models nor the fingerprints.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What lies between them goes to the session's shared checkpoint folder.

    A step's folder goes once the next one is written. The last one stays, as the result is read from it when it is
    used: whoever owns the checkpoint folder clears it, as with Spark's own checkpoints.
    """
    here = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{here}/{k}")
            docs = spark.read.parquet(f"{here}/{k}")
            if k:
                remove(spark, f"{here}/{k - 1}")
    return docs
