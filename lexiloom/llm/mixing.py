"""Mixing sources to target weights by Poisson replication.

A source's documents are to be repeated at a mean rate that brings the source to
its target weight. Each document's count is the Poisson quantile, for that rate,
of a number in [0, 1) that a seeded hash draws from its id. Documents are
exploded by their counts and shuffled globally.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, if_small

WEIGHTS = {"src0": 4.0}
SEED = 17


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_cdf(rate: Column) -> Column:
    """P(count <= n) for n = 0, 1, ... as far as doubles tell it from 1. In logarithms, so that no rate is too large."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30)
    start = F.struct((-rate).alias("lp"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s, n):
        lp = s["lp"] + F.ln(rate / n)
        return F.struct(lp.alias("lp"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + F.exp(lp))).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), last), start, step, lambda s: s["cdf"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, size: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, n_docs, rate, cdf): weights are relative among the sources that occur; a null source is one of its own.

    ``size``: rows of the mixture for each row of ``docs``.
    """
    if default_weight < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("a weight is negative")
    weight = F.lit(float(default_weight))
    for s, w in weights.items():
        weight = F.when(F.col("source") == s, float(w)).otherwise(weight)
    n = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n_docs")).withColumn("weight", weight)
    total = n.agg(F.sum("n_docs").alias("all_docs"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_docs") * float(size) / F.col("n_docs")).otherwise(0.0)
    return n.crossJoin(total).select("source", "n_docs", rate.alias("rate")).withColumn("cdf", poisson_cdf(F.col("rate")))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    default_weight: float = 1.0,
    seed: int = SEED,
    size: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    marks: bool = False,
) -> DataFrame:
    """``docs`` with each row as often as its Poisson count, in global random order.

    The same ids, seed and weights give the same counts. Rows that share an id have one count; a row
    without an id draws its count from its text. Weights that are all 0 give no rows. ``marks`` adds
    mix_copy (from 1) and mix_key, by which the rows of each partition are sorted; columns of these
    names that are there already are left out. All others stay as they are.
    """
    docs = docs.drop("mix_copy", "mix_key")
    src, cdf, draw, name_, n, copy, key = fresh(docs, "source_", "cdf", "u", "name", "n", "mix_copy", "mix_key")
    rates = source_rates(docs, weights, default_weight, size, source_col).select(F.col("source").alias(src), F.col("cdf").alias(cdf))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5(F.col(text_col)), F.lit(""))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = (
        docs.withColumn(draw, uniform(F.concat(F.lit(f"{seed}:"), name)))
        .withColumn(name_, name)
        .join(if_small(rates), F.col(source_col).cast("string").eqNullSafe(F.col(src)))
        .withColumn(n, F.size(F.filter(cdf, lambda c: c <= F.col(draw))))
        .filter(F.col(n) > 0)
    )
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    keyed = copies.withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), name_, F.lit(":"), F.col(copy).cast("string"))))
    out = keyed.select(*docs.columns, copy, key).repartition(parts, key).sortWithinPartitions(key)
    return out.withColumnsRenamed({copy: "mix_copy", key: "mix_key"}) if marks else out.select(*docs.columns)


SQL = f"""
WITH n AS (
  SELECT source, count(*) AS n_docs, CASE WHEN source = 'src0' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM documents GROUP BY source),
r AS (
  SELECT source, weight / (SELECT sum(weight) FROM n) * (SELECT sum(n_docs) FROM n) * 1.0::DOUBLE / n_docs AS rate FROM n),
p AS (
  SELECT source, rate, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate / k) END) OVER (PARTITION BY source ORDER BY k) AS lp
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r)),
c AS (SELECT source, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
cdfs AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (
  SELECT doc_id, text, lang, d.source, n_chars,
    len(list_filter(cdf, lambda x: x <= CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0)) AS copies
  FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source)
SELECT doc_id, text, lang, source, n_chars, mix_copy::INTEGER AS mix_copy, md5('{SEED}:' || doc_id || ':' || mix_copy) AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS mix_copy FROM d)
"""
