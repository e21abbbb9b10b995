"""Evaluation of tokenizers and vocabularies as DataFrame queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_char_a_byte(token: Column | str) -> Column:
    col = F.col(token) if isinstance(token, str) else token
    return F.decode(col.cast("binary"), "ISO-8859-1")


def is_superword(token: Column | str) -> Column:
    """A space follows something other than a space: there is one after those at the start."""
    col = F.col(token) if isinstance(token, str) else token
    return F.ltrim(col.cast("string")).contains(" ")


def share(part: Column, whole: Column, digits: int = 4, scale: float = 1.0) -> Column:
    return F.when(whole > 0, F.round(F.lit(scale) * part / whole, digits)).otherwise(0.0)


def bytes_per_token(encoded: DataFrame, text_col: str = "text", ids_col: str = "ids", *by: str) -> DataFrame:
    """(by..., bytes, tokens, bytes_per_token)."""
    n, t = F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long"), F.coalesce(F.sum(F.size(ids_col)), F.lit(0)).cast("long")
    return encoded.groupBy(*by).agg(n.alias("bytes"), t.alias("tokens")).withColumn("bytes_per_token", share(F.col("bytes"), F.col("tokens")))


def vocab_summary(vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """One row: sizes, shares and means of a vocabulary of distinct tokens."""
    v = vocab.select(one_char_a_byte(token_col).alias("t")).withColumn("n", F.length("t")).withColumn("s", F.col("t").rlike("(?s)[^ ] "))
    own = F.when(F.col("s"), F.col("n"))
    words = F.when(F.col("s"), F.length(F.regexp_replace(F.trim("t"), "[^ ]+", "")) + 1)
    a = v.agg(F.count("*").alias("vocab_size"), F.count(own).alias("n_superwords"), F.sum("n").alias("total"), F.sum(own).alias("own"), F.max(own).alias("longest"), F.sum(words).alias("words"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.select("vocab_size", "n_superwords", share(F.col("n_superwords"), F.col("vocab_size")).alias("superword_fraction"), share(zero("total"), F.col("vocab_size"), 2).alias("mean_token_len"), share(zero("own"), F.col("n_superwords"), 2).alias("mean_superword_len"), zero("longest").alias("max_superword_len"), share(zero("words"), F.col("n_superwords"), 2).alias("mean_words_per_superword"))


def longest_superwords(vocab: DataFrame, n: int = 12, token_col: str = "token") -> DataFrame:
    """The ``n`` longest, of equals the first by their bytes."""
    return vocab.filter(is_superword(token_col)).select(one_char_a_byte(token_col).alias("token")).withColumn("bytes", F.length("token")).orderBy(F.desc("bytes"), "token").limit(n)


def vocab_overlap(ours: DataFrame, theirs: DataFrame, token_col: str = "token") -> DataFrame:
    """(part, ours, theirs, shared, ours_only, theirs_only, jaccard, percentages) for all, subwords and superwords."""
    a, b = (d.select(F.col(token_col).alias("t")).distinct() for d in (ours, theirs))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "t", "full").withColumn("s", is_superword("t"))
    parts = F.explode(F.array(F.lit("vocab"), F.when(F.col("s"), "superwords").otherwise("subwords"))).alias("part")
    have = lambda *c: F.count(F.when(sum(F.col(x).isNotNull().cast("int") for x in c) == len(c), 1))
    g = both.select("a", "b", parts).groupBy("part").agg(have("a").alias("ours"), have("b").alias("theirs"), have("a", "b").alias("shared"))
    return g.select(
        "part", "ours", "theirs", "shared", (F.col("ours") - F.col("shared")).alias("ours_only"), (F.col("theirs") - F.col("shared")).alias("theirs_only"),
        share(F.col("shared"), F.col("ours") + F.col("theirs") - F.col("shared")).alias("jaccard"),
        share(F.col("shared"), F.col("ours"), 2, 100.0).alias("shared_pct_of_ours"), share(F.col("shared"), F.col("theirs"), 2, 100.0).alias("shared_pct_of_theirs"),
    )


def averaged_rank(order: Column, *by: str) -> Column:
    """Ranks from 1, those of equals averaged."""
    part = Window.partitionBy(*by)
    return F.rank().over(part.orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, order)) - 1) / F.lit(2.0)


def rank_agreement(ours: DataFrame, theirs: DataFrame, key: list[str], rank_col: str = "rank") -> DataFrame:
    """(shared, spearman) of what both rank; spearman is null for less than two, or where all ranks are equal."""
    both = ours.select(*key, F.col(rank_col).alias("__x")).join(theirs.select(*key, F.col(rank_col).alias("__y")), key)
    r = both.select(averaged_rank(F.col("__x")).alias("x"), averaged_rank(F.col("__y")).alias("y"))
    rho = F.corr("x", "y")
    return r.agg(F.count("*").alias("shared"), F.when(F.isnan(rho), None).otherwise(F.round(rho, 4)).alias("spearman"))


def displacement(ours: DataFrame, theirs: DataFrame, token_col: str = "token", id_col: str = "id") -> DataFrame:
    """(shared, median, p90, max, within_100): how far apart ids of shared tokens are. Order statistics, not interpolated."""
    both = ours.select(token_col, F.col(id_col).alias("__x")).join(theirs.select(token_col, F.col(id_col).alias("__y")), token_col)
    d = both.select(F.abs(F.col("__x") - F.col("__y")).alias("d"))
    n = d.agg(F.count("*").alias("n"))
    at = d.withColumn("k", F.row_number().over(Window.orderBy("d")) - 1).crossJoin(n)
    pick = lambda i: F.max(F.when(F.col("k") == i, F.col("d")))
    return at.agg(F.count("*").alias("shared"), pick(F.floor(F.col("n") / 2)).alias("median"), pick(F.floor(F.col("n") * 0.9)).alias("p90"), F.max("d").alias("max"), F.coalesce(F.round(100.0 * F.avg((F.col("d") <= 100).cast("int")), 2), F.lit(0.0)).alias("within_100"))


def examples(ours: DataFrame, theirs: DataFrame, n: int = 10, token_col: str = "token", id_col: str = "id") -> DataFrame:
    """(kind, k, token): superwords that are shared or one side's alone, the earliest and the longest."""
    # tokens of one side with all their ids, so that a token that is there twice is listed twice; a token's form decides nothing until the last rows
    token = F.col(token_col) if ours.schema[token_col].dataType == theirs.schema[token_col].dataType else F.col(token_col).cast("binary")
    a, b = (d.filter(is_superword(token_col)).groupBy(token.alias("t")).agg(F.collect_list(F.struct(F.col(id_col).alias("id"))).alias(x)) for d, x in ((ours, "a"), (theirs, "b")))
    both = a.join(b, "t", "full")
    kinds = F.when(F.col("a").isNull(), F.array(F.lit("theirs_only_earliest"), F.lit("theirs_only_longest"))).when(F.col("b").isNull(), F.array(F.lit("ours_only_earliest"), F.lit("ours_only_longest"))).otherwise(F.array(F.lit("shared_earliest")))
    rows = both.select("t", F.explode(F.coalesce("a", "b")).alias("x"), kinds.alias("kinds")).select("t", "x.id", F.explode("kinds").alias("kind"))
    size = F.when(F.col("kind").endswith("longest"), F.octet_length("t")).otherwise(0)
    first = Window.partitionBy("kind").orderBy(F.desc("size"), "id", "t")
    top = rows.withColumn("size", size).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= n)
    return top.select("kind", "k", one_char_a_byte("t").alias("token"))


def running_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with end_byte, the bytes up to the end of each text in the order of ids.

    Rows of one id come in the order of a hash of their texts, and rows without an id last, in that order. In two
    steps, so that no task sees the whole corpus: bytes within ranges, and the sums of the ranges before. The
    ranges are cut at quantiles of the ids, found by a job that runs at once; those without an id by their hashes.
    An ``end_byte`` that is there is replaced.
    """
    docs = docs.drop("end_byte")
    parts = min(512, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / parts for k in range(1, parts)]
    cuts = (docs.agg(F.percentile_approx(id_col, shares, 10_000)).first()[0] if shares else None) or []
    n = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    sized = docs.withColumn("__n", n).withColumn("__h", F.xxhash64(text_col))
    known = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(id_col))) if cuts else F.lit(0)
    # the hash's upper 9 bits, from the least number on
    nameless = F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(-(2**63))), 55).cast("int") + len(cuts) + 1
    sized = sized.withColumn("__range", F.when(F.col(id_col).isNull(), nameless).otherwise(known))
    sums = sized.groupBy("__range").agg(F.sum("__n").alias("__all"))  # at most 1,024 ranges
    before = sums.withColumn("__before", F.coalesce(F.sum("__all").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__all")
    inside = F.sum("__n").over(Window.partitionBy("__range").orderBy(F.col(id_col).asc_nulls_last(), "__h").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn("end_byte", F.col("__before") + F.col("__inside")).drop("__n", "__h", "__range", "__inside", "__before")


def train_eval_split(docs: DataFrame, train_bytes: int, eval_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with part: train for the first bytes, eval for those that follow; the rest is left out. Whole documents."""
    r = running_bytes(docs, id_col, text_col)
    part = F.when(F.col("end_byte") <= train_bytes, "train").when(F.col("end_byte") <= train_bytes + eval_bytes, "eval")
    return r.withColumn("part", part).filter("part is not null")


def first_bytes(docs: DataFrame, limit: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first ``limit`` bytes of the corpus: the last text is cut after a whole character."""
    if limit is None:
        return docs
    r = running_bytes(docs, id_col, text_col).withColumn("__start", F.col("end_byte") - F.coalesce(F.octet_length(text_col), F.lit(0)))
    latin = F.substring(F.decode(F.encode(F.col(text_col), "UTF-8"), "ISO-8859-1"), F.lit(1), F.lit(limit) - F.col("__start"))
    whole = F.regexp_replace(latin, r"[\xC0-\xFF][\x80-\xBF]{0,2}$", "")
    full = F.regexp_extract(latin, r"(?s)^(.*?(?:[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}))$", 1)
    cut = F.decode(F.encode(F.when(full != "", full).otherwise(whole), "ISO-8859-1"), "UTF-8")
    kept = F.when(F.col("end_byte") > limit, cut).otherwise(F.col(text_col))
    return r.filter(F.col("__start") < limit).withColumn(text_col, kept).filter(F.col(text_col) != "").select(*docs.columns)


def digests(models: DataFrame, name_col: str = "name", data_col: str = "data") -> DataFrame:
    """(digest, names): tokenizers that are the same by their contents."""
    return models.groupBy(F.sha2(F.col(data_col), 256).alias("digest")).agg(F.sort_array(F.collect_set(name_col)).alias("names"))


def grouped_results(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Best, worst and mean of repeated measurements."""
    return results.groupBy(*by).agg(F.count("*").alias("runs"), F.min(value).alias("best"), F.max(value).alias("worst"), F.round(F.avg(value), 4).alias("mean"))


def least_seconds(job: Callable[[], object], runs: int = 3) -> float:
    """The shortest of several runs."""
    best = float("inf")
    for _ in range(max(1, runs)):
        began = time.perf_counter()
        job()
        best = min(best, time.perf_counter() - began)
    return best
