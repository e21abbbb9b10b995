"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose metric exceeds a cutoff. A stratum's labelled rows
are split by a hash of their ids. On one part, the selection, cutoffs are placed at
quantiles of the good texts, the same quantile for every rule that is of use there:
a ladder of settings, from the most lenient to the strictest. On the other part, the
holdout, an exact binomial test of "more than ``alpha`` of good texts break any
rule" is made for one setting after the other; the first that can't be refuted
ends the sequence, so that all before it are certified at once (fixed-sequence
testing), with Bonferroni's correction for the number of strata. As a setting
is tested with all its rules together, ``alpha`` limits the false rejections of a
stratum, not of a rule. Of the certified settings the one that rejects most
labelled bad texts less good ones is taken; none if no setting gains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA, DELTA = 0.05, 0.05
#: Of so many labelled rows one selects; the others are the holdout.
PARTS = 4
#: The ladder: how many of a thousand good texts of the selection each rule may reject, and how far, in thousandths of the
#: way to 1000, the cutoff lies above what that allows.
LADDER = ((0, 500), (0, 250), (0, 120), (0, 60), (0, 30), (0, 10), (0, 0), (2, 0), (5, 0), (10, 0), (15, 0), (20, 0), (30, 0), (40, 0))
SYMBOLS = "#$%&*+<=>@[]^_`{|}~"
RULES = ("symbols", "capitals", "same_lines", "long_words")


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the rules' metrics, whole thousandths. A null or empty text has 0 in all."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.length(t)
    letters, upper = F.length(F.regexp_replace(t, r"[^\p{L}]+", "")), F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    words = F.filter(F.split(t, r"[ \n\t\r]+"), lambda x: x != "")
    per_mille = lambda part, whole: F.when(whole > 0, F.floor(F.lit(1000) * part / whole)).otherwise(0).cast("int")
    return docs.withColumns(
        {
            "symbols": per_mille(n - F.length(F.translate(t, SYMBOLS, "")), n),
            "capitals": per_mille(upper, letters),
            "same_lines": per_mille(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
            "long_words": per_mille(F.size(F.filter(words, lambda x: F.length(x) > 25)), F.size(words)),
        }
    )


def allowed_rejections(n, alpha: float, delta):
    """The greatest k for which at most k rejections among n good texts refute a rate over ``alpha``; -1: none does.

    That is the greatest k with P(Binomial(n, alpha) <= k) <= delta, summed in logarithms.
    """
    odds = F.lit(alpha / (1 - alpha))
    zero = n * F.log1p(F.lit(-alpha))
    start = F.struct(zero.alias("lp"), F.exp(zero).alias("cdf"), F.when(F.exp(zero) <= delta, F.lit(0)).otherwise(-1).cast("long").alias("k"))

    def step(s, i):
        lp = s["lp"] + F.ln((n - i + 1) / i * odds)
        cdf = s["cdf"] + F.exp(lp)
        return F.struct(lp.alias("lp"), cdf.alias("cdf"), F.when(cdf <= delta, i).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(n * alpha), F.lit(1)).cast("long")), start, step, lambda s: s["k"])


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, good, selects): one row an id, its least label; whether its hash puts it into the selection."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("good")).filter("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
    part = F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % PARTS
    return known.withColumn("selects", part == 0)


def ladder(metrics: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", label_col: str = "quality") -> tuple[DataFrame, DataFrame]:
    """(stratum, rule, step, cutoff) of the rules of use on the selection, and (stratum, good, metrics) of the holdout."""
    m = metrics.select(F.col(id_col).cast("long").alias("id"), F.col(stratum_col).cast("string").alias("stratum"), *RULES).filter("stratum is not null").join(known_labels(labels, id_col, label_col), "id")
    each = m.filter("selects").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])).alias("x")).select("stratum", "good", "x.*")
    counts = each.groupBy("stratum", "rule", "v").agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("g"), F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("b"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum", "rule")
    tried = counts.select("stratum", "rule", F.col("v").alias("cutoff"), F.sum("g").over(whole).alias("n_good"), F.coalesce(F.sum("g").over(above), F.lit(0)).alias("gr"), F.coalesce(F.sum("b").over(above), F.lit(0)).alias("br"))
    # a step's cutoff is the least value above which no more good texts lie than it allows
    steps = tried.withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(len(LADDER))]))).withColumn("allowed", F.element_at(F.array(*[F.lit(x) for x, _ in LADDER]), F.col("step") + 1))
    margin = F.element_at(F.array(*[F.lit(x) for _, x in LADDER]), F.col("step") + 1)
    placed = steps.filter(F.col("gr") * 1000 <= F.col("allowed") * F.col("n_good")).groupBy("stratum", "rule", "step").agg(F.min("cutoff").alias("cutoff"), F.max(F.struct("gr", "br")).alias("x"))
    placed = placed.withColumn("cutoff", F.col("cutoff") + F.floor((1000 - F.col("cutoff")) * margin / 1000).cast("int"))
    useful = placed.groupBy("stratum", "rule").agg(F.max(F.col("x.br") - F.col("x.gr")).alias("gain")).filter("gain > 0").select("stratum", "rule")
    return placed.join(useful, ["stratum", "rule"], "left_semi").select("stratum", "rule", "step", "cutoff"), m.filter("not selects").select("stratum", "good", *RULES)


def wide(steps: DataFrame, prefix: str = "cut_") -> DataFrame:
    """(stratum, step, a column of cutoffs for each rule); null where the rule isn't used."""
    t = steps.groupBy("stratum", "step").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    return t.select("stratum", "step", *[F.col(r).alias(f"{prefix}{r}") for r in RULES])


def cutoffs(metrics: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """(stratum, step, cut_* for each rule, n_good, good_rejected, bad_rejected) of the strata with a certified setting that gains.

    With probability 1 - ``delta``, no stratum's setting rejects more than ``alpha`` of its good texts, all rules
    together. n_good and what is rejected are counts of the holdout. Rows without an id, a stratum or a label aren't
    used; labels of one id are taken by their least.
    """
    from .common import cut

    placed, holdout = ladder(metrics, labels, id_col, stratum_col, label_col)
    settings = cut(wide(placed))  # strata times steps
    holdout = holdout.groupBy("stratum", "good", *RULES).agg(F.count("*").alias("n"))
    broken = lambda: F.coalesce(F.greatest(*[F.when(F.col(r) > F.col(f"cut_{r}"), 1).otherwise(0) for r in RULES]), F.lit(0))
    judged = holdout.join(settings, "stratum").withColumn("gone", broken() * F.col("n"))
    good, bad = F.col("good") == 1, F.col("good") == 0
    zero = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    tried = judged.groupBy("stratum", "step").agg(zero(good, F.col("n")).alias("n_good"), zero(good, F.col("gone")).alias("good_rejected"), zero(bad, F.col("gone")).alias("bad_rejected"))
    n_strata = settings.agg(F.countDistinct("stratum").alias("n_strata"))
    sizes = tried.select("stratum", "n_good").distinct().crossJoin(n_strata)
    limits = sizes.select("stratum", allowed_rejections(F.col("n_good"), alpha, F.lit(delta) / F.col("n_strata")).alias("limit"))
    # stricter settings reject what more lenient ones do, so that those within the limit are the first of the sequence
    certified = tried.join(limits, "stratum").filter((F.col("good_rejected") <= F.col("limit")) & (F.col("bad_rejected") > F.col("good_rejected")))
    best = Window.partitionBy("stratum").orderBy((F.col("bad_rejected") - F.col("good_rejected")).desc(), "step")
    return certified.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k", "limit").join(settings, ["stratum", "step"])


def quality_filter(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """(id, stratum, metrics) of the texts that break no rule of their stratum's setting.

    A text of a stratum without a setting (few labels, or null) is kept. A null or empty text breaks no
    rule. Ids may be null or repeat: rows are decided each by itself. Columns of ``docs`` named as the metrics are left
    out, unless they are the id or the stratum, which fails. Metrics are computed once, when this is called, and
    kept in a checkpoint, without texts.
    """
    from .common import cut

    if {id_col, stratum_col} & set(RULES):
        raise ValueError(f"the id and stratum columns can't be named as a metric: {', '.join(RULES)}")
    base = docs.select(F.col(id_col), F.col(stratum_col), F.col(text_col).alias("__text"))
    m = cut(with_metrics(base, "__text").drop("__text"))
    t = cutoffs(m, labels, alpha, delta, id_col, stratum_col, label_col)
    t = t.select(F.col("stratum").alias("__stratum"), *[F.col(f"cut_{r}").alias(f"__{r}") for r in RULES])
    joined = m.join(t, F.col(stratum_col).cast("string") == F.col("__stratum"), "left")
    broken = F.lit(False)
    for r in RULES:
        broken = broken | F.coalesce(F.col(r) > F.col(f"__{r}"), F.lit(False))
    return joined.filter(~broken).select(*m.columns)


SQL = f"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines,
    list_filter(string_split_regex(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda x: x <> '') AS words,
    length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]+', '', 'g')) AS letters,
    length(regexp_replace(coalesce(text, ''), '[^\\p{{Lu}}]+', '', 'g')) AS upper_letters
  FROM documents),
m AS (
  SELECT doc_id, lang,
    CASE WHEN length(t) > 0 THEN (1000 * (length(t) - length(translate(t, '{SYMBOLS}', ''))) // length(t)) ELSE 0 END::INTEGER AS symbols,
    CASE WHEN letters > 0 THEN 1000 * upper_letters // letters ELSE 0 END::INTEGER AS capitals,
    CASE WHEN len(lines) > 0 THEN 1000 * (len(lines) - len(list_distinct(lines))) // len(lines) ELSE 0 END::INTEGER AS same_lines,
    CASE WHEN len(words) > 0 THEN 1000 * len(list_filter(words, lambda x: length(x) > 25)) // len(words) ELSE 0 END::INTEGER AS long_words
  FROM t),
known AS (
  SELECT doc_id, min(quality) AS good, ('0x' || substr(md5('fold:' || doc_id), 1, 8))::BIGINT % {PARTS} = 0 AS selects
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT m.*, good, selects FROM m JOIN known USING (doc_id) WHERE lang IS NOT NULL),
each AS (
  SELECT lang, good, rule, v FROM (SELECT * FROM labelled WHERE selects) UNPIVOT (v FOR rule IN ({", ".join(RULES)}))),
counts AS (SELECT lang, rule, v, sum((good = 1)::INT) AS g, sum((good = 0)::INT) AS b FROM each GROUP BY ALL),
above AS (
  SELECT lang, rule, v AS cutoff, sum(g) OVER (PARTITION BY lang, rule) AS n_good,
    coalesce(sum(g) OVER above, 0) AS gr, coalesce(sum(b) OVER above, 0) AS br
  FROM counts WINDOW above AS (PARTITION BY lang, rule ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
steps(step, allowed, margin) AS (VALUES {", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(LADDER))}),
placed AS (
  SELECT lang, rule, step, min(cutoff) + (1000 - min(cutoff)) * margin // 1000 AS cutoff, max(gr) AS gr, max(br) AS br
  FROM above, steps WHERE gr * 1000 <= allowed * n_good GROUP BY lang, rule, step, margin),
useful AS (SELECT lang, rule FROM placed GROUP BY lang, rule HAVING max(br - gr) > 0),
used AS (SELECT * FROM placed SEMI JOIN useful USING (lang, rule)),
held AS (SELECT * FROM (SELECT doc_id, lang, good, {", ".join(RULES)} FROM labelled WHERE NOT selects) UNPIVOT (v FOR rule IN ({", ".join(RULES)}))),
judged AS (
  SELECT lang, step, doc_id, good, max((v > cutoff)::INT) AS gone FROM used JOIN held USING (lang, rule) GROUP BY ALL),
tried AS (
  SELECT lang, step, count(*) FILTER (good = 1) AS n_good, coalesce(sum(gone) FILTER (good = 1), 0) AS gr, coalesce(sum(gone) FILTER (good = 0), 0) AS br
  FROM judged GROUP BY lang, step),
sizes AS (SELECT DISTINCT lang, n_good FROM tried),
terms AS (
  SELECT lang, i, sum(CASE WHEN i = 0 THEN n_good * ln(1 - {ALPHA}) ELSE ln((n_good - i + 1) / i * {ALPHA / (1 - ALPHA)!r}) END) OVER (PARTITION BY lang ORDER BY i) AS lp
  FROM (SELECT lang, n_good::DOUBLE AS n_good, unnest(range(0, greatest(ceil(n_good * {ALPHA}), 1)::BIGINT + 1)) AS i FROM sizes)),
cdfs AS (SELECT lang, i, sum(exp(lp)) OVER (PARTITION BY lang ORDER BY i) AS cdf FROM terms),
limits AS (SELECT lang, max(i) AS k FROM cdfs WHERE cdf <= {DELTA}::DOUBLE / (SELECT count(DISTINCT lang) FROM used) GROUP BY lang),
chosen AS (
  SELECT lang, step FROM tried JOIN limits USING (lang) WHERE gr <= k AND br > gr
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY br - gr DESC, step) = 1),
best AS (SELECT lang, rule, cutoff FROM used JOIN chosen USING (lang, step))
SELECT doc_id, lang, symbols, capitals, same_lines, long_words FROM m
WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.lang = m.lang AND
  CASE rule WHEN 'symbols' THEN symbols WHEN 'capitals' THEN capitals WHEN 'same_lines' THEN same_lines ELSE long_words END > cutoff)
"""
