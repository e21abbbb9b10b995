"""WARC: resolution of not-modified revisits.

A revisit record has no body of its own. An as-of join by canonical URL finds
the latest full response fetched before it; if the validators of the two agree,
the revisit takes that response's body, and its headers updated by those that a
not-modified answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, if_small

#: Headers that describe the stored body or one connection: a not-modified answer doesn't change them.
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
DROPPED_PARAMS = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, www, default port, closing slash and tracking parameters; the host in lower case, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(DROPPED_PARAMS)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def lower_headers(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case alone, the last by name and value."""
    sorted_ = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    pairs = F.transform(sorted_, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1)["value"]))


def header(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(revisit_id, canonical_url, response_id, outcome, headers, payload) of each revisit record.

    ``records`` has record_id LONG, url, fetched (anything that sorts), kind ('response' or 'revisit'), status INT, headers
    MAP and payload; other columns and kinds are left out. A full response is of kind response and status 200. The
    latest one fetched strictly earlier counts, of equal times the one of the greatest record_id.
    outcome: ``resolved``; ``no_earlier_response``, also where url or fetched is null;
    ``mismatch``, where an ETag (compared weakly), else a Last-Modified date, else a payload digest that both have
    differs; ``no_validator``, where both have none of these in common. Only the first has headers and payload.
    Of responses that share a record_id, a null one included, the greatest payload is taken. Repeated revisits are resolved each.
    Headers and outcomes are computed when this is called, and kept in a checkpoint, without bodies.
    """
    wanted = records.filter("kind = 'revisit' or (kind = 'response' and status = 200)").select("record_id", "url", "fetched", "kind", "headers")
    light = wanted.select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("canonical_url"), "fetched", (F.col("kind") == "revisit").alias("asks"), lower_headers(F.col("headers")).alias("headers"))
    placed = light.filter("canonical_url is not null and fetched is not null")
    nowhere = light.filter("asks and (canonical_url is null or fetched is null)")
    # at one time revisits come first, so that only strictly earlier responses lie before them
    order = Window.partitionBy("canonical_url").orderBy("fetched", F.desc("asks"), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    stored = F.when(~F.col("asks"), F.struct(F.col("record_id").alias("id"), "headers"))
    found = placed.withColumn("stored", F.last(stored, ignorenulls=True).over(order)).filter("asks")
    found = found.unionByName(nowhere.withColumn("stored", F.lit(None).cast(found.schema["stored"].dataType)))
    bare = lambda tag: F.regexp_replace(tag, "^W/", "")
    verdict = F.lit(None).cast("boolean")
    for name in ("warc-payload-digest", "last-modified", "etag"):
        a, b = header(F.col("headers"), name), header(F.col("stored.headers"), name)
        verdict = F.when(a.isNotNull() & b.isNotNull(), bare(a) == bare(b) if name == "etag" else a == b).otherwise(verdict)
    outcome = F.when(F.col("stored").isNull(), "no_earlier_response").when(verdict.isNull(), "no_validator").when(verdict, "resolved").otherwise("mismatch")
    judged = found.withColumn("outcome", outcome)
    fresh = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT))
    base = F.map_filter(F.col("stored.headers"), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    key = [F.col("stored.id").isNull().alias("z"), F.coalesce("stored.id", F.lit(0)).alias("i")]
    # rows without bodies, once: only the bodies that some revisit needs are shuffled, and only once
    judged = cut(judged.select(
        F.col("record_id").alias("revisit_id"), "canonical_url", F.col("stored.id").alias("response_id"), "outcome",
        F.when(F.col("outcome") == "resolved", F.map_concat(base, fresh)).alias("headers"), *key,
    ))
    needed = judged.filter("outcome = 'resolved'")
    bodies = records.filter("kind = 'response' and status = 200").select(F.col("record_id").cast("long").isNull().alias("z"), F.coalesce(F.col("record_id").cast("long"), F.lit(0)).alias("i"), "payload")
    bodies = bodies.join(if_small(needed.select("z", "i").distinct()), ["z", "i"], "left_semi").groupBy("z", "i").agg(F.max("payload").alias("payload"))
    with_body = needed.join(bodies, ["z", "i"], "left").drop("z", "i")
    return with_body.unionByName(judged.filter("outcome <> 'resolved'").drop("z", "i").withColumn("payload", F.lit(None).cast(with_body.schema["payload"].dataType)))


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: each page as a full response, and a later visit that was answered with not modified.

    The second visit uses another spelling of the URL. By the length of the page, the second visit came too
    early, its ETag differs, it has a date alone, or it agrees.
    """
    k = F.length("html") % 5
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 7).cast("string"))
    entry = lambda *kv: F.map_from_arrays(F.array(*kv[::2]), F.array(*kv[1::2]))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") + 1_700_000_000).alias("fetched"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        entry(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Cache-Control"), F.lit("no-store")).alias("headers"),
        F.col("html").alias("payload"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.regexp_replace("url", "^http://", "HTTPS://").alias("url"),
        (F.col("page_id") + F.when(k == 0, 1_699_000_000).otherwise(1_700_086_400)).alias("fetched"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(k == 1, entry(F.lit("ETag"), F.lit('"changed"'), F.lit("Last-Modified"), day))
        .when(k == 2, entry(F.lit("last-modified"), day, F.lit("Cache-Control"), F.lit("max-age=60")))
        .otherwise(entry(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"))).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


def flat_headers(df: DataFrame) -> DataFrame:
    """headers as sorted lines of text."""
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return df.withColumn("headers", F.array_join(lines, "\n"))


SQL = f"""
WITH p AS (SELECT *, length(html) % 5 AS k, '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || (page_id % 7) AS day FROM pages),
rec AS (
  SELECT page_id * 2 AS record_id, url, page_id + 1700000000 AS fetched, false AS asks, tag AS etag, day AS modified, 'no-store' AS cache, length(html) AS size, html AS payload FROM p
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(url, '^http://', 'HTTPS://'), page_id + CASE WHEN k = 0 THEN 1699000000 ELSE 1700086400 END, true,
    CASE k WHEN 1 THEN '"changed"' WHEN 2 THEN NULL ELSE tag END, CASE WHEN k IN (1, 2) THEN day END, CASE WHEN k <> 1 THEN 'max-age=60' END, NULL, NULL FROM p),
parts AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM rec),
named AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www[0-9]*[.]', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{DROPPED_PARAMS}'))) AS params FROM parts),
r AS (SELECT *, place || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM named),
m AS (
  SELECT a.record_id AS revisit_id, a.canonical_url, b.record_id AS response_id, a.etag AS ae, b.etag AS be, a.modified AS am, b.modified AS bm,
    a.cache AS ac, b.cache AS bc, b.size, b.payload
  FROM (SELECT * FROM r WHERE asks) a LEFT JOIN (SELECT * FROM r WHERE NOT asks) b ON a.canonical_url = b.canonical_url AND b.fetched < a.fetched
  QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY b.fetched DESC NULLS LAST, b.record_id DESC) = 1),
o AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_earlier_response' WHEN coalesce(ae = be, am = bm) IS NULL THEN 'no_validator'
    WHEN coalesce(ae = be, am = bm) THEN 'resolved' ELSE 'mismatch' END AS outcome,
    CASE WHEN ae IS NULL THEN be ELSE 'W/' || ae END AS etag FROM m)
SELECT revisit_id, canonical_url, response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: ' || ac || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || etag || chr(10) || 'last-modified: ' || coalesce(am, bm) END AS headers,
  CASE WHEN outcome = 'resolved' THEN payload END AS payload
FROM o
"""
