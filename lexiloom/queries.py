"""Queries over the test tables, and DuckDB SQL that gives the same rows.

DuckDB's regular expressions know no lookahead. The SQL puts a mark, a character
of the private use area, before the last white space of each run that something
else follows, and splits the marked text without lookahead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pretokens as P
from .functions.schemes import SCHEMES, by_name
from .operators import encode as E
from .operators import evaluate as V
from .operators import post as O
from .operators import train as R
from .operators.checkpoint import shared_folder
from .plans.kernels import PairTable
from .plans.model import AddedToken, ByteModel
from .sources.readers import BytesSource, JsonlSource, ParquetSource, TextSource, spread
from .streaming import stream as S
from .tokenizer import Tokenizer

EXPRESSIBLE = ("gpt2", "gpt4", "qwen2", "qwen35", "olmo3", "o200k", "nemotron", "superbpe_stage1")
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INNER = r"\t\x{0B}\x{0C} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MARK = ""
FORBIDDEN = ("the", "http", "token = ", "<|endoftext|>", "idiot")
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: One vocabulary as a tokenizer.json and as ranks.
VOCAB, RANKS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/byte_bpe_50k.tiktoken"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def split_sql(scheme: str, text: str = "text") -> str:
    """A list of pretokens in SQL."""
    p = by_name(scheme).patterns[0].replace(r"\s+(?!\S)|", "")
    p = p.replace(r"[^\r\n\p{L}\p{N}]", rf"[^\r\n{MARK}\p{{L}}\p{{N}}]").replace(r"[^\s", f"[^{WS}{MARK}").replace(r"\s", f"[{WS}]")
    last = WS if scheme == "gpt2" else INNER
    marked = f"regexp_replace({text}, {quoted(f'([{WS}])([{last}][^{WS}])')}, {quoted(chr(92) + '1' + MARK + chr(92) + '2')}, 'g')"
    return f"regexp_extract_all({marked}, {quoted(p)})"


def counts_sql(scheme: str, table: str = "documents", text: str = "text", where: str = "true") -> str:
    return f"SELECT pretoken, count(*) AS count FROM (SELECT unnest({split_sql(scheme, text)}) AS pretoken FROM {table} WHERE {where}) GROUP BY pretoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def ids_sql(table: str = "documents", key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> str:
    """Common table expressions up to encoded(key, ids): token ids by merging, in each distinct word, the pair of the least rank until none is left."""
    keys = ", ".join(f"t.{k.strip()}" for k in key.split(","))
    return f"""WITH RECURSIVE ranks AS (
  SELECT hex(from_base64(t)) AS tok, r FROM read_csv({quoted(ranks)}, delim=' ', header=false, quote='', escape='', columns={{'t': 'VARCHAR', 'r': 'INTEGER'}})),
pieces AS (SELECT {key}, pos, p[pos] AS w FROM (SELECT {key}, p, unnest(range(1, len(p) + 1)) AS pos FROM (SELECT {key}, {split_sql("gpt2", text)} AS p FROM {table}))),
unmerged AS (SELECT w, '|' || array_to_string(list_transform(range(1, length(h), 2), lambda i: substr(h, i, 2)), '||') || '|' AS s FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM pieces))),
steps(w, s, n) AS (
  SELECT w, s, 0 FROM unmerged
  UNION ALL
  SELECT w, replace(s, '|' || best.a || '||' || best.b || '|', '|' || best.a || best.b || '|'), n + 1
  FROM (SELECT w, s, n, arg_min({{'a': a, 'b': b}}, r) AS best
    FROM (SELECT w, s, n, l[i] AS a, l[i + 1] AS b FROM (SELECT *, unnest(range(1, len(l))) AS i FROM (SELECT *, string_split(trim(s, '|'), '||') AS l FROM steps)))
    JOIN ranks ON tok = a || b GROUP BY w, s, n)),
merged AS (SELECT w, string_split(trim(arg_max(s, n), '|'), '||') AS l FROM steps GROUP BY w),
word_ids AS (SELECT w, list(r ORDER BY i) AS ids FROM (SELECT w, l[i] AS tok, i FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM merged)) JOIN ranks USING (tok) GROUP BY w),
encoded AS (
  SELECT {keys}, coalesce(got, []) AS ids FROM {table} t
  LEFT JOIN (SELECT {key}, flatten(list(ids ORDER BY pos)) AS got FROM pieces JOIN word_ids USING (w) GROUP BY {key}) g USING ({key}))"""


def merges_sql(merges: int, specials: int = 1) -> str:
    """(rank, l, r) of so many merges: of all pairs of neighbours the most frequent, of equals the one of the least ids, is merged everywhere."""
    return f"""WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS w, count AS n, '|' || array_to_string(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::INTEGER::VARCHAR), '||') || '|' AS s
  FROM (SELECT hex(encode(pretoken)) AS h, count FROM ({counts_sql("gpt2")}))),
steps(w, n, s, l, r) USING KEY (w) AS (
  SELECT w, n, s, NULL::INTEGER, NULL::INTEGER FROM words
  UNION
  SELECT unnest(CASE WHEN w = first THEN [w, -it - 1] ELSE [w] END), n, replace(s, '|' || a || '||' || b || '|', '|' || ({256 + specials} + it) || '|'), a, b
  FROM recurring.steps, (
    SELECT a, b, it, first FROM (
      SELECT l[i]::INTEGER AS a, l[i + 1]::INTEGER AS b, sum(n) AS total, min(w) AS first FROM (
        SELECT *, unnest(range(1, len(l))) AS i FROM (SELECT w, n, string_split(trim(s, '|'), '||') AS l FROM recurring.steps WHERE w > 0))
      GROUP BY ALL), (SELECT count(*) AS it FROM recurring.steps WHERE w < 0)
    ORDER BY total DESC, a, b LIMIT 1)
  WHERE w > 0 AND contains(s, '|' || a || '||' || b || '|') AND it < {merges})
SELECT (-w - 1)::INTEGER AS rank, l, r FROM steps WHERE w < 0"""


@lru_cache(maxsize=1)
def published() -> Tokenizer:
    """A public byte-level vocabulary of 50,257 ids."""
    return Tokenizer(VOCAB)


def byte_model(*added: AddedToken) -> ByteModel:
    """Ids are bytes: what SQL can follow."""
    return ByteModel(tokens=tuple(bytes([b]) for b in range(256)), pairs=PairTable.of({}), merges=(), added=added, scheme=SCHEMES["gpt2"], byte_ids=tuple(range(256)))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


DOCS = "SELECT doc_id, text FROM documents"

# pretokens

for _s in EXPRESSIBLE:
    query(f"pretoken_counts_{_s}", counts_sql(_s))(lambda spark, d, s=_s: P.pretoken_counts(table(spark, d, "documents"), s))
for _s in SCHEMES:
    query(f"tile_{_s}", DOCS)(lambda spark, d, s=_s: table(spark, d, "documents").select("doc_id", F.array_join(P.pretokenize("text", s), "").alias("text")))
for _t, _c in (("conversations", "text"), ("pages", "html"), ("benchmark", "text")):
    query(f"pretoken_counts_{_t}", counts_sql("gpt2", _t, _c))(lambda spark, d, t=_t, c=_c: P.pretoken_counts(table(spark, d, t), "gpt2", c))


@query("pretoken_counts_kimi")
def _(spark, d):
    return P.pretoken_counts(table(spark, d, "documents"), "kimi")


@query("pretoken_counts_deepseek_v3")
def _(spark, d):
    return P.pretoken_counts(table(spark, d, "documents"), "deepseek_v3")


@query("pretoken_topk", f"SELECT pretoken, count FROM ({counts_sql('gpt2')}) ORDER BY count DESC, pretoken LIMIT 50")
def pretoken_topk(spark, d):
    return P.pretoken_counts(table(spark, d, "documents")).orderBy(F.desc("count"), "pretoken").limit(50)


@query("pretoken_rows", f"SELECT doc_id, (pos - 1)::INTEGER AS pos, p[pos] AS pretoken FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS pos FROM (SELECT doc_id, {split_sql('gpt2')} AS p FROM documents))")
def _(spark, d):
    return P.pretoken_rows(table(spark, d, "documents").select("doc_id", "text"))


@query("pretokens_per_doc", f"SELECT doc_id, len({split_sql('gpt4')})::INTEGER AS pretokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(P.pretokenize("text", "gpt4")).alias("pretokens"))


@query("distinct_pretokens_by_lang", f"SELECT lang, count(DISTINCT p) AS distinct_pretokens, count(*) AS pretokens FROM (SELECT lang, unnest({split_sql('gpt2')}) AS p FROM documents) GROUP BY lang")
def _(spark, d):
    rows = P.pretoken_rows(table(spark, d, "documents"))
    each = rows.groupBy("lang", "pretoken").agg(F.count("*").alias("n"))  # one more shuffle of less, in place of a distinct count of everything
    return each.groupBy("lang").agg(F.count("*").alias("distinct_pretokens"), F.sum("n").alias("pretokens"))


@query("stage2_unit_counts")
def _(spark, d):
    return P.unit_counts(table(spark, d, "documents"))


# sources

@query("document_split", "SELECT doc_id, (pos - 1)::INTEGER AS pos, p[pos] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS pos FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents))")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(P.split_documents("text", "\n")).alias("pos", "text"))


@query("parquet_source", "SELECT text FROM documents")
def _(spark, d):
    return ParquetSource(f"{d}/documents.parquet").documents(spark).select("text")


@query("jsonl_source", "SELECT text FROM documents")
def _(spark, d):
    here = folder(spark)
    table(spark, d, "documents").select("text").write.option("compression", "gzip").json(here)
    return JsonlSource(here).documents(spark).select("text")


@query("text_source", "SELECT t AS text FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents) WHERE t <> ''")
def _(spark, d):
    here = folder(spark)
    table(spark, d, "documents").select("text").write.text(here)
    return TextSource(here, "\n").documents(spark).select("text")


@query("bytes_source", "SELECT 'a' AS text UNION ALL SELECT 'b'")
def _(spark, d):
    return BytesSource(b"<|s|>a<|s|><|s|>b<|s|>", b"<|s|>").documents(spark).select("text")


# training

PAIRS = f"""
SELECT ('0x' || substr(h, i, 2))::INTEGER AS l, ('0x' || substr(h, i + 2, 2))::INTEGER AS r, sum(count)::BIGINT AS count
FROM (SELECT h, count, unnest(range(1, length(h) - 2, 2)) AS i FROM (SELECT hex(encode(pretoken)) AS h, count FROM ({counts_sql("gpt2")})))
GROUP BY ALL"""


@query("pair_counts", PAIRS)
def pair_counts(spark, d):
    words = P.pretoken_counts(table(spark, d, "documents"))
    return R.count_pairs(words.select(R.byte_symbols("pretoken").alias("symbols"), "count"))


@query("top_pair", f"SELECT l, r, count FROM ({PAIRS}) ORDER BY count DESC, l, r LIMIT 1")
def _(spark, d):
    return pair_counts(spark, d).orderBy(F.desc("count"), "l", "r").limit(1)


def trained(spark, d, size: int = 320, **more) -> R.Trained:
    return R.train_bpe(table(spark, d, "documents"), size, ["<|endoftext|>"], **more)


def merge_ids(got: R.Trained, spark: SparkSession) -> DataFrame:
    """(rank, l, r): the merges by ids."""
    m = got.merges_df(spark)
    ids = got.vocab_df(spark).filter(~F.col("id").between(256, 255 + len(got.specials))).groupBy("token").agg(F.min("id").alias("id"))
    side = lambda c: ids.select(F.col("token").alias(c), F.col("id").alias(c[0]))
    return m.join(side("left"), "left").join(side("right"), "right").select("rank", "l", "r")


@query("train_bpe", merges_sql(300))
def train_bpe(spark, d):
    return merge_ids(trained(spark, d, 557, tie_breaking="raw_token_ids"), spark)


@query("train_bpe_first_merge", f"SELECT 0 AS rank, l, r FROM ({PAIRS}) ORDER BY count DESC, l, r LIMIT 1")
def _(spark, d):
    m = trained(spark, d, 258, tie_breaking="raw_token_ids").merges_df(spark)
    code = lambda c: F.conv(F.hex(c), 16, 10).cast("int")
    return m.select("rank", code("left").alias("l"), code("right").alias("r"))


@query("train_bpe_over_table", merges_sql(20))
def _(spark, d):
    return merge_ids(trained(spark, d, 277, tie_breaking="raw_token_ids", where="table"), spark)


@query("train_superbpe")
def _(spark, d):
    return R.train_superbpe(table(spark, d, "documents"), 330, 300, ["<|endoftext|>"]).vocab_df(spark)


# encoding and decoding

def rebuilt(docs: DataFrame, tok: Tokenizer, key: str, text: str = "text") -> DataFrame:
    return tok.decode_df(tok.encode_df(docs.select(key, text), text).drop(text), "ids", text).select(key, text)


@query("round_trip_bpe", DOCS)
def round_trip_bpe(spark, d):
    return rebuilt(table(spark, d, "documents"), Tokenizer(trained(spark, d)), "doc_id")


@query("round_trip_superbpe", DOCS)
def _(spark, d):
    tok = Tokenizer(R.train_superbpe(table(spark, d, "documents"), 340, 300, ["<|endoftext|>"]))
    return rebuilt(table(spark, d, "documents"), tok, "doc_id")


@query("round_trip_pieces", DOCS)
def _(spark, d):
    return rebuilt(table(spark, d, "documents"), Tokenizer.from_sentencepiece(PIECES), "doc_id")


for _t, _k, _c in (("conversations", "conv_id, turn", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text")):

    def _trip(spark, d, t=_t, k=_k, c=_c):
        tok = Tokenizer(trained(spark, d))
        keys = k.split(", ")
        df = tok.encode_df(table(spark, d, t).select(*keys, c), c).drop(c)
        return tok.decode_df(df, "ids", c).select(*keys, c)

    query(f"round_trip_{_t}", f"SELECT {_k}, {_c} FROM {_t}")(_trip)


@query("encode_bytes", "SELECT doc_id, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::INTEGER) AS ids FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)")
def _(spark, d):
    return E.encode(table(spark, d, "documents").select("doc_id", "text"), byte_model(), keep_text=False)


@query("encode_ids", f"{ids_sql()} SELECT doc_id, ids FROM encoded")
def encode_ids(spark, d):
    return E.encode(table(spark, d, "documents").select("doc_id", "text"), published().model, special=False, keep_text=False)


@query("encode_through_dictionary_ids", f"{ids_sql('conversations', 'conv_id, turn')} SELECT conv_id * 1000 + turn AS doc_id, ids FROM encoded")
def _(spark, d):
    model = replace(published().model, added=())
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return E.encode_through_dictionary(rows, model)


@query("encode_giant_ids", f"{ids_sql()} SELECT doc_id, ids FROM encoded")
def _(spark, d):
    return E.encode_giant(table(spark, d, "documents"), replace(published().model, added=()), target=2000)


@query("encode_through_dictionary", DOCS)
def _(spark, d):
    model = R.train_bpe(table(spark, d, "documents"), 320).model()
    return E.decode(E.encode_through_dictionary(table(spark, d, "documents"), model), model).select("doc_id", "text")


@query("encode_giant", DOCS)
def _(spark, d):
    tok = Tokenizer(trained(spark, d))
    return tok.decode_df(E.encode_giant(table(spark, d, "documents"), tok.model, target=2000)).select("doc_id", "text")


@query("encode_files", f"{ids_sql()} SELECT sum(len(ids))::BIGINT AS tokens, sum(list_sum(ids))::BIGINT AS sum_of_ids, count(*) AS docs FROM encoded")
def _(spark, d):
    ids = published().encode_files(ParquetSource(f"{d}/documents.parquet"), spark)
    whole = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return ids.agg(F.sum(F.size("ids")).alias("tokens"), F.sum(whole).alias("sum_of_ids"), F.count("*").alias("docs"))


@query("encode_udf", f"{ids_sql()} SELECT doc_id, len(ids)::INTEGER AS n FROM encoded")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(E.encode_udf(published().model)("text")).alias("n"))


@query("special_tokens_split", "SELECT doc_id, (len(string_split(text, 'the')) - 1)::INTEGER AS found, (octet_length(encode(text)) - 3 * (len(string_split(text, 'the')) - 1))::INTEGER AS rest FROM documents")
def _(spark, d):
    ids = E.encode(table(spark, d, "documents").select("doc_id", "text"), byte_model(AddedToken("the", 256)), keep_text=False)
    return ids.select("doc_id", F.size(F.filter("ids", lambda i: i == 256)).alias("found"), F.size(O.drop_ids("ids", [256])).alias("rest"))


@query("token_bytes_by_lang", "SELECT lang, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY lang")
def _(spark, d):
    got = trained(spark, d)
    tok = Tokenizer(got)
    ids = E.encode(table(spark, d, "documents").select("lang", "text"), tok.model, keep_text=False)
    n = ids.select("lang", F.explode("ids").alias("id")).groupBy("lang", "id").count()
    size = tok.vocab_df(spark).select("id", F.octet_length("token").alias("size"))
    return n.join(size, "id").groupBy("lang").agg(F.sum(F.col("count") * F.col("size")).alias("bytes"))


@query("token_totals", f"{ids_sql()} SELECT (SELECT count(*) FROM pieces) AS pretokens, sum(len(ids))::BIGINT AS tokens, (SELECT sum(octet_length(encode(text))) FROM documents)::BIGINT AS bytes FROM encoded")
def _(spark, d):
    return E.token_totals(table(spark, d, "documents"), published().model)


# what comes after

@query("pad_truncate", f"""{ids_sql()},
r AS (SELECT doc_id, least(len(ids), 98) AS kept, ids[1:98] AS ids FROM encoded)
SELECT doc_id, (kept + 2)::INTEGER AS length, list_concat([1], ids, [2], list_transform(range(0, 98 - kept), lambda i: 0)) AS input_ids,
  list_concat(list_transform(range(0, kept + 2), lambda i: 1), list_transform(range(0, 98 - kept), lambda i: 0)) AS attention_mask FROM r""")
def _(spark, d):
    o = O.PadTruncate(0, 100, True, True, prefix=(1,), suffix=(2,))
    return O.pad_truncate(encode_ids(spark, d), o).select("doc_id", "length", "input_ids", "attention_mask")


@query("pad_to_longest", f"{ids_sql('benchmark', 'item_id')} SELECT item_id, len(ids)::INTEGER AS length, list_concat(ids, list_transform(range(len(ids), (SELECT max(len(ids)) FROM encoded)), lambda i: 0)) AS input_ids FROM encoded")
def _(spark, d):
    ids = E.encode(table(spark, d, "benchmark").select("item_id", "text"), published().model, special=False, keep_text=False)
    return O.pad_truncate(ids, O.PadTruncate(0)).select("item_id", "length", "input_ids")


@query("pad_to_longest_of_batch", f"{ids_sql('conversations', 'conv_id, turn')} SELECT conv_id, turn, len(ids)::INTEGER AS length, (max(len(ids)) OVER (PARTITION BY conv_id))::INTEGER AS width, len(ids)::INTEGER AS ones FROM encoded")
def _(spark, d):
    ids = E.encode(table(spark, d, "conversations").select("conv_id", "turn", "text"), published().model, special=False, keep_text=False)
    out = O.pad_truncate(ids, O.PadTruncate(0, pad_left=True), batch_col="conv_id")
    return out.select("conv_id", "turn", "length", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("ones"))


@query("wrap_truncate", f"{ids_sql()} SELECT doc_id, list_concat([1], ids[-10:]) AS ids FROM encoded WHERE len(ids) > 0")
def _(spark, d):
    row = O.wrap_truncate("ids", prefix=[1], max_tokens=10, truncate_left=True)
    return encode_ids(spark, d).filter(F.size("ids") > 0).select("doc_id", row.alias("ids"))


@query("forbidden_special_scan", " UNION ALL ".join(f"SELECT {quoted(p)} AS pattern, count(*) FILTER (contains(text, {quoted(p)})) AS documents FROM documents" for p in FORBIDDEN))
def _(spark, d):
    return O.forbidden_counts(table(spark, d, "documents"), FORBIDDEN)


@query("patterns_found", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN contains(text, {quoted(p)}) THEN {k} END" for k, p in enumerate(FORBIDDEN)) + "], lambda x: x IS NOT NULL) AS found FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", O.patterns_found("text", FORBIDDEN).alias("found"))


# evaluation

@query("bytes_per_token", f"{ids_sql()} SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(len(ids))::BIGINT AS tokens, round(sum(octet_length(encode(text)))::DOUBLE / sum(len(ids)), 4) AS bytes_per_token FROM documents JOIN encoded USING (doc_id) GROUP BY source")
def _(spark, d):
    ids = E.encode(table(spark, d, "documents").select("source", "text"), published().model, special=False)
    return V.bytes_per_token(ids, "text", "ids", "source")


@query("bytes_per_token_of_vocabulary")
def _(spark, d):
    return V.bytes_per_token(Tokenizer(trained(spark, d)).encode_df(table(spark, d, "documents").select("lang", "text")), "text", "ids", "lang")


def ranked(spark, d, lang: str) -> DataFrame:
    """A vocabulary of a language's pretokens, and of pairs of them with a space: id by falling count."""
    from pyspark.sql import Window

    c = P.pretoken_counts(table(spark, d, "documents").filter(F.col("lang") == lang))
    return c.select(F.col("pretoken").alias("token"), (F.row_number().over(Window.orderBy(F.desc("count"), "pretoken")) - 1).alias("id"))


def ranked_sql(lang: str) -> str:
    return f"(SELECT pretoken AS token, row_number() OVER (ORDER BY count DESC, pretoken) - 1 AS id FROM ({counts_sql('gpt2', where=f'lang = {quoted(lang)}')}))"


AB = f"a AS {ranked_sql('en')}, b AS {ranked_sql('de')}"
SUPER = "regexp_matches(token, '(?s)[^ ] ')"


@query("vocab_overlap", f"""
WITH {AB},
j AS (SELECT coalesce(a.token, b.token) AS token, a.token IS NOT NULL AS x, b.token IS NOT NULL AS y FROM a FULL JOIN b ON a.token = b.token),
p AS (SELECT 'vocab' AS part, x, y FROM j UNION ALL SELECT CASE WHEN {SUPER} THEN 'superwords' ELSE 'subwords' END, x, y FROM j),
g AS (SELECT part, count(*) FILTER (x) AS ours, count(*) FILTER (y) AS theirs, count(*) FILTER (x AND y) AS shared FROM p GROUP BY part)
SELECT part, ours, theirs, shared, ours - shared AS ours_only, theirs - shared AS theirs_only,
  CASE WHEN ours + theirs > shared THEN round(shared / (ours + theirs - shared), 4) ELSE 0 END AS jaccard,
  CASE WHEN ours > 0 THEN round(100.0::DOUBLE * shared / ours, 2) ELSE 0 END AS shared_pct_of_ours,
  CASE WHEN theirs > 0 THEN round(100.0::DOUBLE * shared / theirs, 2) ELSE 0 END AS shared_pct_of_theirs FROM g""")
def _(spark, d):
    return V.vocab_overlap(ranked(spark, d, "en"), ranked(spark, d, "de"))


@query("rank_agreement", f"""
WITH {AB}, j AS (SELECT a.id // 10 AS x, b.id // 10 AS y FROM a JOIN b USING (token)),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM j)
SELECT count(*) AS shared, round(corr(x, y), 4) AS spearman FROM r""")
def _(spark, d):
    tens = lambda lang: ranked(spark, d, lang).select("token", F.expr("id div 10").alias("rank"))
    return V.rank_agreement(tens("en"), tens("de"), ["token"])


@query("displacement", f"""
WITH {AB}, d AS (SELECT abs(a.id - b.id) AS d FROM a JOIN b USING (token)), k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM d)
SELECT count(*) AS shared, max(d) FILTER (k = n // 2) AS median, max(d) FILTER (k = floor(n * 0.9::DOUBLE)) AS p90, max(d) AS max, round(100.0::DOUBLE * avg((d <= 100)::INT), 2) AS within_100 FROM k""")
def _(spark, d):
    return V.displacement(ranked(spark, d, "en"), ranked(spark, d, "de"))


def word_pairs(spark, d, lang: str) -> DataFrame:
    """A vocabulary with spaces in its tokens: what spaces part in the whole texts, and all neighbours of these with the space between; id: the least doc_id."""
    w = table(spark, d, "documents").filter(F.col("lang") == lang).select("doc_id", F.split("text", " ").alias("w"))
    two = F.expr("concat(w, zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (x, y) -> concat(x, ' ', y)))")
    return w.select("doc_id", F.explode(two).alias("token")).groupBy("token").agg(F.min("doc_id").alias("id"))


def word_pairs_sql(lang: str) -> str:
    words = f"(SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE lang = {quoted(lang)})"
    return f"(SELECT token, min(doc_id) AS id FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS token FROM {words}) GROUP BY token)"


def as_hex(df: DataFrame) -> DataFrame:
    """Tokens of a character a byte as hexadecimal numbers."""
    return df.withColumn("token", F.hex(F.encode("token", "ISO-8859-1")))


SIZE, BYTES = "octet_length(encode(token))", "hex(encode(token))"


@query("vocab_summary", f"""
WITH v AS (SELECT token, {SIZE} AS n, {SUPER} AS s, len(string_split(trim(token, ' '), ' ')) AS w FROM {word_pairs_sql("en")})
SELECT count(*) AS vocab_size, count(*) FILTER (s) AS n_superwords, round(count(*) FILTER (s) / count(*), 4) AS superword_fraction, round(sum(n) / count(*), 2) AS mean_token_len,
  round(sum(n) FILTER (s) / count(*) FILTER (s), 2) AS mean_superword_len, max(n) FILTER (s)::INTEGER AS max_superword_len, round(sum(w) FILTER (s) / count(*) FILTER (s), 2) AS mean_words_per_superword FROM v""")
def _(spark, d):
    return V.vocab_summary(word_pairs(spark, d, "en"))


@query("longest_superwords", f"SELECT {BYTES} AS token, {SIZE}::INTEGER AS bytes FROM {word_pairs_sql('en')} WHERE {SUPER} ORDER BY 2 DESC, 1 LIMIT 12")
def _(spark, d):
    return as_hex(V.longest_superwords(word_pairs(spark, d, "en")))


@query("vocab_examples", f"""
WITH a AS (SELECT {BYTES} AS token, id FROM {word_pairs_sql("en")} WHERE {SUPER}), b AS (SELECT {BYTES} AS token, id FROM {word_pairs_sql("fr")} WHERE {SUPER}),
k AS (SELECT 'shared_earliest' AS kind, token, row_number() OVER (ORDER BY id, token) AS k FROM a WHERE token IN (SELECT token FROM b)
  UNION ALL SELECT 'ours_only_earliest', token, row_number() OVER (ORDER BY id, token) FROM a WHERE token NOT IN (SELECT token FROM b)
  UNION ALL SELECT 'theirs_only_earliest', token, row_number() OVER (ORDER BY id, token) FROM b WHERE token NOT IN (SELECT token FROM a)
  UNION ALL SELECT 'ours_only_longest', token, row_number() OVER (ORDER BY length(token) DESC, id, token) FROM a WHERE token NOT IN (SELECT token FROM b)
  UNION ALL SELECT 'theirs_only_longest', token, row_number() OVER (ORDER BY length(token) DESC, id, token) FROM b WHERE token NOT IN (SELECT token FROM a))
SELECT kind, k::INTEGER AS k, token FROM k WHERE k <= 10""")
def _(spark, d):
    return as_hex(V.examples(word_pairs(spark, d, "en"), word_pairs(spark, d, "fr")))


@query("running_bytes", "SELECT doc_id, sum(octet_length(encode(text))) OVER (ORDER BY doc_id)::BIGINT AS end_byte FROM documents")
def _(spark, d):
    return V.running_bytes(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "end_byte")


@query("train_eval_split", """
SELECT doc_id, CASE WHEN e <= 600000 THEN 'train' ELSE 'eval' END AS part FROM (SELECT doc_id, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS e FROM documents) WHERE e <= 900000""")
def _(spark, d):
    return V.train_eval_split(table(spark, d, "documents").select("doc_id", "text"), 600_000, 300_000).select("doc_id", "part")


@query("first_bytes", "SELECT count(*) AS docs, sum(octet_length(encode(text)))::BIGINT <= 500000 AS within FROM (SELECT text, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) - octet_length(encode(text)) AS s FROM documents) WHERE s < 0")
def _(spark, d):
    cut = V.first_bytes(table(spark, d, "documents").select("doc_id", "text"), 500_000)
    return cut.select("doc_id", F.octet_length("text").alias("bytes"))


SQL["first_bytes"] = """
WITH r AS (SELECT doc_id, text, octet_length(encode(text)) AS n, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS e FROM documents),
k AS (SELECT doc_id, text, n, e, (500000 - (e - n))::BIGINT AS room FROM r WHERE e - n < 500000)
SELECT doc_id, (CASE WHEN e <= 500000 THEN n ELSE (SELECT max(b) FROM (SELECT octet_length(encode(substr(text, 1, i))) AS b FROM (SELECT unnest(range(0, length(text) + 1)) AS i)) WHERE b <= room) END)::INTEGER AS bytes FROM k"""


@query("digests", "SELECT sha256(text) AS digest, list_sort(list_distinct(list(doc_id))) AS names FROM documents GROUP BY text")
def _(spark, d):
    return V.digests(table(spark, d, "documents"), "doc_id", "text")


@query("grouped_results", "SELECT event_type, count(*) AS runs, min(value) AS best, max(value) AS worst, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def _(spark, d):
    return V.grouped_results(table(spark, d, "events"), ["event_type"], "value")


# streaming

def finished(df: DataFrame, mode: str) -> DataFrame:
    """A stream over what is there, run to its end: its rows go to the shared folder, not to the driver."""
    spark, out, checkpoint = df.sparkSession, folder(df.sparkSession), folder(df.sparkSession)
    if mode == "append":
        S.to_parquet(df, out, checkpoint).awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    last = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{batch}")  # the whole result each time
        last.append(batch)

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/{last[-1]}") if last else spark.createDataFrame([], df.schema)


def stream_of(spark, d, name: str, columns: list[str]) -> DataFrame:
    return S.read_documents(spark, f"{d}/{name}.parquet*", table(spark, d, name).schema).select(*columns)


@query("stream_encode", f"{ids_sql('conversations', 'conv_id, turn')} SELECT conv_id, turn, ids FROM encoded")
def _(spark, d):
    ids = S.encode_stream(stream_of(spark, d, "conversations", ["conv_id", "turn", "text"]), published().model)
    return finished(ids.select("conv_id", "turn", "ids"), "append")


@query("stream_running_counts", counts_sql("gpt2", "conversations"))
def _(spark, d):
    return finished(S.running_counts(stream_of(spark, d, "conversations", ["text"])), "complete")


@query("stream_windowed_tokens", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, sum(octet_length(encode(props)))::BIGINT AS tokens, count(*) AS rows FROM events GROUP BY 1")
def _(spark, d):
    # the table's times have no zone: they pass for UTC on their way through the watermark, which wants one
    zoned = stream_of(spark, d, "events", ["ts", "props"]).withColumn("ts", F.expr("cast(convert_timezone('UTC', current_timezone(), cast(ts as timestamp_ntz)) as timestamp)"))
    sums = S.windowed_tokens(zoned, byte_model(), "ts", "props", "1 day", "3650 days")
    return finished(sums, "complete").withColumn("start", F.expr("convert_timezone(current_timezone(), 'UTC', cast(start as timestamp_ntz))"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
