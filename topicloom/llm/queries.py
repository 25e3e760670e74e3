"""The operators of this subpackage as queries over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import once
from . import ann, chat, decontam, hardneg, html, mixing, neardup, periodic, quality, sharding, tokenids, urls, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_decontam(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bl AS (
  SELECT item_id, ws, least(len(ws), 10) AS n FROM bw WHERE len(ws) > 0
), bg AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bl)
), lens AS (SELECT DISTINCT n FROM bl),
dg AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens WHERE len(ws) >= n)
), hits AS (SELECT doc_id, item_id, n, i FROM dg JOIN bg USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mix(table(spark, folder, "documents")).taken
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    rendered = chat.rotate(table(spark, folder, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rendered.select("conv_id", "segment", "part", "participant", "n_turns", "text", spans.alias("loss_spans"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, CAST(floor(turn / 1024.0) AS BIGINT) AS segment, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS body
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker NOT IN ('', 'system')
), m AS (
  SELECT t.*, participant, '<|im_start|>' || CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = 'system' THEN 'system'
    WHEN speaker = '' THEN 'user' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), n AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, segment, participant ORDER BY turn, speaker, body) - 1) // 4096 AS BIGINT) AS part FROM m
), s AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS piece,
    coalesce(sum(length(head || body || '<|im_end|>' || chr(10))) OVER (PARTITION BY conv_id, segment, part, participant
      ORDER BY turn, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins
  FROM n
)
SELECT conv_id, segment, part, participant, count(*) AS n_turns,
  string_agg(piece, '' ORDER BY turn, speaker, body) AS text,
  coalesce(string_agg(CAST(begins AS BIGINT) || '-' || CAST(begins + length(body) AS BIGINT), ',' ORDER BY turn, speaker, body)
    FILTER (speaker = participant), '') AS loss_spans
FROM s GROUP BY conv_id, segment, part, participant
"""


def op5_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    archives = warc.write(pages, warc.archive_folder(spark))
    return warc.read(archives, with_payload=False).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, folder, "pages"), rules)


OP7_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT page_id, host, path, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

QUALITY_LEAST = 0.7


def held_out():
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels").filter(~held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op9_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def looped(doc_id, text):
    """The words of a tenth of the documents, with a part of them repeated to the end; other texts as they are."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.floor(h / 10).cast("long")

    def repeat(w):
        n = F.size(w)
        a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " "))

    return F.when(h % 10 == 0, once(F.regexp_extract_all(text, F.lit(mixing.WORD), F.lit(0)), repeat)).otherwise(text)


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    higher = lambda r, b: (r["length"] * b["period"] > b["length"] * r["period"]) | b["length"].isNull()
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    found = periodic.runs(docs).withColumn("best", F.aggregate("runs", nothing, lambda b, r: F.when(higher(r, b), r).otherwise(b)))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents")
    files = tokenids.write(docs, tokenids.file_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    kind = docs.schema["doc_id"].dataType
    return tokenids.read(files, with_ids=False).select(F.col("doc_id").cast(kind).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    component = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(F.lit(256.0) * x.cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", component).alias("v"))
    return hardneg.mine(vectors, F.col("id") % 50 == 0)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_decontam, op2_mixing, op3_sharding, op4_chat, op5_neardup, op6_warc, op7_urls, op8_quality, op9_ann, op10_html,
        op11_runs, op12_token_ids, op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {"op1_decontam": OP1_SQL, "op4_chat": OP4_SQL, "op7_urls": OP7_SQL}
