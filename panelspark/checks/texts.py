"""Queries of embeddings, clusters, entities, request tables and landing payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_embedding
from ..functions.text import token_count
from ..operators import clustering as cl
from ..operators import entities as en
from ..operators import models as mo
from ..operators import requests as rq
from ..operators.fundamentals import RATIOS
from ..operators.signals import pct_targets
from ..plans.market import market_panel
from ..scratch import Scratch
from ..sources import landing as la
from ..sources.views import bars, messages, near, reports, scores, series, table
from . import sql
from .panel import FEATURES, FEATURES_SQL
from .tables import _DAYS, _MACRO, _METRICS, _NAMES, _RATIOS_CTE, _SERIES_NAMES, _WIDE, _end, grouped_scores, query

#: ``query`` registers in the shared table of its module; these are this module's own names.
from .tables import ORACLE_SQL as _SQL
from .tables import QUERIES as _ALL

_BEFORE = set(_ALL)


# Embeddings and clusters


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 60)
    return e.select(F.col("vec_id").alias("id"), at.alias("datetime"), (F.col("vec_id") % 20).cast("string").alias("channel_name"), "embedding", F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("message_link"), F.repeat(F.lit("x"), (F.col("vec_id") % 7).cast("int")).alias("news"))


_EMB = "m AS (SELECT vec_id AS id, make_timestamp((1704067200 + vec_id * 60) * 1000000) AS datetime, cast(vec_id % 20 AS varchar) AS channel_name, list_transform(embedding, lambda x: cast(x AS double)) AS v, 'm' || vec_id AS message_link, repeat('x', cast(vec_id % 7 AS integer)) AS news FROM embeddings)"
_NORM = "n AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM m)"


@query(f"WITH {_EMB}, {_NORM} SELECT id, round(v[1] / len, 5) AS first, round(list_dot_product(v, v) / len / len, 6) AS one FROM n")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _embedded(spark, sf_dir).withColumn("u", cl.unit(F.col("embedding")))
    return t.select("id", F.round(F.get("u", F.lit(0)), 5).alias("first"), F.round(cl.dot(F.col("u"), F.col("u")), 6).alias("one"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS e, list_reverse(list_transform(embedding, lambda x: cast(x AS double))) AS r FROM embeddings)
SELECT vec_id, len(e) AS n, round((e[1] + r[1]) / 2, 6) AS first, round((e[20] + r[20]) / 2, 6) AS middle, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: i * (e[i] + r[i]) / 2)), 4) AS weighted FROM v""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of every vector and its reverse, with a third one masked."""
    e = F.col("embedding")
    pooled = cl.mean_pool(F.array(e, F.transform(e, lambda x: x * 7), F.reverse(e)), F.array(F.lit(1), F.lit(0), F.lit(1)))
    t = table(spark, sf_dir, "embeddings").withColumn("p", pooled)
    weighted = F.aggregate(F.transform("p", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return t.select("vec_id", F.size("p").alias("n"), F.round(F.get("p", F.lit(0)), 6).alias("first"), F.round(F.get("p", F.lit(19)), 6).alias("middle"), F.round(weighted, 4).alias("weighted"))


@query("SELECT vec_id, round(cast(embedding[2] AS double), 5) AS second, len(embedding) AS n FROM embeddings")
def parse_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").withColumn("v", parse_embedding(F.to_json("embedding")))
    return t.select("vec_id", F.round(F.get("v", F.lit(1)).cast("double"), 5).alias("second"), F.size("v").alias("n"))


@query(f"WITH {_EMB} SELECT id, datetime, cast(datetime AS date) - o AS \"window\" FROM m, (SELECT unnest([0, 1]) AS o)")
def assign_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cl.assign_windows(_embedded(spark, sf_dir), 2, 1)
    return out.select("id", "datetime", "window")


@query(f"""WITH {_EMB}, e AS (SELECT cast(min(datetime) AS date) AS first, max(datetime) AS last FROM m), k AS (SELECT first, greatest(0, floor((epoch(last) - epoch(first)) / 86400 - 3) // 2 + 1) AS top FROM (SELECT first, last FROM e)),
w AS (SELECT first + cast(2 * i AS integer) AS "window", i = top AS open FROM k, unnest(range(0, cast(top AS bigint) + 1)) r(i))
SELECT id, "window" FROM m JOIN w ON datetime >= "window" AND (open OR datetime < "window" + 3)""")
def windows_from_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three days every other day from the first midnight; the last one takes what is left."""
    return cl.assign_windows(_embedded(spark, sf_dir), 3, 2, from_first=True).select("id", "window")


_PAIRS = f"""{_EMB}, {_NORM}, p AS (SELECT cast(a.datetime AS date) AS "window", a.id AS a, b.id AS b, 1 - list_dot_product(a.v, b.v) / a.len / b.len AS raw, a.channel_name = b.channel_name AS same, abs(epoch_us(a.datetime) - epoch_us(b.datetime)) / 3.6e9 - 8 AS h FROM n a JOIN n b ON cast(a.datetime AS date) = cast(b.datetime AS date) AND a.id < b.id),
q AS (SELECT *, least(1.0, raw * CASE WHEN same THEN 5 ELSE 1 END) AS d FROM p), r AS (SELECT "window", a, b, least(1.0, d * (1 + 3 / (1 + exp(-h)))) AS distance FROM q)"""


_OVER_ALL = _PAIRS.replace("cast(a.datetime AS date) = cast(b.datetime AS date) AND ", "")


@query(f"WITH {_OVER_ALL} SELECT \"window\", a, b, {sql.near('distance', 5)} AS distance FROM r WHERE distance < 0.9")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all messages, on both sides of a midnight too; ``window`` is the day of the earlier one."""
    return cl.pair_distances_over_all(_embedded(spark, sf_dir), below=0.9).withColumn("distance", near("distance", 5))


@query(f"WITH {_PAIRS}, s AS (SELECT \"window\", a, b, CASE WHEN same THEN d ELSE least(1.0, d * (1 + 3 / (1 + exp(-h)))) END AS distance FROM q) SELECT \"window\", a, b, {sql.near('distance', 5)} AS distance FROM s WHERE distance < 0.9")
def pair_distances_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cl.assign_windows(_embedded(spark, sf_dir))
    return cl.pair_distances(rows, cl.ClusterConfig(channel_skips_time=True), below=0.9).withColumn("distance", near("distance", 5))


@query(f"""WITH {_PAIRS}, f AS (SELECT "window", a, b, raw, same, h, a % 5 IN (1, 2) AND b % 5 IN (1, 2) AS exempt, least(a % 4, b % 4) >= 1 AND greatest(a % 4, b % 4) <= 2 AND a % 3 = b % 3 AS pictured FROM p),
g AS (SELECT *, least(1.0, raw * CASE WHEN same THEN 5 ELSE 1 END) * CASE WHEN pictured AND NOT same THEN 0.5 ELSE 1 END AS d FROM f),
s AS (SELECT "window", a, b, CASE WHEN same OR exempt THEN d ELSE least(1.0, d * (1 + 3 / (1 + exp(-h)))) END AS distance FROM g) SELECT "window", a, b, {sql.near('distance', 5)} AS distance FROM s WHERE distance < 0.9""")
def pair_distances_all_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics without a time penalty, a bonus for images of one group, one channel without a time penalty."""
    rows = cl.assign_windows(_embedded(spark, sf_dir)).withColumns({"topic": F.concat(F.lit("t"), (F.col("id") % 5).cast("string")), "n_images": (F.col("id") % 4).cast("int"), "image_group": (F.col("id") % 3).cast("int")})
    cfg = cl.ClusterConfig(channel_skips_time=True, exempt_topics=("t1", "t2"), image_bonus=0.5)
    return cl.pair_distances(rows, cfg, below=0.9).withColumn("distance", near("distance", 5))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cl.assign_windows(_embedded(spark, sf_dir))
    return cl.cluster_windows(spark, rows, cl.ClusterConfig(threshold=0.3)).join(rows, ["window", "id"])


@query(None)
def cluster_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage clusters of each day; tests compare them with one dense matrix a day."""
    return _members(spark, sf_dir).select("window", "id", "cluster")


@query(None)
def cluster_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their members as arrays."""
    return cl.cluster_records(_members(spark, sf_dir))


_GROUPED = "WITH m AS (SELECT *, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS datetime FROM documents)"


@query(f"{_GROUPED} SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, datetime, doc_id) AS n FROM m) WHERE n = 1")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").withColumns({"id": F.col("doc_id"), "news": F.col("text"), "datetime": F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)})
    return cl.representatives(t, ["lang", "source"]).select("lang", "source", "doc_id", "n_chars")


@query(f"{_GROUPED} SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY datetime, doc_id) AS n FROM m) WHERE n = 1")
def earliest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").withColumns({"id": F.col("doc_id"), "news": F.col("text"), "datetime": F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)})
    return cl.representatives(t, ["lang", "source"], earliest=True).select("lang", "source", "doc_id", "n_chars")


@query(None)
def embed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed unit vectors of all messages."""
    return cl.embed(messages(spark, sf_dir)).select("message_link", "embedding")


@query(None)
def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of nearly equal vectors, read as two images a document."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("id"), (F.col("vec_id") % 2).alias("position"), "embedding")
    return cl.image_groups(spark, e, 0.05)


# Entities


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded dictionary: 12 pairs of common words as companies."""
    words = ["the", "of", "de", "and", "is in", "to the", "la", "les", "der", "und", "que", "on the"]
    return spark.createDataFrame([(f"T{i}", w, "company", i) for i, w in enumerate(words)], "secid string, alias string, kind string, seq int")


_ALIAS_ROWS = ", ".join(f"('T{i}', '{w}')" for i, w in enumerate(["the", "of", "de", "and", "is in", "to the", "la", "les", "der", "und", "que", "on the"]))


@query(f"""WITH a(secid, alias) AS (VALUES {_ALIAS_ROWS}), h AS (SELECT DISTINCT doc_id, secid FROM documents, a WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || alias || '($|[^\\p{{L}}\\p{{N}}_])'))
SELECT doc_id, list_sort(list(secid)) AS secids FROM h WHERE secid <> 'T0' GROUP BY doc_id""")
def find_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return en.find_entities(docs, en.alias_table(_aliases(spark, sf_dir)), ["T0"], key="doc_id")


@query("""WITH s AS (SELECT cast(ts AS date) AS date, 'Сбер-' || user_id AS name, value AS score, event_id AS seq FROM events)
SELECT date, 'SBER' || cast(replace(name, 'Сбер-', '') AS bigint) AS secid, arg_max(score, row(abs(score), -seq)) AS score FROM s GROUP BY ALL""")
def resolve_and_max_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.select(F.to_date("ts").alias("date"), F.concat(F.lit("Сбер-"), F.col("user_id").cast("string")).alias("name"), F.col("value").cast("string").alias("score"), F.col("event_id").alias("seq"))
    aliases = e.select(F.concat(F.lit("сбер "), F.col("user_id").cast("string")).alias("alias"), F.concat(F.lit("SBER"), F.col("user_id").cast("string")).alias("secid")).distinct()
    # capital and small Cyrillic es map to different letters, so both spellings are aliases
    aliases = aliases.unionByName(aliases.withColumn("alias", F.initcap("alias")))
    return en.max_abs(en.resolve_entities(s, aliases, aliases.select("secid").distinct()))


# Requests and answers


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 5).cast("int"))
    return t.select(day.cast("timestamp").alias("datetime"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("role").alias("title"), "text")


_CHATS = """c AS (SELECT DATE '2024-01-01' + cast(conv_id % 5 AS integer) AS date, conv_id * 100 + turn AS seq, trim(role) AS title, trim(text) AS text FROM conversations WHERE trim(role) <> '' AND trim(text) <> ''),
k AS (SELECT *, cast((row_number() OVER (PARTITION BY date ORDER BY seq) - 1) // 50 + 1 AS integer) AS chunk FROM c)"""


@query(f"WITH {_CHATS} SELECT date, seq, title, text, chunk FROM k")
def chunk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.chunk_messages(rq.prepare_messages(_chats(spark, sf_dir)))


_BLOCKS = f"""{_CHATS}, b AS (SELECT 'date_' || date || '_chunk_' || chunk AS custom_id, date, chunk, cast(count(*) AS integer) AS n_messages,
  string_agg(replace(replace(title, chr(10), ' '), chr(13), '') || ' : ' || replace(replace(text, chr(10), ' '), chr(13), ''), '\\n' ORDER BY seq) AS block FROM k GROUP BY date, chunk)"""


@query(f"WITH {_BLOCKS} SELECT * FROM b")
def message_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.message_blocks(rq.chunk_messages(rq.prepare_messages(_chats(spark, sf_dir))))


_TEMPLATE = """### SYSTEM ###
Answer {{"summary": "..."}} for {TICKERS_AND_INDICES}
######
### USER ###
Day {DATE}: {NEWS_LINES}
######"""


@query(f"""WITH {_BLOCKS} SELECT custom_id, '{{"custom_id":"' || custom_id || '","method":"POST","url":"/v1/chat/completions","body":{{"model":"model","messages":[{{"role":"system","content":"Answer {{\\"summary\\": \\"...\\"}} for T0 : the"}},{{"role":"user","content":"Day ' || date || ': ' || n_messages || '"}}],"temperature":0,"response_format":{{"type":"json_object"}}}}}}' AS request FROM b""")
def build_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rq.message_blocks(rq.chunk_messages(rq.prepare_messages(_chats(spark, sf_dir))))
    system, user = rq.split_prompt(_TEMPLATE)
    none = spark.createDataFrame([], "custom_id string, secids array<string>")
    b = rq.ticker_block(b, none, spark.createDataFrame([], "secid string, description string"), ["T0 : the"])
    return rq.build_requests(b, rq.render_prompt(system, {"TICKERS_AND_INDICES": F.col("tickers")}), rq.render_prompt(user, {"DATE": F.col("date").cast("string"), "NEWS_LINES": F.col("n_messages").cast("string")}))


@query(f"WITH {_BLOCKS} SELECT custom_id, cast(len(regexp_extract_all(block, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) + 9 AS integer) AS n_tokens FROM b")
def request_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rq.message_blocks(rq.chunk_messages(rq.prepare_messages(_chats(spark, sf_dir))))
    return rq.token_stats(b, token_count(F.col("block")))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers of every form: plain, signed, with raw newlines, with text around, cut off, failed."""
    e = table(spark, sf_dir, "events")
    cid = F.concat(F.lit("date_"), F.date_format("ts", "yyyy-MM-dd"), F.lit("_chunk_"), (F.col("event_id") % 12).cast("string"))
    k, v = F.col("event_id") % 7, (F.floor(F.col("value")) % 4).cast("string")
    body = F.concat(F.lit('{"summary": "s'), (F.col("event_id") % 12).cast("string"), F.lit('", "impact": {"A": '), F.when(k == 1, "+").otherwise(""), v, F.lit(', "B": -'), v, F.lit("}, \"confidence\": 5}"))
    content = F.when(k == 2, F.concat(F.lit("Sure: "), body, F.lit(" bye"))).when(k == 3, F.substring(body, 1, 30)).when(k == 4, F.replace(body, F.lit("summary\": \""), F.lit("summary\": \"\n"))).when(k == 5, None).otherwise(body)
    r = e.select(cid.alias("custom_id"), F.col("event_id").alias("seq"), F.when(k == 6, 500).otherwise(200).alias("status_code"), content.alias("content"), F.lit(None).cast("string").alias("error"))
    bad = e.filter("event_id % 211 = 0").select(cid.alias("custom_id"), F.lit("limit").alias("code"), F.lit(429).alias("status"), F.lit("slow down").alias("message"))
    return r, bad


_RESULTS = """e AS (SELECT 'date_' || strftime(ts, '%Y-%m-%d') || '_chunk_' || event_id % 12 AS custom_id, cast(ts AS date) AS date, event_id % 12 AS chunk, event_id AS seq, event_id % 7 AS k, floor(value) % 4 AS v FROM events),
bad AS (SELECT DISTINCT custom_id FROM e WHERE seq % 211 = 0), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY custom_id ORDER BY seq) AS n FROM e) WHERE n = 1 AND custom_id NOT IN (SELECT custom_id FROM bad)),
ans AS (SELECT custom_id, date, chunk, CASE k WHEN 3 THEN 'ERROR: Failed to parse JSON response' WHEN 5 THEN 'ERROR: missing body' WHEN 6 THEN 'ERROR: status 500' WHEN 4 THEN chr(10) || 's' || chunk ELSE 's' || chunk END AS summary, k NOT IN (3, 5, 6) AS ok, cast(v AS double) AS v FROM f
  UNION ALL SELECT DISTINCT b.custom_id, e.date, e.chunk, 'ERROR (limit, status: 429): slow down', false, NULL FROM bad b JOIN e USING (custom_id))"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.parse_responses(*_results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT custom_id, summary, CASE WHEN ok THEN cast(v AS varchar) END AS a FROM ans")
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.try_element_at("answer.impact", F.lit("A")).cast("double").cast("string")
    return _answers(spark, sf_dir).select("custom_id", "answer.summary", a.alias("a"))


@query(f"WITH {_RESULTS} SELECT custom_id FROM ans WHERE NOT ok")
def problem_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.problem_ids(_answers(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT DISTINCT custom_id FROM e WHERE custom_id IN (SELECT custom_id FROM e WHERE k IN (1, 2, 3, 4, 5, 6))")
def failed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = _results(spark, sf_dir)
    return rq.failed_requests(r.select("custom_id").distinct(), r)


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import id_chunk, id_date

    return _answers(spark, sf_dir).select(id_date("custom_id").alias("date"), id_chunk("custom_id").alias("chunk"), "answer")


_FLAT = f"{_RESULTS}, t AS (SELECT date, chunk, 'A' AS secid, v AS x FROM ans WHERE ok UNION ALL SELECT date, chunk, 'B', -v FROM ans WHERE ok)"


@query(f"WITH {_FLAT} SELECT date, secid, round(arg_max(x, row(abs(x), chunk)), 2) + 0.0 AS score FROM t GROUP BY date, secid")
def merge_day_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.merge_day(_by_day(spark, sf_dir))[1].withColumn("score", F.col("score") + 0.0)


@query(f"WITH {_RESULTS} SELECT date, coalesce(string_agg(CASE WHEN ok THEN summary END, ' ' ORDER BY chunk), '') AS summary, count(*) FILTER (NOT ok) AS n_failed FROM ans GROUP BY date")
def merge_day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.merge_day(_by_day(spark, sf_dir))[0]


@query(f"WITH {_FLAT} SELECT date, secid, round(avg(x), 2) + 0.0 AS score FROM t GROUP BY date, secid")
def merge_day_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.merge_day(_by_day(spark, sf_dir), "mean")[1].withColumn("score", F.col("score") + 0.0)


@query(f"WITH {_FLAT}, s AS (SELECT date, secid, round(arg_max(x, row(abs(x), chunk)), 2) + 0.0 AS score FROM t GROUP BY date, secid) SELECT date, max(CASE WHEN secid = 'A' THEN score END) AS \"A\", max(CASE WHEN secid = 'B' THEN score END) AS \"B\" FROM s GROUP BY date")
def widen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.widen_scores(rq.merge_day(_by_day(spark, sf_dir))[1].withColumn("score", F.col("score") + 0.0), ["A", "B"])


@query("""WITH e AS (SELECT 'date_' || strftime(ts, '%Y-%m-%d') || '_chunk_' || event_id AS custom_id, cast(ts AS date) AS date, CASE WHEN event_id % 2 = 0 THEN 'k' || json_extract_string(props, '$.k') ELSE 'plain ' || event_id END AS s FROM events)
SELECT date, list(s ORDER BY custom_id) AS summaries FROM e GROUP BY date""")
def group_chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = F.concat(F.lit("date_"), F.date_format("ts", "yyyy-MM-dd"), F.lit("_chunk_"), F.col("event_id").cast("string"))
    content = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"summary": "k'), F.get_json_object("props", "$.k"), F.lit('"}'))).otherwise(F.concat(F.lit("plain "), F.col("event_id").cast("string")))
    return rq.group_chunk_summaries(table(spark, sf_dir, "events").select(cid.alias("custom_id"), content.alias("content")))


@query("""WITH d AS (SELECT cast(ts AS date) AS date, count(*) AS n FROM events GROUP BY 1)
SELECT 'date_' || date AS custom_id, '{"custom_id":"date_' || date || '","method":"POST","url":"/v1/chat/completions","body":{"model":"model","messages":[{"role":"system","content":"Sum up"},{"role":"user","content":"n=' || n || '"}],"temperature":0,"response_format":{"type":"json_object"}}}' AS request FROM d WHERE date > DATE '2024-01-10'""")
def daily_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.array(F.concat(F.lit("n="), F.count("*").cast("string"))).alias("summaries"))
    return rq.build_daily_requests(s, "### SYSTEM ###\nSum up\n###\n### USER ###\n{CHUNK_SUMMARIES}\n###", "2024-01-10")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE event_type END AS summary FROM events")
def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"summary"'))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", rq.extract_summary(content).alias("summary"))


_BY_GROUP = ", ".join(f"max(CASE WHEN secid % 10 = {i} THEN score END) AS \"T{i}\"" for i in range(10))


@query(f"""WITH {sql.SCORES}, s AS (SELECT date, {_BY_GROUP} FROM (SELECT date, cast(secid AS bigint) AS secid, score FROM scores WHERE source = 'news') GROUP BY date), d AS (SELECT DISTINCT date FROM scores), m AS (SELECT min(date) + cast((max(date) - min(date)) // 2 AS integer) AS middle FROM d)
SELECT d.date, CASE WHEN d.date < middle THEN 'old' ELSE 'new' END AS tg_summary, coalesce(s."T0", CASE WHEN d.date < middle THEN 9.0 END) AS "T0", {", ".join(f's."T{i}"' for i in range(1, 10))} FROM d CROSS JOIN m LEFT JOIN s USING (date)""")
def update_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the days is stored with an older score of one group; scores of ten groups are new."""
    s = scores(spark, sf_dir)
    days = s.select("date").distinct()
    middle = days.agg(F.expr("date_add(min(date), cast(floor(datediff(max(date), min(date)) / 2) AS int))").alias("middle"))
    old = days.join(F.broadcast(middle), F.col("date") < F.col("middle")).select("date", F.lit("old").alias("tg_summary"), F.lit(9.0).alias("T0"))
    new = days.select("date", F.lit(1).alias("seq"), F.lit("new").alias("tg_summary"))
    wide = grouped_scores(s.filter("source = 'news'")).withColumn("seq", F.lit(1))
    return rq.update_digest(old, new, wide)


# Landing payloads made of the tables


@query(f"WITH {sql.BARS} SELECT date, secid, open, high, low, close, volume, waprice FROM bars")
def parse_history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["BOARDID", "TRADEDATE", "SECID", "OPEN", "HIGH", "LOW", "CLOSE", "VOLUME", "WAPRICE"]
    row = lambda board: F.array(F.lit(board), F.col("date").cast("string"), "secid", *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume", "waprice")])
    pages = bars(spark, sf_dir).groupBy("secid", F.year("date").alias("y")).agg(F.collect_list(row("TQBR")).alias("a"), F.collect_list(row("OTHER")).alias("b"))
    value = F.to_json(F.struct(F.struct(F.array(*[F.lit(n) for n in names]).alias("columns"), F.concat("a", "b").alias("data")).alias("history")))
    return la.parse_history_json(pages.select(value.alias("value")))


@query(f"WITH {sql.SERIES} SELECT date, series, value FROM series")
def parse_index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.array(F.col("date").cast("string"), "series", F.col("value").cast("string"))
    pages = series(spark, sf_dir).groupBy("series", F.year("date").alias("y")).agg(F.collect_list(row).alias("d"))
    value = F.to_json(F.struct(F.struct(F.array(F.lit("TRADEDATE"), F.lit("SECID"), F.lit("CLOSE")).alias("columns"), F.col("d").alias("data")).alias("history")))
    return la.parse_index_json(pages.select(value.alias("value")))


@query(f"WITH {sql.SERIES} SELECT date, value FROM series")
def parse_commodity_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    lo, hi = rows.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    pages = rows.groupBy("series", F.year("date")).agg(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), F.col("value").cast("string").alias("value"))).alias("data"))
    return la.parse_commodity_json(pages.select(F.to_json(F.struct("data")).alias("value")), lo, hi)


@query(f"WITH {sql.SERIES} SELECT date, value AS key_rate FROM series")
def parse_html_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), F.date_format("date", "dd.MM.yyyy"), F.lit("</td><td><b>"), F.translate(F.col("value").cast("decimal(20,2)").cast("string"), ".", ","), F.lit("</b></td><td>x</td></tr>\n"))
    pages = series(spark, sf_dir).groupBy("series", F.year("date")).agg(F.concat_ws("", F.lit("<table><tr><th>Date</th></tr>"), F.collect_list(row), F.lit("</table>")).alias("value"))
    return la.parse_html_rate_table(pages.select("value"))


# Whole plans and models


_HORIZONS = (1, 3, 7, 30, 180, 365)
_FIN = [*_NAMES, "NetDebt_q", "NetDebt_y"]
_Q = lambda names, of: ", ".join(f'{of}."{n}"' for n in names)
_AHEAD = lambda h: f"(lead(close, {h}) OVER (PARTITION BY secid ORDER BY date) / close - 1) * 100"


@query(f"""WITH {sql.BARS}, {sql.SERIES}, {sql.REPORTS}, {_WIDE}, {_DAYS}, {_MACRO}, {_RATIOS_CTE.replace("count(*) * 100.0 - 300", "count(*) * 100.0")},
goal AS (SELECT secid, date, {", ".join(f'{sql.near(_AHEAD(h), 3)} AS target_{h}d, cast(coalesce({_AHEAD(h)} > 0, false) AS integer) AS target_{h}d_binary' for h in _HORIZONS)} FROM bars)
SELECT secid, date, b.close, {_Q(FEATURES, "t")}, {_Q(_FIN, "f")}, {_Q(_SERIES_NAMES, "m")}, {", ".join(f'{sql.near(f'r."{n}"', 4)} AS "{n}"' for n in RATIOS)}, {", ".join(f"target_{h}d, target_{h}d_binary" for h in _HORIZONS)}
FROM bars b JOIN ({FEATURES_SQL}) t USING (secid, date) JOIN goal USING (secid, date) LEFT JOIN fin f ON f.ticker = secid AND f.date = b.date LEFT JOIN macro m ON m.date = b.date LEFT JOIN ratios r ON r.ticker = secid AND r.date = b.date""")
def market_panel_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators, fundamentals, macro values, ratios and targets in one table."""
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("secid")).agg((F.count("*") * 100.0).alias("issue_size")).withColumn("date", F.lit("1990-01-01").cast("date"))
    out = market_panel(bars(spark, sf_dir, by_ticker=True), reports(spark, sf_dir), series(spark, sf_dir), sizes, _METRICS, _SERIES_NAMES, _end(spark, sf_dir), digits=12)
    rounded = [near(c, 4).alias(c) for c in FEATURES], [near(c, 4).alias(c) for c in RATIOS], [x for h in _HORIZONS for x in (near(f"target_{h}d", 3).alias(f"target_{h}d"), F.col(f"target_{h}d_binary"))]
    return out.select("secid", "date", "close", *rounded[0], *_FIN, *_SERIES_NAMES, *rounded[1], *rounded[2])


@query(None)
def predicted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day returns of every bar predicted by a regressor trained on earlier days."""
    rows = mo.ordered_split(Scratch(spark, "targets").table(pct_targets(bars(spark, sf_dir), (7,)), "rows"), 0.7, 0.15)
    models = mo.train_regressors(rows.filter("part = 'train'"), ["open", "high", "low", "close", "volume"], ["target_7d"], maxIter=5, maxDepth=3)
    return mo.score(rows, models).select("secid", "date", "target_7d", "target_7d_pred")


QUERIES = {k: v for k, v in _ALL.items() if k not in _BEFORE}
ORACLE_SQL = {k: v for k, v in _SQL.items() if k in QUERIES}
