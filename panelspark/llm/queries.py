"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .conversation_trie import prefix_trie
from .decontam import contaminated
from .kn_lm import perplexity_scores
from .mixing import mix
from .ngram_jaccard import jaccard_components
from .pii import find_personal_data
from .quality import quality_verdicts
from .setsketch import sketch_components
from .token_counts import token_counts
from .token_files import tokens_through_files
from .url_filters import judge_urls
from .warc import archive_pages

#: Rules of the url query: action, host, start of the path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word Jaccard similarity of 0.75 or more."""
    return jaccard_components(spark, _table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url by rules and aliases."""
    return judge_urls(spark, _table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under the word-piece vocabulary."""
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every page, written to seekable bundles and read back."""
    records, _ = archive_pages(spark, _table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, through ORC files in ascending doc_id order."""
    return tokens_through_files(spark, _table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole document under a model of those not held out."""
    return perplexity_scores(spark, _table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of every whole document."""
    return quality_verdicts(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    return find_personal_data(spark, _table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best window of each item."""
    return contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that bring the sources to their target weights."""
    return mix(spark, _table(spark, sf_dir, "documents"))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under four-word Jaccard similarity of 0.8 or more."""
    return sketch_components(spark, _table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two or three words of every language."""
    return collocations(spark, _table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each begun with turns of the first one of its five."""
    c = F.col("conv_id")
    return prefix_trie(spark, _table(spark, sf_dir, "conversations"), c - c % 5, F.crc32(c.cast("string")) % 9)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_url_filters, op3_token_counts, op4_warc, op5_token_files, op6_kneser_ney, op7_quality_rules, op8_pii, op9_decontamination, op10_mixing, op11_setsketch, op12_collocations, op13_conversation_trie)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
#: Pages of the given tables declare no canonical link or redirect, so SQL needs the rules only. The
#: other operators are random, iterative or follow a library; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": f"""WITH rules(act, h, p) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
f AS (SELECT v.*, h || p AS rule, act, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS n FROM v LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM f WHERE n = 1""",
    "op4_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN original <> page_id THEN original END AS refers_to FROM p LEFT JOIN m USING (payload_digest)""",
    "op11_setsketch": rf"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS g FROM t, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT e.b, r.o FROM r JOIN e ON r.d = e.a),
m AS (SELECT d, min(o) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m ON d = doc_id""",
    "op13_conversation_trie": """WITH k AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: [256 + ascii(substr(c::VARCHAR, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, s: CASE WHEN s >= 0 THEN xor(a, s - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)) % 9 AS h FROM k),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, count(*) AS l FROM t GROUP BY 1),
b AS (SELECT h.c, h.h, least(h.h, coalesce(l.l, 0)) AS m FROM h LEFT JOIN l ON l.c = h.c - h.c % 5),
r AS (SELECT b.c, t.i AS d, role, text FROM b JOIN t ON t.c = b.c - b.c % 5 WHERE t.i <= b.m UNION ALL SELECT b.c, b.m + t.i - b.h, role, text FROM b JOIN t ON t.c = b.c WHERE t.i > b.h),
p AS (SELECT c, 0 AS d, [] AS path, 0 AS bytes FROM k UNION ALL SELECT c, d, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS path, strlen(text) FROM r),
p2 AS (SELECT c, d, sha256(path::VARCHAR) AS x, bytes FROM p),
p3 AS MATERIALIZED (SELECT *, lag(x) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS e FROM p2),
n AS MATERIALIZED (SELECT x, d AS depth, min(c) AS conv_id, any_value(up) AS up, any_value(bytes) AS bytes, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN d = e THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM p3 GROUP BY 1, 2),
ch AS (SELECT up, count(*) AS n_children FROM n GROUP BY 1),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.up = n.x),
a AS (SELECT DISTINCT w.x AS top, v.x AS x FROM p3 v JOIN p3 w ON v.c = w.c AND w.d <= v.d),
s AS (SELECT a.top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM a JOIN f ON f.x = a.x GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256 FROM f JOIN s ON s.top = f.x LEFT JOIN n q ON q.x = f.up""",
    "op12_collocations": rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM w, unnest([1, 2, 3]) q(k), unnest(range(1, len(w) - k + 2)) r(i)),
c AS MATERIALIZED (SELECT lang, k, g, lang || ' ' || g AS id, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY 1),
x AS MATERIALIZED (SELECT *, string_split(g, ' ') AS w FROM c WHERE k > 1 AND f >= 10),
u AS MATERIALIZED (SELECT id, f, 1 AS i, lang || ' ' || w[1] AS lid, lang || ' ' || array_to_string(w[2:], ' ') AS rid FROM x UNION ALL SELECT id, f, 2, lang || ' ' || array_to_string(w[1:2], ' '), lang || ' ' || w[3] FROM x WHERE k = 3),
s1 AS MATERIALIZED (SELECT u.*, c.f AS l FROM u JOIN c ON c.id = u.lid),
s AS (SELECT s1.*, c.f AS r, (1000000::HUGEINT * s1.f * s1.f) // (l::HUGEINT * c.f) AS score FROM s1 JOIN c ON c.id = s1.rid),
b AS (SELECT id, arg_min(struct_pack(l := l, r := r, score := score), row(score, i)) AS b FROM s GROUP BY 1),
z AS MATERIALIZED (SELECT f, lang || ' ' || array_to_string(w[1:2], ' ') AS id FROM x WHERE k = 3 UNION ALL SELECT f, lang || ' ' || array_to_string(w[2:3], ' ') FROM x WHERE k = 3),
gone AS (SELECT DISTINCT x.id FROM x JOIN z ON z.id = x.id WHERE 100 * z.f >= 50 * x.f),
o AS (SELECT lang, g AS phrase, f AS a, b.l AS l, b.r AS r, b.score::BIGINT AS score FROM x JOIN b USING (id) WHERE id NOT IN (SELECT id FROM gone)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM p JOIN n USING (lang) WHERE rank <= 2000""",
}
