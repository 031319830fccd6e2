"""URL rules whose block decisions spread over redirects and canonical links.

A rule is ``host/path``; it fits its host and every subdomain when the url's path starts with the
rule's path, and the longest fitting rule decides. Urls without a rule take the decision of their
aliases: urls that redirects or canonical links connect form a component, and a component with a
blocked and no expressly allowed member is blocked. A url's own rule always wins, and within a
component an allow rule outweighs any block rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..operators.components import connected_components
from .common import Scratch, looked_up

#: Copies of one hot url or component are shared out over so many tasks.
SALTS = 64

#: A tag that can declare a link, with quoted values that may hold ``>``, and one of its attributes.
_TAG = r"""(?is)<(link|meta|base)(?=[\s/>])[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
_PAIR = r"""(?is)[^\s"'<>/=]+\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
#: Content of a refresh: seconds, then the url with or without its name and quotes.
_REFRESH = r"""(?is)^\s*[0-9][0-9.]*[\s;,]+(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*\S))"""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty when it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return ascii_lower(host), path


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, fits`` for the distinct hosts that rules of their own or of a parent domain fit.

    ``fits`` lists path, name and action of ``rules(action, host, path)``, the longest name first.
    Hosts meet rules by equality of their domain suffixes, so a rule list of any length is a join.
    """
    labels = F.split("host", "\\.")
    most = rules.agg(F.max(F.size(labels))).first()[0] or 0  # no longer suffix can be a rule's host
    suffix = F.explode(F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    found = hosts.select("host").distinct().filter("host <> ''").select("host", suffix.alias("domain"))
    known = rules.select(F.col("host").alias("domain"), "path", F.concat("host", "path").alias("name"), "action").dropna()
    fit = F.struct((-F.length("name")).alias("order"), "domain", "path", "name", "action")
    return found.join(known, "domain").groupBy("host").agg(F.array_sort(F.collect_set(fit)).alias("fits"))


def with_rule(rows: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(host, path, ...)`` with ``rule`` and ``action`` of the longest fitting rule, or nulls."""
    of = scratch.table(rules_of_hosts(rows, rules), "rules")
    both = looked_up(rows, of, of.count(), "host")
    best = F.get(F.filter("fits", lambda f: F.col("path").startswith(f["path"])), F.lit(0))
    return both.withColumn("best", best).select(*rows.columns, F.col("best.name").alias("rule"), F.col("best.action").alias("action"))


def url_key(host: Column, path: Column, url: Column) -> Column:
    """What identifies a page among aliases: host, path and query, without scheme and fragment."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def without_dots(path: Column) -> Column:
    """An absolute path with its ``.`` and ``..`` segments resolved."""
    parts = F.slice(F.split(path, "/"), 2, F.length(path) + 1)

    def walk(segments: Column) -> Column:
        up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
        open_end = F.element_at(segments, -1).isin(".", "..")
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(open_end & (F.size(k) > 0), "/").otherwise("")))

    return let(parts, walk)


def resolved(src: Column, to: Column) -> Column:
    """The url that reference ``to`` names on page ``src``; null for schemes without ``://``."""
    scheme = F.regexp_extract(src, r"(?s)^([^:]*):", 1)
    base = F.regexp_extract(src, r"(?s)^([^:]*://[^/?#]*)", 1)
    path = F.regexp_extract(src, r"(?s)^[^:]*://[^/?#]*(/[^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(src, r"(?s)^[^?#]*(\?[^#]*)", 1)
    own, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(base, without_dots(own), rest))
        .when(to.startswith("?"), F.concat(base, path, to)).when(own == "", F.concat(base, path, query))
        .otherwise(F.concat(base, without_dots(F.concat(folder, own)), rest))
    )


def _attribute(pairs: Column, name: str) -> Column:
    """Value of the first of ``pairs`` with the name, A-Z of any case; null without one."""
    found = F.get(F.filter(pairs, lambda p: ascii_lower(F.regexp_extract(p, r"(?s)^([^\s=]+)", 1)) == name), F.lit(0))
    value = F.regexp_extract(found, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
    return F.regexp_replace(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"), "&amp;", "&")


def links_of(pages: DataFrame) -> DataFrame:
    """``src, dst`` of canonical links and refresh redirects that the pages' html declares, comments aside.

    Tags are read attribute by attribute: ``rel`` is a list of words, ``data-href`` is another name
    than ``href``, a refresh may quote its url, and references are relative to ``<base href>``.
    """
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    some = pages.filter(url.contains("://") & html.rlike("(?i)canonical|refresh"))
    some = some.select(url.alias("src"), F.regexp_replace(html, r"(?s)<!--.*?-->", "").alias("html"))
    tag = lambda t: F.struct(ascii_lower(F.regexp_extract(t, r"^<([A-Za-z]+)", 1)).alias("kind"), F.regexp_extract_all(t, F.lit(_PAIR), F.lit(0)).alias("pairs"))
    tags = some.select("src", F.transform(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)), tag).alias("tags"))
    of = lambda kind: F.filter("tags", lambda t: t["kind"] == kind)
    words = lambda t, name: F.split(F.trim(ascii_lower(F.coalesce(_attribute(t["pairs"], name), F.lit("")))), r"\s+")
    canonical = F.transform(F.filter(of("link"), lambda t: F.array_contains(words(t, "rel"), "canonical")), lambda t: _attribute(t["pairs"], "href"))
    content = F.transform(F.filter(of("meta"), lambda t: words(t, "http-equiv") == F.array(F.lit("refresh"))), lambda t: _attribute(t["pairs"], "content"))
    refresh = F.transform(content, lambda c: F.concat(*[F.regexp_extract(c, _REFRESH, i) for i in (1, 2, 3)]))
    base = F.get(F.filter(F.transform(of("base"), lambda t: _attribute(t["pairs"], "href")), lambda x: x.isNotNull()), F.lit(0))
    raw = tags.select("src", base.alias("base"), F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("to"))
    raw = raw.select("src", F.coalesce(resolved(F.col("src"), F.trim("base")), "src").alias("from"), F.trim("to").alias("to")).filter("to <> ''")
    return raw.select("src", resolved(F.col("from"), F.col("to")).alias("dst")).dropna()


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every row of ``pages(page_id, url, html)``.

    ``rules`` are (action, host, path) triples or a table of such columns; of equally long fitting
    rules the one with the smaller domain and path counts. ``redirects(src, dst)`` adds logged
    redirects to the links that the html declares. A null url,
    or one without ``://``, has an empty host and path, no alias and the verdict allow. Repeated
    rows repeat in the result; extra columns are ignored. component is null without aliases.
    """
    scratch = Scratch(spark, "url-filters")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "action string, host string, path string")

    def keyed(url: Column) -> Column:
        host, path = split_url(url)
        return url_key(host, path, url)

    def judged(df: DataFrame, url: Column) -> DataFrame:
        host, path = split_url(url)
        return with_rule(df.withColumns({"host": host, "path": path, "key": url_key(host, path, url)}), rules, scratch)

    links = links_of(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    ends = scratch.table(links.select(keyed(F.col("src")).alias("a"), keyed(F.col("dst")).alias("b")).dropna().distinct(), "links")
    found = connected_components(ends, scratch)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    members = judged(found, as_url).select("node", "root", "action")
    say = members.groupBy("root").agg(F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed"))
    bad = F.coalesce(F.col("blocked"), F.lit(False)) & ~F.coalesce(F.col("allowed"), F.lit(False))
    say = scratch.table(say.select(F.col("root").alias("r"), bad.alias("bad")), "components")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")
    split = found.withColumn("t", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    alias = split.join(say.select("r", "bad", salts), (F.col("root") == F.col("r")) & (F.col("t") == F.col("s"))).select("node", "root", "bad")
    alias = scratch.table(alias, "aliases")
    rows = judged(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), F.col("url"))
    rows = rows.withColumn("t", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    out = rows.join(alias.select("node", "root", "bad", salts), (F.col("key") == F.col("node")) & (F.col("t") == F.col("s")), "left")
    verdict = F.coalesce("action", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("root").alias("component"))
