"""Entity dictionaries, mentions in texts and the resolution of score names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name


def load_entities(raw: DataFrame) -> DataFrame:
    """``secid, alias, kind, seq`` of config texts ``raw(value)``: companies with their names, indices."""
    schema = "companies map<string, struct<names:array<string>>>, indices map<string,string>"
    cfg = raw.select(F.from_json("value", schema).alias("c"))
    company = cfg.select(F.explode("c.companies").alias("secid", "v")).select("secid", F.posexplode(F.concat(F.array("secid"), F.coalesce("v.names", F.array().cast("array<string>")))).alias("seq", "alias"), F.lit("company").alias("kind"))
    index = cfg.select(F.explode("c.indices").alias("secid", "alias")).select("secid", F.lit(0).alias("seq"), "alias", F.lit("index").alias("kind"))
    return company.unionByName(index)


def load_channels(raw: DataFrame) -> DataFrame:
    """``section, url, name`` of channel configs ``raw(value)``."""
    cfg = raw.select(F.explode(F.from_json("value", "map<string, map<string,string>>")).alias("section", "m"))
    return cfg.select("section", F.explode("m").alias("url", "name"))


def alias_table(entities: DataFrame) -> DataFrame:
    """``alias, secid``: lower-cased aliases of companies and tickers; the first definition wins."""
    names = entities.filter("kind = 'company'").select(F.lower("alias").alias("alias"), "secid", "seq")
    codes = entities.filter("kind = 'index'").select(F.lower("secid").alias("alias"), "secid", F.lit(1000000).alias("seq"))
    w = Window.partitionBy("alias").orderBy("seq", "secid")
    return names.unionByName(codes).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("alias", "secid")


#: Aliases that are broadcast at most, and first words that runs are chosen by at most.
BROADCAST_ROWS, STARTS = 100_000, 1_000


def find_entities(docs: DataFrame, aliases: DataFrame, base: list[str] = (), key: str = "id", text: str = "text", max_words: int = 4) -> DataFrame:
    """``key, secids``: tickers whose alias stands in the text as whole words, less the ``base`` ones.

    Texts and aliases become runs of one to ``max_words`` words, which join by equality; only runs
    of as many words as some alias has are made, and of several only those that begin like one. A plain
    alias, words with single blanks between, is found by runs that keep to such blanks. The others, which
    may be longer or have other marks between words, are checked against the text.
    Rows of one key count together, also those of the null key.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))
    table = aliases.select("alias", "secid", words(F.col("alias")).alias("w")).filter(F.size("w") > 0)
    table = table.withColumns({"gram": F.array_join(F.slice("w", 1, max_words), " "), "plain": (F.size("w") <= max_words) & (F.col("alias") == F.array_join("w", " "))})
    n = F.count(F.lit(1))
    shapes = table.groupBy("plain", F.least(F.size("w"), F.lit(max_words)).alias("size")).agg(n.alias("n"), F.when(n <= STARTS, F.collect_set(F.get("w", F.lit(0)))).alias("starts")).collect()
    known = table.select("gram", "alias", "secid", "plain")
    known = F.broadcast(known) if sum(s["n"] for s in shapes) <= BROADCAST_ROWS else known

    def runs(plain: bool) -> Column:
        """Distinct runs of ``_w``, the words of a text; plain ones are words with the single blank after them."""
        out = F.array().cast("array<string>")
        for s in sorted((s for s in shapes if s["plain"] == plain), key=lambda s: s["size"]):
            size = s["size"]
            if size == 1:
                one = F.transform("_w", lambda w: F.rtrim(w)) if plain else F.col("_w")
            else:
                at = F.sequence(F.lit(0), F.size("_w") - size)
                begins = lambda i: F.get("_w", i).isin([w + " " * plain for w in s["starts"]]) if s["starts"] is not None else F.get("_w", i).endswith(" " * plain)  # noqa: B023, E731
                one = F.transform(F.filter(at, begins), lambda i: F.rtrim(F.array_join(F.slice("_w", i + 1, size), "" if plain else " ")))  # noqa: B023
                one = F.when(F.size("_w") >= size, one).otherwise(F.array().cast("array<string>"))
            out = F.concat(out, F.array_distinct(one))
        return out

    found = None
    if any(s["plain"] for s in shapes):
        tokens = docs.select(key, F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)(\w+(?: (?=\w))?)"), F.lit(1)).alias("_w"))
        found = tokens.select(key, F.explode(runs(True)).alias("gram")).join(known, "gram").filter("plain").select(key, "secid")
    if found is None or not all(s["plain"] for s in shapes):
        tokens = docs.select(F.col(key), F.lower(F.col(text)).alias("_t"), words(F.col(text)).alias("_w"))
        hits = tokens.select(key, F.xxhash64("_t").alias("_h"), F.explode(runs(False)).alias("gram")).join(known, "gram")
        texts = tokens.select(F.col(key).alias("_k"), "_t", F.xxhash64("_t").alias("_at")).dropDuplicates(["_k", "_at"])
        open_ = hits.filter("NOT plain").select(key, "_h", "alias", "secid").distinct()
        exact = open_.join(texts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_at")))
        quoted = F.concat(F.lit("(?U)(?<!\\w)\\Q"), F.col("alias"), F.lit("\\E(?!\\w)"))
        checked = exact.filter(F.regexp_like("_t", quoted)).select(key, "secid")
        found = checked if found is None else found.unionByName(checked)
    found = found.filter(~F.col("secid").isin(list(base))) if base else found
    return found.groupBy(key).agg(F.array_sort(F.collect_set("secid")).alias("secids"))


def _close_pairs(names: DataFrame, codes: DataFrame, cutoff: float) -> DataFrame:
    """``name, norm, secid, code`` that may be ``cutoff`` percent alike.

    A code of ``n`` letters may differ from such a name in ``d = (1 - cutoff) / cutoff * n`` places at
    most, so one of ``d + 1`` pieces of the code stands in the name, shifted by ``d`` at most.
    """
    if cutoff <= 50:
        raise ValueError("cutoff must be over 50")
    rate = (100 - cutoff) / cutoff
    edits = lambda n: F.floor(n * rate + 1e-9).cast("int")
    cut = lambda n, parts, i: F.floor(n * i / parts).cast("int")
    n = F.length("code")
    pieces = codes.withColumns({"n": n, "parts": edits(n) + 1}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start, end = cut(F.col("n"), F.col("parts"), F.col("i")), cut(F.col("n"), F.col("parts"), F.col("i") + 1)
    pieces = pieces.select("secid", "code", "n", "i", F.substring("code", start + 1, end - start).alias("piece"))
    size = F.length("norm")
    low, high = F.ceil(size / (1 + rate) - 1e-9).cast("int"), F.floor(size * 100 / cutoff + 1e-9).cast("int")
    windows = names.withColumn("n", F.explode(F.sequence(F.greatest(low, F.lit(0)), high))).withColumn("parts", edits(F.col("n")) + 1)
    windows = windows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("shift", F.explode(F.sequence(1 - F.col("parts"), F.col("parts") - 1)))
    start, end = cut(F.col("n"), F.col("parts"), F.col("i")), cut(F.col("n"), F.col("parts"), F.col("i") + 1)
    at = start + F.col("shift")
    windows = windows.filter((at >= 0) & (at + end - start <= size)).select("name", "norm", "n", "i", F.substring("norm", at + 1, end - start).alias("piece")).distinct()
    return windows.join(pieces, ["n", "i", "piece"]).select("name", "norm", "secid", "code").distinct()


def resolve_entities(scores: DataFrame, aliases: DataFrame, canon: DataFrame, cutoff: float = 85.0, short_cutoff: float = 96.0) -> DataFrame:
    """``scores(date, name, score, seq)`` with the ticker that each name stands for as ``secid``.

    An alias that normalises to the same text decides, else the most similar canonical code of at
    least ``cutoff`` percent (a one-letter code needs ``short_cutoff`` for names of over two
    letters). Distinct names meet codes by common pieces, so no list is broadcast or compared whole;
    unmatched names go. ``cutoff`` must be over 50.
    """
    names = scores.select("name").distinct().withColumn("norm", normalize_name(F.col("name")))
    known = aliases.select(normalize_name(F.col("alias")).alias("norm"), "secid").groupBy("norm").agg(F.min("secid").alias("secid"))
    exact = names.join(known, "norm").select("name", "secid")
    rest = names.join(exact.select("name"), "name", "left_anti")
    codes = canon.select(F.col("secid"), normalize_name(F.col("secid")).alias("code")).distinct()
    near = _close_pairs(rest, codes, cutoff)
    longest = F.greatest(F.length("norm"), F.length("code"), F.lit(1))
    near = near.withColumn("ratio", 100 * (1 - F.levenshtein("norm", "code") / longest))
    enough = F.when((F.length("code") == 1) & (F.length("norm") > 2), short_cutoff).otherwise(cutoff)
    fuzzy = near.filter(F.col("ratio") >= enough).groupBy("name").agg(F.max(F.struct("ratio", (-F.length("code")).alias("l"), "secid")).alias("b")).select("name", F.col("b.secid").alias("secid"))
    return scores.join(exact.unionByName(fuzzy), "name")


def max_abs(scores: DataFrame) -> DataFrame:
    """``date, secid, score`` of the largest size, sign kept; the smallest ``seq`` of equals."""
    value = F.expr("try_cast(score AS double)")
    return scores.withColumn("_x", value).filter("_x IS NOT NULL").groupBy("date", "secid").agg(F.max_by("_x", F.struct(F.abs("_x"), -F.col("seq"))).alias("score"))
