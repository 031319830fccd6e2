"""Ranked daily digests as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all

#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = ("кв", "г", "гг", "млн", "млрд", "трлн", "тыс", "руб", "долл", "евро", "проц", "п\\.п", "т\\.д", "т\\.п", "др", "см", "стр", "рис", "табл", "ул", "пр", "корп", "д", "эт", "тел", "факс", "e-mail", "email", "vs", "etc", "i\\.e", "e\\.g")
NO_SCORES = "Нет оценок"


def top_scores(scores: DataFrame, n: int = 3, per_line: int = 3) -> DataFrame:
    """``date, source, top``: the n scores of largest size a day, the market's first, as text lines.

    Nulls and zeros don't count; ties go by name; a day without any has a fixed phrase.
    """
    valid = scores.filter("score IS NOT NULL AND score <> 0")
    market = F.col("secid").startswith("MOEX")
    w = Window.partitionBy("date", "source").orderBy(market.desc(), F.abs("score").desc(), "secid")
    ranked = valid.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    token = F.concat(F.lit("#"), "secid", F.lit(" : "), F.when(F.col("score") > 0, "+").otherwise("-"), F.format_string("%.1f", F.abs("score")))
    lines = ranked.groupBy("date", "source").agg(F.array_sort(F.collect_list(F.struct("_n", token.alias("t")))).alias("ts"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ts") - 1) / per_line).cast("int")), lambda i: F.array_join(F.transform(F.slice("ts", i * per_line + 1, per_line), lambda t: t["t"]), " | "))
    shown = lines.select("date", "source", F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("top"))
    return scores.select("date", "source").distinct().join(shown, ["date", "source"], "left").select("date", "source", F.coalesce("top", F.lit(NO_SCORES)).alias("top"))


#: White space between an end mark and an opening letter or quote, where the mark isn't the point of an abbreviation.
BETWEEN = r"(?<=[.!?])(?<!(?iU:\b(?:" + "|".join(ABBREVIATIONS) + r")\.))(?U:\s+)(?=[А-ЯA-Z\"'«])"


def format_summary(c: Column, bullet: str = "🔹") -> Column:
    """Sentences as bullets with a blank line between; points of abbreviations end none."""
    sentences = F.filter(F.transform(F.split(c, BETWEEN), trim_all), lambda s: s != "")
    return F.array_join(F.transform(sentences, lambda s: F.concat(F.lit(bullet), F.lit(" "), s)), "\n\n")


def digest(days: DataFrame, scores: DataFrame, n: int = 3, title: str = "📰") -> DataFrame:
    """``date, source, message`` of ``days(date, source, summary)``: title and day, bullets, best scores."""
    rows = days.join(top_scores(scores, n), ["date", "source"], "left")
    head = F.concat(F.lit(title + " "), F.date_format("date", "dd.MM.yyyy"), F.lit(" ("), "source", F.lit(")"))
    return rows.select("date", "source", F.concat_ws("\n\n", head, format_summary(F.col("summary")), F.coalesce("top", F.lit(NO_SCORES))).alias("message"))


def linkify(c: Column, channels: dict[str, str]) -> Column:
    """Mentions of a channel, in any case, as links that keep the text."""
    for name, url in channels.items():
        quoted = "\\Q" + name.replace("\\E", "") + "\\E"
        c = F.regexp_replace(c, f"(?iu)({quoted})", "[$1](" + url.replace("\\", "\\\\").replace("$", "\\$") + ")")
    return c


def italicize(c: Column, starts: tuple[str, ...] = ("Сообщение сгенерировано", "Оценки (")) -> Column:
    """Lines that begin with a disclaimer in italics."""

    def line(x: Column) -> Column:
        hit = F.lit(False)
        for s in starts:
            hit = hit | x.startswith(s)
        return F.when(hit, F.concat(F.lit("_"), x, F.lit("_"))).otherwise(x)

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def unpublished(digests: DataFrame, done: DataFrame) -> DataFrame:
    """Digests whose day and source aren't published yet; ``rank`` puts news before blogs."""
    rest = digests.join(done.select("date", "source").distinct(), ["date", "source"], "left_anti")
    return rest.withColumn("rank", F.when(F.col("source") == "news", 0).otherwise(1))
