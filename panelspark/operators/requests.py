"""Tables of chunked model requests and of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import id_date

ANSWER = "summary string, impact map<string,string>, confidence int"


def prepare_messages(df: DataFrame) -> DataFrame:
    """``date, seq, title, text`` of messages with all three; blank texts and titles go."""
    rows = df.select(F.to_date("datetime").alias("date"), "seq", F.trim("title").alias("title"), F.trim("text").alias("text"))
    return rows.filter("date IS NOT NULL AND title <> '' AND text <> ''")


def chunk_messages(df: DataFrame, size: int = 50) -> DataFrame:
    """Add ``chunk``: messages of a day in order, at most ``size`` to a chunk, from 1."""
    n = F.row_number().over(Window.partitionBy("date").orderBy("seq"))
    return df.withColumn("chunk", (F.floor((n - 1) / size) + 1).cast("int"))


def message_line(title: Column, text: Column) -> Column:
    flat = lambda c: F.translate(c, "\n\r", " ")
    return F.concat(flat(title), F.lit(" : "), flat(text))


def message_blocks(df: DataFrame) -> DataFrame:
    """``custom_id, date, chunk, n_messages, block``: the lines of a chunk, joined by a written ``\\n``."""
    line = F.struct("seq", message_line(F.col("title"), F.col("text")).alias("line"))
    by = df.groupBy("date", "chunk").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    block = F.array_join(F.transform("lines", lambda x: x["line"]), "\\n")
    return by.select(F.concat(F.lit("date_"), F.col("date").cast("string"), F.lit("_chunk_"), F.col("chunk").cast("string")).alias("custom_id"), "date", "chunk", F.size("lines").alias("n_messages"), block.alias("block"))


def split_prompt(template: str) -> tuple[str, str]:
    """System and user part of a template whose parts are marked by lines of # around their names."""
    parts: dict[str, list[str]] = {"SYSTEM": [], "USER": []}
    now = None
    for line in template.splitlines():
        bare = line.strip().strip("#").strip()
        if line.strip().startswith("#") and (bare in parts or not bare):
            now = bare or None
        elif now:
            parts[now].append(line)
    return "\n".join(parts["SYSTEM"]).strip(), "\n".join(parts["USER"]).strip()


def render_prompt(template: str, values: dict[str, Column]) -> Column:
    """The template with ``{NAME}`` replaced by columns; doubled braces become single ones."""
    out = F.replace(F.replace(F.lit(template), F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.translate(out, "\x01\x02", "{}")


def ticker_block(chunks: DataFrame, found: DataFrame, descriptions: DataFrame, base: list[str]) -> DataFrame:
    """Add ``tickers``: base description lines, then those of the tickers found in the chunk, by code."""
    extra = found.select("custom_id", F.explode("secids").alias("secid")).join(descriptions, "secid", "left")
    line = F.concat("secid", F.lit(" : "), F.coalesce("description", F.lit("no description")))
    extra = extra.groupBy("custom_id").agg(F.array_sort(F.collect_list(line)).alias("more"))
    lines = F.concat(F.array(*[F.lit(b) for b in base]).cast("array<string>"), F.coalesce("more", F.array().cast("array<string>")))
    return chunks.join(extra, "custom_id", "left").withColumn("tickers", F.array_join(lines, "\n")).drop("more")


def build_requests(chunks: DataFrame, system: Column, user: Column, model: str = "model") -> DataFrame:
    """``custom_id, request``: JSON lines for a batch endpoint, temperature 0 and a JSON answer."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(say("system", system), say("user", user)).alias("messages"), F.lit(0).alias("temperature"), F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    line = F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    return chunks.select("custom_id", line.alias("request"))


def token_stats(requests: DataFrame, count: Column, per_message: int = 3, per_reply: int = 3, messages: int = 2) -> DataFrame:
    """``custom_id, n_tokens``: tokens of the contents, with the fixed cost of messages and the reply."""
    return requests.select("custom_id", (count + per_message * messages + per_reply).alias("n_tokens"))


def _parsed(text: Column) -> Column:
    """The answer if the text is a JSON object, else null."""
    whole = F.trim(text)
    ok = F.expr("true") & whole.startswith("{") & F.try_parse_json(whole).isNotNull()
    return F.when(ok, F.from_json(whole, ANSWER))


def _between_braces(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def safe_json(content: Column) -> Column:
    """Answer struct of model text: signs before numbers and raw newlines are mended, then what
    surrounds the outer braces is cut; text beyond repair gives a summary that begins with ERROR."""
    plus = F.regexp_replace(content, r":\s?\+", ": ")
    newline = r"\r\n|\n|\r"
    tries = [F.regexp_replace(plus, newline, r"\\n"), F.regexp_replace(plus, newline, ""), _between_braces(plus), _between_braces(content)]
    failed = F.struct(F.when(content.isNull(), "ERROR: No content received").otherwise("ERROR: Failed to parse JSON response").alias("summary"), F.create_map().cast("map<string,string>").alias("impact"), F.lit(None).cast("int").alias("confidence"))
    return F.coalesce(*[_parsed(t) for t in tries], failed)


def parse_errors(errors: DataFrame) -> DataFrame:
    """``custom_id, answer`` of ``errors(custom_id, code, status, message)``."""
    text = F.format_string("ERROR (%s, status: %s): %s", "code", F.col("status").cast("string"), "message")
    return errors.select("custom_id", F.struct(text.alias("summary"), F.create_map().cast("map<string,string>").alias("impact"), F.lit(None).cast("int").alias("confidence")).alias("answer"))


def parse_responses(results: DataFrame, errors: DataFrame) -> DataFrame:
    """``custom_id, answer``: errors first, else the first result row of each id.

    ``results(custom_id, seq, status_code, content)``; a status other than 200 and a missing body
    become ERROR summaries.
    """
    bad = parse_errors(errors).dropDuplicates(["custom_id"])
    w = Window.partitionBy("custom_id").orderBy("seq")
    first = results.filter("custom_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").join(bad.select("custom_id"), "custom_id", "left_anti")
    note = lambda text: F.struct(text.alias("summary"), F.create_map().cast("map<string,string>").alias("impact"), F.lit(None).cast("int").alias("confidence"))
    status = note(F.concat(F.lit("ERROR: status "), F.coalesce(F.col("status_code").cast("string"), F.lit("unknown"))))
    answer = F.when(F.coalesce(F.col("status_code") != 200, F.lit(True)), status).when(F.col("content").isNull(), note(F.lit("ERROR: missing body"))).otherwise(safe_json(F.col("content")))
    return first.select("custom_id", answer.alias("answer")).unionByName(bad)


def problem_ids(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("answer.summary").startswith("ERROR")).select("custom_id")


def failed_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests to send again: those with an error, another status, no body or an unreadable answer."""
    bad = F.col("error").isNotNull() | F.coalesce(F.col("status_code") != 200, F.lit(True)) | F.col("content").isNull() | _parsed(F.col("content")).isNull()
    return requests.join(results.filter(bad).select("custom_id").distinct(), "custom_id", "left_semi")


def _scores(answers: DataFrame) -> DataFrame:
    rows = answers.filter(~F.col("answer.summary").startswith("ERROR")).select("date", "chunk", F.explode("answer.impact").alias("secid", "text"))
    return rows.withColumn("score", F.expr("try_cast(text AS double)")).filter("score IS NOT NULL AND NOT isnan(score)")


def merge_day(answers: DataFrame, mode: str = "max", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries ``date, summary, n_failed`` and scores ``date, secid, score`` of ``answers(date, chunk, answer)``.

    ``max`` keeps the score of largest size, the last chunk's of equals; ``mean`` averages. Scores
    are rounded to 2 places. Valid summaries are joined in order and cut to ``limit``; ``mean``
    puts a warning before them when chunks failed, and gives the first error of a day without any.
    """
    limit = limit or (2000 if mode == "max" else 100_000)
    pick = F.max_by("score", F.struct(F.abs("score"), "chunk")) if mode == "max" else F.avg("score")
    scores = _scores(answers).groupBy("date", "secid").agg(F.round(pick, 2).alias("score"))
    good = ~F.col("answer.summary").startswith("ERROR")
    item = F.struct("chunk", F.col("answer.summary").alias("s"))
    by = answers.groupBy("date").agg(F.array_sort(F.collect_list(F.when(good, item))).alias("ok"), F.min(F.when(~good, item)).alias("bad"), F.count(F.when(~good, 1)).alias("n_failed"))
    text = F.array_join(F.filter(F.transform("ok", lambda x: x["s"]), lambda s: s != ""), " ")
    if mode == "mean":
        text = F.when(F.size("ok") == 0, F.col("bad.s")).when(F.col("n_failed") > 0, F.concat(F.format_string("WARNING: %d part(s) failed. ", "n_failed"), text)).otherwise(text)
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)
    return by.select("date", cut.alias("summary"), "n_failed"), scores


def widen_scores(scores: DataFrame, names: list[str]) -> DataFrame:
    return scores.groupBy("date").pivot("secid", names).agg(F.max("score"))


def group_chunk_summaries(results: DataFrame) -> DataFrame:
    """``date, summaries`` of ``results(custom_id, content)``: the summary field, else the whole content."""
    text = F.coalesce(F.when(F.try_parse_json("content").isNotNull(), F.get_json_object("content", "$.summary")), F.col("content"))
    rows = results.select(id_date("custom_id").alias("date"), "custom_id", F.trim(text).alias("s")).filter("date IS NOT NULL AND s <> ''")
    return rows.groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("custom_id", "s"))), lambda x: x["s"]).alias("summaries"))


def build_daily_requests(summaries: DataFrame, template: str, after: str | None = None, model: str = "model") -> DataFrame:
    """One request a day, for days after ``after``."""
    rows = summaries if after is None else summaries.filter(F.col("date") > F.lit(after).cast("date"))
    rows = rows.withColumn("custom_id", F.concat(F.lit("date_"), F.col("date").cast("string")))
    system, user = split_prompt(template)
    return build_requests(rows, render_prompt(system, {}), render_prompt(user, {"CHUNK_SUMMARIES": F.array_join("summaries", "\n"), "DATE": F.col("date").cast("string")}), model)


def extract_summary(content: Column) -> Column:
    return F.coalesce(F.when(F.try_parse_json(content).isNotNull(), F.get_json_object(content, "$.summary")), content)


def update_digest(old: DataFrame, new: DataFrame, scores: DataFrame) -> DataFrame:
    """Stored days plus new ones, the first of each; score columns take the newest non-null values.

    ``old(date, tg_summary, <scores>...)``, ``new(date, seq, tg_summary)``, ``scores(date, seq, <scores>...)``.
    """
    names = [c for c in scores.columns if c not in ("date", "seq")]
    w = Window.partitionBy("date").orderBy("seq")
    fresh = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").join(old.select("date"), "date", "left_anti").select("date", "tg_summary")
    last = scores.withColumn("_n", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("seq")))).filter("_n = 1").select("date", *[F.col(n).alias(f"_{n}") for n in names])
    rows = old.unionByName(fresh, allowMissingColumns=True).join(last, "date", "left")
    kept = [c for c in rows.columns if not c.startswith("_") and c not in names]
    return rows.select(*kept, *[F.coalesce(f"_{n}", n if n in old.columns else F.lit(None)).alias(n) for n in names])
