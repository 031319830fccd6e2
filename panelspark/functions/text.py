"""Rule-based cleaning of messages and names, as column expressions with Unicode-aware patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let

#: Ranges and points of the emoji class that cleaning removes.
EMOJI = r"[\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2300}-\x{2BFF}\x{FE0E}-\x{FE0F}\x{1F195}]"
#: Cyrillic letters and what stands for them in simplified names; ``Ы`` has none.
LETTERS = {
    "А": "A", "а": "a", "В": "B", "в": "v", "Е": "E", "е": "e", "К": "K", "к": "k", "М": "M", "м": "m", "Н": "H", "н": "n",
    "О": "O", "о": "o", "Р": "P", "р": "r", "С": "C", "с": "s", "Т": "T", "т": "t", "Х": "X", "х": "h", "У": "U", "у": "u",
    "Г": "G", "г": "g", "Д": "D", "д": "d", "З": "Z", "з": "z", "И": "I", "и": "i", "Л": "L", "л": "l", "П": "P", "п": "p",
    "Ф": "F", "ф": "f", "Ц": "TS", "ц": "ts", "Ч": "CH", "ч": "ch", "Ш": "SH", "ш": "sh", "Щ": "SCH", "щ": "sch", "Э": "E", "э": "e",
    "Ю": "YU", "ю": "yu", "Я": "YA", "я": "ya", "Й": "Y", "й": "y", "Ж": "ZH", "ж": "zh", "Б": "B", "б": "b", "Ь": "", "ь": "",
    "Ъ": "", "ъ": "", "Ё": "E", "ё": "e",
}


@dataclass(frozen=True)
class CleanConfig:
    """Words that reject a message, substrings that reject it, and substrings to blank out."""

    filter_words: tuple[str, ...] = ()
    obscene: tuple[str, ...] = ()
    rm_substrings: tuple[str, ...] = ()
    skip_substrings: tuple[str, ...] = ()
    use_skip: bool = field(default=False)


def remove_emoji(c: Column) -> Column:
    """Text without emoji; only texts with a byte that all of their kind begin with are scanned."""
    raw = c.cast("binary")
    may = F.contains(raw, F.lit(b"\xf0\x9f")) | F.contains(raw, F.lit(b"\xe2")) | F.contains(raw, F.lit(b"\xef\xb8"))
    return F.when(may, F.regexp_replace(c, EMOJI, "")).otherwise(c)


def _if(c: Column, marks: tuple[str, ...], changed: Column) -> Column:
    """``changed`` where the text has one of the marks without which its pattern can't match."""
    return F.when(_any(c, marks), changed).otherwise(c)


def trim_all(c: Column) -> Column:
    """Text without white space at its ends; only texts with some are scanned, and no run of blanks twice."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(F.regexp_like(ends, F.lit(r"(?U)\s")), F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")).otherwise(c)


def remove_hashtags(c: Column) -> Column:
    return _if(c, ("#",), F.regexp_replace(c, r"(?U)#\w++", ""))


def remove_users(c: Column) -> Column:
    """User names after white space, which goes with them."""
    return _if(c, ("@",), F.regexp_replace(c, r"(?U)\s@\w++", ""))


def remove_urls(c: Column) -> Column:
    """Links with and without a scheme; the latter are whole words with a known ending and a path."""
    schemed = lambda x: _if(x, ("http", "www."), F.regexp_replace(x, r"(?U)http\S++|www\.\S++", ""))
    bare = lambda x: _if(x, (".ru/", ".me/", ".com/", ".org/"), F.regexp_replace(x, r"(?U)(?<!\S)\S+\.(?:ru|me|com|org)/\S++", ""))
    return let(let(c, schemed), bare)


def fix_punct(c: Column) -> Column:
    for old, new in ((". .", "."), ("..", "."), ("« ", "«"), (" »", "»"), (" :", ":"), (" ", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def fix_paragraphs(c: Column) -> Column:
    """Lines with blanks collapsed; those of fewer than 3 characters go."""
    # what is white space and ends no line; a lone blank stays as it is
    blank = r"[\s&&[^\n\x0B\f\r\x{85}\x{2028}\x{2029}]]"
    lines = F.transform(F.split(F.regexp_replace(c, rf"(?U){blank}{{2,}}|(?! ){blank}", " "), r"\R"), lambda p: F.trim(p))
    return F.array_join(F.filter(lines, lambda p: F.length(p) >= 3), "\n")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def clean_text(c: Column, cfg: CleanConfig = CleanConfig()) -> Column:
    """Cleaned message text; empty when it is null, rejected by a word, or nothing is left."""

    def blank(x: Column) -> Column:
        for s in cfg.rm_substrings:
            x = F.replace(x, F.lit(s), F.lit(" "))
        return x

    def cleaned(text: Column) -> Column:
        bad = _any(F.lower(text), cfg.filter_words) | _any(text, cfg.obscene)
        if cfg.use_skip:
            bad = bad | _any(text, cfg.skip_substrings)
        out = blank(text)
        for step in (remove_emoji, remove_hashtags, remove_users, remove_urls, fix_punct, fix_paragraphs):
            out = let(out, step)
        return F.when(bad, "").otherwise(let(out, lambda o: F.when(_any(o, cfg.obscene), "").otherwise(trim_all(blank(o)))))

    return let(trim_all(F.coalesce(c, F.lit(""))), cleaned)


def normalize_messages(df: DataFrame) -> DataFrame:
    """Chat export rows to messages: blanks collapsed in the text, links with a scheme, ordered columns."""
    link = F.when(F.col("message_link").startswith("t.me"), F.concat(F.lit("https://"), "message_link")).otherwise(F.col("message_link"))
    return df.select("datetime", "channel_name", link.alias("message_link"), "views", F.trim(F.regexp_replace("news", r"(?U)\s+", " ")).alias("news"))


def process_messages(df: DataFrame, cfg: CleanConfig = CleanConfig(), since: str = "2019-02-01") -> tuple[DataFrame, DataFrame]:
    """Cleaned messages since a day (UTC), and how many rows each rule removed.

    Rows without a time, before ``since`` or with nothing left after cleaning go, in this order.
    """
    early = F.col("datetime") < F.lit(since).cast("timestamp")
    # a generated column, since a filter on a computed one would clean every text twice
    rows = df.withColumn("news", F.explode(F.array(clean_text(F.col("news"), cfg))))
    reason = F.when(F.col("datetime").isNull(), "bad_datetime").when(early, "too_early").when(F.col("news") == "", "empty")
    rows = rows.withColumn("reason", reason)
    count = lambda r: F.count(F.when(F.col("reason") == r, 1)).alias(r)
    report = rows.agg(F.count(F.lit(1)).alias("total"), count("bad_datetime"), count("too_early"), count("empty"))
    return rows.filter("reason IS NULL").drop("reason"), report


def normalize_name(c: Column) -> Column:
    """Name in Latin letters without ``- _ .`` and blanks, lower-cased after the letters are mapped."""
    for old, new in ((o, n) for o, n in LETTERS.items() if len(n) > 1):
        c = F.replace(c, F.lit(old), F.lit(new))
    single = [o for o, n in LETTERS.items() if len(n) == 1]
    none = [o for o, n in LETTERS.items() if not n]
    c = F.translate(c, "".join(single) + "".join(none) + "-_. ", "".join(LETTERS[o] for o in single))
    return F.lower(c)


def token_count(c: Column) -> Column:
    """Words and punctuation marks of a text; a stand-in wherever no vocabulary is given."""
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\w+|[^\w\s]")), F.lit(0))


def lower_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))
