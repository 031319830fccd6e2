"""Personal data by weak supervision, with built-in functions only.

Base patterns find spans that always stay. Looser patterns propose further candidates: a card
number inside a longer chain of digits, a phone number that a chain has swallowed or without a
country, a spelled-out address, an address of the new internet protocol, an access token, a bank
account, a social security number. Labelers (check digits and shape, gazetteers, words before the
span, its surroundings, its layout, other candidates in the text) vote on all of them. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is. Its
posteriors, as soft labels of all candidates, train a logistic classifier over features of the span
and its neighbourhood, which decides on every candidate beyond the base ones. Vote and feature
patterns are few by construction; only their counts, over all texts, reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import Scratch

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
#: Kinds with base patterns, which come first.
BASE_KINDS = KINDS[:4]

_LOCAL, _DIGIT = r"[A-Za-z0-9._%+-]", r"[0-9]"


def _from_start(chars: str, rest: str) -> str:
    """A match that begins with a run of ``chars`` begins at its start or where the last match ended."""
    return rf"(?:\G|(?<!{chars})){rest}"


#: Base patterns, written so that no long run is scanned twice; they match what the plain ones match.
BASE = {
    "email": _from_start(_LOCAL, rf"{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": _from_start(_DIGIT, r"[0-9]++(?:\.[0-9]++){3}"),
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates by kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{0,63}+(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+)+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])|(?<![0-9+(.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Gazetteers: endings of mail domains, countries of bank accounts, beginnings and lengths of well-known tokens.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "nl", "ch", "at", "be", "pl", "uk", "us", "ca", "ru", "eu")
COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
TOKENS = r"^(?:AKIA|ASIA|gh[pousr]_|sk-|pk_|xox|eyJ|AIza)"
#: Words before a span that speak for or against a kind.
CONTEXT = {
    "email": (r"(?i)\b(?:e-?mail|mail|contact|write|correo|adresse)\b", r"(?i)\b(?:was|were|is|are|meet|look)\x20*$"),
    "ip": (r"(?i)\b(?:ip|host|server|address|ping)\b", r"(?i)\b(?:version|section|chapter|release)\b"),
    "card": (r"(?i)\b(?:card|visa|mastercard|payment|pay|tarjeta|karte|carte)\b", r"(?i)\b(?:isbn|order|serial|invoice|sha|hash|id)\b"),
    "phone": (r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|teléfono|tél)\b", r"(?i)\b(?:isbn|order|serial|invoice|page|id)\b"),
    "secret": (r"(?i)(?:token|secret|passw|passwd|api[_-]?key|access|auth|bearer|credential)", r"(?i)\b(?:sha-?[0-9]*|hash|commit|md5|checksum|digest|file|isbn|doi)\b"),
    "iban": (r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b", r"(?i)\b(?:serial|order|part|model)\b"),
    "ssn": (r"(?i)\b(?:ssn|social|security)\b", r"(?i)\b(?:part|order|serial|model|isbn|page)\b"),
}
#: Characters that a span of a kind has, from and to.
LENGTHS = {"email": (6, 60), "ip": (7, 39), "card": (14, 23), "phone": (10, 20), "secret": (20, 80), "iban": (15, 42), "ssn": (11, 11)}
LABELERS = ("shape", "gazetteer", "context", "surroundings", "layout", "company")
FEATURES = ("shape", "gazetteer", "context", "surroundings", "layout", "company", "size", "digits", "varied", "opened", "closed")
#: Characters of context before a span.
NEAR = 40


def running_sum(lengths: Column, depth: int = 3, width: int = 64) -> Column:
    """Sums of all elements before each element, in time proportional to the length."""

    def direct(a: Column) -> Column:
        return F.transform(a, lambda x, i: F.aggregate(F.slice(a, 1, i), F.lit(0), lambda s, y: s + y))

    def blocked(a: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda b: F.aggregate(F.slice(a, b * width + 1, width), F.lit(0), lambda s, y: s + y))
        inside = lambda i: F.aggregate(F.slice(a, F.floor(i / width).cast("int") * width + 1, i % width), F.lit(0), lambda s, y: s + y)
        return let(running_sum(sums, depth - 1, width), lambda before: F.transform(a, lambda x, i: F.get(before, F.floor(i / width).cast("int")) + inside(i)))

    return let(lengths, lambda a: F.when(F.size(a) <= width, direct(a)).otherwise(blocked(a) if depth else direct(a)))


def _matches(text: Column, pattern: str) -> Column:
    """``start, end, span`` (code points) of the matches, from the lengths of what lies between them."""

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        sizes = F.transform(found, lambda m: F.length(m))
        before = let(gaps, lambda g: F.transform(sizes, lambda n, i: F.get(g, i) + n))
        starts = let(gaps, lambda g: let(running_sum(before), lambda b: F.transform(found, lambda m, i: F.get(b, i) + F.get(g, i))))
        return let(starts, lambda s: F.transform(found, lambda m, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(m)).alias("end"), m.alias("span"))))

    empty = F.array().cast("array<struct<start:int,end:int,span:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(place(found)))


def luhn(span: Column) -> Column:
    digits = F.reverse(F.regexp_replace(span, "[^0-9]", ""))

    def check(d: Column) -> Column:
        one = lambda i: F.substr(d, i, F.lit(1)).cast("int")
        twice = lambda i: F.when(i % 2 == 0, F.when(one(i) > 4, 2 * one(i) - 9).otherwise(2 * one(i))).otherwise(one(i))
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + twice(i)) % 10 == 0

    return let(digits, check)


def _account(span: Column) -> Column:
    """Whether a bank account number passes its check modulo 97; letters count from 10."""
    plain = F.regexp_replace(span, "\\x20", "")
    moved = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    step = lambda r, c: F.when(F.ascii(c) < 65, r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _n_digits(span: Column) -> Column:
    return F.length(F.regexp_replace(span, "[^0-9]", ""))


def _byte_parts(span: Column) -> Column:
    short = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    return F.forall(F.split(span, r"\."), lambda p: short(p) & (F.expr("int(0)") + F.when(short(p), F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int")).otherwise(999) <= 255))


def _valid(kind: str, span: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _byte_parts(span)
    if kind == "card":
        return F.when(_n_digits(span).between(14, 19), luhn(span)).otherwise(False)
    return _n_digits(span).between(10, 15)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test without which no base match is possible."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][0-9\x20-]{12}"), "phone": text.contains("+")}[kind]


def _may_hold_loose(kind: str, text: Column) -> Column:
    """A cheap test without which no looser match is possible."""
    return {"email": text.rlike(r"(?:[\[(]\x20?at\x20?[\])]|\x20at\x20)"), "ip": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": text.rlike(r"[0-9][0-9\x20-]{12}"), "phone": text.contains("+") | text.rlike(r"[0-9]{3}[.-][0-9]{4}"), "secret": text.rlike(r"[A-Za-z0-9_-]{20}"), "iban": text.rlike(r"[A-Z]{2}[0-9]{2}"), "ssn": text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")}[kind]


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(_matches(text, BASE[kind]), lambda s: _valid(kind, s["span"]))
    return F.when(_may_hold(kind, text), found).otherwise(F.array().cast("array<struct<start:int,end:int,span:string>>"))


def _candidates(text: Column, bases: dict[str, Column]) -> Column:
    """All spans with kind, whether they are base, and the text before and after them."""
    parts = []
    for k, kind in enumerate(KINDS):
        shown = lambda s, k=k, base=True: F.struct(F.lit(k).alias("kind"), F.lit(base).alias("base"), s["start"].alias("start"), s["end"].alias("end"), s["span"].alias("span"), F.substring(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR))).alias("left"), F.substring(text, s["end"] + 1, F.lit(2)).alias("right"))
        if kind in bases:
            parts.append(F.transform(bases[kind], _one_arg(shown, True)))
        clear = lambda s: ~F.exists(F.concat(*[bases[x] for x in BASE_KINDS]), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        loose = F.filter(_matches(text, LOOSE[kind]), clear)
        loose = F.transform(loose, _one_arg(shown, False))
        parts.append(F.when(_may_hold_loose(kind, text), loose).otherwise(F.array_repeat(F.lit(None), 0).cast("array<struct<kind:int,base:boolean,start:int,end:int,span:string,left:string,right:string>>")))
    return F.concat(*parts)


def _one_arg(f, base: bool):
    return lambda s: f(s, base=base)


def _votes(rows: DataFrame) -> DataFrame:
    """Votes 1, -1 or 0 of every labeler on every candidate, and the features of the classifier."""
    by = lambda options: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in enumerate(options)])
    span, digits, size = F.col("span"), _n_digits(F.col("span")), F.length("span")
    vote = lambda yes, no=None: F.when(yes, 1).otherwise(F.when(no, -1).otherwise(0) if no is not None else -1)
    letters = F.length(F.regexp_replace(span, "[^A-Za-z]", ""))
    turns = F.regexp_count(span, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"))
    shape = by([
        vote(span.contains("@") | span.rlike(r"(?i)[\[(]\x20?(?:at|dot)|\x20dot\x20[A-Za-z0-9-]*[A-Za-z]{2}$")), vote(_byte_parts(span) | span.contains(":")), vote(luhn(span) & digits.between(14, 19)), vote(digits.between(10, 15)),
        vote((turns >= 4) & (4 * digits >= size) & (8 * letters >= size)), vote(_account(span)), vote(~span.rlike(r"^(?:000|666|9..)|-00-|-0000$")),
    ])
    gazetteer = by([
        vote(F.lower(F.regexp_extract(span, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS)),
        vote(~span.rlike(r"^(?:0|127|255)\."), span.rlike(r"^0")),
        vote(span.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), span.rlike(r"^[0189]")),
        vote(span.rlike(r"^\+[1-9]|^\(?[2-9]"), span.rlike(r"^\(?[01]")),
        vote(span.rlike(TOKENS) | (span.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & size.isin(32, 40, 64)), size < 24),
        vote(F.substring(span, 1, 2).isin(*COUNTRIES)),
        F.lit(0),
    ])
    context = by([vote(F.col("left").rlike(CONTEXT[k][0]), F.col("left").rlike(CONTEXT[k][1])) for k in KINDS])
    glued = F.col("left").rlike(r"[\p{L}\p{N}_./-]$") | F.col("right").rlike(r"^[\p{L}\p{N}_/=]")
    layout = by([
        vote(span.rlike(r"^[a-z0-9._%+-]+@|\x20?[\[(]"), span.rlike(r"[A-Z].*[a-z].*[A-Z]")), vote(~span.rlike(r"(?:^|[.])0[0-9]")), vote(span.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[\x20-][0-9]{4}){3})$")),
        vote(span.rlike(r"[\x20().-]"), span.rlike("^[0-9]+$")), vote(span.rlike("^(?:[a-z0-9_-]+|[A-Z0-9_-]+)$")), vote(~span.rlike("[a-z]")), F.lit(1),
    ])
    low, high = by([F.lit(LENGTHS[k][0]) for k in KINDS]), by([F.lit(LENGTHS[k][1]) for k in KINDS])
    distinct = F.size(F.array_distinct(F.split(F.substring(span, 1, 64), "")))
    return rows.withColumns({
        "shape": shape, "gazetteer": gazetteer, "context": context, "surroundings": F.when(glued, -1).otherwise(1), "layout": layout,
        "company": F.when(F.col("others") > 0, 1).otherwise(0),
        "size": F.when(size < low, -1).when(size > high, 1).otherwise(0),
        "digits": F.when(10 * digits >= 8 * size, 1).when(10 * digits >= 2 * size, 0).otherwise(-1),
        "varied": F.when(distinct >= 5, 1).otherwise(-1),
        "opened": F.when(F.col("left").rlike(r"[\"'(<\[:=]\x20?$"), 1).when(F.col("left").rlike(r"(?:^|\s)$"), 0).otherwise(-1),
        "closed": F.when(F.col("right").rlike(r"^[\"')>\],;.!?]"), 1).when(F.col("right").rlike(r"^(?:$|\s)"), 0).otherwise(-1),
    })


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """Dawid-Skene by expectation maximisation: prior, per labeler P(vote | true / false), posteriors.

    It starts from the majority vote; every count begins with a few made-up candidates on which a
    labeler is right more often than not, so that little or unanimous data stay sensible.
    """
    post = [min(max(0.5 + 0.45 * sum(v) / max(1, len(v)), 0.05), 0.95) for v, _ in patterns]
    total = sum(n for _, n in patterns)
    prior, rates = 0.5, []
    for _ in range(rounds):
        yes = sum(n * p for (_, n), p in zip(patterns, post))
        prior = (yes + 1) / (total + 2)
        rates = []
        for i in range(len(LABELERS)):
            t, f = {1: 3.0, 0: 1.5, -1: 1.0}, {1: 1.0, 0: 1.5, -1: 3.0}
            for (v, n), p in zip(patterns, post):
                t[v[i]] += n * p
                f[v[i]] += n * (1 - p)
            rates.append({x: (t[x] / sum(t.values()), f[x] / sum(f.values())) for x in t})
        new = []
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(r[x][0] / r[x][1]) for r, x in zip(rates, v))
            new.append(1 / (1 + math.exp(-max(min(odds, 40), -40))))
        done = max((abs(a - b) for a, b in zip(new, post)), default=0) < 1e-6
        post = new
        if done:
            break
    return prior, rates, post


#: Weights that the classifier starts from and is held to where little speaks against them.
START = np.array([0.0, 1.5, 0.5, 0.5, 0.5, 0.25, 0.0, 0.0, 0.0, 0.25, 0.0, 0.0])


def fit_classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 60, hold: float = 2.0) -> list[float]:
    """Logistic weights (bias first) of feature patterns ``(features, count, summed posterior)`` by Newton steps."""
    x = np.array([(1, *v) for v, _, _ in rows], float).reshape(-1, len(FEATURES) + 1)
    n, yes = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    w = START.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (yes - n * p) - hold * (w - START)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def find_personal_data(spark: SparkSession, docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Counts, digest of the base spans and all spans for every row of ``docs(doc_id, text)``.

    Null texts are empty; without spans the digest is that of the empty string. Rows that repeat
    doc_id and text repeat their results. Extra columns are ignored. Spans beyond the base ones
    need a probability of ``threshold`` from the classifier and go if a longer one holds them;
    ``n_spans`` counts all spans.
    """
    scratch = Scratch(spark, "pii")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = rows.select("doc_id", "text", *[base_spans(F.col("text"), k).alias(k) for k in BASE_KINDS])
    found = found.select("doc_id", *BASE_KINDS, let(F.array(*[F.col(k) for k in BASE_KINDS]), lambda b: _candidates(F.col("text"), {k: F.get(b, i) for i, k in enumerate(BASE_KINDS)})).alias("all"))
    found = scratch.table(found.select("doc_id", F.monotonically_increasing_id().alias("row"), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS], "all"), "candidates")
    votes = _votes(found.filter(F.size("all") > 0).select("row", (F.size("all") - 1).alias("others"), F.explode("all").alias("c")).select("row", "others", "c.*"))
    votes = scratch.table(votes.drop("left", "right", "span", "others"), "votes")
    counts = votes.groupBy("kind", *LABELERS).count().collect()
    known = []
    for k in range(len(KINDS)):
        patterns = [(tuple(r[x] for x in LABELERS), float(r["count"])) for r in counts if r["kind"] == k]
        known += [(k, *v, p) for (v, _), p in zip(patterns, estimate(patterns)[2])]
    schema = ", ".join(f"{c} int" for c in ("kind", *LABELERS)) + ", posterior double"
    soft = votes.join(F.broadcast(spark.createDataFrame(known, schema)), ["kind", *LABELERS])
    seen = soft.groupBy("kind", *FEATURES).agg(F.count("*").alias("n"), F.sum("posterior").alias("yes")).collect()
    chance = F.lit(None).cast("double")
    for k in range(len(KINDS)):
        w = fit_classifier(sorted((tuple(r[x] for x in FEATURES), float(r["n"]), r["yes"]) for r in seen if r["kind"] == k))
        z = sum((F.lit(a) * F.col(x) for a, x in zip(w[1:], FEATURES)), F.lit(w[0]))
        chance = F.when(F.col("kind") == k, 1 / (1 + F.exp(-z))).otherwise(chance)
    kept = votes.filter(F.col("base") | (chance >= threshold))
    one = F.struct("start", "kind", "end", "base")
    kept = kept.groupBy("row").agg(F.array_sort(F.collect_set(one)).alias("kept"))
    inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    kept = kept.withColumn("kept", let(F.col("kept"), lambda a: F.filter(a, lambda s: s["base"] | ~F.exists(a, lambda o: inside(s, o)))))
    full = found.select("doc_id", "row", *[f"n_{k}" for k in BASE_KINDS]).join(kept, "row", "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda a: F.coalesce(F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
    return full.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(shown(F.filter("kept", lambda s: s["base"])), 256).alias("base_sha256"), shown(F.col("kept")).alias("spans"), F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_spans"))
