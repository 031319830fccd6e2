"""Quality rules: simple limits, then robust multivariate outliers by language and source.

Word and line statistics come from built-in functions. Their transformed vectors are compared with
regularised minimum-covariance-determinant estimates of each language and source. Concentration
steps keep the share ``KEEP`` of documents nearest to the centre and recompute mean and covariance
until no determinant falls any more; of several starts the one with the smallest determinant
counts. An estimate of ``n`` documents is drawn towards that of its language, and this one towards
that of all documents, with the weight of ``SHRINK`` further documents, whatever ``n`` is. The
starts are the coordinatewise median with absolute deviations, the same centre in units of the
floors, and plain moments. What a statistic of one text may vary by chance, from the text's own
length, widens the variance it is judged by. Squared Mahalanobis distances beyond ``CUT`` reject a document. All documents take
part; a group only ever meets as partial sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import WS, Scratch, looked_up

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Limits of the simple rules: words at least, and percent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED, RUN = 10, 20, 5
#: Bins per doubling of the distance, by which the nearest are told; fall of the log determinant that counts.
BINS, LEAST_GAIN = 32, 1e-3
#: Share of the nearest documents, concentration steps at most, and documents that the wider group counts for.
KEEP, STEPS, SHRINK = 0.75, 15, 50
#: Transformed statistics, and the spread below which their differences mean nothing.
FEATURES = {"x_word": 0.03, "x_symbol": 0.05, "x_line": 0.1, "x_repeat": 0.15}
#: Squared distance that normal data exceed once in a thousand documents (four degrees of freedom).
CUT = 18.47


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def repeated_words(words: Column, run: int = RUN) -> Column:
    """Words inside runs of ``run`` words that occur twice or more, first occurrences included.

    Runs are compared by 64-bit hashes. Only texts with a repeated run are sorted.
    """

    def covered(runs: Column) -> Column:
        order = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(ps: Column) -> Column:
            same = lambda p, j: (F.get(ps, j)["h"] == p["h"])
            hit = F.transform(ps, lambda p, j: F.when(F.coalesce(same(p, j - 1), F.lit(False)) | F.coalesce(same(p, j + 1), F.lit(False)), p["i"]))
            return F.array_sort(F.filter(hit, lambda i: i.isNotNull()))

        def union(at: Column) -> Column:
            widths = F.transform(at, lambda s, j: F.least(F.lit(run), F.coalesce(F.get(at, j + 1) - s, F.lit(run))))
            return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

        return let(let(order, starts), union)

    def of(hashes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - run), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(run)]))
        return let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), 0).otherwise(covered(r)))

    return F.when(F.size(words) < run, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def text_statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Word and line statistics of every row of ``docs(doc_id, text, lang, source)``; null text has none.

    ``carry`` adds the whole row as the struct ``row``.
    """
    carried = [F.struct("*").alias("row")] if carry else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), *carried)

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    n = F.length("text")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    rows = rows.select(
        "doc_id", "lang", "source", *(["row"] if carry else []), let(words_of(F.col("text")), of_words).alias("w"), let(lines, of_lines).alias("l"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"), (n - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return rows.select("doc_id", "lang", "source", *(["row"] if carry else []), "w.*", "l.*", "word_chars", "n_symbols")


def _vectors(stats: DataFrame) -> DataFrame:
    """Transformed statistics ``x_*`` and the variances ``v_*`` that chance gives them in one text.

    Symbols, repeated lines and repeats count as rare events of a text; one repeat is a run, or a
    whole line where lines are longer.
    """
    words, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "n_lines"))
    event = F.greatest(F.lit(2.0 * RUN), 2 * words / lines)
    rare = lambda scale, of, count, unit: F.pow(scale / (of + scale * F.col(count)), 2) * unit * F.greatest(unit, F.col(count).cast("double"))
    return stats.withColumns({
        "x_word": F.log(1 + F.col("word_chars") / words),
        "x_symbol": F.log1p(10 * F.col("n_symbols") / words),
        "x_line": F.log1p(4 * F.col("n_dup_lines") / lines),
        "x_repeat": F.log1p(10 * F.col("n_repeat_words") / words),
        "v_word": 0.25 / words,
        "v_symbol": rare(10, words, "n_symbols", F.lit(1.0)),
        "v_line": rare(4, lines, "n_dup_lines", F.lit(1.0)),
        "v_repeat": rare(10, words, "n_repeat_words", event),
    })


def consistency(keep: float) -> float:
    """Factor that makes the covariance of the nearest ``keep`` of 4-variate normal data consistent."""
    lo, hi = 0.0, 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < keep else (lo, mid)
    return keep / (1 - math.exp(-lo / 2) * (1 + lo / 2 + lo * lo / 8))


def _at(i: int, j: int) -> int:
    """Place of row ``i``, column ``j`` in a lower triangle that is stored row by row."""
    return i * (i + 1) // 2 + j


def _triangle(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _array(*values: Column) -> Column:
    return F.array(*values) if values else F.array().cast("array<double>")


def _built(d: int, value) -> Column:
    """A lower triangle whose entries follow from those before them: ``value(so_far, i, j)``."""
    at = lambda i, j: F.floor(i * (i + 1) / 2).cast("int") + j
    step = lambda acc, p: F.concat(acc, F.array(value(lambda i, j: F.get(acc, at(i, j)), p["i"], p["j"])))
    return F.aggregate(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _triangle(d)]), _array(), step)


def _inverse_factor(c: Column, floors: list[float]) -> Column:
    """Inverse of the Cholesky factor of the covariance ``c`` with the squared floors on its diagonal."""
    d = len(floors)
    added = F.array(*[F.lit(f * f) for f in floors])
    place = lambda i, j: F.floor(i * (i + 1) / 2).cast("int") + j
    # Sums run over all columns; entries that aren't there yet are null and count nothing.
    dot = lambda one, two: F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.lit(0.0), lambda s, k: s + F.coalesce(one(k) * two(k), F.lit(0.0)))
    within = lambda k, end, x: F.when(k < end, x)

    def lower(so_far, i, j):
        rest = F.get(c, place(i, j)) - dot(lambda k: within(k, j, so_far(i, k)), lambda k: within(k, j, so_far(j, k)))
        return F.when(i == j, F.sqrt(F.greatest(rest + F.get(added, i), F.lit(1e-12)))).otherwise(rest / so_far(j, j))

    def inverse(factor: Column) -> Column:
        def entry(so_far, i, j):
            own = F.get(factor, place(i, i))
            return F.when(i == j, 1 / own).otherwise(-dot(lambda k: within(k, i, F.get(factor, place(i, k))), lambda k: F.when(k >= j, so_far(k, j))) / own)

        return _built(d, entry)

    return let(_built(d, lower), inverse)


def _distance(rows: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """``rows`` (with mean ``m``, covariance ``c`` and inverse factor ``w`` of their group) plus the distance ``d2``.

    Variances that chance gives a text widen its statistics' own variances; correlations stay.
    """
    keep, d = rows.columns, len(names)
    wide = [1 + F.col(x.replace("x_", "v_", 1)) / (F.get("c", F.lit(_at(i, i))) + floors[i] ** 2) for i, x in enumerate(names)]
    out = rows.withColumns({f"t_{i}": (F.col(x) - F.get("m", F.lit(i))) / F.sqrt(wide[i]) for i, x in enumerate(names)})
    ys = [sum((F.get("w", F.lit(_at(i, k))) * F.col(f"t_{k}") for k in range(1, i + 1)), F.get("w", F.lit(_at(i, 0))) * F.col("t_0")) for i in range(d)]
    out = out.withColumns({f"y_{i}": y for i, y in enumerate(ys)})
    return out.select(*keep, sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, d)), F.col("y_0") * F.col("y_0")).alias("d2"))


def _shrunk(raw: DataFrame, floors: list[float]) -> DataFrame:
    """Estimates drawn towards those of the wider group, widest first, with inverse factor and log determinant."""
    ids, values = ["g", "up", "level", "start", "n"], ["m", "c"]

    def drawn(rows: DataFrame, wider: DataFrame) -> DataFrame:
        above = wider.select(F.col("g").alias("of"), F.col("start").alias("same"), *[F.col(x).alias(f"wide_{x}") for x in values])
        both = rows.join(above, (F.col("up") == F.col("of")) & (F.col("start") == F.col("same")), "left")
        mean = lambda x, y: (F.col("n") * x + SHRINK * y) / (F.col("n") + SHRINK)
        return both.select(*ids, *[F.when(F.col("of").isNull(), F.col(x)).otherwise(F.zip_with(x, f"wide_{x}", mean)).alias(x) for x in values])

    upper = drawn(raw.filter("level < 2"), raw.filter("level = 0"))
    done = drawn(raw, upper).withColumn("w", _inverse_factor(F.col("c"), floors))
    return done.withColumn("det", sum((-2 * F.log(F.get("w", F.lit(_at(i, i)))) for i in range(len(floors))), F.lit(0.0)))


def robust_estimates(members: DataFrame, features: dict[str, float], scratch: Scratch, keep: float = KEEP, steps: int = STEPS) -> DataFrame:
    """Mean ``m``, covariance ``c`` and inverse factor ``w`` of every group ``g`` of ``members(g, up, level, x_*, v_*)``.

    Level 0 is the group of all, ``up`` the next wider group. A group without members has no row.
    """
    names, floors = list(features), list(features.values())
    d, factor = len(names), consistency(keep)
    ids = ["g", "up", "level"]
    means = _array(*[F.avg(x) for x in names]).alias("mean")
    covs = _array(*[F.covar_pop(names[i], names[j]) for i, j in _triangle(d)]).alias("cov")
    middle = members.groupBy(*ids).agg(_array(*[F.percentile_approx(x, 0.5, 4000) for x in names]).alias("mid"), means, covs, F.count("*").alias("n"))
    middle = scratch.table(middle, "medians")
    count = middle.count()
    off = looked_up(members.select("g", *names), middle.select("g", "mid"), count)
    mads = off.groupBy(F.col("g").alias("of")).agg(_array(*[F.percentile_approx(F.abs(F.col(x) - F.get("mid", F.lit(i))), 0.5, 4000) for i, x in enumerate(names)]).alias("mad"))
    zero = F.lit(0.0)
    first = F.array(
        F.struct(F.lit(0).alias("start"), F.col("mid").alias("m"), _array(*[F.pow(1.4826 * F.get("mad", F.lit(i)), 2) if i == j else zero for i, j in _triangle(d)]).alias("c")),
        F.struct(F.lit(1).alias("start"), F.col("mid").alias("m"), _array(*[zero for _ in _triangle(d)]).alias("c")),
        F.struct(F.lit(2).alias("start"), F.col("mean").alias("m"), F.col("cov").alias("c")),
    )
    raw = middle.join(mads, F.col("g") == F.col("of")).select(*ids, "n", F.explode(first).alias("s")).select(*ids, "n", "s.*")
    groups = scratch.table(_shrunk(raw, floors), "estimates")
    for step in range(steps):
        near = _distance(looked_up(members, groups.select("g", "start", "m", "c", "w"), 3 * count), names, floors)
        near = near.select(F.struct("g", "start").alias("g"), *[(F.col(x) - F.get("m", F.lit(i))).alias(x) for i, x in enumerate(names)], F.floor(F.log2(F.greatest("d2", F.lit(1e-9))) * BINS).cast("int").alias("bin"))
        bins = near.groupBy("g", "bin").count().withColumn("up_to", F.sum("count").over(Window.partitionBy("g").orderBy("bin")))
        cut = bins.groupBy("g").agg(F.sum("count").alias("all"), F.collect_list(F.struct("bin", "up_to")).alias("bins"))
        cut = cut.select("g", F.array_min(F.transform(F.filter("bins", lambda b: b["up_to"] >= keep * F.col("all")), lambda b: b["bin"])).alias("cut"))
        core = looked_up(near, cut, 3 * count).filter("bin <= cut")
        sums = core.groupBy(F.col("g").alias("of")).agg(F.count("*").alias("k"), *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i, j in _triangle(d)])
        raw = groups.select(*ids, "start", "n", "m").join(sums, (F.col("g") == F.col("of.g")) & (F.col("start") == F.col("of.start")))
        mean = _array(*[F.get("m", F.lit(i)) + F.col(f"s_{i}") / F.col("k") for i in range(d)])
        cov = _array(*[factor * (F.col(f"s_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("k")) / F.col("k") for i, j in _triangle(d)])
        raw, values = scratch.table(raw.select(*ids, "start", "n", mean.alias("m"), cov.alias("c")), "moments"), ["m", "c", "w", "det"]
        old = groups.select(F.col("g").alias("of"), F.col("start").alias("same"), F.struct(*values).alias("old"))
        both = _shrunk(raw, floors).join(old, (F.col("g") == F.col("of")) & (F.col("start") == F.col("same")))
        better = F.lit(step == 0) | (F.col("det") < F.col("old.det") - LEAST_GAIN)
        new = both.select(*ids, "start", "n", *[F.when(better, F.col(x)).otherwise(F.col(f"old.{x}")).alias(x) for x in values], better.alias("moved"))
        new = scratch.table(new, "estimates")
        scratch.drop(groups, raw)
        groups = new
        if groups.filter("moved").isEmpty():
            break
    best = groups.groupBy("g").agg(F.min_by(F.struct("m", "c", "w"), F.struct("det", "start")).alias("x"))
    return scratch.table(best.select("g", "x.*"), "best")


def quality_verdicts(spark: SparkSession, docs: DataFrame, cut: float = CUT, carry: bool = False) -> DataFrame:
    """Base statistics, ``base_failed``, ``d2`` and ``kept`` for every row of ``docs(doc_id, text, lang, source)``.

    Null text counts as empty and fails; null languages and sources are groups of their own. Only
    documents that pass the simple rules shape estimates; where none of a language and source
    does, ``d2`` is null, and all of them fail anyway. Repeated rows repeat in the result; extra
    columns are ignored. ``carry`` returns each whole row, text and extra columns too, as the
    struct ``row``, so that a verdict never has to be joined back to its text.
    """
    scratch = Scratch(spark, "quality")
    stats = _vectors(text_statistics(docs, carry))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = scratch.table(stats.withColumns({"base_failed": failed, "g": F.to_json(F.struct("lang", "source"))}), "statistics")
    vectors = [*FEATURES, *(x.replace("x_", "v_", 1) for x in FEATURES)]
    language = F.to_json(F.struct("lang"))
    wider = F.array(F.struct(F.lit("").alias("g"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("level")), F.struct(language.alias("g"), F.lit("").alias("up"), F.lit(1).alias("level")), F.struct(F.concat(F.lit("own "), "g").alias("g"), language.alias("up"), F.lit(2).alias("level")))
    members = rows.filter("not base_failed").select(F.explode(wider).alias("of"), *vectors).select("of.*", *vectors)
    best = robust_estimates(members, FEATURES, scratch)
    own = best.filter(F.col("g").startswith("own ")).withColumn("g", F.substring("g", 5, 1 << 30))
    judged = _distance(looked_up(rows, own, best.count()), list(FEATURES), list(FEATURES.values()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cut)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2", *vectors, "lang", "source", *(["row"] if carry else []))
