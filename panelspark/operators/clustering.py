"""Time-windowed near-duplicate clustering of embedded messages by average linkage.

A merge at average distance below the threshold needs a pair below it, so every cluster lies within
a connected component of the graph of such pairs, and clustering component by component is exact.
Pairs, components and clusters go by one distance, with all penalties of ``ClusterConfig``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..scratch import Scratch
from .components import connected_components
from .neighbours import close_pairs


#: Messages of a window that one task compares with as many others.
TILE = 2000
#: A bound that every cosine distance stays under.
ANY = 2.1


@dataclass(frozen=True)
class ClusterConfig:
    """Distance threshold and penalties; windows of fewer than ``min_docs`` messages give no clusters."""

    threshold: float = 0.10
    same_channel: float = 5.0
    time_modifier: float = 4.0
    shift_hours: float = 8.0
    min_docs: int = 5
    window_days: int = 1
    step_days: int = 1
    exempt_topics: tuple[str, ...] = ()
    image_bonus: float = 0.0
    channel_skips_time: bool = False


def windows_from(first: Column, at: Column, size_days: int, step_days: int, last: Column | None = None) -> Column:
    """Starts (days) of the windows that hold ``at``, counted from midnight of ``first``.

    A window begins every ``step_days``. With ``last``, the latest time of all, the first window that
    reaches beyond it takes what is left, and none begins after that one.
    """
    day = 86_400_000_000
    since = lambda t: F.unix_micros(t) - F.unix_micros(first.cast("timestamp"))
    low = F.greatest(F.lit(0), F.floor((since(at) - size_days * day) / (step_days * day)) + 1)
    high = F.floor(since(at) / (step_days * day))
    if last is not None:
        high = F.least(high, F.greatest(F.lit(0), F.floor((since(last) - size_days * day) / (step_days * day)) + 1))
    numbers = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.date_add(first, k * step_days))


def assign_windows(df: DataFrame, size_days: int = 1, step_days: int = 1, since: str | None = None, col: str = "datetime", from_first: bool = False) -> DataFrame:
    """Add ``window`` (its first day): one row for each window that holds the message, on UTC midnights.

    Windows are those of the calendar, or with ``from_first`` begin at midnight of the first message
    and end with one that takes what is left (see ``windows_from``).
    """
    if since is not None:
        df = df.filter(F.col(col) >= F.lit(since).cast("timestamp"))
    if from_first:
        ends = df.agg(F.to_date(F.min(col)).alias("_first"), F.max(col).alias("_last"))
        out = df.crossJoin(F.broadcast(ends)).withColumn("window", F.explode(windows_from(F.col("_first"), F.col(col), size_days, step_days, F.col("_last"))))
        return out.drop("_first", "_last")
    return df.withColumn("window", F.to_date(F.window(col, f"{size_days} days", f"{step_days} days")["start"]))


def unit(c: Column) -> Column:
    """Vector of length one; null for a zero vector."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.when(n > 0, F.transform(c, lambda x: x.cast("double") / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; null without any."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["t"])
    zero = F.transform(F.get(kept, 0), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def _penalised(cfg: ClusterConfig) -> Column:
    same = F.col("channel_a") == F.col("channel_b")
    d = F.least(F.lit(1.0), F.col("raw") * F.when(same, cfg.same_channel).otherwise(1.0))
    if cfg.image_bonus:
        images = [F.coalesce(f"images_{s}", F.lit(0)) for s in "ab"]
        bonus = (F.least(*images) >= 1) & (F.greatest(*images) <= 2) & (F.col("group_a") == F.col("group_b"))
        d = F.when(bonus & ~(same if cfg.channel_skips_time else F.lit(False)), F.greatest(F.lit(0.0), d * (1 - cfg.image_bonus))).otherwise(d)
    if cfg.time_modifier > 1:
        hours = F.abs(F.unix_micros("at_a") - F.unix_micros("at_b")) / F.lit(3.6e9) - cfg.shift_hours
        late = F.least(F.lit(1.0), d * (1 + (cfg.time_modifier - 1) / (1 + F.exp(-hours))))
        spared = F.lit(False)
        if cfg.channel_skips_time:
            spared = spared | same
        if cfg.exempt_topics:
            spared = spared | (F.col("topic_a").isin(*cfg.exempt_topics) & F.col("topic_b").isin(*cfg.exempt_topics))
        d = F.when(spared, d).otherwise(late)
    return d


def _bound(cfg: ClusterConfig, below: float) -> float:
    """The cosine distance that a pair of penalised distance under ``below`` stays under.

    Distances are cut at 1 before the image bonus, so where the bonus takes 1 under ``below`` no cosine
    distance is too large.
    """
    if cfg.image_bonus >= 1 or cfg.same_channel <= 0 or max(below, below / (1 - cfg.image_bonus)) > 1:
        return np.inf
    return below / ((1 - cfg.image_bonus) * min(1.0, cfg.same_channel)) * (1 + 1e-12)


_META = {"datetime": "at", "channel_name": "channel", "topic": "topic", "n_images": "images", "image_group": "group"}


def _meta(df: DataFrame, s: str) -> list[Column]:
    return [F.col(c).alias(f"{n}_{s}") for c, n in _META.items() if c in df.columns]


def _known(df: DataFrame) -> list[Column]:
    """What penalties need of a message, named as ``close_pairs`` passes it on."""
    return [F.col(c).alias(n) for c, n in _META.items() if c in df.columns]


def _points(df: DataFrame, window: Column, *more: Column) -> DataFrame:
    """Points of ``close_pairs`` of the rows that have a vector, with what penalties need and ``more``."""
    zero = F.when(F.forall("embedding", lambda x: x == 0), F.transform("embedding", lambda x: F.lit(0.0)))
    rows = df.select(window.alias("window"), "id", F.coalesce(unit(F.col("embedding")), zero).alias("v"), *_known(df), *more)
    return rows.filter("v IS NOT NULL")


def pair_distances(df: DataFrame, cfg: ClusterConfig = ClusterConfig(), below: float | None = None) -> DataFrame:
    """``window, a, b, distance`` of pairs of ``df(window, id, datetime, channel_name, embedding)``.

    Only pairs with distance under ``below`` where given: candidates then come from a metric index,
    which misses none (see ``neighbours``), since penalties never shrink a distance by more than a
    known factor. A zero vector is at cosine distance 1 from all others. Without ``below`` the result
    is all pairs of a window; it is dealt into tiles of about ``TILE`` messages, and every two tiles
    meet in a task of their own. Exempt topics need the column ``topic``, the image bonus
    ``n_images, image_group``.
    """
    if below is not None:
        pairs = close_pairs(_points(df, F.col("window")), min(_bound(cfg, below), ANY), Scratch(df.sparkSession, "pairs"))
        return pairs.withColumn("distance", _penalised(cfg)).filter(F.col("distance") < below).select("window", "a", "b", "distance")
    tiles = df.groupBy(F.col("window").alias("_of")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("_tiles"))
    df = df.join(tiles, F.col("window") == F.col("_of")).withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int"))
    side = lambda s: df.select(F.col("window"), F.col("id").alias(s), unit(F.col("embedding")).alias(f"v_{s}"), *_meta(df, s), "_tile", "_tiles")
    left = side("a").select("*", F.col("_tile").alias("_u"), F.explode(F.sequence(F.col("_tile"), F.col("_tiles") - 1)).alias("_v")).drop("_tile", "_tiles")
    right = side("b").select("*", F.col("_tile").alias("_v"), F.explode(F.sequence(F.lit(0), F.col("_tile"))).alias("_u")).drop("_tile", "_tiles")
    pairs = left.join(right, ["window", "_u", "_v"]).filter("_u < _v or a < b").withColumn("raw", 1 - dot(F.col("v_a"), F.col("v_b")))
    pairs = pairs.withColumn("distance", _penalised(cfg)).select("window", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    return pairs if below is None else pairs.filter(F.col("distance") < below)


def pair_distances_over_all(df: DataFrame, cfg: ClusterConfig = ClusterConfig(), below: float = 0.9, hours: int = 12) -> DataFrame:
    """``window, a, b, distance`` of all pairs of ``df`` with distance under ``below``, across windows too.

    ``df`` is that of ``pair_distances`` without ``window``; ids are distinct. ``window`` is the day of the
    earlier message. The time penalty grows with the time between two messages, so pairs of one block of
    ``hours`` or of neighbouring ones are looked for by themselves, and what is further apart has to be
    nearer by the penalty that it has at least. All vectors meet for that, in groups of bounded size.
    """
    scratch = Scratch(df.sparkSession, "pairs")
    block = F.floor(F.unix_micros("datetime") / F.lit(hours * 3.6e9)).cast("long")
    df = scratch.table(df.withColumn("_block", block).filter("_block IS NOT NULL"), "messages")
    # a window holds a block and the next one; a pair counts in that of its earlier block
    near = close_pairs(_points(df.withColumn("_from", F.explode(F.array(F.col("_block") - 1, "_block"))), F.col("_from"), F.col("_block").alias("block")), min(_bound(cfg, below), ANY), scratch)
    near = near.filter(F.least("block_a", "block_b") == F.col("window"))
    penalised = cfg.time_modifier > 1 and not cfg.channel_skips_time and not cfg.exempt_topics and below <= 1
    least = 1 + (cfg.time_modifier - 1) / (1 + np.exp(cfg.shift_hours - hours)) if penalised else 1.0
    far = close_pairs(_points(df, F.lit(0).cast("long"), F.col("_block").alias("block")), min(_bound(cfg, below / least), ANY), scratch)
    far = far.filter(F.abs(F.col("block_a") - F.col("block_b")) > 1)
    pairs = near.unionByName(far).withColumn("distance", _penalised(cfg)).filter(F.col("distance") < below)
    return pairs.select(F.to_date(F.least("at_a", "at_b")).alias("window"), "a", "b", "distance")


def _mean_distance(cfg: ClusterConfig, va: np.ndarray, vb: np.ndarray, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[float, float]:
    """Mean and least penalised distance of the pairs between two sets of weighted messages.

    ``va`` and ``vb`` are the vectors of the messages; the columns of ``_META`` and ``n`` are in the
    dictionaries.
    """
    total, least = 0.0, np.inf
    for lo in range(0, len(va), 256):
        x = {c: y[lo : lo + 256, None] for c, y in a.items()}
        d = 1 - va[lo : lo + 256] @ vb.T
        same = x["channel_name"] == b["channel_name"][None, :]
        d = np.minimum(1.0, d * np.where(same, cfg.same_channel, 1.0))
        if cfg.image_bonus:
            few, many = np.minimum(x["n_images"], b["n_images"][None, :]), np.maximum(x["n_images"], b["n_images"][None, :])
            bonus = (few >= 1) & (many <= 2) & (x["image_group"] == b["image_group"][None, :])
            d = np.where(bonus & ~(same & cfg.channel_skips_time), np.maximum(0.0, d * (1 - cfg.image_bonus)), d)
        if cfg.time_modifier > 1:
            hours = np.abs(x["datetime"] - b["datetime"][None, :]) / 3.6e9 - cfg.shift_hours
            late = np.minimum(1.0, d * (1 + (cfg.time_modifier - 1) / (1 + np.exp(-hours))))
            spared = (same & cfg.channel_skips_time) | (x["topic"] & b["topic"][None, :])
            d = np.where(spared, d, late)
        least = min(least, float(d.min()))
        total += float((d * x["n"] * b["n"][None, :]).sum())
    return total / (a["n"].sum() * b["n"].sum()), least


def link_points(vectors: np.ndarray, messages: dict[str, np.ndarray], bound: float, cfg: ClusterConfig) -> np.ndarray:
    """Labels of points when the clusters of least mean distance merge while it is under the threshold.

    ``messages["point"]`` says which of ``vectors`` a message has. Only distances between clusters
    with a pair of messages under the threshold are kept, as others can't merge; what a merged
    cluster still needs is computed then. No table of all pairs exists.
    """
    order = np.argsort(messages["point"], kind="stable")
    messages = {c: x[order] for c, x in messages.items()}
    v = vectors[messages["point"]]
    starts = np.searchsorted(messages["point"], np.arange(len(vectors) + 1))
    members = {i: [np.arange(starts[i], starts[i + 1])] for i in range(len(vectors))}
    weight = {i: messages["n"][starts[i] : starts[i + 1]].sum() for i in members}

    def measured(a: int, b: int) -> tuple[float, float]:
        x, y = np.concatenate(members[a]), np.concatenate(members[b])
        return _mean_distance(cfg, v[x], v[y], {c: m[x] for c, m in messages.items()}, {c: m[y] for c, m in messages.items()})

    near: dict[int, dict[int, float]] = {i: {} for i in members}
    heap: list[tuple[float, int, int]] = []

    def note(a: int, b: int, d: float) -> None:
        near[a][b] = near[b][a] = d
        if d < cfg.threshold:
            heapq.heappush(heap, (d, min(a, b), max(a, b)))

    for lo in range(0, len(vectors), 256):
        for x, y in np.argwhere(1 - vectors[lo : lo + 256] @ vectors.T < bound):
            if lo + x < y:
                mean, least = measured(int(lo + x), int(y))
                if least < cfg.threshold:
                    note(int(lo + x), int(y), mean)
    label = np.arange(len(vectors))
    points = {i: [i] for i in members}
    fresh = len(vectors)
    while heap:
        _, a, b = heapq.heappop(heap)
        if a not in near or b not in near:
            continue
        others = (near[a].keys() | near[b].keys()) - {a, b}
        means = {c: (weight[a] * (near[a][c] if c in near[a] else measured(a, c)[0]) + weight[b] * (near[b][c] if c in near[b] else measured(b, c)[0])) / (weight[a] + weight[b]) for c in others}
        for old in (a, b):
            for c in near.pop(old):
                if c in near:
                    near[c].pop(old, None)
        near[fresh] = {}
        members[fresh], points[fresh], weight[fresh] = members.pop(a) + members.pop(b), points.pop(a) + points.pop(b), weight.pop(a) + weight.pop(b)
        for c, d in means.items():
            note(fresh, c, d)
        fresh += 1
    for some in points.values():
        label[some] = min(some)
    return label


def cluster_windows(spark: SparkSession, df: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """``window, id, cluster`` for messages of windows with enough of them; cluster is its smallest id.

    ``df(window, id, datetime, channel_name, embedding)``, with ``topic`` for exempt topics and
    ``n_images, image_group`` for the image bonus: ids are distinct within a window and rows without a
    vector are left out. Messages without a close partner are clusters of their own.

    Messages of equal vectors are at distance 0 under all penalties, so they are one weighted point.
    Points without another one in reach need no task; the points of a component are linked in one,
    with the messages of a point counted by time and channel.
    """
    if cfg.threshold <= 0:
        raise ValueError("the threshold has to be positive")
    scratch = Scratch(spark, "clusters")
    given = [c for c in _META if c in df.columns]
    rows = df.select("window", "id", *given, unit(F.col("embedding")).alias("v")).filter("v IS NOT NULL")
    full = rows.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= cfg.min_docs).select("window")
    full = scratch.table(full, "full")
    rows = rows.join(full, "window", "left_semi").withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    rows = scratch.table(rows, "rows")
    points = rows.groupBy("window", "h", "g", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(n) for c, n in _META.items() if c in given])
    points = scratch.table(points, "points")
    # vectors are known by 128 bits; the point of a single message is itself
    copied = points.filter("n > 1").select("window", "h", "g", F.col("id").alias("first"))
    of = rows.drop("v").join(copied, ["window", "h", "g"], "left").select("window", "id", *given, F.coalesce("first", "id").alias("point"))
    of = scratch.table(of, "messages")
    bound = min(_bound(cfg, cfg.threshold), ANY)
    close = close_pairs(points.drop("h", "g"), bound, scratch)
    node = lambda c: F.concat_ws("/", F.col("window").cast("string"), F.lpad(F.col(c).cast("string"), 20, "0"))
    tied = close.filter((F.col("n_a") > 1) | (F.col("n_b") > 1) | (_penalised(cfg) < cfg.threshold))
    roots = connected_components(scratch.table(tied.select(node("a").alias("a"), node("b").alias("b")), "tied"), scratch)
    held = points.join(roots, node("id") == F.col("node")).select("root", F.col("window").alias("w"), F.col("id").alias("p"), "v")
    counted = of.groupBy("window", "point", *given).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    counted = counted.join(held.drop("v"), (F.col("window") == F.col("w")) & (F.col("point") == F.col("p"))).drop("w", "p")
    first = held.select("root", F.col("w").alias("window"), F.col("p").alias("point"), "v", F.lit(0).cast("long").alias("n"))
    parts = counted.withColumn("v", F.lit(None).cast("array<double>")).select("root", "window", "point", "v", "n", *given)
    parts = parts.unionByName(first, allowMissingColumns=True)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = pdf[pdf["n"] == 0].sort_values("point")
        ids, rest = heads["point"].to_numpy(), pdf[pdf["n"] > 0]
        codes = lambda c: pd.factorize(rest[c], use_na_sentinel=True)[0] if c in rest else np.full(len(rest), -1)
        apart = lambda x: np.where(x < 0, -1 - np.arange(len(x)), x)
        m = {"point": np.searchsorted(ids, rest["point"].to_numpy()), "n": rest["n"].to_numpy(float), "channel_name": codes("channel_name"), "image_group": codes("image_group")}
        m["datetime"] = rest["datetime"].to_numpy("datetime64[us]").astype("int64").astype(float)
        m["n_images"] = rest["n_images"].fillna(0).to_numpy() if "n_images" in rest else np.zeros(len(rest))
        m["topic"] = rest["topic"].isin(cfg.exempt_topics).to_numpy() if "topic" in rest else np.zeros(len(rest), bool)
        for c in ("channel_name", "image_group"):
            m[c] = apart(m[c])
        label = link_points(np.array(heads["v"].tolist(), float), m, bound, cfg)
        return pd.DataFrame({"window": heads["window"], "point": ids, "cluster": ids[label]})

    window = df.schema["window"].dataType.simpleString()
    linked = parts.groupBy("root").applyInPandas(link, f"window {window}, point long, cluster long")
    linked = scratch.table(linked, "linked")
    return of.join(linked, ["window", "point"], "left").select("window", "id", F.coalesce("cluster", "point").alias("cluster"))


def cluster_records(members: DataFrame) -> DataFrame:
    """``cluster_id, cluster_date, members`` of ``members(window, cluster, id, datetime, ...)``.

    The id joins the first time and a label that ranks the window's clusters by time and smallest id.
    """
    item = F.struct("datetime", "id", "channel_name", "message_link", "news")
    by = members.groupBy("window", "cluster").agg(F.min("datetime").alias("first"), F.array_sort(F.collect_list(item)).alias("members"))
    label = F.dense_rank().over(Window.partitionBy("window").orderBy("first", "cluster")) - 1
    return by.select(F.concat_ws("_", F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss"), label.cast("string")).alias("cluster_id"), F.to_date("first").alias("cluster_date"), "members")


def representatives(members: DataFrame, by: list[str] = ("window", "cluster"), earliest: bool = False) -> DataFrame:
    """One message per cluster: the longest text (the earliest of equals), or the earliest."""
    order = [F.asc("datetime"), F.asc("id")] if earliest else [F.desc(F.length(F.coalesce("news", F.lit("")))), F.asc("datetime"), F.asc("id")]
    return members.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def image_groups(spark: SparkSession, images: DataFrame, threshold: float = 0.02) -> DataFrame:
    """``id, image_group`` of documents by ``images(id, position, embedding)``; a document's last image decides."""
    scratch = Scratch(spark, "images")
    day = F.lit("1970-01-01")
    rows = scratch.table(images.select(F.col("id").alias("doc"), "position", F.xxhash64("id", "position").alias("id"), "embedding"), "images")
    one = rows.select(day.cast("date").alias("window"), "id", day.cast("timestamp").alias("datetime"), F.col("id").cast("string").alias("channel_name"), "embedding")
    found = cluster_windows(spark, one, ClusterConfig(threshold=threshold, same_channel=1.0, time_modifier=1.0, min_docs=2))
    found = found.join(rows.select("id", "doc", "position"), "id")
    return found.groupBy(F.col("doc").alias("id")).agg(F.max_by("cluster", "position").alias("image_group"))


def _counted(dims: int):
    """Unit vectors of signed counts by bucket; null for a null text and for a zero vector."""

    @F.pandas_udf("array<float>")
    def run(codes: pd.Series) -> pd.Series:
        out = []
        for c in codes:
            n = None if c is None else np.bincount(np.asarray(c, np.int64), minlength=2 * dims).astype(float)
            v = None if n is None else n[0::2] - n[1::2]
            norm = 0.0 if v is None else np.sqrt(v @ v)
            out.append((v / norm).astype("float32") if norm > 0 else None)
        return pd.Series(out, dtype=object)

    return run


def embed(df: DataFrame, text: str = "news", prefix: str = "query: ", dims: int = 64, encoder=None) -> DataFrame:
    """Add ``embedding``: unit vectors from ``encoder(list of texts) -> 2-d array``, 64 texts at a time.

    Without an encoder, words are hashed into ``dims`` signed buckets with built-in functions and
    counted by bucket, each word once.
    """
    if encoder is None:
        words = F.filter(F.split(F.lower(F.col(text)), r"(?U)\W+"), lambda w: w != "")
        # a word is its bucket, doubled, plus one for a negative sign
        code = lambda w: (F.pmod(F.xxhash64(w), F.lit(dims)) * 2 + (F.xxhash64(w) < 0).cast("int")).cast("int")
        return df.withColumn("embedding", _counted(dims)(F.transform(words, code)))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [encoder([prefix + (t or "") for t in texts[i : i + 64]]) for i in range(0, len(texts), 64)]
            v = np.vstack(out).astype(float)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list((v / np.where(norm > 0, norm, 1)).astype("float32")))

    return df.withColumn("embedding", run(F.col(text)))
