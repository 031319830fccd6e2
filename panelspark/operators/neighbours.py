"""All pairs of vectors within a cosine distance, by cells around pivots.

Unit vectors at cosine distance ``r`` are ``sqrt(2 r)`` apart. Every vector lives in the cell of its
nearest pivot. Two vectors in the cells of ``p`` and ``q`` are at least as far apart as one of them is
from the plane midway between ``p`` and ``q``, and one is no nearer to the other's pivot than the
cell's radius allows, so a vector only visits cells that these bounds leave open. Nothing within the
distance is missed; how many pairs are compared depends on how the vectors lie (``comparisons``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Pivots of a window at most, and vectors for each; vectors that one task sorts.
PIVOTS, PER_PIVOT, TILE = 256, 16, 2000
#: Vectors that a task holds, and vectors that it compares with them.
HELD, GUESTS = 16_384, 131_072


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of equal values of ``names``."""
    keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
    starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        yield keys[a], batch.slice(a, b - a)


def _more(points: DataFrame) -> list[str]:
    """Columns that come along."""
    return [c for c in points.columns if c not in ("window", "id", "v")]


def cells(points: DataFrame, bound: float, scratch: Scratch) -> DataFrame:
    """``window, id, v, cell, visits`` of ``points(window, id, v)``, unit vectors of one length.

    ``visits`` are the cells, from the own one on, that may hold a vector within ``bound``. Further columns stay.
    """
    more = _more(points)
    sizes = points.groupBy(F.col("window").alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_w", F.least(F.ceil(F.col("_n") / PER_PIVOT), F.lit(PIVOTS)).cast("int").alias("_pivots"), F.ceil(F.col("_n") / TILE).cast("int").alias("_slices"))
    sizes = scratch.table(sizes, "sizes")
    first = Window.partitionBy("window").orderBy(F.xxhash64("id"), "id")
    pivots = points.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= PIVOTS).join(sizes, F.col("window") == F.col("_w")).filter("_r <= _pivots")
    pivots = pivots.select("window", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("slice"), F.lit(0).alias("kind"), "id", "v")
    dealt = points.join(sizes, F.col("window") == F.col("_w")).select("window", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), "id", "v", *more)
    reach = float(np.sqrt(2 * bound)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for (window, part, kind), some in _runs(batch, ["window", "slice", "kind"]):
                if kind == 0:
                    held = [*(held if now == (window, part) else []), _matrix(some.column("v"))]
                    now = window, part
                    continue
                p, v = np.vstack(held), _matrix(some.column("v"))
                apart = np.sqrt(np.maximum(((p[:, None, :] - p[None, :, :]) ** 2).sum(2), 0))
                far = np.maximum(2 - 2 * (v @ p.T), 0)
                home = far.argmin(1)
                plane = (far - far[np.arange(len(v)), home][:, None]) / (2 * np.maximum(apart[home], 1e-12))
                near = (plane <= reach) & (np.arange(len(p))[None, :] >= home[:, None])
                near[np.arange(len(v)), home] = True
                visits = [np.flatnonzero(x).astype(np.int32) for x in near]
                yield pa.RecordBatch.from_arrays([some.column("window"), some.column("id"), some.column("v"), pa.array(home.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(v)), home])), pa.array(visits, pa.list_(pa.int32())), pa.array([np.sqrt(far[i, x]) for i, x in enumerate(visits)], pa.list_(pa.float64())), *map(some.column, more)], ["window", "id", "v", "cell", "off", "visits", "offs", *more])

    both = dealt.unionByName(pivots, allowMissingColumns=True).repartition("window", "slice").sortWithinPartitions("window", "slice", "kind").select("window", "slice", "kind", "id", "v", *more)
    schema = f"window {points.schema['window'].dataType.simpleString()}, id long, v array<double>, cell int, off double, visits array<int>, offs array<double>"
    found = scratch.table(both.mapInArrow(run, ", ".join([schema, *(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in more)])), "cells")
    radii = found.groupBy("window", "cell").agg(F.max("off").alias("r")).groupBy(F.col("window").alias("_w")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "r"))).alias("_radii"))
    # looked up by place for every visit, where a map would be searched through
    radii = radii.withColumn("_radii", F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda c: F.element_at("_radii", c)))
    radii = scratch.table(radii, "radii")
    open_ = F.expr(f"transform(filter(arrays_zip(visits, offs), x -> x.visits = cell OR x.offs <= get(_radii, x.visits) + {reach!r}D), x -> x.visits)")
    return found.join(radii, F.col("window") == F.col("_w")).select("window", "id", "v", "cell", open_.alias("visits"), *more)


def comparisons(dealt: DataFrame) -> int:
    """How many pairs ``close_pairs`` compares."""
    homes = dealt.groupBy(F.col("window").alias("w"), F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    visits = dealt.select("window", "cell", F.explode("visits").alias("to")).groupBy("window", "to").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("cell") == F.col("to"), 1)).alias("own"))
    one = visits.join(homes, (F.col("window") == F.col("w")) & (F.col("to") == F.col("c")))
    return int(one.agg(F.sum(F.expr("(m - own) * n + n * (n - 1) / 2"))).first()[0] or 0)


def groups(points: DataFrame, bound: float, scratch: Scratch) -> DataFrame:
    """The cells of ``points`` taken together until they hold about ``HELD`` vectors, as ``cell``, with ``visits``.

    A vector travels once to each group that it visits. Further columns stay.
    """
    dealt = cells(points, bound, scratch)
    n = F.count(F.lit(1))
    sizes = points.groupBy(F.col("window").alias("_o")).agg(F.least(F.ceil(n / HELD), F.lit(PIVOTS)).alias("_groups"), F.least(F.ceil(n / PER_PIVOT), F.lit(PIVOTS)).alias("_pivots"))
    dealt = dealt.join(scratch.table(sizes, "groups"), F.col("window") == F.col("_o"))
    # groups grow with cells, so a visit still goes to the own group or a later one
    group = lambda c: F.floor(c * F.col("_groups") / F.col("_pivots")).cast("int")
    visits = F.array_distinct(F.transform("visits", group))
    return scratch.table(dealt.select("window", "id", "v", group(F.col("cell")).alias("cell"), visits.alias("visits"), *_more(points)), "dealt")


#: What a group of vectors that meet is known by; kind 0 are held, 1 guests, 2 held and compared among themselves.
_MEET = ["window", "_at", "_tile", "_share", "_kind"]


def _met(points: DataFrame, bound: float, scratch: Scratch) -> DataFrame:
    """Vectors of large windows with the groups they meet in: groups dealt into tiles, their visitors into shares."""
    more = _more(points)
    dealt = groups(points, bound, scratch)
    full = dealt.groupBy("window", "cell").agg(F.count(F.lit(1)).alias("n"))
    came = dealt.select("window", F.explode("visits").alias("cell")).groupBy("window", "cell").agg(F.count(F.lit(1)).alias("m"))
    tiles = full.join(came, ["window", "cell"]).select(F.col("window").alias("_w"), F.col("cell").alias("_c"), F.ceil(F.col("n") / HELD).cast("int").alias("_tiles"), F.ceil(F.col("m") / GUESTS).cast("int").alias("_shares"))
    tiles = scratch.table(tiles, "tiles")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = dealt.join(tiles, (F.col("window") == F.col("_w")) & (F.col("cell") == F.col("_c")))
    homes = homes.select("window", F.col("cell").alias("_at"), deal("_tiles").alias("_tile"), every("_shares").alias("_share"), F.lit(0).alias("_kind"), "cell", "id", "v", *more)
    guests = dealt.select("window", "cell", "id", "v", *more, F.explode("visits").alias("_at")).join(tiles, (F.col("window") == F.col("_w")) & (F.col("_at") == F.col("_c")))
    return homes.unionByName(guests.select("window", "_at", every("_tiles").alias("_tile"), deal("_shares").alias("_share"), F.lit(1).alias("_kind"), "cell", "id", "v", *more))


def close_pairs(points: DataFrame, bound: float, scratch: Scratch) -> DataFrame:
    """``window, a, b, raw`` with ``a < b`` of all pairs of a window whose cosine distance is under ``bound``.

    ``points(window, id, v)``: unit vectors, ids distinct within a window and not null. A further column
    ``c`` comes along as ``c_a`` and ``c_b``, so pairs need not be joined with what is known of their sides.
    A window of at most ``HELD`` vectors is sent whole and once. In larger ones a group of cells is dealt
    into tiles and its visitors into shares, and each tile meets each share in a task of its own.
    """
    more = _more(points)
    sizes = points.groupBy(F.col("window").alias("_z")).agg((F.count(F.lit(1)) > HELD).alias("_large"))
    sizes = scratch.table(sizes, "windows")
    of = lambda large: points.join(sizes.filter("_large" if large else "NOT _large"), F.col("window") == F.col("_z"), "left_semi")
    zero = F.lit(0)
    met = of(False).select("window", zero.alias("_at"), zero.alias("_tile"), zero.alias("_share"), F.lit(2).alias("_kind"), zero.alias("cell"), "id", "v", *more)
    if not sizes.filter("_large").isEmpty():
        met = met.unionByName(_met(of(True), bound, scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, vs = None, [], np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            for (window, at, tile, share, kind), some in _runs(batch, _MEET):
                own, v = some.column("id").to_numpy(), _matrix(some.column("v"))
                if kind == 1 and now != (window, at, tile, share):
                    continue
                if kind != 1:
                    if now != (window, at, tile, share):
                        now, held, ids, vs = (window, at, tile, share), [], own[:0], v[:0]
                    held.append([some.column(c) for c in more])
                    ids, vs = np.concatenate([ids, own]), np.vstack([vs, v])
                if kind == 0:
                    continue
                # rows that a pair is taken from: the held ones, and guests after them
                known, sides = (np.concatenate([ids, own]), [*held, [some.column(c) for c in more]]) if kind == 1 else (ids, held)
                columns = [pa.concat_arrays(list(parts)) for parts in zip(*sides, strict=True)]
                first = len(known) - len(own)
                cell = some.column("cell").to_numpy()
                for lo in range(0, len(v), 128):
                    upto = len(ids) if kind == 1 else first + min(lo + 128, len(v))
                    raw = 1 - v[lo : lo + 128] @ vs[:upto].T
                    mine = np.arange(first + lo, first + lo + len(raw))
                    once = (cell[lo : lo + 128] < at)[:, None] | (own[lo : lo + 128][:, None] < ids[None, :]) if kind == 1 else mine[:, None] > np.arange(upto)[None, :]
                    x, y = np.nonzero((raw < bound) & once)
                    if len(x):
                        i, j = mine[x], y
                        swap = known[i] > known[j]
                        a, b = np.where(swap, j, i), np.where(swap, i, j)
                        both = [c.take(pa.array(at_)) for c in columns for at_ in (a, b)]
                        yield pa.RecordBatch.from_arrays([pa.array([window] * len(x), some.column("window").type), pa.array(known[a]), pa.array(known[b]), pa.array(raw[x, y]), *both], ["window", "a", "b", "raw", *names])

    names = [f"{c}_{s}" for c in more for s in "ab"]
    schema = [f"window {points.schema['window'].dataType.simpleString()}, a long, b long, raw double", *(f"`{c}_{s}` {points.schema[c].dataType.simpleString()}" for c in more for s in "ab")]
    return met.repartition(*_MEET[:4]).sortWithinPartitions(*_MEET).mapInArrow(run, ", ".join(schema))
