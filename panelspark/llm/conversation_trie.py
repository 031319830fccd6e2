"""The prefix trie of conversations, with subtree totals by centroid decomposition.

Every distinct sequence of the first ``d`` turns of a conversation is a node of depth ``d``. A node is
named by its smallest conversation and its depth, which is unique, as all its members share the
sequence. Sequences are told apart by 128 bits: the exclusive or of a hash of every turn with its
place, so a running value over the turns names every prefix.

Totals over subtrees don't follow the levels of the trie, whose depth nothing bounds. The forest of
parent edges is split at centroids instead (see ``subtree_totals``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import with_blocks, with_index
from .common import Scratch

#: Turns that a conversation takes from another one at most.
BORROWED = 8
#: Nodes of a component that one task finishes at most, and nodes that a task finishes at once.
LOCAL, AT_ONCE = 4096, 100_000
#: One in so many turns: nodes that hold more of them are few enough to be broadcast.
HEAVY = 10_000
#: Conversation ids that are written into one piece.
PIECE = 4096


def prefix_steps(scratch: Scratch, turns: DataFrame, base: Column | None = None, borrowed: Column | None = None) -> DataFrame:
    """``conv, depth, x1, x2, p1, p2, bytes, depths`` for every conversation and depth from 0 on.

    ``turns(conv_id, turn, role, text)`` are ordered by turn, null first; turns of equal number in an
    order that only their contents decide. A null role or text counts as empty; rows without conv_id
    belong to no conversation and are left out. ``x`` names the prefix, ``p`` the one before it, bytes
    are those of its last text, depths is the conversation's length.

    With ``base`` and ``borrowed``, columns over ``conv_id``, a conversation begins with the first
    ``borrowed`` (up to 8) turns of conversation ``base``, all if it has fewer and none if it doesn't
    exist, and goes on with its own turns after its first ``borrowed`` ones.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = [F.xxhash64(F.lit(i), text("role"), text("text")).alias(f"h{i}") for i in (1, 2)]
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *h, F.octet_length(text("text")).cast("long").alias("bytes"))
    cut = with_blocks(rows, "conv", "turn", scratch)
    rows = rows.withColumn("_block", F.lit(0)) if cut is None else cut
    rows = scratch.table(with_index(rows, "conv", ["turn", "h1", "h2"], scratch), "turns")
    convs = rows.groupBy("conv", "_block").agg(F.first("_rows").alias("own"))
    if base is None:
        convs = convs.select("*", F.lit(0).alias("skip"), F.expr("array()").cast("array<struct<h1:bigint,h2:bigint,bytes:bigint>>").alias("head"))
    else:
        item = F.struct("_index", "h1", "h2", "bytes")
        heads = rows.filter(F.col("_index") < BORROWED).groupBy(F.col("conv").alias("from")).agg(F.array_sort(F.collect_list(item)).alias("all"))
        convs = convs.withColumn("conv_id", F.col("conv")).select("*", base.alias("base"), F.least(borrowed, F.lit(BORROWED)).cast("int").alias("skip"))
        convs = convs.join(heads, F.col("base") == F.col("from"), "left")
        convs = convs.withColumn("head", F.coalesce(F.slice("all", F.lit(1), F.col("skip")), F.expr("array()"))).select("conv", "_block", "own", "skip", F.transform("head", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["bytes"].alias("bytes"))).alias("head"))

    def marks(side: int) -> Column:
        return F.transform("head", lambda t, i: F.xxhash64(t[f"h{side}"], (i + 1).cast("long"), F.lit(side)))

    convs = convs.withColumns({"m1": marks(1), "m2": marks(2), "taken": F.size("head").cast("long")}).withColumn("depths", F.col("taken") + F.greatest(F.col("own") - F.col("skip"), F.lit(0)))
    convs = scratch.table(convs, "convs")

    def fold(marks: str, upto: Column) -> Column:
        return F.aggregate(F.slice(marks, F.lit(1), upto), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))

    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken")))
    lead = convs.filter("_block = 0").select("conv", at.alias("depth"), "m1", "m2", "head", "depths")
    lead = lead.select("conv", "depth", *[fold(f"m{s}", F.col("depth").cast("int")).alias(f"x{s}") for s in (1, 2)], *[F.when(F.col("depth") > 0, fold(f"m{s}", F.col("depth").cast("int") - 1)).alias(f"p{s}") for s in (1, 2)], F.coalesce(F.get("head", F.col("depth").cast("int") - 1)["bytes"], F.lit(0)).alias("bytes"), "depths")
    starts = convs.select("conv", "_block", "skip", "taken", "depths", *[fold(f"m{s}", F.col("taken").cast("int")).alias(f"s{s}") for s in (1, 2)])
    own = rows.join(starts, ["conv", "_block"]).filter(F.col("_index") >= F.col("skip")).withColumn("depth", F.col("taken") + F.col("_index") - F.col("skip") + 1)
    own = own.withColumns({f"e{s}": F.xxhash64(f"h{s}", F.col("depth").cast("long"), F.lit(s)) for s in (1, 2)})
    w = Window.partitionBy("conv", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({f"r{s}": F.bit_xor(f"e{s}").over(w) for s in (1, 2)})
    if not rows.filter("_block > 0").isEmpty():
        ends = own.groupBy(F.col("conv").alias("of"), F.col("_block").alias("at")).agg(*[F.bit_xor(f"e{s}").alias(f"b{s}") for s in (1, 2)])
        upto = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        ends = scratch.table(ends.select("of", F.col("at"), *[F.coalesce(F.bit_xor(f"b{s}").over(upto), F.lit(0).cast("long")).alias(f"c{s}") for s in (1, 2)]).filter("at > 0"), "carries")
        own = own.join(ends, (F.col("conv") == F.col("of")) & (F.col("_block") == F.col("at")), "left")
        own = own.withColumns({f"r{s}": F.col(f"r{s}").bitwiseXOR(F.coalesce(f"c{s}", F.lit(0).cast("long"))) for s in (1, 2)})
    own = own.withColumns({f"x{s}": F.col(f"r{s}").bitwiseXOR(F.col(f"s{s}")) for s in (1, 2)}).withColumns({f"p{s}": F.col(f"x{s}").bitwiseXOR(F.col(f"e{s}")) for s in (1, 2)})
    names = ["conv", "depth", "x1", "x2", "p1", "p2", "bytes", "depths"]
    steps = scratch.table(lead.select(names).unionByName(own.select(names)), "steps")
    scratch.drop(rows, convs)
    return steps


def _looked_up(rows: DataFrame, on: tuple[str, str], table: DataFrame, key: tuple[str, str], heavy: Column, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the row of ``table`` that ``key`` names, inner.

    Rows of ``table`` that many of ``rows`` may name, those where ``heavy`` holds, are broadcast; they
    must be few. The others share rows out evenly.
    """
    a, b = (F.col(c) for c in on)
    side = table.select(F.col(key[0]).alias("_k1"), F.col(key[1]).alias("_k2"), *[F.col(c).alias(f"_{c}") for c in columns], heavy.alias("_heavy"))
    joined = rows.join(F.broadcast(side.filter("_heavy")), (a == F.col("_k1")) & (b == F.col("_k2")), "left")
    found = joined.filter("_k1 IS NOT NULL")
    rest = joined.filter("_k1 IS NULL").select(rows.columns).join(side.filter("NOT _heavy"), (a == F.col("_k1")) & (b == F.col("_k2")))
    return found.unionByName(rest).select(*rows.columns, *[f"_{c}" for c in columns])


def split_locally(parent: np.ndarray, weight: np.ndarray, top: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of ``values`` (rows are nodes) by recursive splits at centroids.

    ``parent`` is the place of a node's parent within its component or -1, ``weight`` the weight of
    its subtree there, ``top`` the place of the component's top. All components are split at once.
    """
    n = len(parent)
    total = np.zeros_like(values)
    parent, weight, top, live = parent.copy(), weight.copy(), top.copy(), np.arange(n)
    while len(live):
        whole = weight[top[live]]
        path = live[2 * weight[live] > whole]
        order = path[np.lexsort((weight[path], top[path]))]
        centre = order[np.r_[True, top[order][1:] != top[order][:-1]]]
        of = np.full(n, -1)
        of[top[centre]] = centre
        mine = of[top[live]]
        up, cut = parent[live], np.zeros(n, bool)
        cut[centre] = True
        below = (up >= 0) & (up == mine)
        jump = np.arange(n)
        free = ~below & ~cut[live] & (up >= 0)
        jump[live[free]] = up[free]
        while True:
            further = jump[jump[live]]
            if (further == jump[live]).all():
                break
            jump[live] = further
        new = jump[live]
        child_top = np.zeros(n, bool)
        child_top[live[below]] = True
        inside = child_top[new] | (live == mine)
        sums = np.zeros_like(values)
        np.add.at(sums, mine[inside], values[live[inside]])
        total[path] += sums[of[top[path]]]
        weight[path] -= np.where(cut[path], 0, weight[of[top[path]]])
        parent[live[below]] = -1
        stay = ~cut[live]
        top[live] = new
        live = live[stay]
    return total


def subtree_totals(scratch: Scratch, forest: DataFrame, paths: DataFrame, values: list[str], local: int | None = None) -> DataFrame:
    """``conv_id, depth`` of every node and the totals of ``values`` over its subtree.

    ``forest(conv_id, depth, parent, weight, *values)``: a node's parent is ``(parent, depth - 1)``, a
    root's is null; weight is positive and adds up over the subtree. ``paths(conv, depth, conv_id,
    parent)`` names the node at every depth of every conversation that names a node, and its parent.

    A component's centroid is its deepest node that holds more than half of its weight. The nodes
    that hold so much are just those on the path from there to the top, so all of them get the total
    of what lies under the centroid, in one pass. Without the centroid, the components that remain
    weigh half at most: the subtrees of its children, whose tops are looked up in ``paths``, and the
    rest. A node is in as many components as the logarithm of the weight, whatever the depth.
    Components of at most ``local`` nodes are dealt out and finished by ``split_locally``.
    """
    local = local or LOCAL
    sums = ", ".join(f"{v} long" for v in values)
    roots = forest.filter("parent IS NULL").select(F.col("conv_id").alias("t"), F.lit(0).cast("long").alias("td"))
    if roots.limit(2).count() > 1:
        raise ValueError("the forest has one root, the empty prefix")
    live = forest.crossJoin(F.broadcast(roots)).select("conv_id", "depth", "parent", "weight", *values, "t", "td")
    live = scratch.table(live, "live")
    added, finished = [], []
    while True:
        sizes = live.groupBy("t", "td").agg(F.count(F.lit(1)).alias("nodes"), F.max("weight").alias("whole")).withColumnsRenamed({"t": "_t", "td": "_td"})
        sizes = scratch.table(sizes, "sizes")
        here = (F.col("t") == F.col("_t")) & (F.col("td") == F.col("_td"))
        big = sizes.filter(F.col("nodes") > local)
        if big.isEmpty():
            finished.append(live)
            break
        finished.append(scratch.table(live.join(big, here, "left_anti"), "small"))
        held = scratch.table(live.join(big, here).drop("_t", "_td", "nodes"), "held")
        scratch.drop(live, sizes)
        path = held.filter(2 * F.col("weight") > F.col("whole"))
        centre = path.groupBy("t", "td").agg(F.min(F.struct("weight", "conv_id", "depth")).alias("c"))
        centre = scratch.table(centre.select(F.col("t").alias("_t"), F.col("td").alias("_td"), F.col("c.weight").alias("cw"), F.col("c.conv_id").alias("cc"), F.col("c.depth").alias("cd")), "centres")
        held2 = held.join(centre, here).drop("_t", "_td")
        at = paths.select(F.col("conv").alias("_v"), F.col("depth").alias("_d"), F.col("conv_id").alias("child"), F.col("parent").alias("up"))
        moved = held2.join(at, (F.col("conv_id") == F.col("_v")) & (F.col("cd") + 1 == F.col("_d")) & (F.col("depth") > F.col("cd")), "left").drop("_v", "_d")
        is_centre = (F.col("conv_id") == F.col("cc")) & (F.col("depth") == F.col("cd"))
        under = F.coalesce(F.col("up") == F.col("cc"), F.lit(False))
        moved = scratch.table(moved.select("*", is_centre.alias("centre"), under.alias("under")), "moved")
        under_sums = moved.filter("centre OR under").groupBy("t", "td").agg(*[F.sum(v).alias(f"s_{v}") for v in values]).withColumnsRenamed({"t": "_t", "td": "_td"})
        on_path = moved.filter(2 * F.col("weight") > F.col("whole")).join(under_sums, here)
        added.append(scratch.table(on_path.select("conv_id", "depth", *[F.col(f"s_{v}").alias(v) for v in values]), "added"))
        less = F.when(2 * F.col("weight") > F.col("whole"), F.col("cw")).otherwise(0)
        top = F.when(F.col("under"), F.col("child")).otherwise(F.col("t")), F.when(F.col("under"), F.col("cd") + 1).otherwise(F.col("td"))
        live = scratch.table(moved.filter("NOT centre").select("conv_id", "depth", "parent", (F.col("weight") - less).alias("weight"), *values, top[0].alias("t"), top[1].alias("td")), "live")
        scratch.drop(held, centre, moved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: np.ndarray) -> pa.RecordBatch:
            key = {}
            for i, (c, d) in enumerate(zip(part["conv_id"].tolist(), part["depth"].tolist(), strict=True)):
                key[c, d] = i
            top = np.fromiter((key[x] for x in zip(part["t"].tolist(), part["td"].tolist(), strict=True)), np.int64, len(part))
            up = np.fromiter((key[p, d - 1] if (c, d) != (t, td) else -1 for c, d, p, t, td in zip(*(part[x].tolist() for x in ("conv_id", "depth", "parent", "t", "td")), strict=True)), np.int64, len(part))
            got = split_locally(up, part["weight"].copy(), top, np.column_stack([part[v] for v in values]))
            return pa.RecordBatch.from_arrays([pa.array(part["conv_id"]), pa.array(part["depth"]), *(pa.array(np.ascontiguousarray(got[:, i])) for i in range(len(values)))], ["conv_id", "depth", *values])

        kind = np.dtype([(c, np.int64) for c in columns])
        held, n = [], 0
        for batch in batches:
            part = np.empty(len(batch), kind)
            for c in columns:
                part[c] = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
            held.append(part)
            n += len(part)
            if n >= AT_ONCE:
                every = np.concatenate(held)
                last = (every["t"] == every["t"][-1]) & (every["td"] == every["td"][-1])
                if not last.all():
                    yield done(every[~last])
                held, n = [every[last]], int(last.sum())
        if n:
            yield done(np.concatenate(held))

    columns = ["conv_id", "depth", "parent", "weight", "t", "td", *values]
    rest = finished[0].select(columns)
    for other in finished[1:]:
        rest = rest.unionByName(other.select(columns))
    rest = rest.repartition(F.xxhash64("t", "td")).sortWithinPartitions("t", "td").mapInArrow(run, f"conv_id long, depth long, {sums}")
    for other in added:
        rest = rest.unionByName(other)
    return rest.groupBy("conv_id", "depth").agg(*[F.sum(v).alias(v) for v in values])


def _id_hashes(ends: DataFrame) -> DataFrame:
    """``x1, x2, ends_sha256`` of ``ends(x1, x2, conv)``: the hash of ascending ids, comma-joined.

    Tasks over ranges of ids write pieces of text; the pieces of a prefix then pass through one
    running hash in order, so neither step holds them all.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for batch in batches:
            out = []
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ids and ((a, b) != now or len(ids) >= PIECE):
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = a, b
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["x1", "x2", "first", "piece"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, ids[0], ",".join(map(str, ids)))], ["x1", "x2", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "piece")), strict=True):
                if (a, b) != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["x1", "x2", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, digest.hexdigest())], ["x1", "x2", "ends_sha256"])

    parts = ends.repartitionByRange(F.col("conv")).sortWithinPartitions("x1", "x2", "conv").select("x1", "x2", "conv").mapInArrow(pieces, "x1 long, x2 long, first long, piece string")
    return parts.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first").mapInArrow(hashed, "x1 long, x2 long, ends_sha256 string")


def prefix_trie(spark: SparkSession, turns: DataFrame, base: Column | None = None, borrowed: Column | None = None, local: int | None = None) -> DataFrame:
    """One row for every distinct prefix of the conversations of ``turns(conv_id, turn, role, text)``.

    ``conv_id`` (its smallest member) and ``depth`` name it; ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of its subtree), ``saved_tokens`` (over
    the subtree, bytes of the last text of all members but one) and ``ends_sha256`` (of the ids of
    members that end there) follow. See ``prefix_steps`` for order, nulls, ties and borrowed turns. A
    conversation without turns is a member of the root. No conversation gives no row; other columns
    are ignored.
    """
    scratch = Scratch(spark, "trie")
    steps = prefix_steps(scratch, turns, base, borrowed)
    nodes = steps.groupBy("x1", "x2").agg(F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("depths") - F.col("depth") + 1).alias("weight"))
    nodes = scratch.table(nodes, "nodes")
    heavy = F.col("n_convs") * HEAVY > F.lit(steps.count())
    top = nodes.filter("p1 IS NULL").select("*", F.lit(None).cast("long").alias("parent"))
    nodes2 = top.unionByName(_looked_up(nodes.filter("p1 IS NOT NULL"), ("p1", "p2"), nodes, ("x1", "x2"), heavy, ["conv_id"]).withColumnRenamed("_conv_id", "parent"))
    children = nodes.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes2.join(children, (F.col("x1") == F.col("c1")) & (F.col("x2") == F.col("c2")), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).drop("c1", "c2", "p1", "p2")
    full = scratch.table(full, "linked")
    scratch.drop(nodes)
    forest = full.select("conv_id", "depth", "parent", "weight", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    paths = scratch.table(_looked_up(steps.select("conv", "depth", "x1", "x2"), ("x1", "x2"), full, ("x1", "x2"), heavy, ["conv_id", "parent"]).select("conv", "depth", F.col("_conv_id").alias("conv_id"), F.col("_parent").alias("parent")), "paths")
    totals = scratch.table(subtree_totals(scratch, forest, paths, ["n_leaves", "saved_tokens"], local), "totals").withColumnsRenamed({"conv_id": "_c", "depth": "_d"})
    ends = scratch.table(_id_hashes(steps.filter("depth = depths").select("x1", "x2", "conv")), "ends").withColumnsRenamed({"x1": "e1", "x2": "e2"})
    out = full.join(totals, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d"))).join(ends, (F.col("x1") == F.col("e1")) & (F.col("x2") == F.col("e2")), "left")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
