"""Exponentially weighted means as an associative scan of affine maps, on two levels.

A value ``x`` that follows ``k`` rows after the one before it maps the mean ``y`` to
``(d ** k * y + alpha * x) / (d ** k + alpha)``, with ``d = 1 - alpha``; a null keeps the mean. Such maps
compose to ``A * y + B``, so short runs of rows are scanned on their own, the runs of a block and the
blocks of a key pass their results on, and every row finishes with what came in. A key of any length
is spread over tasks, and nothing leaves the JVM.

Within a run, ``A`` is a running product and ``B / A`` a running sum, both plain windows. A run has so
few rows that the product can't get under ``exp(-RANGE)``. Where every key is one run, that is all;
where every key is one block, its few runs meet in a window, so all means are one pass over the rows; where keys have several
blocks, the rows are written once, as both the runs and the means are read from them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .blocks import LAID, block_rows, in_block, lay_out, most_rows

#: Natural logarithm of the range of the running product, and rows of a run at most.
RANGE, MOST_ROWS = 600.0, 4096


def alpha_of(span: float) -> float:
    return 2.0 / (span + 1.0)


def _step(d: float, alpha: float, y: Column, k: Column, x: Column) -> Column:
    """The mean after ``x``, ``k`` rows after ``y``; ``x`` itself without a ``y``."""
    old = F.pow(F.lit(d), k.cast("double"))
    return F.when(y.isNull(), x).otherwise((old * y + alpha * x) / (old + alpha))


class _Spec:
    """One mean: the column it follows and its number, by which its helper columns are named."""

    def __init__(self, i: int, of: int, alpha: float):
        self.i, self.of, self.alpha, self.d = i, of, alpha, 1.0 - alpha
        self.plain = self.d < math.exp(-RANGE)

    def after(self, run: Column, y: Column, at: Column) -> Column:
        """The mean at the end of ``run``, into which ``y`` of row ``at`` came."""
        first = _step(self.d, self.alpha, y, run[f"if{self.of}"] - at, run[f"xf{self.of}"])
        return F.when(run[f"xf{self.of}"].isNull(), y).otherwise(run[f"A{self.i}"] * first + run[f"B{self.i}"])

    def joined(self, a: Column, b: Column) -> Column:
        """The runs ``a`` and ``b`` as one, both structs of this spec alone."""
        old = F.pow(F.lit(self.d), (b["if"] - a["il"]).cast("double"))
        pass_on = F.lit(0.0) if self.plain else b["A"] * old / (old + self.alpha)
        both = F.struct(a["if"].alias("if"), a["xf"].alias("xf"), b["il"].alias("il"), (pass_on * a["A"]).alias("A"), (b["A"] * (old * a["B"] + self.alpha * b["xf"]) / (old + self.alpha) + b["B"]).alias("B"))
        return F.when(b["xf"].isNull(), a).when(a["xf"].isNull(), b).otherwise(both)

    def alone(self, run: Column) -> Column:
        return F.struct(run[f"if{self.of}"].alias("if"), run[f"xf{self.of}"].alias("xf"), run[f"il{self.of}"].alias("il"), run[f"A{self.i}"].alias("A"), run[f"B{self.i}"].alias("B"))


_STATE = "struct<y:double,at:bigint>"


def _follow(spec: _Spec, state: Column, run: Column) -> Column:
    """The mean after ``run`` and the row of its last value."""
    return F.struct(spec.after(run, state["y"], state["at"]).alias("y"), F.coalesce(run[f"il{spec.of}"], state["at"]).alias("at")).cast(_STATE)


def _start(y: Column | None, at: Column | None) -> Column:
    return F.struct((F.lit(None) if y is None else y).alias("y"), (F.lit(None) if at is None else at).alias("at")).cast(_STATE)


def _outgoing(runs: Column, spec: _Spec) -> Column:
    """What goes out of ``runs`` in order."""
    return F.aggregate(runs, _start(None, None), lambda state, run: _follow(spec, state, run))


def _incoming(runs: Column, spec: _Spec, y: Column | None = None, at: Column | None = None) -> Column:
    """For each of ``runs`` in order, what comes in."""
    kind = f"struct<s:{_STATE},out:array<{_STATE}>>"
    start = F.struct(_start(y, at).alias("s"), F.array().cast(f"array<{_STATE}>").alias("out")).cast(kind)
    step = lambda acc, run: F.struct(_follow(spec, acc["s"], run).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")).cast(kind)
    return F.aggregate(runs, start, step)["out"]


def _whole(spec: _Spec) -> Column:
    """All runs of a block as one."""
    return F.aggregate(F.slice("_runs", F.lit(2), F.size("_runs")), spec.alone(F.get("_runs", F.lit(0))), lambda x, y: spec.joined(x, spec.alone(y)))


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], key: str = "secid", order: str = "date") -> DataFrame:
    """Add column ``out`` for each ``out: (column, alpha)``; ``alpha`` 1 copies the column forward.

    Rows of a key are taken in ``order``; leading nulls give null, NaN counts as null. A null key is a
    key of its own; an empty table stays empty. Rows that are laid out already stay so.
    """
    given = "_block" in df.columns
    laid = df if given else lay_out(df, key, order)
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    each = [_Spec(i, columns.index(c), a) for i, (c, a) in enumerate(specs.values())]
    rows = min([MOST_ROWS, *(int(RANGE / -math.log(s.d)) for s in each if not s.plain and s.d < 1)])
    size = block_rows(laid)
    start = F.col("_index") if size is None else F.col("_index") - F.col("_block") * size
    alone = size is None and most_rows(laid) <= rows
    out = laid if alone else laid.withColumn("_run", F.floor(start / rows).cast("int"))
    w = in_block() if alone else Window.partitionBy("_key", "_block", "_run").orderBy("_index")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_x{j}": F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for j, c in enumerate(columns)})
    out = out.withColumns({f"_o{j}": F.when(F.col(f"_x{j}").isNotNull(), F.col("_index")) for j in range(len(columns))})
    wide = {} if alone else {"_last": F.lead("_index").over(w).isNull()}
    for j in range(len(columns)):
        wide |= {f"_p{j}": F.last(f"_o{j}", True).over(before), f"_xf{j}": F.first(f"_x{j}", True).over(upto)}
        wide |= {} if alone else {f"_if{j}": F.first(f"_o{j}", True).over(upto), f"_il{j}": F.last(f"_o{j}", True).over(upto)}
        if any(s.plain and s.of == j for s in each):
            wide[f"_xl{j}"] = F.last(f"_x{j}", True).over(upto)
    out = out.withColumns(wide)
    sums = [s for s in each if not s.plain]
    # most values follow the one before them, for which nothing has to be computed
    gap = {j: F.col(f"_o{j}") - F.col(f"_p{j}") for j in range(len(columns))}
    old = {s.i: F.when(gap[s.of] == 1, F.lit(s.d)).otherwise(F.pow(F.lit(s.d), gap[s.of].cast("double"))) for s in sums}
    shrink = {s.i: F.when(gap[s.of] == 1, F.lit(math.log(s.d / (s.d + s.alpha)) if s.d > 0 else None)).otherwise(F.log(old[s.i] / (old[s.i] + s.alpha))) for s in sums}
    out = out.withColumns({f"_l{s.i}": F.sum(F.coalesce(shrink[s.i], F.lit(0.0))).over(upto) for s in sums})
    out = out.withColumns({f"_s{s.i}": F.sum(F.coalesce(F.col(f"_x{s.of}") * s.alpha / (old[s.i] + s.alpha) * F.exp(-F.col(f"_l{s.i}")), F.lit(0.0))).over(upto) for s in sums})
    a = {s.i: F.lit(0.0) if s.plain else F.exp(f"_l{s.i}") for s in each}
    b = {s.i: F.col(f"_xl{s.of}") if s.plain else a[s.i] * F.col(f"_s{s.i}") for s in each}
    if alone:
        value = {s.i: b[s.i] if s.plain else F.when(F.col(f"_xf{s.of}").isNotNull(), a[s.i] * F.col(f"_xf{s.of}") + b[s.i]) for s in each}
        out = out.select(*laid.columns, *[value[s.i].alias(o) for o, s in zip(specs, each, strict=True)])
        return out if given else out.drop(*LAID)
    run = F.struct("_run", *[F.col(f"_{n}{j}").alias(f"{n}{j}") for j in range(len(columns)) for n in ("if", "xf", "il")], *[a[s.i].alias(f"A{s.i}") for s in each], *[b[s.i].alias(f"B{s.i}") for s in each])
    if size is None:
        whole = Window.partitionBy("_key", "_block")
        out = out.withColumn("_runs", F.array_sort(F.collect_list(F.when(F.col("_last"), run)).over(whole)))
        seen = F.slice("_runs", F.lit(1), F.col("_run"))
        out = out.withColumns({f"_c{s.i}": F.when(F.col("_run") > 0, _outgoing(seen, s)) for s in each})
    else:
        scratch = Scratch(df.sparkSession, "scan")
        out = scratch.table(out, "rows")
        runs = out.filter("_last").groupBy(F.col("_key").alias("_of"), F.col("_block").alias("_at")).agg(F.array_sort(F.collect_list(run)).alias("_runs"))
        runs = scratch.table(runs, "runs")
        maps = [_whole(s) for s in each]
        blocks = runs.select("_of", F.struct("_at", *[m[n].alias(f"{n}{s.i}") for s, m in zip(each, maps, strict=True) for n in ("if", "xf", "il", "A", "B")]).alias("m"))
        blocks = blocks.groupBy("_of").agg(F.array_sort(F.collect_list("m")).alias("_runs"))
        own = [_Spec(s.i, s.i, s.alpha) for s in each]
        came = blocks.select("_of", F.transform("_runs", lambda r: r["_at"]).alias("_ats"), *[_incoming(F.col("_runs"), s).alias(f"c{s.i}") for s in own])
        came = came.select("_of", F.explode(F.arrays_zip("_ats", *[f"c{s.i}" for s in each])).alias("z")).select(F.col("_of").alias("_k"), F.col("z._ats").alias("_b"), *[F.col(f"z.c{s.i}").alias(f"_c{s.i}") for s in each])
        runs = runs.join(came, (F.col("_of") == F.col("_k")) & (F.col("_at") == F.col("_b")))
        carried = [_incoming(F.col("_runs"), s, F.col(f"_c{s.i}")["y"], F.col(f"_c{s.i}")["at"]).alias(f"_c{s.i}") for s in each]
        out = out.join(runs.select("_of", "_at", *carried), (F.col("_key") == F.col("_of")) & (F.col("_block") == F.col("_at")))
        out = out.withColumns({f"_c{s.i}": F.get(f"_c{s.i}", F.col("_run")) for s in each})

    def mean(s: _Spec) -> Column:
        came = F.col(f"_c{s.i}")
        first = _step(s.d, s.alpha, came["y"], F.col(f"_if{s.of}") - came["at"], F.col(f"_xf{s.of}"))
        return F.when(F.col(f"_xf{s.of}").isNull(), came["y"]).otherwise(b[s.i] if s.plain else a[s.i] * first + b[s.i])

    out = out.select(*laid.columns, *[mean(s).alias(o) for o, s in zip(specs, each, strict=True)])
    return out if given else out.drop(*LAID)
