"""Exact quantiles that never hold a whole group in one task.

Selection by rounds of counting. The first round counts the rows of each key in cells of a fixed logarithmic scale and
finds the cell a position falls into; each further round cuts that cell into equal steps between its smallest and largest
value and counts again. Cells are summed up before they are shuffled and there is a bounded number of them per key, so a key
with all rows is a few thousand numbers. Rounds end when the cell holds few rows or a single value; then its values are put
in order. Cells cover all values, so a position is always found; one outside its group raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import store

OCTAVE = 16  # cells for each doubling of the value
STEPS = 1 << 16  # steps a cell is cut into, and rows that are put in order
ROUNDS = 8  # a cell of the scale holds under 2^49 different doubles, which four rounds part


def _scale(value: Column) -> Column:
    """Number of the cell on the logarithmic scale; grows with the value."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(2000.0)) * OCTAVE).cast("long") + F.lit(2000 * OCTAVE)
    return F.when(F.isnan(value), 10000 * OCTAVE).when(value > 0, size).when(value < 0, -size).otherwise(0).cast("long")


def _bracket(cells: DataFrame, by: list[str], order: str, keep: list[str]) -> DataFrame:
    """The cell of each group that holds position ``_at``; ``_before`` rows lie below it."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return placed.filter((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_c"))).select(*keep)


def _select(rows: DataFrame, keys: list[str], value: str, targets: dict[str, Column], steps: int) -> DataFrame:
    """Keys, ``_n`` and a column for each target."""
    names = list(targets)
    clean = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).dropna(subset=keys)
    number = F.col("_v").cast("double")
    clean = clean.withColumn("_cell", _scale(number))
    summed = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    cells = clean.groupBy(*keys, "_cell").agg(*summed).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    wanted = F.array(*[F.struct(F.lit(i).alias("_i"), targets[n].cast("long").alias("_at")) for i, n in enumerate(names)])
    outside = F.raise_error(F.concat(F.lit("position outside the group: "), F.col("_at").cast("string")))
    at = F.when((F.col("_at") >= 0) & (F.col("_at") < F.col("_n")), F.col("_at")).otherwise(outside.cast("long"))
    spread = cells.select("*", F.inline(wanted)).withColumn("_at", at).withColumn("_base", F.lit(0).cast("long"))
    keep = [*keys, "_cell", "_n", "_i", "_at", "_c", "_lo", "_hi", "_before"]
    found = store(_bracket(spread, [*keys, "_i"], "_cell", keep), "brackets")
    open_ = (F.col("_c") > steps) & (F.col("_lo") < F.col("_hi"))
    for _ in range(ROUNDS):
        wide = found.filter(open_)
        if wide.isEmpty():
            break
        lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
        step = F.floor((number - lo) / (hi - lo) * F.lit(float(steps - 1))).cast("long")
        cut = (
            clean.join(wide.withColumnRenamed("_before", "_base").drop("_c"), [*keys, "_cell"])
            .filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
            .groupBy(*keys, "_n", "_i", "_at", "_base", step.alias("_step")).agg(*summed, F.min("_cell").alias("_cell"))
        )
        found = store(_bracket(cut, [*keys, "_i"], "_step", keep).unionByName(found.filter(~open_).select(*keep)), "brackets")
    if not found.filter(open_).isEmpty():
        raise ValueError(f"a quantile is still open after {ROUNDS} rounds")
    single = found.filter(F.col("_lo").eqNullSafe(F.col("_hi")))
    few = found.filter(~F.col("_lo").eqNullSafe(F.col("_hi"))).withColumnRenamed("_before", "_base").drop("_c")
    values = (
        clean.join(few, [*keys, "_cell"]).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        .groupBy(*keys, "_n", "_i", "_at", "_base", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    shown = [*keys, "_n", "_i", "_v"]
    picked = _bracket(values, [*keys, "_i"], "_v", shown).unionByName(single.withColumn("_v", F.col("_lo")).select(*shown))
    return picked.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)])


def values_at(rows: DataFrame, keys: list[str], value: str, targets: dict[str, Column], steps: int = STEPS) -> DataFrame:
    """Values at 0-based sorted positions.

    ``targets`` maps an output column to its position, an expression over ``_n`` (the group's number of rows with a
    value). Groups without a value, and null keys, are left out.
    """
    return _select(rows, keys, value, targets, steps).drop("_n")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], steps: int = STEPS) -> DataFrame:
    """Linearly interpolated quantiles, one output column per entry of ``probs``."""
    if not keys:
        return exact_quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], value, probs, steps).drop("_all")
    targets = {}
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        targets[f"_lo_{name}"] = F.floor(pos)
        targets[f"_hi_{name}"] = F.ceil(pos)
    picked = _select(rows, keys, value, targets, steps)
    out = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)


def exact_quantile(rows: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    return exact_quantiles(rows, keys, value, {out: p})
