"""Running aggregates over long sequences without one task per sequence.

A sequence is cut into blocks of its position. Aggregates of blocks (one row each) are accumulated over blocks, and each block
continues from what precedes it. Sliding frames get the rows before a block as a halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16

_COMBINE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_OF = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def running(df: DataFrame, by: list[str], order: str, what: dict[str, tuple[str, Column]], block: Column | None = None) -> DataFrame:
    """df with each aggregate (sum, count, min or max of a column) over all rows of its group up to and including its own.

    `order` is a whole number that is unique in a group; blocks default to BLOCK successive values of it. min and max may be over
    structs; least and greatest cannot, so these compare by the window alone.
    """
    block = F.floor(F.col(order) / BLOCK) if block is None else block
    keys = [*by, "_block"]
    rows = df.withColumn("_block", block).withColumns({f"_in_{n}": c for n, (_, c) in what.items()})
    sums = rows.groupBy(*keys).agg(*(_OF[k](f"_in_{n}").alias(f"_of_{n}") for n, (k, _) in what.items()))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, *(_MERGE[k](f"_of_{n}").over(before).alias(f"_before_{n}") for n, (k, _) in what.items()))
    joined = rows.join(offsets, keys) if not by else rows.join(offsets, keys)
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n, (k, _) in what.items():
        own = _OF[k](f"_in_{n}").over(inside)
        if k in ("sum", "count"):
            out[n] = _COMBINE[k](F.col(f"_before_{n}"), own)
        else:
            better = own < F.col(f"_before_{n}") if k == "min" else own > F.col(f"_before_{n}")
            out[n] = F.when(F.col(f"_before_{n}").isNull() | better, own).otherwise(F.col(f"_before_{n}"))
    helpers = ["_block", *(f"_in_{n}" for n in what), *(f"_before_{n}" for n in what)]
    return joined.withColumns(out).drop(*helpers)


def sliding(df: DataFrame, by: list[str], order: str, preceding: int, what: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with each aggregate column over the row and up to `preceding` rows before it. `order` numbers the rows of a group densely."""
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    ahead = F.floor((F.col(order) + preceding) / block)
    copies = rows.withColumn("_block", F.explode(F.sequence(F.col("_block"), ahead))).withColumn("_own", F.floor(F.col(order) / block) == F.col("_block"))
    w = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(-preceding, 0)
    return copies.withColumns({n: c.over(w) for n, c in what.items()}).filter("_own").drop("_block", "_own")


def sliding_mean(df: DataFrame, by: list[str], order: str, window: int, value: str, mean: str, count: str, block: int = BLOCK) -> DataFrame:
    """df with the mean and count of `value` over the last `window` rows: differences of running sums inside a block and its halo, so a row's
    cost does not grow with the window. `value` has no nulls."""
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    copies = rows.withColumn("_block", F.explode(F.sequence(F.col("_block"), F.floor((F.col(order) + window - 1) / block)))).withColumn("_own", F.floor(F.col(order) / block) == F.col("_block"))
    w = Window.partitionBy(*by, "_block").orderBy(order)
    summed = copies.withColumns({"_sum": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_row": F.row_number().over(w)})
    last = summed.withColumns({count: F.least(F.col("_row"), F.lit(window)), "_left": F.coalesce(F.lag("_sum", window).over(w), F.lit(0.0))})
    return last.filter("_own").withColumn(mean, (F.col("_sum") - F.col("_left")) / F.col(count)).drop("_block", "_own", "_sum", "_row", "_left")


def value_ranges(df: DataFrame, by: list[str], value: str, ranges: int = 1024) -> DataFrame:
    """df with _range (long), which ascends with `value` in each group: equal parts of the span of values, of which those with more than their share
    of the rows are cut once more into equal parts of their own span, so that crowded values do not meet in one."""
    v = F.col(value)
    part = lambda lo, hi, n: F.coalesce(F.floor((v - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)) * n), F.lit(0))
    spans = df.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_rows"))
    first = (df.join(spans, by) if by else df.crossJoin(spans)).withColumn("_part", part("_lo", "_hi", ranges))
    parts = first.groupBy(*by, "_part").agg(F.min(v).alias("_plo"), F.max(v).alias("_phi"), F.count("*").alias("_prows"))
    cut = first.join(parts, [*by, "_part"]).withColumn("_cuts", F.ceil(F.col("_prows") * ranges / F.col("_rows")))
    return cut.withColumn("_range", F.shiftleft(F.col("_part").cast("long"), 32) + part("_plo", "_phi", F.col("_cuts"))).drop("_lo", "_hi", "_rows", "_part", "_plo", "_phi", "_prows", "_cuts")
