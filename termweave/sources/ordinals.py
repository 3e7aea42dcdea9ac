"""Exact ranks on integer columns without a window over a whole group.

``counts_before`` is a prefix sum over the values of an integer column by levels of
slices: the values are cut into slices of ``2 ** bits`` neighbours, these into
slices of ``2 ** bits`` slices and so on, and a window only ever runs inside one
slice of one level.  No window sees more than ``2 ** bits`` rows, be the values
dense or random over all 64 bits, and the levels do not depend on the data, so
nothing has to be counted or sampled while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 14


def counts_before(counts: DataFrame, group: Sequence[str], value: str, n: str, name: str = "before",
                  bits: int = SLICE_BITS, width: int = 64) -> DataFrame:
    """Add ``name``: the sum of ``n`` over the rows of the same ``group`` with a smaller
    ``value``.  ``counts`` has one row for each (group, value); ``value`` is a
    bigint of at most ``width`` bits, of any sign.  Columns that begin with ``_s`` or
    ``_b`` are reserved."""
    shifts = [s for s in range(bits, width, bits)]
    base = counts.withColumns({f"_s{s}": F.shiftright(F.col(value), s) for s in shifts})
    # rows of each level: the sums of its slices, with the numbers of the slices above
    levels = [(base.withColumn("_n", F.col(n)), value, shifts)]
    for k, s in enumerate(shifts):
        above = shifts[k + 1:]
        rows = levels[-1][0].groupBy(*group, f"_s{s}", *[f"_s{x}" for x in above]).agg(F.sum("_n").alias("_n"))
        levels.append((rows, f"_s{s}", above))
    before = None
    for rows, order, above in reversed(levels):
        inside = [*group, *[f"_s{x}" for x in above[:1]]]
        w = Window.partitionBy(*inside).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        part = rows.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        if before is not None:
            part = part.join(before, inside).withColumn("_b", F.col("_b") + F.col("_o")).drop("_o")
        if order == value:
            return part.withColumnRenamed("_b", name).drop("_n", *[f"_s{s}" for s in shifts])
        before = part.select(*group, order, F.col("_b").alias("_o"))
    raise AssertionError("the levels end with the values themselves")
