"""Global row numbers without a window over the whole table."""

from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

_PLACE_BITS = 33  # of a partition's rows in the numbers that Spark gives out


def numbered(rows: DataFrame, *order, name="_n"):
    """(`rows` with `name`: position from 0 in the total order of the columns, number of rows).

    The rows are dealt into ranges of `order` and sorted inside, so a common prefix or a
    crowded value is divided like any other; a row's number is its place in its range
    after the sizes of the ranges before it. The ranges are checkpointed, as a second
    sample would cut them elsewhere; only their sizes come to the driver.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _PLACE_BITS)
    sizes = sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    ends = list(accumulate(n for _, n in sizes))
    starts = [(p, end - n) for (p, n), end in zip(sizes, ends, strict=True)]
    before = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    inside = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    placed = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row per range
    return placed.withColumn(name, F.col("_before") + inside).drop("_place", "_part", "_before"), ends[-1] if ends else 0
