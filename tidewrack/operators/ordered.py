"""Global order without a window over all rows: range partitions, one figure a partition, offsets added in a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: Bits of a row's place in its partition; the bits above are the partition.
PLACE = 33


def ranged(df: DataFrame, *order: Column, partitions: int | None = None) -> DataFrame:
    """df as a table in range partitions of the order, with `part` (number of the partition) and `place` (from 0 in it)."""
    d = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    # the id counts rows of a partition as they come, which is sorted
    d = d.sortWithinPartitions(*order).withColumn("place_id", F.monotonically_increasing_id())
    d = d.withColumns({"part": F.shiftright("place_id", PLACE).cast("int"), "place": F.col("place_id").bitwiseAND((1 << PLACE) - 1)}).drop("place_id")
    return cut(d, "ranged")


def _offsets(per_part: DataFrame, group: list[str], value: str) -> DataFrame:
    """o_part, o_<group>..., `before`: the sum of value over the parts before one; a row for each part (and group), not for each row."""
    w = Window.partitionBy(*group or [F.lit(0)]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(F.col("part").alias("o_part"), *[F.col(g).alias(f"o_{g}") for g in group], F.coalesce(F.sum(value).over(w), F.lit(0)).alias("before"))


def numbered(df: DataFrame, *order: Column, name: str = "ord", partitions: int | None = None) -> DataFrame:
    """df with `name`: a number from 0 in the order, over all rows."""
    d = ranged(df, *order, partitions=partitions)
    o = F.broadcast(_offsets(d.groupBy("part").agg(F.count("*").alias("n")), [], "n"))
    return d.join(o, d.part == o.o_part).withColumn("place", F.col("before") + F.col("place")).drop("part", "o_part", "before").withColumnRenamed("place", name)


def running(d: DataFrame, value: Column, group: str | None = None) -> DataFrame:
    """d (what ranged() gives, in an order that starts with group) with `upto`: the sum of value up to and with a row, in its group if there is one.

    Sums within a part are over that part's rows; what runs over many parts gets the sums of the parts before.
    """
    by = [group] if group else []
    d = d.withColumn("value", value)
    o = _offsets(d.groupBy("part", *by).agg(F.sum("value").alias("n")), by, "n")
    within = Window.partitionBy("part", *by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("value").over(within))
    on = d.part == o.o_part
    for g in by:
        on = on & d[g].eqNullSafe(o[f"o_{g}"])
    return d.join(o if by else F.broadcast(o), on).withColumn("upto", F.col("upto") + F.col("before")).drop("o_part", *[f"o_{g}" for g in by], "before", "value")
