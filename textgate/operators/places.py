"""Places and running sums inside groups of any size: a group is split over ranges of its order, so none is one task's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows whose keys are looked at on the driver (those of smallest hash), and ranges that these are cut in.
LOOKED_AT, RANGES = 8192, 256


def literal(value) -> Column:
    """A value of the driver as a column; rows become structs."""
    return F.struct(*[literal(v) for v in value]) if isinstance(value, tuple) else F.lit(value)


def in_order(value) -> tuple:
    """What to sort values by so that nulls, also those inside rows, come first."""
    return (value is not None, tuple(in_order(v) for v in value) if isinstance(value, tuple) else value)


def range_of(frame: DataFrame, key: str) -> Column:
    """The range of a key, from 0: ranges follow the key's order and have about as many rows each, but where single keys have more.
    Nulls are in the first. Which bounds are taken follows from the keys alone, so that a repeated run has the same."""
    some = frame.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(LOOKED_AT).collect()
    keys = sorted((r[0] for r in some), key=in_order)
    bounds = list(dict.fromkeys(keys[i * len(keys) // RANGES] for i in range(1, RANGES))) if keys else []
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[literal(b).cast(frame.schema[key].dataType) for b in bounds]), lambda b: b < F.col(key)))


def running(rows: DataFrame, groups: list[str], key: str, name: str, *ties: str, weight: str | None = None, keys_of: DataFrame | None = None) -> DataFrame:
    """rows with name: the sum of weight (of ones: the place, from 1) over the group's rows up to and with each by (key, ties). keys_of: a frame
    with the key that is cheaper to look at than rows. Null groups are groups; between rows that tie any order may be taken."""
    rows = rows.withColumn("_range", range_of(rows if keys_of is None else keys_of, key))
    add = F.lit(1) if weight is None else F.col(weight)
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*groups, "_range").agg(F.sum(add).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("bigint")))
    named = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"), "_before")  # a row per group and range
    inside = Window.partitionBy(*groups, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_range") == F.col("_r"))
    own = rows.withColumn("_own", F.sum(add).over(inside))
    return own.join(named, same).withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_range", "_r", "_own", "_before", *[f"_g{i}" for i in range(len(groups))])
