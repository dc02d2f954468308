"""Incremental variants: arrivals as an available-now stream, and first-value state per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry


def arrivals(spark: SparkSession, path: str, schema: T.StructType, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Process what is new in a Parquet folder since the last run and append it to sink; removed or rewritten files still
    need operators.history.manifest_diff."""
    stream = spark.readStream.schema(schema).parquet(path)
    return transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_definitions(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Upsert (acronym, field, expansion, and doc_id, kind, pos for their order) into a registry table batch by batch, as
    registry.fold does for whole tables: the first expansion stands, the first that differs makes a lasting conflict. Order is that
    of batches, then that of the columns. Each batch writes a version; a version that can't be read is an error."""

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        keys = ["acronym", "field"]
        new = registry.fold(batch, *keys).withColumnRenamed("expansions_seen", "seen")
        if n == 0:
            new.write.mode("overwrite").parquet(f"{sink}/v0")
            return
        o, b = spark.read.parquet(f"{sink}/v{n - 1}").alias("o"), new.alias("b")
        both = o.join(b, keys, "full_outer")
        first = F.coalesce("o.expansion", "b.expansion")
        later = F.filter(F.coalesce("b.seen", F.array().cast("array<string>")), lambda x: ~registry.same_expansion(x, first))
        other = F.coalesce(F.try_element_at("o.seen", F.lit(2)), F.try_element_at(later, F.lit(1)))
        status = F.when(other.isNull(), "verified").otherwise("conflict")
        both.select(*keys, first.alias("expansion"), status.alias("status"), F.array_compact(F.array(first, other)).alias("seen")).write.mode("overwrite").parquet(f"{sink}/v{n}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
