"""Fitted steps on a streaming DataFrame.

The reference has no streaming. Every fitted step here is a projection with
literal parameters (scalers, naive Bayes, one-class scores, label rules), so the
same functions apply to ``spark.readStream`` frames unchanged; this module only
wires a file stream to a Parquet sink through ``foreachBatch`` with an
``availableNow`` trigger (process what is there, then stop), checkpointing the
stream state in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from flowlens.session import scratch_path


def score_stream(spark: SparkSession, source_dir: str, schema: StructType,
                 step: Callable[[DataFrame], DataFrame], out_dir: str, fmt: str = "parquet") -> str:
    """Run ``step`` over every file in ``source_dir`` as a stream; append results to ``out_dir``."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    scored = step(stream)

    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("append").parquet(out_dir)

    q = (scored.writeStream.foreachBatch(sink)
         .option("checkpointLocation", scratch_path(spark, "stream-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir
