"""Comparison of pairs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimp.config import DEFAULT, Options
from palimp.plans.compare import compare, stats


def compare_stream(pairs: DataFrame, output: str, checkpoint: str, options: Options = DEFAULT) -> StreamingQuery:
    """Writes statistics of each pair (pair_id, old_text, new_text) of a stream to a folder of its batch; a batch that is repeated overwrites its own folder, so each counts once."""

    def run(batch: DataFrame, number: int) -> None:
        stats(compare(batch, options)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return pairs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
