"""Streams into the load operators (an extension: specifications only name watermark, late_arrival and dedup)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.load import upsert


def deduplicated(stream: DataFrame, keys: list[str], time: str, watermark: str) -> DataFrame:
    """One row for each key within the watermark; what comes later than that is dropped."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, watermark: str, width: str, slide: str | None = None, keys: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) in tumbling or sliding windows."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    made = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return stream.withWatermark(time, watermark).groupBy(window.alias("window"), *(keys or [])).agg(*made)


def upsert_stream(stream: DataFrame, keys: list[str], order: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch is merged into the table that read gives, the latest row of a key first; write must put the result in another place than read reads from."""

    def load(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        write(upsert(read(), latest, keys, check=False), number)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
