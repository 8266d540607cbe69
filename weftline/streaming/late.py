"""Windows over a stream whose rows come late and twice: keyed state that corrects what was said, and timers that close it (an extension; specifications only name watermark, late_arrival and dedup).

A window of a key says its numbers as soon as a row comes, and again, with the next revision, when a later row belongs to it. Rows that come twice are known by their id and counted once. When the watermark
passes a window's end, nothing more can come for it: a timer says it a last time as closed and its state goes. State is kept by bucket of keys and window, and a bucket's keys are updated at once as arrays;
it holds the numbers of its keys and the ids of its rows. A hot key is as many groups as it has windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, VariantType

from weftline.storage import fresh_dir

_STATE = "told binary, seen binary"
_NUMBERS = ["n", "total", "low", "high", "revision"]
#: Rows of a replayed batch's file.
FILE_ROWS = 2_000_000


def _text(name: str, kind: DataType) -> Column:
    """A key as text that _key reads; a null stays null."""
    if isinstance(kind, BinaryType):
        return F.base64(name)
    return F.when(F.col(name).isNotNull(), F.to_json(F.struct(name))) if isinstance(kind, (ArrayType, MapType, StructType, VariantType)) else F.col(name).cast("string")


def _key(name: str, kind: DataType) -> Column:
    if isinstance(kind, BinaryType):
        return F.unbase64(name)
    return F.from_json(name, StructType().add(name, kind))[name] if isinstance(kind, (ArrayType, MapType, StructType, VariantType)) else F.col(name).cast(kind)


def corrected(stream: DataFrame, keys: list[str], time: str, value: str, identity: str, width: str, lateness: str, buckets: int = 1024) -> DataFrame:
    """keys, window_start, n, total, low, high (of value, nulls apart from n), revision from 1, closed. lateness: how far behind the latest row another may come; later ones are dropped.

    Emitted rows are appended: of a key and window, the one with the greatest revision holds. Rows without a time are dropped, as they belong to no window; null keys are keys. Times
    without a zone are taken in the session's. buckets: into how many the keys are dealt; some thousand rows a bucket and window are handled best.
    """
    window = F.window(time, width)
    kinds = {k: stream.schema[k].dataType for k in keys}
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).where(F.col(time).isNotNull()).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), *(_text(k, t).alias(k) for k, t in kinds.items()), F.xxhash64(*keys).alias("_key"), F.col(time),
        F.col(value).cast("double").alias("_value"), F.xxhash64(identity, *keys).alias("_id"), window.start.alias("window_start"), F.unix_millis(window.end.cast("timestamp")).alias("_end"),
    )
    start = rows.schema["window_start"].dataType.simpleString()

    def say(at: object, told: dict[str, np.ndarray], closed: bool) -> pd.DataFrame:
        out = {k: told[k] for k in keys} | {"window_start": [at] * len(told["_key"])} | {c: told[c] for c in _NUMBERS}
        return pd.DataFrame(out | {"closed": closed})  # NaN is null in the result

    def packed(told: dict[str, np.ndarray]) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.table([pa.array(v, pa.string() if k in keys else None) for k, v in told.items()], names=list(told))
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def unpacked(raw: bytes) -> dict[str, np.ndarray]:
        table = pa.ipc.open_stream(bytes(raw)).read_all()
        return {k: table[k].to_numpy() for k in table.column_names}

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            told = unpacked(state.get[0])
            state.remove()
            yield say(key[1], told | {"revision": told["revision"] + 1}, True)
            return
        frame = pd.concat(list(frames), ignore_index=True)
        ids, first = np.unique(frame["_id"].to_numpy(), return_index=True)
        held = state.get if state.exists else None
        seen = np.frombuffer(bytes(held[1]), np.int64) if held else np.zeros(0, np.int64)
        unknown = ~np.isin(ids, seen, assume_unique=True)
        if unknown.any():
            rows = first[unknown]
            v, one, none = frame["_value"].to_numpy(np.float64, na_value=np.nan)[rows], np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
            new = {k: frame[k].to_numpy(object)[rows] for k in keys} | {"_key": frame["_key"].to_numpy()[rows], "n": one, "total": v, "low": v, "high": v, "revision": none}
            old = unpacked(held[0]) if held else {k: x[:0] for k, x in new.items()}
            both = {k: np.concatenate((old[k], x)) for k, x in new.items()}
            order = np.argsort(both["_key"], kind="stable")
            both = {k: x[order] for k, x in both.items()}
            begin = np.flatnonzero(np.concatenate(([True], both["_key"][1:] != both["_key"][:-1])))
            touched = np.logical_or.reduceat(order >= len(old["_key"]), begin)
            missing = np.isnan(both["total"])
            told = {k: both[k][begin] for k in (*keys, "_key")} | {
                "n": np.add.reduceat(both["n"], begin),
                "total": np.where(np.logical_and.reduceat(missing, begin), np.nan, np.add.reduceat(np.where(missing, 0.0, both["total"]), begin)),
                "low": np.fmin.reduceat(both["low"], begin),
                "high": np.fmax.reduceat(both["high"], begin),
                "revision": np.add.reduceat(both["revision"], begin) + touched,
            }
            state.update((packed(told), np.concatenate((seen, ids[unknown])).tobytes()))
            yield say(key[1], {k: x[touched] for k, x in told.items()}, False)
        if state.exists:
            state.setTimeoutTimestamp(max(int(frame["_end"].iloc[0]), state.getCurrentWatermarkMs() + 1))

    ddl = ", ".join(f"`{k}` string" for k in keys) + f", window_start {start}, n long, total double, low double, high double, revision long, closed boolean"
    told = rows.groupBy("_bucket", "window_start").applyInPandasWithState(update, ddl, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(*(_key(k, t).alias(k) for k, t in kinds.items()), "window_start", *_NUMBERS, "closed")


def holding(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that hold of all that was emitted: of each key and window, the greatest revision."""
    columns = [*keys, "window_start"]
    rest = [c for c in emitted.columns if c not in columns]
    return emitted.groupBy(*columns).agg(F.max_by(F.struct(*rest), "revision").alias("_row")).select(*columns, "_row.*")


def replayed(df: DataFrame, batch: str, batches: int) -> DataFrame:
    """df as a stream that comes in so many micro-batches, by a column with numbers from 0: written to the shared folder one batch after another, since files are read in the order of their times.
    Every batch is as many files, of some FILE_ROWS rows on average; empty ones fill up a batch with fewer."""
    spark = df.sparkSession
    folder, rows = fresh_dir(spark, "replay"), df.drop(batch)
    files = 1 + df.count() // (max(1, batches) * FILE_ROWS)
    there = 0
    for i in range(batches):
        own = df.where(df[batch] == i).drop(batch)
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(folder)
        if files > 1:
            there += files
            for _ in range(there - _count(spark, folder)):
                rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _count(spark: SparkSession, folder: str) -> int:
    """The Parquet files of a folder, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    return len(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or ())


def settled(stream: DataFrame, name: str) -> DataFrame:
    """What a stream has emitted once all that is there has been read, as a table in the shared folder."""
    spark = stream.sparkSession
    path = fresh_dir(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
