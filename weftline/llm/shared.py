"""What the operators of this subpackage share: the shared folder, written tables and Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that goes to Python; with texts of 100 kB that is 25 MB.
BATCH_ROWS = 256

_written: list[tuple[SparkSession, str]] = []


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose tasks are the driver's, may go without: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
    return _own_dir[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove_dir(spark, path)
        except Exception:  # the session may have ended before  # noqa: BLE001
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written Parquet table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.weftline_path = path
    return out


def one_each(manifest: DataFrame) -> int:
    """Partitions in which files are read: one for each row of their manifest, up to some rounds of tasks."""
    spark = manifest.sparkSession
    most = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return min(max(1, manifest.count()), most)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written() that no plan needs any more."""
    remove_dir(df.sparkSession, df.weftline_path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session, so that long texts don't pile up in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def by_batch(f: Callable[..., Iterable[tuple]], columns: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: f gets the named columns as Python lists and gives a list per output column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = f(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return run
