"""What the corpus operators share: table reading, scratch space, Arrow mapping.

Every operator works on the columns it names and ignores all others, so extra
columns (also ones called like an operator's own outputs) never clash.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a Python worker; bounds its memory, not its results.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts and pages in fewer partitions than there are cores (a small file) are dealt over all cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name not in ("documents", "pages") or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def scratch(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``, or the session's checkpoint folder. A local session without either gets
    one of its own, which goes when Python ends; on a cluster that is an error, as executors wouldn't share it."""
    context = spark.sparkContext._jsc.sc()
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir().isEmpty():
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = shared or tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(own)
        if not shared:
            atexit.register(shutil.rmtree, own, ignore_errors=True)
    return shared or context.getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours from the shared one, by Spark's own file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so that a lost executor costs no recomputation.

    A checkpoint has a file a partition. For each, Hadoop's local file system starts two processes (chmod), and what sums up the memory of a process tree
    may meet one before it is replaced, as a second executor of the same size. ``files`` deals the rows to so many partitions first; the work that makes them stays as it is dealt."""
    scratch(df.sparkSession)
    return (df.repartition(files) if files else df).checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key that holds more than one of this many rows is hot.
HOT = 1000


def attached(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row a key; rows without a match get nulls.

    ``rows`` is materialised. Keys that hold over a thousandth of its rows, of which there are fewer than a thousand, are broadcast, so that no key's rows
    are one task's; all others are shuffled. Keys aren't null."""
    total = rows.count()
    hot = F.broadcast(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows_of_key")).where(F.col("rows_of_key") * HOT > max(total, 100 * HOT)).drop("rows_of_key"))
    if not hot.head(1):
        return rows.join(found, key, "left")
    few = F.broadcast(found.join(hot, key, "left_semi"))  # fewer than HOT rows
    return rows.join(hot, key, "left_semi").join(few, key, "left").unionByName(rows.join(hot, key, "left_anti").join(found, key, "left"))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own; a null text becomes empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_slices(df: DataFrame, work: Callable[..., dict], schema: str, setup: Callable | None = None) -> DataFrame:
    """mapInArrow over slices of ``SLICE_ROWS`` rows.

    ``work(state, columns)`` gets a dict of Python lists and returns a dict of lists or arrays in the order of
    ``schema``; ``setup()`` makes ``state`` once a task.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    names = StructType.fromDDL(schema)
    arrow = to_arrow_schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = work(state, part.to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(made.values(), arrow, strict=True)],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def sum_blocks(df: DataFrame, key: str, kind: str = "string") -> DataFrame:
    """Adds float64 blocks of equal length by key: (key, block) to one row a key.

    The rows stream through a running sum, so a task holds one block a key whatever the number of rows.
    """
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(block, dtype="<f8")
                if k in sums:
                    sums[k] += values
                else:
                    sums[k] = values.copy()
        for k, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], type=batch.schema.field(0).type), pa.array([values.tobytes()], type=pa.binary())], names=[key, "block"])

    return df.select(key, "block").repartition(tasks(df.sparkSession), key).mapInArrow(run, f"{key} {kind}, block binary")


def filter_slices(df: DataFrame, text_col: str, keep: Callable[..., list[bool]], setup: Callable | None = None) -> DataFrame:
    """The rows for which ``keep(state, texts)`` is true, with all columns as they are; a null text counts as empty."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                yield part.filter(pa.array(keep(state, [t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)
