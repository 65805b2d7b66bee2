"""What the operators of this subpackage share: shared-folder tables, reading, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own: str | None = None
#: Bytes of an Arrow batch, and rows of it that become Python objects at a time.
BATCH_BYTES, ROWS = 8 << 20, 1000


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: under spark.checkpoint.dir, or where that is unset (tests on one machine) under a temporary folder."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own = _own or tempfile.mkdtemp(prefix="veridate-")
    return f"{base.rstrip('/')}/veridate-{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, outlives executors, and is computed once."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove what table() wrote for these frames, once all that reads them is written itself."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def check_of(*columns: str) -> Column:
    """A second hash, independent of xxhash64 of the same columns, so that both together tell values apart."""
    return F.xxhash64(F.lit("check"), *columns)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that a task's Python memory does not depend on how long texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Apply fn to a task's Arrow batches as dicts of Python lists (so that ids with nulls among them stay exact); it yields pandas frames of `schema`."""
    small_batches(df.sparkSession)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn({name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)} for b in _slices(batches)):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, struct)


def map_frames(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas over batches of bounded bytes."""
    small_batches(df.sparkSession)
    return df.mapInPandas(fn, schema)


def filter_batches(df: DataFrame, column: str, fn: Callable[[Iterator[list]], Iterator[list[bool]]]) -> DataFrame:
    """The rows of df for which fn, given one column batch by batch, says True; all columns stay as they are."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def values() -> Iterator[list]:
            for b in _slices(batches):
                held.append(b)
                yield b.column(b.schema.names.index(column)).to_pylist()

        for keep in fn(values()):
            yield held.pop(0).filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
