"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.plans.session import checkpoint_dir, ship_code, written

#: Rows handed to a row function at once; bounds the Python-side memory of a batch of long texts.
CHUNK_BYTES = 8 << 20
#: Rows of a few numbers that are worth a task.
TASK_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def parse_schema(ddl: str) -> T.StructType:
    """A DDL string as a schema, without needing a running session on the caller's side."""
    return T.StructType.fromDDL(ddl)


def map_columns(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str) -> DataFrame:
    """Runs ``fn`` over column lists of ``df`` and returns the columns named in ``schema``.

    ``fn`` gets one Python list per column of ``df`` and returns equally long lists by output name.
    Arrow batches are cut so that about CHUNK_BYTES are handled at a time; rows keep their order. An empty
    partition yields nothing. There is no shuffle, so a hot key has no effect.
    """
    out = parse_schema(schema)
    kind = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            step = n if batch.nbytes <= CHUNK_BYTES else max(1, n * CHUNK_BYTES // batch.nbytes)
            for at in range(0, n, step or 1):
                part = batch.slice(at, step)
                got = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in kind], schema=kind)

    ship_code(df.sparkSession)
    return df.mapInArrow(run, out)


saved = written


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows of a few numbers, in tasks of TASK_ROWS, but as many as the cluster has cores at least.

    Partitions beyond that are merged without a shuffle, so rows of one key stay together. Rounds over small tables then do not take
    the session's number of shuffle partitions in tasks, and as many files, each time, where the planner does not merge them itself.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def settled(df: DataFrame, width: int = 1) -> tuple[DataFrame, int]:
    """``df`` written, in few tasks, and its number of rows; one is as wide as ``width`` rows of a few numbers."""
    held = saved(df)
    rows = in_few(held, 0).count()
    return in_few(held, rows * width), rows


class Scratch:
    """Parquet tables below spark.checkpoint.dir for loops: they are removed on leaving, or sooner by ``keep_only``.

    A checkpoint hands on its plan's estimated size, a product over joins that grows exponentially from round to round; a
    written table has its true size.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []
        self.folder = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.made)}"
        df.write.parquet(path)
        self.made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def keep_only(self, last: int = 1) -> None:
        """Removes all but the ``last`` tables put."""
        for path in self.made[:-last]:
            self._delete(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
