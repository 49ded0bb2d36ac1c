"""Shared plumbing of the corpus operators: staged tables, Arrow row maps, stable hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

_STAGED: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; on a cluster that would be a folder of one machine, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="matchloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/matchloom/{what}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_stage(df: DataFrame, what: str, of: Column | None = None) -> tuple[DataFrame, int]:
    """``stage``, and the number of rows written for which ``of`` holds (all rows without it), counted by the write itself."""
    seen = Observation()
    counted = F.count(F.lit(1)) if of is None else F.count_if(of)
    staged = stage(df.observe(seen, counted.alias("n")), what)
    return staged, seen.get["n"]


def clean_staging() -> None:
    """Remove all staged tables of this process. Frames that read them can't be used afterwards."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the context may be gone when the process ends
            return


atexit.register(clean_staging)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def give_back() -> None:
    """At the end of a task, memory that the worker has freed goes back to the system: workers live on and share it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_rows(df: DataFrame, schema: str | T.StructType, setup: Callable[[], Callable[..., Iterable[tuple]]], rows: int = 4096, size: int = 8 << 20) -> DataFrame:
    """Run ``setup()(*row)`` for each row and emit the tuples it gives.

    Rows are converted a few hundred at a time and results leave in batches of at most about ``rows`` rows or ``size``
    bytes, so that memory follows the longest row and not the partition.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out, held = None, [], 0

        def made() -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            fn = fn or setup()
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    for made_row in fn(*row):
                        out.append(made_row)
                        held += sum(len(x) for x in made_row if hasattr(x, "__len__"))
                        if len(out) >= rows or held >= size:
                            yield made()
                            out, held = [], 0
        if out:
            yield made()
        fn, out = None, []
        give_back()

    return df.mapInArrow(run, schema)
