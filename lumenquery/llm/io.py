"""Reading tables, text batches and cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Type of row_key().
ROW_KEY = "struct<a:bigint,b:bigint>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*names: str) -> Column:
    """128 bits of a row's doc_id and text, or the columns named; a null differs from every value. Only rows equal in all share a key."""
    parts = [x for c in names or ("doc_id", "text") for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("row"), *reversed(parts)).alias("b"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset on one machine, as in tests, a temporary one is made.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ckpt-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts lineage: a lost executor costs no recomputation of earlier stages. Columns
    stay compressed, unlike the rows of checkpoint(). The tables go when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_clear, spark)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[str] = []


def _clear(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; the folder is the cluster's to clear then
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for p in _made:
            where = jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(conf).delete(where, True)


def doc_and_text(docs: DataFrame, cols: list[str]) -> tuple[list[Column], Callable[[pa.RecordBatch], list[pa.Array]]]:
    """Columns doc and text to send to Python, and what gives the columns cols back from a batch that starts with them.

    A text column that is a string already is sent as text only, so that batches hold it once.
    """
    schema = docs.select(*cols).schema
    beside = [c for c in cols if not (c.lower() == "text" and schema[c].dataType == StringType())]
    doc = F.struct(*beside) if beside else F.lit(True)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        parts = dict(zip(beside, batch.column(0).flatten(), strict=True)) if beside else {}
        return [parts[c] if c in parts else batch.column(1) for c in cols]

    return [doc.alias("doc"), F.col("text").cast("string").alias("text")], columns


def _give_back() -> None:
    """Return freed memory to the system: workers stay alive between stages and would keep their largest batch's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", bytes_at_once: int = 8 << 20, rows_at_once: int = 2048) -> Iterator[pa.RecordBatch]:
    """Split batches so that one holds about bytes_at_once of the text column, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows:
            continue
        at = size = 0
        lens = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        for i, n in enumerate(lens):
            if i > at and (size + n > bytes_at_once or i - at >= rows_at_once):
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        yield batch.slice(at)
        _give_back()


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
