"""Reading tables, identity of rows, and saving intermediate tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.ranking import shared_folder

#: A word is a run of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tag(text: Column | str = "text") -> Column:
    """Half of a row's identity: documents are told apart by (id, hash of the text), so repeated rows are one document."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that later steps neither compute it again nor depend on any executor.

    The table goes to the folder that all executors share.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_decisions(docs: DataFrame, decisions: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", how: str = "left") -> DataFrame:
    """``docs`` as a struct ``_row`` beside the decision columns made for each (``_id``, ``_tag``).

    Packing the row keeps extra columns of any name apart from ours.
    """
    left = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_lid"), tag(text_col).alias("_ltag"))
    right = decisions.select("_id", "_tag", *columns)
    joined = left.join(right, F.col("_lid").eqNullSafe(F.col("_id")) & (F.col("_ltag") == F.col("_tag")), how)
    return joined.select("_row", *columns)


def give_back() -> None:
    """Hand memory that is no longer used back to the system, so that an idle Python worker leaves it to its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(f: Callable) -> Callable:
    """``f`` of one or two arguments, on a group of rows, after which its memory is handed back."""

    def run(*args):
        out = f(*args)
        give_back()
        return out

    # Spark counts the arguments by their names.
    return (lambda rows: run(rows)) if f.__code__.co_argcount == 1 else (lambda a, b: run(a, b))


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``limit`` bytes of text, so that memory doesn't follow Arrow's count of rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = raw_text(batch.column(column))[1][1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, dtype=np.int64, count=column.offset + n + 1)[column.offset :] if at is not None and n else np.zeros(n + 1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]
