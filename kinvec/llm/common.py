"""What the text operators share: bounded Arrow batches, durable cuts of lineage, table access."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: Rows of one Arrow batch. Texts are a few KB on average; a batch stays at a few MB.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Python workers then hold some hundred texts at a time, however many rows a partition has."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and the UTF-8 bytes of text, null as empty, and nothing else but the columns asked for."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *more,
    )


def map_columns(
    df: DataFrame, fn: Callable[[], Callable[..., dict[str, object]]], schema: str
) -> DataFrame:
    """mapInArrow over columns: fn() runs once a task and returns the function of a batch.

    That function gets one list for each input column and returns a dict of equally long columns.
    """
    bounded_batches(df.sparkSession)
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = fn()
        for batch in batches:
            if batch.num_rows:
                out = one(*[c.to_pylist() for c in batch.columns])
                made = [pa.array(out[f.name], type=f.type) for f in arrow]
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays(made, names=arrow.names)

    return df.mapInArrow(run, spark_schema)


#: Rows of a column of longs that are broadcast at most (8 bytes each).
BROADCAST_LONGS = 2_000_000


def small_column(column: DataFrame, limit: int = BROADCAST_LONGS) -> np.ndarray | None:
    """A column of longs, sorted, if it has few enough rows to be broadcast; else None."""
    if column.count() > limit:
        return None
    return np.sort(np.array([r[0] for r in column.toLocalIterator()], np.int64))


def restricted(docs: DataFrame, ids: DataFrame, inside: bool, limit: int = BROADCAST_LONGS) -> DataFrame:
    """The rows of docs whose doc_id is (inside) or is not in ids(doc_id); null is in no ids.

    While ids are few they are broadcast and docs are filtered where they are read; else docs are joined.
    """
    known = small_column(ids, limit)
    if known is None:
        return docs.join(ids.distinct(), "doc_id", "left_semi" if inside else "left_anti").select(*[f"`{c}`" for c in docs.columns])
    if not len(known):
        return docs.limit(0) if inside else docs
    shared = docs.sparkSession.sparkContext.broadcast(known)
    at = docs.columns.index("doc_id")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(at)
            got = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = own[np.minimum(np.searchsorted(own, got), len(own) - 1)] == got
            found &= column.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(found if inside else ~found))

    return docs.mapInArrow(run, docs.schema)


def with_marks(docs: DataFrame, marks: DataFrame, limit: int = BROADCAST_LONGS) -> DataFrame:
    """docs left-joined with marks, one row for each doc_id that has any.

    While the marked ids are few, only the marked rows are shuffled.
    """
    marks = durable(marks)
    ids = marks.select("doc_id")
    if small_column(ids, limit) is None:
        return docs.join(marks, "doc_id", "left")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in marks.schema if f.name != "doc_id"}
    return restricted(docs, ids, True, limit).join(marks, "doc_id").unionByName(restricted(docs, ids, False, limit).withColumns(empty))
