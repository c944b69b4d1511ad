"""Shared pieces of the training-data operators: folds, samples and Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written

__all__ = ["filter_arrow", "fold", "hashed_share", "held_out", "map_arrow", "short_batches", "table", "written"]

#: Rows of an Arrow batch. Texts are long: the default of 10,000 rows would hold some hundred MB
#: in the JVM's and the Python worker's buffers at once.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 3. A null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True for the third of all documents that no model may learn from."""
    return fold(doc_id) == 1


def hashed_share(key: Column, keep: Column) -> Column:
    """True for a share ``keep`` (0 to 1) of the keys, the same keys on every run."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < (keep * 1_000_000)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``fn`` turns one record batch into a dict of equally long columns named as in ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in target], schema=target
                )
                pa.default_memory_pool().release_unused()

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def filter_arrow(df: DataFrame, keep: Callable[[pa.RecordBatch], object]) -> DataFrame:
    """Rows of ``df``, all columns untouched, for which ``keep(batch)`` says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch), type=pa.bool_()))
                pa.default_memory_pool().release_unused()

    short_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
