"""Add computed columns to rows in Arrow batches, whatever other columns the rows have."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Work = Callable[[list[pa.Array]], list[pa.Array]]


def map_rows(rows: DataFrame, read: list[Column], added: str, make: Callable[[], Work]) -> DataFrame:
    """(row, added...): each row of ``rows`` packed in a struct, with the columns that Python computes.

    ``make`` is called once per task; what it returns gets the arrays of ``read`` for each batch
    and gives the arrays of ``added`` (a schema string). Only narrow work: no shuffle.
    """
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[c.alias(f"_{k}") for k, c in enumerate(read)])
    new = T.StructType.fromDDL(added)
    schema = T.StructType([packed.schema["row"], *new.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *work(batch.columns[1:])], names=names)

    return packed.mapInArrow(run, schema)
