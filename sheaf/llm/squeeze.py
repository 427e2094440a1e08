"""Texts as compressed bytes, for shuffles and stored copies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import tidied


def squeezed(docs: DataFrame, text_column: str) -> DataFrame:
    """docs with the text as compressed bytes, for shuffles."""
    place = docs.columns.index(text_column)
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if i == place else f.dataType) for i, f in enumerate(docs.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            small = pa.array([None if (t := x.as_py()) is None else press.compress(t.encode()) for x in batch.column(place)], pa.binary())
            yield pa.RecordBatch.from_arrays([small if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(tidied(run), schema)


def texts_of(column: pa.Array) -> pa.Array:
    """Compressed texts as text; nulls stay."""
    return pa.array([None if z is None else zstandard.decompress(z) for z in column.to_pylist()], pa.large_binary()).view(pa.large_string())
