"""Per-batch work on Arrow columns: texts as bytes or strings, results as new columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes and rows of a batch that are turned into Python objects together.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 512


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8, a missing one as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of text or binary columns and at most `rows` rows; one long text is a slice of its own."""
    for batch in batches:
        wide = [c for c in batch.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in wide), np.zeros(batch.num_rows, np.int64))
        part = (np.cumsum(sizes) - sizes) // size
        start = 0
        for stop in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
            while start < stop:
                yield batch.slice(start, min(rows, stop - start))
                start += min(rows, stop - start)


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]], added: str, keep: list[str] | None = None) -> DataFrame:
    """The rows of `df` with the columns of the schema text `added`, computed slice by slice of a batch.

    `make` is called once in each task and returns a function from a slice to the added columns.  `keep` names the columns that pass
    through (all, if not given).
    """
    kept = df.columns if keep is None else keep
    fields = [f for f in df.schema.fields if f.name in kept]
    new = T.StructType.fromDDL(added)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + list(new.fields))
    arrow, names = to_arrow_schema(new), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches):
            columns = work(batch)
            arrays = [batch.column(n) for n in names] + [pa.array(columns[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=names + arrow.names)

    return df.mapInArrow(run, schema)
