"""Columns that Python makes row by row, handed on by bytes and not by rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Bytes of made values that are handed on at a time.
MOST = 4 << 20


def appended(rows: DataFrame, of: list[str], make: Callable[..., tuple], schema: str) -> DataFrame:
    """rows with the columns of a schema (DDL), which make() gives for the values of the columns `of`.

    A column function holds its results for a whole batch of Spark's, 10,000 rows of any length; here a worker holds the
    rows that came at once and about MOST bytes of results.
    """
    new = StructType.fromDDL(schema).fields
    kinds, whole = [to_arrow_type(f.dataType) for f in new], StructType([*rows.schema.fields, *new])

    def run(batches):
        for batch in batches:
            out, first, held = [], 0, 0
            for k, values in enumerate(zip(*(batch.column(c) for c in of))):
                out.append(make(*(v.as_py() for v in values)))
                held += 16 + sum(getattr(x, "nbytes", None) or len(x) for x in out[-1] if hasattr(x, "__len__"))
                if held > MOST or k + 1 == batch.num_rows:
                    own = [pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, k + 1 - first) for c in batch.columns), *own], names=whole.names)
                    out, first, held = [], k + 1, 0

    return rows.mapInArrow(run, whole)
