"""How a module collects its queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of made files that are handed on at a time.
MOST = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(rows: DataFrame, make: Callable[..., Iterable[tuple[str, bytes]]]) -> DataFrame:
    """path, content of the files that make() yields for the values of each row, in batches of about MOST bytes: a worker holds
    the rows that came at once and few of their files."""

    def run(batches):
        paths, contents, held = [], [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                for path, content in make(*(v.as_py() for v in row)):
                    paths.append(path)
                    contents.append(content)
                    held += len(path) + len(content)
                    if held > MOST:
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                        paths, contents, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function under its name, with SQL that gives the same rows."""

        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
