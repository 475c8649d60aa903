"""The registered queries over the media roles of the tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelframe.queries import fields, files, samples, streams, timelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**timelines.QUERIES, **samples.QUERIES, **fields.QUERIES, **files.QUERIES, **streams.QUERIES}
ORACLE_SQL: dict[str, str] = {**timelines.ORACLE_SQL, **samples.ORACLE_SQL, **fields.ORACLE_SQL, **files.ORACLE_SQL, **streams.ORACLE_SQL}
