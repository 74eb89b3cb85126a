"""What the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, ship

#: Tells the rows of a staged table apart, whatever their doc_id; and holds their other columns.
ROW, REST = "__row", "__rest"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_rows(docs: DataFrame, label: str) -> DataFrame:
    """``ROW``, doc_id, text and, if there are more, the other columns in the struct ``REST``, written once.

    Every later read sees the same keys, and no other column can clash with those of an operator.
    """
    rest = [quoted(c) for c in docs.columns if c not in ("doc_id", "text")]
    return materialize(docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", "text", *([F.struct(*rest).alias(REST)] if rest else [])), label)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def restored(name: str) -> Column:
    """A column of the documents behind :func:`with_rows`."""
    return F.col(name if name in ("doc_id", "text") else f"{REST}.{quoted(name)}").alias(name)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, setup: Callable | None = None) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``setup`` runs once a task and its value goes first to ``fn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            if batch.num_rows and (out := fn(*state, batch)) is not None:
                yield out
            del batch
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker lives on, idle, beside the stages that don't need it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def blocks(values: list, size: int) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]
