"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lispmill.sources.shared import shared_dir

#: Rows or bytes (whichever comes first) that a Python stage gathers before it hands a batch on.
OUT_ROWS = 4096
OUT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: the lineage ends in files every executor can read."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def trim() -> None:
    """Gives memory that a task has freed back to the machine: workers live on, and what they hold adds up over stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def values(column: pa.Array) -> Iterator:
    """Python values one at a time, so that a batch is never held twice."""
    for x in column:
        yield x.as_py()


def raw(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, or a binary column as it is."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return values(column)


def arrow_schema(spec: str) -> pa.Schema:
    """pa.Schema of a flat DDL string such as ``doc_id long, text string``."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
        "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()),
    }
    pairs = [x.strip().rsplit(" ", 1) for x in spec.split(",")]
    return pa.schema([(n.strip(), kinds[k.strip()]) for n, k in pairs])


def map_rows(df: DataFrame, columns: list[str], rows: Callable[[Iterator[tuple]], Iterable[tuple]], spec: str, text_as_bytes: bool = True) -> DataFrame:
    """``rows`` turns a partition's tuples into output tuples, over Arrow batches of bounded size."""
    schema = arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for b in batches:
                cols = []
                for i in range(b.num_columns):
                    c = b.column(i)
                    is_text = pa.types.is_string(c.type) or pa.types.is_large_string(c.type)
                    cols.append(raw(c) if text_as_bytes and is_text else values(c))
                yield from zip(*cols, strict=True)

        out: list[tuple] = []
        size = 0
        for r in rows(tuples()):
            out.append(r)
            size += sum(len(v) for v in r if isinstance(v, (bytes, str)))
            if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                yield to_batch(out, schema)
                out, size = [], 0
        if out:
            yield to_batch(out, schema)
        out.clear()
        trim()

    return df.select(*columns).mapInArrow(run, spec)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def bucket_of(column: str, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus``; null ids count as never held out (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))
