"""What the operators of this subpackage share: code on executors, the shared folder, reading tables, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
_PLACES = 1 << 24
_ROOT = str(Path(__file__).resolve().parents[2])


def on_executors(module: str, name: str, *args, mb: int = 8) -> Callable:
    """A function for mapInArrow that calls loomcert.llm.<module>.<name>(batches, *args) where it runs.

    It is pickled by value and imports by name, so that what a module keeps (tables, models) stays for a worker's later tasks. Batches come
    in slices of about `mb` MB, and what is free after each goes back to the system, since a worker stays for many stages.
    """
    root, module = _ROOT, f"loomcert.llm.{module}"

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        util = importlib.import_module("loomcert.llm.util")
        yield from getattr(importlib.import_module(module), name)(util.sliced(batches, mb << 20), *args)
        util.give_back()

    return run


def sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, len(batch) * size // max(batch.nbytes, 1))
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
        give_back()


def give_back() -> None:
    """Returns free memory to the system where the C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomcert-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _delete_at_exit(spark, folder)
    return f"{folder.rstrip('/')}/loomcert-{spark.sparkContext.applicationId}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.deleteOnExit(place)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: this cuts its lineage, and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for t in tables:
        system, place = _place(t.sparkSession, t.stored_at)
        system.delete(place, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or the name with as many underscores in front as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def thinned(wanted: int, n: Column) -> Column:
    """Whether a row's hash `h` is among the least share of hashes that holds `wanted` of about n different ones with near certainty, and about twice as many."""
    return F.pmod(F.xxhash64("h"), F.lit(_PLACES)) < F.lit((2.0 * wanted + 50) * _PLACES) / F.greatest(n, F.lit(1))


def utf8(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes | None]:
    """A string column's values as bytes, without making Python strings."""
    values = batch.column(batch.schema.get_field_index(column))
    return (v.as_py() for v in values.cast(pa.large_string()).cast(pa.large_binary()))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def to_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
