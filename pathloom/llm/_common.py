"""Reading of tables and Arrow helpers that the operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.scratch import clear as clear_scratch, discard, numbered, root as scratch_root, spread_join, stored

__all__ = ["batch_of", "clear_scratch", "discard", "give_back", "numbered", "pieces", "row_hashes", "scratch_root", "spread_join", "stored", "table", "tidy"]

#: Bytes of text that a kernel turns into arrays at once; a longer text is one piece of its own.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hashes(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that tell rows apart by all their columns; what holds a map, which has no hash, counts as its JSON."""
    names = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*names), F.xxhash64(F.lit(1), *names)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES):
    """Slices of a batch whose texts in `column` have about `limit` bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Returns the memory that arrays no longer use to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(kernel):
    """The kernel, giving the memory that it has used back to the system at its end: workers live on between stages."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
