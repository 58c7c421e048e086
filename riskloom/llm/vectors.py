"""Vector columns: which take part, and as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def _clean(kind: str):
    item = np.dtype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column("vec")
            some = pc.fill_null(pc.greater(pc.list_value_length(vecs), 0), False)
            ids, vecs = b.column("vec_id").filter(some), vecs.filter(some)
            dims = pc.list_value_length(vecs).to_numpy()
            flat = vecs.flatten().to_numpy(zero_copy_only=False)  # a null component is NaN here
            if len(dims):
                with np.errstate(over="ignore"):
                    square = np.add.reduceat(flat * flat, np.cumsum(dims) - dims)
                keep = np.isfinite(square) & (square > 0)
                ids, flat, dims = ids.filter(pa.array(keep)), flat[np.repeat(keep, dims)], dims[keep]
            ends = np.concatenate([[0], np.cumsum(dims, dtype=np.int32) * item.itemsize]).astype(np.int32)
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(dims), [
                None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat, item))])
            yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), raw], names=["vec_id", "dim", "vec"])
    return run


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", as_given: bool = False) -> DataFrame:
    """(vec_id long, dim int, vec binary of doubles) of the rows that take part.

    Left out: null ids, and vectors that are null, empty, zero, or hold null
    or non-finite components (or are so large that their square overflows).
    ``as_given``: components that are floats in ``df`` stay floats.
    """
    given = df.schema[vec_col].dataType
    kind = "<f4" if as_given and isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.where("vec_id is not null").mapInArrow(_clean(kind), "vec_id long, dim int, vec binary")


def matrix(raw, dim: int) -> np.ndarray:
    """Vectors of one length as rows; of floats or doubles, as their bytes tell."""
    if isinstance(raw, pa.BinaryArray):
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
        joined = raw.buffers()[2][int(ends[0]):int(ends[-1])]
    else:
        joined = b"".join(raw)
    return np.frombuffer(joined, f"<f{len(joined) // max(1, len(raw) * dim) or 8}").reshape(-1, dim)
