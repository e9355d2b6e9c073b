"""Small helpers that the operators share: Arrow batches in and out, staging, and combined keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path, stage

__all__ = ["blocks", "code_bytes", "combine", "fresh", "map_batches", "scratch_path", "stage", "texts_only"]

# Python steps work on this many bytes of text at once (a longer text is a block by itself), so their
# memory depends on neither the batch size nor the number of rows.
BLOCK_BYTES = 1 << 20


def texts_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), whatever other columns there are."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened where ``df`` has such a column already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def map_batches(df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """mapInArrow for functions that yield a dict of arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(k).type) for k, v in out.items()]
            made = pa.RecordBatch.from_arrays([a.cast(arrow.field(k).type) for k, a in zip(out, arrays)], names=list(out))
            yield made.select(arrow.names)

    return df.mapInArrow(run, schema)


def code_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the offsets of its rows in them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES):
    """Yields (batch, first row, last row, bytes, offsets): rows of up to ``limit`` bytes of text."""
    for batch in batches:
        data, offsets = code_bytes(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, len(batch)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch, i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def combine(keys: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Map-side combine of equal keys before a shuffle that looks for repeated keys.

    A row whose key repeats within the chunk is known to be repeated: it travels under ``spread`` (any
    evenly dealt number) with weight 2, and one row without content carries its key, also with weight 2.
    Other rows travel under their key with weight 1. A key is repeated where its weights sum to 2 or more,
    and no key reaches the shuffle more than once per chunk, however hot it is.

    Returns the rows' keys, their weights, and the keys that need a row without content."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    repeated = np.zeros(len(k), bool)
    repeated[order] = same
    return np.where(repeated, spread, keys), np.where(repeated, 2, 1).astype(np.int8), np.unique(k[same])
