"""Sequential work within blocks: many short blocks run through one Python task, one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..shipping import ship


def whole_blocks(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that no block crosses, from batches whose rows stand block by block."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        if held and found[-1] == key:
            held.append(batch)
            continue
        last = len(found) - 1
        while last and found[last - 1] == found[-1]:
            last -= 1
        done = [*held, batch.slice(0, last)]
        if held or last:
            yield pa.Table.from_batches(done)
        held, key = [batch.slice(last)], found[-1]
    if held:
        yield pa.Table.from_batches(held)


def spans(rows: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    """First row and end of each block of a table."""
    found = list(zip(*[rows.column(k).to_pylist() for k in keys], strict=True))
    start = 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i] != found[start]:
            yield start, i
            start = i


def in_blocks(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """``run`` over tables of whole blocks, ordered within each; a block's rows meet in one task.

    A call for each block would cost more than the work where blocks are short and many.
    """
    ship(rows.sparkSession)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches, keys):
            yield from run(table).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)
