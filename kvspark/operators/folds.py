"""Ordered folds: rows of each key in order, in Arrow batches, with a small state that goes from row to row.

A key's rows come sorted to one task, which reads them batch by batch and holds one state; so memory does
not grow with a key's rows, and a task takes many keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: str, order: list[str], fresh: Callable[[], object], step: Callable[[object, dict], tuple], names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """Rows with new columns: ``step(state, columns)`` takes a batch's rows of one key and gives a list for each of ``names``; ``fresh`` makes a key's first state."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, begun = None, None, False
        for batch in batches:
            keys = batch.column(key).to_pylist()
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            out: list[list] = [[] for _ in names]
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if not begun or keys[at] != here:
                    here, state, begun = keys[at], fresh(), True
                for whole, part in zip(out, step(state, {c: v[at:to] for c, v in columns.items()}), strict=True):
                    whole.extend(part)
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], [*batch.schema.names, *names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
