"""Rows that are sorted by a key, as batches of many whole groups: Python takes one step for many small groups at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _new(column: pa.ChunkedArray) -> np.ndarray:
    """Which rows differ from the one before."""
    x = column.combine_chunks()
    a, b = x.slice(1), x.slice(0, max(len(x) - 1, 0))
    differs = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(x.type):  # Spark groups NaN as one value
        differs = pc.and_not(differs, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where each group begins) of rows that are sorted by their keys. Of earlier batches only the last group is held."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        joint = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table]) if held else table
        new = np.zeros(joint.num_rows - 1, bool)
        for k in keys:
            new |= _new(joint.column(k))
        # places of this batch where a group begins, as its rows count
        begins = np.flatnonzero(new) + (0 if held else 1)
        if not len(begins):
            held.append(table)
            continue
        last = int(begins[-1])
        before = sum(t.num_rows for t in held)
        whole = pa.concat_tables([*held, table.slice(0, last)]).combine_chunks()
        yield whole, np.append(0, begins[:-1] + before)
        held = [table.slice(last)]
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.zeros(1, np.int64)
