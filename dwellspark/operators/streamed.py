"""Work on whole keys of few rows each, many of them in one call."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that a task gathers before it works on their keys, about.
ROWS = 65_536


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The first row of each key in rows that lie by key; nulls are a key like any other, and so is NaN."""
    n = len(table)
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for k in keys:
        c = table.column(k)
        a, b = c.slice(1), c.slice(0, n - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(c.type):
            other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        fresh[1:] |= np.asarray(other, dtype=bool)
    return np.flatnonzero(fresh)


def by_key(df: DataFrame, keys: Sequence[str], schema: str, work: Callable[[pa.Table, np.ndarray], dict]) -> DataFrame:
    """keys and further columns (schema) of each key, null ones too. Rows are dealt out and sorted by key (of plain types), and read in that order; work has the rows of many whole keys
    and where each starts, and returns of (the number of the key, for each row made) and the further columns. A task holds ROWS rows and those of one key."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = work(table, starts)
            own = table.select(names).take(pa.array(starts[found.pop("of")]))
            for name, values in found.items():
                own = own.append_column(name, pa.array(values))
            yield from own.combine_chunks().to_batches()

        held, n, limit = [], 0, ROWS
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n < limit:
                continue
            table = pa.concat_tables(held)
            starts = _starts(table, names)
            if len(starts) > 1:
                yield from made(table.slice(0, starts[-1]), starts[:-1])
            rest = table.slice(starts[-1])
            # A long key is gathered until it has doubled, not copied with each batch.
            held, n, limit = [rest], len(rest), max(ROWS, 2 * len(rest))
        if n:
            table = pa.concat_tables(held)
            yield from made(table, _starts(table, names))

    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{own}, {schema}")
