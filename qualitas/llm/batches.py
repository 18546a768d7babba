"""Arrow helpers for functions given to ``mapInArrow``: rows in, bounded record batches out."""
from __future__ import annotations

import pyarrow as pa

#: Output batches are closed at this many rows or bytes, so a task's memory does not follow its input.
BATCH_ROWS = 2_000
BATCH_BYTES = 8_000_000


class Rows:
    """Collects output rows and hands them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.columns = [[] for _ in schema]
        self.bytes = 0

    def add(self, *values) -> pa.RecordBatch | None:
        """Add a row; returns a batch when one is full."""
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
            if isinstance(value, (str, bytes)):
                self.bytes += len(value)
        return self.close() if len(self.columns[0]) >= BATCH_ROWS or self.bytes >= BATCH_BYTES else None

    def close(self) -> pa.RecordBatch | None:
        """What has been collected so far, or None if nothing has."""
        if not self.columns[0]:
            return None
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns, self.bytes = [[] for _ in self.schema], 0
        return batch


def flat_map(batches, schema: pa.Schema, rows_of):
    """Yield the batches made of ``rows_of(row)`` for each input row (a tuple in column order)."""
    out = Rows(schema)
    for batch in batches:
        step = max(1, min(BATCH_ROWS, batch.num_rows))
        for start in range(0, batch.num_rows, step):          # Python objects of a slice at a time
            part = batch.slice(start, step)
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for made in rows_of(*row):
                    full = out.add(*made)
                    if full is not None:
                        yield full
    rest = out.close()
    if rest is not None:
        yield rest
