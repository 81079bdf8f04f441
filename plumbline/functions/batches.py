"""Arrow batches of bounded size for passes whose Python objects are many times their texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS, SIZE = 128, 1 << 20


def small(batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int = SIZE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes (a row is never cut).

    Spark sends up to 10,000 rows at a time; what Python makes of them at once would grow with the input until that cap.
    """
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
