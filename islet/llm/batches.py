"""Arrow batches cut into slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time inside a Python worker.
SLICE_BYTES = 2 << 20


def text_slices(batch: pa.RecordBatch, column: str | pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes of ``column`` (a name, or texts as long as the batch) each; a longer value stands alone."""
    text = batch.column(batch.schema.get_field_index(column)) if isinstance(column, str) else column
    if isinstance(text, pa.StringViewArray) or not len(text):
        if len(text):
            yield batch
        return
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    ends = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
