"""Ordered folds over rows of a key that may be any number: sorted partitions are read row by row and a state is carried on, whatever batches they come in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows that are sent at once.
SENT = 4096


def fold(rows: DataFrame, keys: list[str], order: list[str], schema: str, begin: Callable[[], object], step: Callable[[object, dict], Iterable[tuple]], end: Callable[[object], Iterable[tuple]] = lambda state: ()) -> DataFrame:
    """A fold over each key's rows in ``order``: ``begin()`` gives a key's state, ``step(state, row)`` changes it and yields rows, ``end(state)`` yields the last ones.

    Results are the keys and what is yielded; ``schema`` has both. Rows of one key pass through one task, sorted on disk as
    need be; memory holds a batch, the state and ``SENT`` results. No rows give no rows, null keys are a key.
    """
    target: pa.Schema = to_arrow_schema(_parse_datatype_string(schema))

    def sent(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, found = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != now:
                    if state is not None:
                        found += [(*now, *r) for r in end(state)]
                    now, state = key, begin()
                found += [(*key, *r) for r in step(state, row)]
                if len(found) >= SENT:
                    yield sent(found)
                    found = []
        if state is not None:
            found += [(*now, *r) for r in end(state)]
        yield sent(found)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
