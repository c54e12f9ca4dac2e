"""Folds over a key's rows in order, as sorted runs: a task reads its keys batch by batch and holds one key's state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def folded(df: DataFrame, keys: list[str], order: list[str], columns: list[str], new: list[T.StructField], begin: Callable[[], Any], step: Callable[..., tuple[Any, tuple]]) -> DataFrame:
    """df with the new fields: step(state, *values of columns) gives the next state and the row's new values.

    The state begins anew with each key; null keys are one key. Order needs a tie-breaker to be repeatable. A key goes
    through one task, which holds no more of it than a batch and the state.
    """
    out = T.StructType([*df.schema.fields, *new])
    names, types = out.names, [to_arrow_type(f.dataType) for f in new]
    at, of = [df.columns.index(c) for c in columns], [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: Any = None
        for b in batches:
            made: list[tuple] = []
            inputs = zip(*(b.column(i).to_pylist() for i in at), strict=True)
            for key, values in zip(zip(*(b.column(i).to_pylist() for i in of), strict=True), inputs, strict=True):
                if key != now or now is None:
                    now, state = key, begin()
                state, row = step(state, *values)
                made.append(row)
            cols = list(zip(*made, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)

