"""Ordered folds as streams: the rows of a key pass by in order, and only the state of the key at hand is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


def fold_sorted(rows: DataFrame, keys: list[str], by: list[str | Column], inputs: list[str], make: Callable[[], Callable[..., tuple]], outputs: str, dealt: bool = False) -> DataFrame:
    """rows with the columns of outputs added. make() gives a function for each key, which gets the row's inputs and returns its outputs.

    A key's rows are one task's, in order of `by`; memory does not grow with them, time does linearly. dealt: the rows come straight
    from a window over the same keys, so that they need not be dealt by them again. Without keys all rows are one task's. Null keys
    are a key. An empty table gives none.
    """
    extra = _parse_datatype_string(outputs)
    schema = StructType([*rows.schema.fields, *extra.fields])
    key_at, input_at = ([rows.columns.index(c) for c in names] for names in (keys, inputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(extra)
        last, step = None, None
        for batch in batches:
            made = []
            named = zip(*[batch.column(i).to_pylist() for i in key_at]) if key_at else iter(lambda: (), None)
            for key, values in zip(named, zip(*[batch.column(i).to_pylist() for i in input_at])):
                if step is None or key != last:
                    last, step = key, make()
                made.append(step(*values))
            new = [pa.array([m[i] for m in made], kind.type) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f.name for f in schema.fields])

    spread = rows if dealt else rows.repartition(*keys) if keys else rows.repartition(1)
    return spread.sortWithinPartitions(*keys, *by).mapInArrow(run, schema)
