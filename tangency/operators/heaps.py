"""The first k rows of each group without sorting a group.

A task holds the best k rows it has met of each group, as heaps would, and
sends only those; where the parts of a group meet, the same is done again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _codes(rows: pa.Table, groups: Sequence[str]) -> np.ndarray:
    """A number per row, the same for rows of one group; nulls are a value."""
    codes = np.zeros(rows.num_rows, np.int64)
    for name in groups:
        found = rows.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes * max(1, len(found.dictionary)) + found.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    return codes


def _best(rows: pa.Table, groups: Sequence[str], order: Sequence[tuple[str, bool]], k: int) -> tuple[pa.Table, np.ndarray]:
    """The first ``k`` rows of each group, group by group, and their places from 1; of equal rows the earlier ones."""
    columns = [np.arange(rows.num_rows)]
    for name, down in reversed(order):
        column = rows.column(name)
        void = pc.is_null(column).to_numpy()
        values = pc.fill_null(column, 0).to_numpy()
        odd = np.isnan(values) if values.dtype.kind == "f" else np.zeros(len(values), bool)
        values = np.where(odd, 0, values)
        columns += [-values, ~odd, void] if down else [values, odd, ~void]
    codes = _codes(rows, groups)
    at = np.lexsort([*columns, codes])
    start = np.flatnonzero(np.r_[True, codes[at][1:] != codes[at][:-1]]) if len(at) else np.zeros(0, np.int64)
    nth = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    return rows.take(pa.array(at[nth < k])), nth[nth < k] + 1


def first_rows(rows: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]], k: int, held: int = 100_000) -> DataFrame:
    """At most ``k`` rows per group, the first by ``order``, (column of numbers, descending) each, with rn from 1.

    ``order`` should tell all rows of a group apart; of rows equal in it the
    earlier ones of a task win. NaN is above all numbers, nulls below, as Spark
    sorts; null group keys are a group of their own. A task holds ``k`` rows per
    group that it has met and passes them on when they are over ``held``;
    after the shuffle a group is at most ``k`` rows of each task, and goes
    through in batches too.
    """

    def run(last: bool, schema: pa.Schema):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, place = None, np.zeros(0, np.int64)
            for batch in batches:
                both = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
                kept, place = _best(both, groups, order, k)
                # Where all of a group meets, it is known only when the last batch is through.
                if not last and len(place) > held:
                    yield from kept.cast(schema).to_batches()
                    kept = None
            if kept is not None:
                kept = kept.append_column("rn", pa.array(place)) if last else kept
                yield from kept.cast(schema).to_batches()

        return task

    own = to_arrow_schema(rows.schema)
    parts = rows.mapInArrow(run(False, own), rows.schema)
    out = T.StructType([*rows.schema.fields, T.StructField("rn", T.LongType())])
    return parts.repartition(*groups).mapInArrow(run(True, to_arrow_schema(out)), out)
