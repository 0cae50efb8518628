"""Grouped work over sorted rows, without one Python call's overhead per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_sorted_group(df: DataFrame, key: str, each: Callable[[pa.Table], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``each`` on all rows of every value of the integer column ``key``.

    Rows are dealt by the key and sorted, and groups are cut out of the Arrow
    stream, one in memory at a time.  The caller bounds the size of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if open_ and (last := open_[-1]).column(last.schema.get_field_index(key))[-1].as_py() != int(k[lo]):
                    yield from each(pa.Table.from_batches(open_).combine_chunks())
                    open_ = []
                open_.append(b.slice(lo, hi - lo))
        if open_:
            yield from each(pa.Table.from_batches(open_).combine_chunks())

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)
