"""Packing in order: state that streams over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_packs(df: DataFrame, keys: list[str], order: list[str], size: str, gap: str | None, joins: str | None, limit: int, out: str, ordered: bool = False) -> DataFrame:
    """Adds the number, from 1 in each key, of the pack that a row falls into: a row joins the pack before it if `joins` allows it and the
    pack's size, a gap and its own size stay within the limit; else it begins a new one. A row above the limit is a pack of its own.
    Rows of a key are in one partition in order and pass through one at a time: neither a key nor a partition is ever held whole. ordered: rows come
    straight from a window by these keys in this order, so they need no second shuffle and sort."""
    columns = df.columns
    at = {c: columns.index(c) for c in [*keys, size, *([gap] if gap else []), *([joins] if joins else [])]}
    rows = df if ordered else df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pack, held = None, 0, 0
        for batch in batches:
            key = list(zip(*(batch.column(at[k]).to_pylist() for k in keys)))
            sizes = batch.column(at[size]).to_pylist()
            gaps = batch.column(at[gap]).to_pylist() if gap else [0] * len(sizes)
            may = batch.column(at[joins]).to_pylist() if joins else [True] * len(sizes)
            numbers = np.empty(len(sizes), np.int32)
            for i, (k, n, g, ok) in enumerate(zip(key, sizes, gaps, may)):
                if k != last:
                    last, pack, held = k, 1, n
                elif ok and held + g + n <= limit:
                    held += g + n
                else:
                    pack, held = pack + 1, n
                numbers[i] = pack
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*columns, out])

    return rows.mapInArrow(run, df.withColumn(out, F.lit(0)).schema)


def with_state(df: DataFrame, keys: list[str], order: list[Column], reads: list[str], start: Callable[[], object], step: Callable, out: str, kind: pa.DataType) -> DataFrame:
    """Adds step(state, *values of reads) for each row, in order within its key; a key begins with start(). As in with_packs, rows of a key
    are in one partition in order and pass through one batch at a time, so only the state is held."""
    columns = df.columns
    at = {c: columns.index(c) for c in [*keys, *reads]}
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            own = zip(*(batch.column(at[k]).to_pylist() for k in keys))
            values = zip(*(batch.column(at[c]).to_pylist() for c in reads))
            made = []
            for key, row in zip(own, values):
                if state is None or key != last:
                    last, state = key, start()
                made.append(step(state, *row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*columns, out])

    like = {pa.bool_(): F.lit(True), pa.int64(): F.lit(0).cast("bigint")}[kind]
    return rows.mapInArrow(run, df.withColumn(out, like).schema)
