"""Mergeable validators: every validator of a table in one pass, however rows are spread."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Validator:
    """A fold over a segment's rows that may be done in pieces.

    ``update(state, rows)`` takes a batch of rows in order, ``merge(a, b)`` joins
    the states of neighbouring stretches, the earlier first, and ``finish(state)``
    gives the status.  States are small: they do not grow with the rows.
    """

    init: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], str]


#: What became of a validator so far: whether it is sound, and its state, or the fault of one that raised.
Outcome = tuple[bool, Any]


def _guarded(call: Callable, *states: Outcome, rows: tuple = ()) -> Outcome:
    failed = next((s for s in states if not s[0]), None)
    if failed is not None:
        return failed
    try:
        return True, call(*(s[1] for s in states), *rows)
    except Exception as failure:  # a validator's own fault becomes a row
        return False, str(failure)


def map_segments(
    rows: DataFrame, validators: Mapping[str, Validator], keys: Sequence[str] = ("file_id", "segment_id"), order: str | None = None
) -> DataFrame:
    """``keys, module, status, error`` of every segment and validator; a failing validator yields CRASHED.

    Rows are ranged by ``keys`` and ``order``, so a segment of any size is spread
    evenly over parts.  Each part is read once and folded for all validators at a
    time; the states of segments that cross the border of a part are merged in a
    second, small step.  Without ``order`` rows come in any order.  Null keys are
    keys; rows without a segment give none.
    """
    names, keys = list(validators), list(keys)
    ranged = rows.repartitionByRange(*[F.col(k) for k in keys], *([F.col(order)] if order else [F.rand(17)]))
    ranged = ranged.sortWithinPartitions(*keys, *([order] if order else []))
    kinds = [f for f in rows.schema.fields if f.name in keys]
    kinds = sorted(kinds, key=lambda f: keys.index(f.name))
    schema = T.StructType([*kinds, T.StructField("part", T.IntegerType()), T.StructField("states", T.BinaryType())])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, states = None, {}

        def done() -> pa.RecordBatch:
            columns = [*(pa.array([v], t) for v, t in zip(current, key_types)), pa.array([part], pa.int32()), pa.array([cloudpickle.dumps(states)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "part", "states"])

        for batch in batches:
            key_types = [batch.schema.field(k).type for k in keys]
            values = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            frame, start = batch.to_pandas(), 0
            while start < len(values):
                stop = start + 1
                while stop < len(values) and values[stop] == values[start]:
                    stop += 1
                if values[start] != current:
                    if current is not None:
                        yield done()
                    current, states = values[start], {n: _guarded(validators[n].init) for n in names}
                stretch = frame.iloc[start:stop]
                states = {n: _guarded(validators[n].update, states[n], rows=(stretch,)) for n in names}
                start = stop
        if current is not None:
            yield done()

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pd.concat(batches).sort_values("part")
        states = None
        for blob in pieces["states"]:
            own = cloudpickle.loads(blob)
            states = own if states is None else {n: _guarded(validators[n].merge, states[n], own[n]) for n in names}
        first = pieces[keys].head(1)
        ends = {n: _guarded(validators[n].finish, states[n]) for n in names}
        out = first.loc[first.index.repeat(len(names))].reset_index(drop=True)
        out["module"] = names
        out["status"] = [ends[n][1] if ends[n][0] else "CRASHED" for n in names]
        out["error"] = [None if ends[n][0] else ends[n][1] for n in names]
        yield out

    pieces = ranged.mapInArrow(folded, schema)
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", module string, status string, error string"
    merged.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    # A segment has a row for each part it lies in, whose numbers keep their order.
    return pieces.groupBy(*keys).applyInPandas(merged, whole)
