"""Models that a user supplies: embedders, classifiers, scorers and judges, behind one surface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Model = Callable[[list], list]

#: Arrow types of the values that models give.
VALUES = {"double": pa.float64(), "array<float>": pa.list_(pa.float32()), "map<string,double>": pa.map_(pa.string(), pa.float64())}


def filled(model: Model) -> Model:
    """``model``, with null texts given to it as empty ones."""
    return lambda texts: model(["" if t is None else t for t in texts])


def answers(model: Model, inputs: list, value: pa.DataType) -> pa.Array:
    """What ``model`` gives for ``inputs``, as Arrow; raises if that is another number of values or of another type."""
    got = [[*x.items()] if isinstance(x, dict) else x for x in model(inputs)]
    if len(got) != len(inputs):
        raise ValueError(f"the model gave {len(got)} values for {len(inputs)} rows")
    return pa.array(got, value)


def guarded(model: Model, inputs: list, value: pa.DataType, strict: bool) -> tuple[pa.Array, list[str | None]]:
    """(values, errors) of a batch. If it fails its rows are tried one by one, so only those that fail themselves have an error; ``strict`` raises instead."""
    try:
        return answers(model, inputs, value), [None] * len(inputs)
    except Exception as failed:  # a user's model may fail in any way; the rows say so
        if strict:
            raise
        if len(inputs) == 1:
            return pa.nulls(1, value), [str(failed) or type(failed).__name__]
    parts = [guarded(model, [x], value, strict) for x in inputs]
    return pa.concat_arrays([v for v, _ in parts]), [e for _, errors in parts for e in errors]


def predict(rows: DataFrame, make: Callable[[], Model], inputs: list[str], name: str, kind: str, batch_size: int = 16, strict: bool = False) -> DataFrame:
    """Adds ``name``, of the SQL type ``kind``, and ``error``.

    ``make`` is called once a task and gives the model, which is called with lists of at most ``batch_size`` inputs and gives as many values. An
    input is the value of the one column in ``inputs``, or a tuple of several. Nulls reach the model as None. A row that fails has a null value and
    the failure's text; with ``strict`` the job fails. Other columns pass as they are, in Arrow; an empty table gives an empty one. ``rows`` must have
    neither ``name`` nor ``error``.
    """
    if clash := {name, "error"} & {*rows.columns}:
        raise ValueError(f"the rows have columns {sorted(clash)} already")
    value, names = VALUES[kind], [*rows.columns, name, "error"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{name}` {kind}", "error string"])
    at = [rows.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            for k in range(0, batch.num_rows, batch_size):
                part = batch.slice(k, batch_size)
                own = [part.column(i).to_pylist() for i in at]
                values, errors = guarded(model, own[0] if len(own) == 1 else [*zip(*own, strict=True)], value, strict)
                yield pa.RecordBatch.from_arrays([*part.columns, values, pa.array(errors, pa.string())], names=names)

    return rows.mapInArrow(run, schema)
