"""A user's model as a node: batches of rows in, batches of results out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

Batches = Iterator[pa.RecordBatch]


def predict(df: DataFrame, model: Callable[[Batches], Batches], schema: str, columns: Sequence[str] | None = None, batch_rows: int = 0, load: Callable[[], object] | None = None) -> DataFrame:
    """What ``model`` yields for the ``columns`` of ``df`` (all, if None), as rows of ``schema``.

    The model gets an iterator of Arrow batches of at most ``batch_rows`` rows (0: as they come)
    and may yield any batches for them, so it can keep several in flight, or drop and add rows. Where
    ``load`` is given it is called once for each task, in the executor, and its result is the
    model's first argument. Each task sees its own partition; nothing is shuffled."""

    def run(batches: Batches) -> Batches:
        parts = (b.slice(at, batch_rows) for b in batches for at in range(0, b.num_rows, batch_rows)) if batch_rows else batches
        yield from model(load(), parts) if load else model(parts)

    return (df.select(*columns) if columns is not None else df).mapInArrow(run, schema)


def predict_rows(df: DataFrame, model: Callable[[dict[str, pa.Array]], dict[str, pa.Array]], added: str, inputs: Sequence[str], batch_rows: int = 0) -> DataFrame:
    """``df`` with the columns ``added`` (as DDL), which ``model`` makes of the columns ``inputs``, a
    batch at a time, one value for each row."""
    names = [f.split()[0].strip("`") for f in added.split(",")]

    def each(batches: Batches) -> Batches:
        for b in batches:
            made = model({c: b.column(c) for c in inputs})
            yield pa.RecordBatch.from_arrays([*b.columns, *(made[n] for n in names)], [*b.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return predict(df, each, f"{schema}, {added}", batch_rows=batch_rows)
