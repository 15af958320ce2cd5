"""Arrow batch functions: over arrays of structs, one array a row, many rows a batch, and over rows in
order, of which only a batch is in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string


def per_list(f: Callable[..., Sequence[list]], kind: str):
    """A column function over columns of arrays. ``f`` gets a row's arrays as lists of values, one
    list for each field of the structs, and gives a list for each field of ``kind``, the DDL of a
    result's fields. Fields stay columns of numbers throughout: no object is made for a struct."""
    fields = _parse_datatype_string(kind)
    assert isinstance(fields, StructType)
    types = [to_arrow_type(x.dataType) for x in fields]

    @F.arrow_udf(ArrayType(fields))
    def run(*arrays: pa.Array) -> pa.Array:
        cols, cuts = [], []
        for a in arrays:
            values = a.values
            at = a.offsets.to_pylist()
            null = [not v for v in a.is_valid().to_pylist()]
            cuts.append([(0, 0) if n else (s, e) for s, e, n in zip(at, at[1:], null)])
            cols.append([c.to_pylist() for c in values.flatten()] if pa.types.is_struct(values.type) else [values.to_pylist()])
        out: list[list] = [[] for _ in types]
        ends = [0]
        for each in zip(*cuts):
            for o, made in zip(out, f(*(c[s:e] for (s, e), own in zip(each, cols) for c in own))):
                o += made
            ends.append(len(out[0]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(o, t) for o, t in zip(out, types)], fields.names))

    return run


def floats(t: pa.Table, *names: str) -> np.ndarray:
    """Columns of numbers as a matrix, null as NaN."""
    return np.stack([t.column(c).cast(pa.float64()).to_numpy() for c in names], axis=1).copy()


def _edges(t: pa.Table, keys: Sequence[str]) -> list[int]:
    """Rows, but the first, that differ from the row before in one of ``keys``; null equals null."""
    new = np.zeros(max(0, t.num_rows - 1), dtype=bool)
    for k in keys:
        code = t.column(k).combine_chunks().dictionary_encode("encode")
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return (np.flatnonzero(new) + 1).tolist()


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], make: Callable, schema: str | StructType, whole: Sequence[str] = (), dealt: Sequence[str] = ()) -> DataFrame:
    """The rows of each of ``keys`` in ``order``, gone through by what ``make`` gives for a task: a
    function of some rows, a table, and of the places in it at which other keys begin, that yields
    record batches. Rows come sorted out of the shuffle, so those of a key are never together in
    memory; those that agree in ``whole`` too are never apart. ``dealt``: keys by which the table is
    dealt out already, some of ``keys``."""
    unit = [*keys, *whole]

    def parts(batches):
        rest = []
        for b in batches:
            if not whole:
                yield pa.Table.from_batches([b])
                continue
            t = pa.Table.from_batches([*rest, b])
            at = _edges(t, unit)
            if at:
                yield t.slice(0, at[-1])
            rest = t.slice(at[-1] if at else 0).to_batches()
        if rest:
            yield pa.Table.from_batches(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, last = make(), None
        for t in parts(batches):
            if not t.num_rows:
                continue
            ends = [t.select(list(keys)).slice(k, 1) for k in (0, t.num_rows - 1)]
            new = last is None or bool(_edges(pa.concat_tables([last, ends[0]]), keys))
            last = ends[1]
            yield from walk(t, [*([0] if new else []), *_edges(t, keys)])

    return (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
