"""What several operators share: reading, shared-folder storage and connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are Python objects at a time.
STEP = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, text: int = 1) -> Iterator[list[tuple]]:
    """The batch's rows as lists of tuples, STEP at a time, the texts as UTF-8 bytes."""
    for at in range(0, batch.num_rows, STEP):
        part = batch.slice(at, STEP)
        yield list(zip(*(c.cast(pa.binary()).to_pylist() if k == text else c.to_pylist() for k, c in enumerate(part.columns))))
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Where that is unset, a folder in the
    warehouse in local mode, where there are no other executors, and an error elsewhere."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir"):
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """What is stored inside is deleted at the end, unless it is taken off the list given."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        for df in made:
            discard(df)


def store(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage in a way
    that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``store`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A name for an inner column that no column of ``df`` has."""
    name = f"__{name}"
    while name in df.columns:
        name += "_"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, list[str], DataFrame | None]:
    """``docs`` with two longs that tell every row from every other and are the same each time it is
    read, their names, and what has been stored for that.

    Rows selected from Parquet files have their file and their place in it; anything else is
    stored first."""
    plan, stored = docs._jdf.queryExecution().analyzed(), None
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "parquet" not in plan.toString():
        docs = stored = store(docs, "rows")
    names = [fresh(docs, "file"), fresh(docs, "row")]
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names, stored


def _smallest(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links ``(u, v)`` as links from each node to the smallest node that it reaches in the
    batches, ``least`` links and more at a time."""

    def solve(parts: list[np.ndarray]) -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate(parts), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        to = np.arange(len(nodes))
        while True:
            low = np.minimum(to[a], to[b])
            new = to.copy()
            np.minimum.at(new, to[a], low)
            np.minimum.at(new, to[b], low)
            new = new[new]
            if (new == to).all():
                break
            to = new
        some = np.flatnonzero(to != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[to[some]])], ["u", "v"])

    parts, n = [], 0
    for b in batches:
        parts.append(np.stack([c.to_numpy() for c in b.columns], axis=1).ravel())
        n += b.num_rows
        if n >= least:
            yield solve(parts)
            parts, n = [], 0
    if n:
        yield solve(parts)


def connected_components(edges: DataFrame, max_rounds: int = 60, local: int = 2_000_000) -> DataFrame:
    """Components of the graph with the links ``(a, b)`` of longs: ``(node, component)`` for each
    node that has a link to another node, ``component`` being the smallest node reachable.

    Each task first joins what its own links join, ``local`` links at a time. Then come alternating
    large-star and small-star rounds (Kiveris et al., 2014). Each star step is a minimum with
    map-side combining and one join, so a node with very many links is never gathered in one
    task. Rounds end when the links no longer change, or when ``local`` links at most are left,
    which one task joins."""
    shrink = lambda df: df.mapInArrow(lambda batches: _smallest(batches, local), "u long, v long")
    e = store(shrink(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))), "cc")
    seen = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= local or now == seen:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(low, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = store(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "cc")
        discard(e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if now[0] <= local:
        new = store(shrink(e.coalesce(1)), "cc")
        discard(e)
        e = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._stored_at = e._stored_at
    return out
