"""A queryable model catalog, its defaults, and exemplars by k-means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SCHEMA = "ord int, model_name string, alias string, task string, hardware array<string>, zoo_url string, device_type string, metadata map<string,string>"


def load(spark: SparkSession, config: str | dict) -> DataFrame:
    """A catalog from YAML text, a path to a YAML file, or a dict {models: {name: {...}}, defaults}."""
    if isinstance(config, str):
        import yaml

        text = config if "\n" in config else "\n".join(r.value for r in spark.read.text(config, wholetext=True).collect())
        config = yaml.safe_load(text)
    if not isinstance(config, dict) or not isinstance(config.get("models"), dict):
        raise ValueError("a catalog needs a table of models")
    rows = []
    for k, (name, m) in enumerate(config["models"].items()):
        if not isinstance(m, dict) or not m.get("task") or not m.get("hardware"):
            raise ValueError(f"model {name} needs a task and hardware")
        hardware = m["hardware"] if isinstance(m["hardware"], list) else [m["hardware"]]
        rows.append((k, name, m.get("alias"), m["task"], hardware, m.get("zoo_url"), m.get("device_type"), {a: str(b) for a, b in (m.get("metadata") or {}).items()}))
    return with_defaults(spark.createDataFrame(rows, SCHEMA), config.get("defaults") or {})


def with_defaults(df: DataFrame, defaults: dict | None = None, overrides: dict | None = None) -> DataFrame:
    """Settings by precedence: overrides, then defaults, then the entry; metadata of the entry beat
    the defaults'. The device type comes from the hardware unless it is given."""
    d, o = defaults or {}, overrides or {}

    def pick(name: str) -> Column:
        return F.coalesce(*(F.lit(x[name]) for x in (o, d) if x.get(name) is not None), F.col(name))

    device = F.coalesce(pick("device_type"), F.concat_ws(",", "hardware"))
    metadata = F.col("metadata")
    if d.get("metadata"):
        base = F.create_map(*(x for k, v in d["metadata"].items() for x in (F.lit(k), F.lit(str(v)))))
        metadata = F.map_from_entries(F.concat(F.filter(F.map_entries(base), lambda e: ~F.map_contains_key("metadata", e["key"])), F.map_entries("metadata")))
    return df.withColumns({"zoo_url": pick("zoo_url"), "device_type": device, "metadata": metadata})


def models(df: DataFrame, task: str | None = None, hardware: str | None = None, alias: str | None = None, metadata: dict | None = None, where: Column | None = None) -> DataFrame:
    """Entries by task, alias, one of their hardware kinds, metadata values, and any predicate."""
    for name, value in (("task", task), ("alias", alias)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if hardware is not None:
        df = df.where(F.array_contains("hardware", hardware))
    for k, v in (metadata or {}).items():
        df = df.where(F.col("metadata")[k] == str(v))
    return df if where is None else df.where(where)


def best(df: DataFrame, by: str | None = None, largest: bool = True) -> DataFrame:
    """The first entry, or that of the greatest (least) numeric metadata ``by``; ties by order."""
    if by is None:
        return df.orderBy("ord").limit(1)
    v = F.col("metadata")[by].cast("double")
    return df.where(v.isNotNull()).orderBy(v.desc() if largest else v.asc(), "ord").limit(1)


def distinct_values(df: DataFrame, what: str) -> DataFrame:
    """Sorted distinct tasks, aliases, or hardware kinds."""
    c = F.explode("hardware") if what == "hardware" else F.col(what)
    return df.select(c.alias("value")).where("value is not null").distinct().orderBy("value")


@dataclass(frozen=True)
class ModelSpec:
    """One model's address: a full URL, or a name with a zoo and a host."""

    model_name: str | None = None
    zoo_url: str | None = None
    host: str = "@cloud"
    model_url: str | None = None

    def __post_init__(self):
        if self.model_url and self.model_name:
            raise ValueError("give a URL or a name, not both")
        if self.model_url:
            zoo, _, name = self.model_url.rpartition("/")
            object.__setattr__(self, "zoo_url", zoo)
            object.__setattr__(self, "model_name", name)
        if not self.model_name or not self.zoo_url or not self.host:
            raise ValueError("a name, a zoo and a host are needed")


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def assign_centroids(df: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec: str = "v") -> DataFrame:
    """(…, cluster, d2): the nearest of a few fixed centroids (cluster, c); ties to the lowest
    number. Centroids are k rows, sent as one literal-sized broadcast."""
    packed = F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("__cs")))
    best_ = F.array_min(F.transform("__cs", lambda k: F.struct(distance2(F.col(vec), k["c"]).alias("d2"), k["cluster"].alias("cluster"))))
    return df.crossJoin(packed).withColumn("__b", best_).withColumns({"cluster": F.col("__b.cluster"), "d2": F.col("__b.d2")}).drop("__b", "__cs")


def exemplars(assigned: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The real member nearest to each centroid; empty clusters give no row."""
    return assigned.groupBy("cluster").agg(F.min(F.struct("d2", id_col)).alias("b"), F.count(F.lit(1)).alias("n")).select("cluster", f"b.{id_col}", "n", "b.d2")


def cluster_sums(vectors: DataFrame, centroids, k: int) -> DataFrame:
    """``(cluster, n, s)``: number and sum of the vectors nearest to each of the broadcast
    centroids. A task sends one row a cluster; rows are added in the tasks' order."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        c = centroids.value
        n, s = np.zeros(k, dtype=np.int64), np.zeros(c.shape)
        step = max(1, 4_000_000 // max(c.size, 1))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), dtype=float)
            for at in range(0, len(x), step):
                part = x[at : at + step]
                own = ((part[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
                n += np.bincount(own, minlength=k)
                np.add.at(s, own, part)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(some), pa.int64()), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.float64()))], ["cluster", "part", "n", "s"])

    def add(t):
        t = t.sort_by("part")
        return pa.table({"cluster": t.column("cluster").slice(0, 1), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "s": pa.array([np.array(t.column("s").to_pylist()).sum(axis=0).tolist()], pa.list_(pa.float64()))})

    return vectors.mapInArrow(run, "cluster long, part long, n long, s array<double>").groupBy("cluster").applyInArrow(add, "cluster long, n long, s array<double>")


def kmeans_exemplars(df: DataFrame, k: int = 0, id_col: str = "vec_id", vec: str = "v", rounds: int = 20, seed: int = 1, fit_rows: int = 20_000, seeds: list[list[float]] | None = None) -> DataFrame:
    """k-means and its exemplars: k 0 means one cluster per 25 vectors, 3 at least. Centroids start
    at ``seeds``, or else are seeded by k-means++ on a sample of ``fit_rows`` vectors, or k if that
    is more (the first by hash of the id); every vector moves them and is assigned. An empty
    cluster stays where it is, and has no exemplar."""
    import numpy as np

    spark = df.sparkSession
    vectors = df.select(id_col, F.col(vec).cast("array<double>").alias(vec)).persist()
    if seeds is not None:
        c = np.array(seeds, dtype=float)
        k = len(c)
    else:
        n = vectors.count()
        k = min(k or int(max(3, n / 25)), n)
        rows = vectors.orderBy(F.xxhash64(id_col), id_col).limit(max(fit_rows, k)).collect()
        c = seed_centroids(np.array([r[1] for r in rows], dtype=float), k, seed)
    for _ in range(rounds if k else 0):
        sent = spark.sparkContext.broadcast(c)
        new = c.copy()
        for r in cluster_sums(vectors.select(vec), sent, k).collect():
            new[r.cluster] = np.array(r.s) / r.n
        sent.destroy()
        if np.allclose(new, c, rtol=1e-12, atol=1e-12):
            break
        c = new
    vectors.unpersist()
    return exemplars(nearest_of(df.where(F.col(vec).isNotNull()), c, id_col, vec), id_col)


def seed_centroids(x, k: int, seed: int):
    """k-means++: each next centroid is drawn by its squared distance to those there are."""
    import numpy as np

    rng = np.random.default_rng(seed)
    if k >= len(x):
        return x
    c = np.empty((k, x.shape[1]))
    c[0] = x[int(rng.integers(len(x)))]
    d = ((x - c[0]) ** 2).sum(axis=1)
    for j in range(1, k):
        c[j] = x[int(rng.choice(len(x), p=d / d.sum()))] if d.sum() > 0 else x[j]
        d = np.minimum(d, ((x - c[j]) ** 2).sum(axis=1))
    return c


def nearest_of(df: DataFrame, centroids, id_col: str = "vec_id", vec: str = "v") -> DataFrame:
    """(id, cluster, d2) by Arrow batches, a part of the distances at a time, so that many centroids
    are no wider a row than few; they are sent to each executor once."""
    import numpy as np
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = sent.value
        step = max(1, 4_000_000 // max(c.size, 1))
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=float).reshape(b.num_rows, -1)
            at, d2 = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            for k in range(0, len(x) if len(c) else 0, step):
                d = ((x[k : k + step, None, :] - c[None, :, :]) ** 2).sum(axis=2)
                at[k : k + step] = d.argmin(axis=1)
                d2[k : k + step] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at), pa.array(d2)], [id_col, "cluster", "d2"])

    return df.select(id_col, F.col(vec).cast("array<double>")).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, cluster int, d2 double")


def rank_by(df: DataFrame, metric: Column, keys: list[str], k: int, tie: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(metric.desc(), tie))).where(F.col("rank") <= k)
